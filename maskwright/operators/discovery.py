"""Names without a role word: found by the words around them, or by the form of a transaction's line.

Where a name begins and ends a word segmenter says, which is a plug-in: a factory, called once per
worker, gives a function from texts to lists of words. Without one only lines of transactions are searched.
Everything else is an expression over one row: a row's words are looked at with their neighbours.

Defined results: a null or empty text holds no names; a name is listed once a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import let
from ..plans.catalog import HAN
from .entities import COMPOUND_SURNAMES, NOT_NAMES, ORGANISATION, SURNAMES, plausible, surname_led

Segmenter = Callable[[list[str]], list[list[str]]]

# Characters that stand before or behind a person, and words of transactions.
BEFORE = "向与和给对为被由把将叫欠借还付转签交送收出让起诉告称表示委托指定要求主张员"
AFTER = "欠借贷付还签称诉辩陈述出庭委托支付偿还提交主张认为要求表示答应拒绝承认起诉告到庭"
TRANSACTIONS = "转账|代发|消费|收入|支出|退款|取现|存入|转入|转出"
DATED = r"\d{4}[-/年]\s*\d{1,2}[-/月]\s*\d{1,2}"
LEAST_DIGITS = 8


def dictionary_segmenter(words: list[str]) -> Callable[[], Segmenter]:
    """Words of a list, longest first, and what lies between them as words of its own."""

    def make() -> Segmenter:
        import re

        cut = re.compile("(" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r"|[^一-龥]+)")
        return lambda texts: [[w for w in cut.split(t) if w] for t in texts]

    return make


def words(df: DataFrame, factory: Callable[[], Segmenter], text_col: str = "text", name: str = "words") -> DataFrame:
    """Adds the words of each text."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for b in batches:
            yield pd.Series(model([t or "" for t in b]), index=b.index, dtype=object)

    return df.withColumn(name, split(text_col))


def by_words(text: Column, tokens: Column) -> Column:
    """array<string> of names among a text's words.

    A word, or a surname and the word behind it, counts if a character that goes with people stands next to
    it; longer ones also if the text has them twice. A word that runs into such a character ends before it.
    """
    surname = f"^(?:[{SURNAMES}]|{'|'.join(COMPOUND_SURNAMES)})$"

    def at(t: Column, i: Column) -> Column:
        behind = F.coalesce(F.get(tokens, i + 1), F.lit(""))
        joined = t.rlike(surname) & behind.rlike(f"^[{HAN}]{{1,2}}$") & ~behind.rlike(f"^[{AFTER}]")
        whole = F.when(joined, F.concat(t, behind)).otherwise(F.regexp_replace(t, f"(?<=^[{HAN}]{{2,3}})[{AFTER}]+$", ""))
        after = F.when(joined, F.coalesce(F.get(tokens, i + 2), F.lit(""))).otherwise(F.concat(F.substring(t, F.length(whole) + 1, F.length(t)), behind))
        return F.struct(whole.alias("name"), F.substring(F.coalesce(F.get(tokens, i - 1), F.lit("")), -1, 1).alias("before"), F.substring(after, 1, 4).alias("after"))

    def good(c: Column) -> Column:
        n, compound = F.length(c["name"]), c["name"].rlike(f"^(?:{'|'.join(COMPOUND_SURNAMES)})")
        near = c["before"].rlike(f"^[{BEFORE}]$") | c["after"].rlike(f"^[{AFTER}]")
        often = (F.length(text) - F.length(F.replace(text, c["name"], F.lit("")))) >= 2 * n
        return (
            c["name"].rlike(f"^[{HAN}]+$") & surname_led(c["name"]) & F.when(compound, n.between(3, 4)).otherwise(n.between(2, 3))
            & (near | ((n >= 3) & often)) & plausible(c["name"], c["after"]) & ~F.concat(c["name"], c["after"]).rlike(ORGANISATION) & ~c["after"].rlike("^(?:路|街|巷|号|人民法院|法院)")
        )

    found = F.filter(F.transform(tokens, at), good)
    return F.array_distinct(F.transform(found, lambda c: c["name"]))


def by_transaction(text: Column) -> Column:
    """array<string> of lone names in lines with a date: in front of an account's number, or behind a word for a transaction."""
    lone = f"(?<![{HAN}])([{HAN}]{{2,4}})"
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(DATED))
    before = F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(lone + rf"(?=[\s　]*\d{{{LEAST_DIGITS},}})"), F.lit(1)))
    behind = F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(rf"(?:{TRANSACTIONS})[\s　]+([{HAN}]{{2,4}})(?![{HAN}])"), F.lit(1)))
    return F.array_distinct(F.filter(F.flatten(F.concat(before, behind)), lambda n: surname_led(n) & ~n.isin(*NOT_NAMES) & plausible(n, F.lit(""))))


def discover(df: DataFrame, factory: Callable[[], Segmenter] | None = None, text_col: str = "text", name: str = "found_names") -> DataFrame:
    """Adds the names of each text that no role word introduces."""
    text = F.col(text_col)
    rows = by_transaction(text)
    if factory is None:
        return df.withColumn(name, rows)
    told = words(df, factory, text_col, "_mw_words")
    return told.withColumn(name, F.array_union(rows, let(F.col("_mw_words"), lambda w: by_words(F.coalesce(text, F.lit("")), w)))).drop("_mw_words")
