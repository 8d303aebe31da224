"""Secret scanning with character Markov models, in DataFrame functions only.

Base patterns find assignments, access keys and long hexadecimal runs. Beyond them, candidates are
runs of key characters that hold letters and digits; each is scored by two first-order Markov models
over characters, one trained on random strings and one on ordinary identifiers. The log-likelihood
ratio is a sum over neighbouring characters, so one table of ratios is all that a task needs, and its
size is that of the alphabet squared. A run whose mean reaches the threshold is a secret as a whole. In
any other the stretches of neighbouring characters that gain most over the threshold are looked for, so
words joined to a secret don't dilute it; such a stretch is widened to the separators around it.

Offsets are counted natively: a text is split at a pattern's matches, and running sums of the lengths of
the parts and of the matches give each match's place in code points, in time that grows with the text.

Defined results: a null text counts as empty; null ids pass through; repeated rows give equal results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns and the least lengths of what they find.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?[A-Za-z0-9+/_.=-]+"
ASSIGN_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Candidates for the models: runs of key characters, this long at least.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
LEAST_CANDIDATE = 20
#: Mean log-likelihood ratio a character from which a candidate is a secret.
THRESHOLD = 0.3
#: What the ratios of a stretch must sum to beyond the threshold of each, and the fall from its best sum that ends it.
LEAST_GAIN, FALL = 9.0, 8.0
#: Identifiers of this form are random but public.
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
UUID_INSIDE = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])"

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"
#: The alphabet from here on separates words.
SEPARATORS = ALPHABET.index("/")

# Words that ordinary identifiers of code and configuration are made of.
WORDS = (
    "access account action active address admin after agent alias allow amount api app archive array asset async attribute audit auth "
    "balance base batch before binary block body bool branch bucket buffer build byte cache call cancel cart category change channel char "
    "check child class clean clear client clock close cloud cluster code collection color column command comment commit common compare "
    "component config connect console container content context control convert copy core count create cron current custom customer "
    "data database date day debug default delay delete deploy detail device dialog dict digest directory disable disk display document "
    "domain double download driver edit element email empty enable encode end engine entity entry env error event example exception "
    "execute expire export extract factory fail fetch field file filter final find first flag float flow folder font footer force "
    "form format forward frame from function gateway generate get global graph grid group handler hash head header health height hidden "
    "history host hour html http icon id image import index info init inner input insert install instance int integer internal invoice "
    "item iterator job join json key label language last layer layout left length level library license limit line link list listener load "
    "local location lock log login logo loop main manager map mask master match max media member memory menu merge message meta method "
    "metric min minute mode model module monitor month name native network next node normal note null number object offset open option "
    "order origin output owner package page panel param parent parse partition patch path pattern payment pending permission phone pixel "
    "plugin point policy pool port position post prefix preview price primary print private process product profile progress project "
    "property provider proxy public query queue random range rate read record recovery redirect reference refresh region register release "
    "remote remove render repeat replace report repository request reset resource response result retry return review right role root route "
    "row rule run sample save scale schedule schema scope score script search section security segment select send sequence server service "
    "session set setting shape share shard shell short show signal simple size slot snapshot socket sort source space split stack stage start "
    "state static status step stop storage store stream string style submit success suffix summary support switch sync system table tag target "
    "task team template test text theme thread time title to tool top total trace track transaction transform tree trigger type unit update "
    "upload url usage user util valid value variable vector vendor version video view visible volume wait warning watch web weight widget width "
    "window with word worker workflow wrapper write year zone the of and that thing with tion ing ment over"
).split()


def labelled_samples(n: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """Strings labelled 1 (random) or 0 (identifiers), as many of each; the bound is ``n``."""
    draw, out = random.Random(seed), []
    alphabets = (ALPHABET[:62], ALPHABET, ALPHABET[:36], ALPHABET[:10] + ALPHABET[36:62], ALPHABET[:62] + "_-", "0123456789abcdef")
    for i in range(n // 2):
        out.append(("".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(20, 64))), 1))
        parts = [draw.choice(WORDS) for _ in range(draw.randint(3, 9))]
        if draw.random() < 0.4:
            parts.insert(draw.randint(1, len(parts)), str(draw.choice((draw.randint(0, 12), draw.randint(1990, 2035), draw.randint(0, 9)))))
        style = i % 6
        if style == 0:
            text = "_".join(parts)
        elif style == 1:
            text = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif style == 2:
            text = "-".join(parts)
        elif style == 3:
            text = "_".join(parts).upper()
        elif style == 4:
            text = "/".join(parts)
        else:
            text = "".join(parts)
        out.append((text, 0))
    return out


@lru_cache(maxsize=4)
def train(n: int = 4000, seed: int = 11) -> tuple[float, ...]:
    """log P(b|a, random) - log P(b|a, identifier) for all pairs of the alphabet, row by row, smoothed."""
    size = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[0.5] * size for _ in range(size)] for _ in range(2)]
    for text, label in labelled_samples(n, seed):
        for a, b in zip(text, text[1:], strict=False):
            counts[label][at[a]][at[b]] += 1
    return tuple(
        math.log(counts[1][a][b] / sum(counts[1][a])) - math.log(counts[0][a][b] / sum(counts[0][a])) for a in range(size) for b in range(size)
    )


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


#: Numbers whose sums are formed one by one; longer arrays are summed by blocks of so many.
SUM_BLOCK = 32


def running(numbers: Column, levels: int = 4) -> Column:
    """Sums of an array up to each place, its own number included.

    Blocks are summed by themselves, their totals in the same way a level higher, so the work grows in
    proportion for arrays of up to ``SUM_BLOCK`` to the power of ``levels`` plus one, about 33 million.
    """
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, y: acc + y)
    plain = lambda x: F.transform(x, lambda _, i: total(F.slice(x, 1, i + 1)))
    if not levels:
        return plain(numbers)

    def blocked(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / SUM_BLOCK).cast("int")), lambda b: F.slice(x, b * SUM_BLOCK + 1, SUM_BLOCK))

        def joined(parts: Column) -> Column:
            def shifted(before: Column) -> Column:
                return F.flatten(F.transform(parts, lambda part, b: F.transform(part, lambda _, i: F.coalesce(F.get(before, b - 1), F.lit(0)) + total(F.slice(part, 1, i + 1)))))

            return let(running(F.transform(parts, total), levels - 1), shifted)

        return let(blocks, joined)

    return let(numbers, lambda x: F.when(F.size(x) <= SUM_BLOCK, plain(x)).otherwise(blocked(x)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost non-overlapping matches, in code points.

    The text is split at the matches; a match ends where the lengths of all parts and matches up to it sum to.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(found: Column) -> Column:
        def joined(parts: Column) -> Column:
            ends = running(F.transform(found, lambda m, i: (F.length(F.get(parts, i)) + F.length(m)).cast("long")))
            return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).cast("int").alias("start"), e.cast("int").alias("end"), m.alias("value")))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), joined)).otherwise(empty)

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(empty)


def meets(spans: Column, m: Column) -> Column:
    """Whether span ``m`` shares text with one of ``spans``, which are disjoint and in order: a search by halves."""
    first_ending_after = F.aggregate(
        F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int")),
        F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")),
        lambda acc, _: let(
            F.floor((acc["low"] + acc["high"]) / 2).cast("int"),
            lambda mid: F.when(acc["low"] >= acc["high"], acc)
            .when(F.get(spans, mid)["end"] > m["start"], F.struct(acc["low"].alias("low"), mid.alias("high")))
            .otherwise(F.struct((mid + 1).alias("low"), acc["high"].alias("high"))),
        ),
        lambda acc: acc["low"],
    )
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(F.coalesce(F.get(spans, first_ending_after)["start"] < m["end"], F.lit(False)))


def _table(table: tuple[float, ...]) -> Column:
    return F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")


def _place(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c) - 1


def ratio(value: Column, table: tuple[float, ...]) -> Column:
    """Mean log-likelihood ratio a pair of neighbouring characters."""
    size = len(ALPHABET)
    ratios = _table(table)

    def total(codes: Column) -> Column:
        pairs = F.transform(codes, lambda c, i: F.coalesce(F.get(ratios, c * size + F.get(codes, i + 1)), F.lit(0.0)))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)

    return let(F.transform(F.split(value, ""), _place), total) / (F.length(value) - 1)


def stretches(value: Column, table: tuple[float, ...], threshold: float) -> Column:
    """array<struct<start, end, value>> of a run's random stretches, widened to the separators around them.

    One pass over the pairs of neighbours: a stretch begins where the sum of ratios beyond the threshold
    turns positive and reaches to its largest sum; it is over when the sum is used up or falls by ``FALL``.
    Pieces between separators are numbered on the way, and stretches that share one are joined. UUIDs
    inside a run count as separators.
    """
    size, ratios = len(ALPHABET), _table(table)
    blanked = F.regexp_replace(value, UUID_INSIDE, " " * 36)
    none = F.array().cast("array<struct<first:int,last:int>>")

    def pair(codes: Column):
        def gain(c: Column, i: Column) -> Column:
            after = F.get(codes, i + 1)
            known = F.when((c >= 0) & (after >= 0), F.get(ratios, c * size + after) - threshold)
            # the end of the run, like a UUID, ends a stretch
            return F.struct(F.coalesce(known, F.lit(-1e9)).alias("gain"), ((c < 0) | (c >= SEPARATORS)).cast("int").alias("cut"))

        return gain

    def step(acc: Column, x: Column) -> Column:
        piece, total = acc["piece"] + x["cut"], acc["total"] + x["gain"]
        first = F.when(acc["total"] > 0, acc["first"]).otherwise(piece)
        more = total > acc["best"]
        best = F.when(more, total).otherwise(acc["best"])
        last = F.when(more, piece).otherwise(acc["last"])
        over = (total <= 0) | (total < best - FALL)
        out = F.when(over & (best >= LEAST_GAIN), F.concat(acc["out"], F.array(F.struct(first.alias("first"), last.alias("last"))))).otherwise(acc["out"])
        zero = lambda c: F.when(over, F.lit(0.0)).otherwise(c)
        return F.struct(piece.alias("piece"), zero(total).alias("total"), zero(best).alias("best"), first.alias("first"), last.alias("last"), out.alias("out"))

    def found(codes: Column) -> Column:
        start = F.struct(F.lit(0).alias("piece"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), F.lit(0).alias("first"), F.lit(0).alias("last"), none.alias("out"))
        pieces = F.aggregate(F.transform(codes, pair(codes)), start, step, lambda acc: acc["out"])

        def join(acc: Column, x: Column) -> Column:
            end = F.get(acc, F.size(acc) - 1)
            one = lambda first: F.array(F.struct(first.alias("first"), x["last"].alias("last")))
            return F.when(end["last"] >= x["first"], F.concat(F.slice(acc, 1, F.size(acc) - 1), one(end["first"]))).otherwise(F.concat(acc, one(x["first"])))

        # where each piece starts; its end is the separator before the next
        places = F.filter(F.transform(codes, lambda c, i: F.when((c < 0) | (c >= SEPARATORS), i + 1)), lambda i: i.isNotNull())
        starts = F.concat(F.array(F.lit(0)), places, F.array(F.size(codes) + 1))

        def placed(at: Column) -> Column:
            span = lambda s: let(F.struct(F.get(at, s["first"]).alias("start"), (F.get(at, s["last"] + 1) - 1).alias("end")), lambda b: F.struct(b["start"], b["end"], F.substring(value, b["start"] + 1, b["end"] - b["start"]).alias("value")))
            return F.transform(F.aggregate(pieces, none, join), span)

        return let(starts, placed)

    spans = let(F.transform(F.split(blanked, ""), _place), found)
    return F.filter(spans, lambda s: (s["end"] - s["start"] >= LEAST_CANDIDATE) & s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))


def scan(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, table: tuple[float, ...] | None = None, name: str = "secrets") -> DataFrame:
    """Adds ``name``, replacing a column so named: array<struct<start, kind_no, kind, end, value>> by start, then kind as listed.

    A span of the models that lies inside a base span or shares text with one is left out, as it is
    found already; the run's other stretches are still looked for.
    """
    table = table or train()
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = {
        "assign": F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_replace(m["value"], ASSIGN_VALUE, "")) >= LEAST_ASSIGN),
        "access": F.filter(matches(text, ACCESS), lambda m: F.length(m["value"]) >= LEAST_ACCESS),
        # a run of the pattern's characters that is long enough is a whole match, and shorter ones fail anyway
        "hex": matches(text, rf"(?<![0-9a-f])[0-9a-f]{{{LEAST_HEX},}}"),
    }
    runs = F.filter(matches(text, rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z]){CANDIDATE}"), lambda m: ~m["value"].rlike(UUID))
    free = lambda m: ~reduce(lambda x, y: x | y, (meets(F.col(f"_mw_{k}"), m) for k in spans))

    def random_parts(m: Column) -> Column:
        parts = F.transform(stretches(m["value"], table, threshold), lambda s: F.struct((m["start"] + s["start"]).alias("start"), (m["start"] + s["end"]).alias("end"), s["value"].alias("value")))
        return F.when(free(m) & (ratio(m["value"], table) >= threshold), F.array(m)).otherwise(F.filter(parts, free))

    out = docs
    for kind, found in spans.items():
        out = out.withColumn(f"_mw_{kind}", found)
    out = out.withColumn("_mw_random", F.flatten(F.transform(runs, random_parts)))

    def named(kind: str) -> Column:
        return F.transform(f"_mw_{kind}", lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    return out.withColumn(name, F.array_sort(F.concat(*map(named, KINDS)))).drop(*(f"_mw_{k}" for k in KINDS))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every secret replaced by ``[secret:kind]``; of overlapping ones the first counts."""
    found = scan(docs, text_col, name="_mw_secrets")
    step = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.aggregate(
        "_mw_secrets",
        step,
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[secret:"), s["kind"], F.lit("]")).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return found.withColumn(text_col, F.when(F.size("_mw_secrets") > 0, kept).otherwise(F.col(text_col))).drop("_mw_secrets")


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import documents

    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
