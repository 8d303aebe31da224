"""Plug-in recognisers: a model that finds entities joins the masking of a text.

A recogniser is made once per worker by a factory and called with batches of texts; it returns for each
(type, start, end, confidence) tuples. None is on by default.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import let, weave
from .entities import normal_person, resolve

Entity = tuple[str, int, int, float]
Recogniser = Callable[[list[str]], list[list[Entity]]]
LEAST_CONFIDENCE = 0.5
# What recognised types become.
PLACEHOLDERS = {"COURT": "[审理法院]", "ADDRESS": "[地址]", "PERSON": "[当事人]", "COMPANY": "[公司]"}
SCHEMA = "array<struct<type:string,text:string,start:int,end:int,confidence:double>>"


def pattern_recogniser(patterns: dict[str, str], confidence: float = 1.0) -> Callable[[], Recogniser]:
    """A recogniser of patterns by type, for tests and for rules that columns can't express."""

    def make() -> Recogniser:
        compiled = {k: re.compile(p) for k, p in patterns.items()}
        return lambda texts: [[(k, *m.span(), confidence) for k, p in compiled.items() for m in p.finditer(t)] for t in texts]

    return make


def spacy_recogniser(model: str = "zh_core_web_trf") -> Callable[[], Recogniser]:
    """A recogniser of a spaCy pipeline; the library is needed where it runs only."""
    kinds = {"PERSON": "PERSON", "ORG": "COMPANY", "GPE": "ADDRESS", "LOC": "ADDRESS", "FAC": "ADDRESS"}

    def make() -> Recogniser:
        import spacy

        pipeline = spacy.load(model)
        return lambda texts: [[(kinds[e.label_], e.start_char, e.end_char, 0.85) for e in doc.ents if e.label_ in kinds] for doc in pipeline.pipe(texts)]

    return make


def transformers_recogniser(model: str) -> Callable[[], Recogniser]:
    """A recogniser of a token classifier; the library is needed where it runs only."""
    kinds = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "COMPANY", "LOC": "ADDRESS", "GPE": "ADDRESS"}

    def make() -> Recogniser:
        from transformers import pipeline

        tag = pipeline("token-classification", model=model, aggregation_strategy="simple")
        return lambda texts: [[(kinds[e["entity_group"]], e["start"], e["end"], float(e["score"])) for e in found if e["entity_group"] in kinds] for found in tag(texts)]

    return make


def reply_recogniser(ask: Callable[[str], str], confidence: float = 0.8) -> Callable[[], Recogniser]:
    """A recogniser of a model's replies: ``ask`` gives JSON, a list of objects with type and text, for a text.

    Every place of a named text counts; what the text doesn't hold is left out, and so is a reply that is no such list.
    """

    def make() -> Recogniser:
        import json

        def one(text: str) -> list[Entity]:
            try:
                named = [(str(x["type"]), str(x["text"])) for x in json.loads(ask(text))]
            except (ValueError, KeyError, TypeError):
                return []
            return [(kind, m.start(), m.end(), confidence) for kind, value in dict.fromkeys(named) if value for m in re.finditer(re.escape(value), text)]

        return lambda texts: [one(t) for t in texts]

    return make


def only(factory: Callable[[], Recogniser], types: tuple[str, ...]) -> Callable[[], Recogniser]:
    """A recogniser's entities of some types."""

    def make() -> Recogniser:
        inner = factory()
        return lambda texts: [[e for e in found if e[0] in types] for found in inner(texts)]

    return make


def recognise(df: DataFrame, factory: Callable[[], Recogniser], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Id, text and entities of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            texts = [t or "" for t in b["text"]]
            b["entities"] = [[{"type": k, "text": t[s:e], "start": s, "end": e, "confidence": float(c)} for k, s, e, c in found] for t, found in zip(texts, model(texts), strict=True)]
            yield b

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInPandas(run, f"{id_col} {kind}, text string, entities {SCHEMA}")


def kept(entities):
    """Sure entities without brackets: the surest of each span, then leftmost ones that overlap none before."""
    good = F.filter(entities, lambda e: (e["confidence"] >= LEAST_CONFIDENCE) & ~e["text"].rlike(r"[\[\]]") & e["type"].isin(*PLACEHOLDERS))
    ordered = F.array_sort(F.transform(good, lambda e: F.struct(e["start"], (-e["confidence"]).alias("c"), (-e["end"]).alias("e"), e["type"], e["text"])))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,c:double,e:int,type:string,text:string>>").alias("out"))
    return F.aggregate(ordered, start, lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(F.struct((-x["e"]).alias("at"), F.concat(acc["out"], F.array(x)).alias("out"))), lambda acc: acc["out"])


def mask_entities(recognised: DataFrame) -> DataFrame:
    """Adds ``masked`` with the kept entities replaced; people and companies are numbered and linked as in masking."""
    shown = F.create_map(*(F.lit(x) for pair in PLACEHOLDERS.items() for x in pair))
    named = {"PERSON": True, "COMPANY": False}

    def placed(found: Column) -> Column:
        names = F.filter(F.transform(found, lambda x, i: F.struct(F.lit(0).alias("rule"), i.alias("ord"), (x["type"] == "PERSON").alias("person"), normal_person(x["text"]).alias("canonical"), F.lit("").alias("role"), x["type"].alias("type"))), lambda x: x["type"].isin(*named))

        def woven(known: Column) -> Column:
            values = F.transform(found, lambda x, i: F.coalesce(F.get(F.filter(known, lambda n: n["ord"] == i), 0)["placeholder"], F.element_at(shown, x["type"])))
            end = lambda i: F.coalesce(-F.get(found, i)["e"], F.lit(0))
            gap = F.transform(F.sequence(F.lit(0), F.size(found)), lambda i: F.substring("text", end(i - 1) + 1, F.coalesce(F.get(found, i)["start"], F.length("text")) - end(i - 1)))
            return weave(gap, values)

        return let(resolve(names), woven)

    return recognised.withColumn("masked", let(kept(F.col("entities")), placed))
