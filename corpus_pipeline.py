"""The corpus pipeline: language ID, quality rules, near-dedup, PII and packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. A stage works on all that its predecessor kept.

Defined results: a null or empty text has no language and goes in the first stage; a null id is kept as a
document of its own, which near-dedup links with nothing; null languages teach nothing. Texts are taken
whole, however long. Of near duplicates the smallest id stays, of repeated rows one. An empty table gives
an empty result. Other columns, whatever their names, pass through to the last stage, which drops them.
"""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import langid, neardup, packing, pii, quality
from maskwright.llm._shared import cut, documents

#: Predictions below this times a guess among the learned languages are no language for sure; among four it is 0.3.
LEAST_OVER_GUESS = 1.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that look like none of the learned languages.

    Where no row teaches a language nothing can be judged, and all documents with letters stay.
    """
    model = langid.train(docs, ~langid.held_out())
    if not model.languages:
        warnings.warn("no row teaches a language: all documents with letters stay", stacklevel=2)
        return docs.where(F.col("text").rlike(r"\p{L}"))
    least = min(1.0, LEAST_OVER_GUESS / len(model.languages))
    seen = langid.predict(docs, model, names=("_mw_lang", "_mw_score"))
    return seen.where((F.col("_mw_lang") != langid.UNDEFINED) & (F.col("_mw_score") >= least)).select(*docs.columns)


def line_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail, and removes failed lines from those that stay."""
    return _counted(quality.clean(docs, replace_text=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return neardup.deduplicate(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks."""
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language", language),
    ("line_quality", line_quality),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: Trained models, hashes and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage reads several times is cut before it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        if name in ("near_dedup", "personal_data"):
            docs = cut(docs)
        docs = stage(spark, docs, sf_dir)
    return docs
