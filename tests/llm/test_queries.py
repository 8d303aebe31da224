"""The registered queries, their SQL, and the pipeline's stages."""

import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import langid, neardup, pii, quality, registry


def rows(frame: pd.DataFrame) -> list[tuple]:
    plain = lambda v: "" if v is None or v is pd.NA or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "embeddings", "conversations"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = c.execute(registry.ORACLE_SQL[name]).df()
        assert rows(got[sorted(want.columns)]) == rows(want) and sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0


def test_entry_names_all_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline"} | set(registry.QUERIES) <= names
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 11))


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "pack":
            assert docs.columns == before.columns
        if name == "line_quality":
            verdict = {r.doc_id: r.kept for r in quality.measure(before).select("doc_id", "quality.kept").collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, kept in verdict.items() if kept}
        if name == "near_dedup":
            assert docs.count() == neardup.near_duplicates(before, 5, 80).where("kept").count() and neardup.near_duplicates(docs, 5, 80).where("NOT kept").count() == 0
        if name == "personal_data":
            assert docs.count() == before.count() and pii.find(docs).where("exists(spans, s -> s.kind IN ('email', 'card', 'phone', 'ip'))").count() == 0
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert docs.select("doc_id").distinct().count() == before.count()


def test_language_without_labels_keeps_texts_with_letters(spark):
    rows = [(1, "a few words"), (2, "123 456"), (3, None), (4, "слова")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    with pytest.warns(UserWarning):
        assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 4]


def test_language_score_follows_the_number_of_languages(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a few words", "en")], "doc_id long, text string, lang string")
    for score, languages, kept in ((0.2, 10, 1), (0.1, 10, 0), (0.55, 2, 0), (1.0, 1, 1), (0.3, 4, 1)):
        monkeypatch.setattr(langid, "train", lambda *a, n=languages: type("Model", (), {"languages": ("en",) * n}))
        monkeypatch.setattr(langid, "predict", lambda d, m, names, s=score: d.withColumn(names[0], F.lit("en")).withColumn(names[1], F.lit(s)))
        assert corpus_pipeline.language(spark, docs, "").count() == kept


def test_pipeline_keeps_odd_rows_out_without_failing(spark, tmp_path):
    rows = [(1, None, "en", None, None), (None, "w. " * 80, None, "s", 1), (2, "", "en", "s", 0), (3, " ".join(f"word{i}, again." for i in range(60)), "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {3, None} and 3 in {r.doc_id for r in out}
    assert langid.UNDEFINED == "und"


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    with pytest.warns(UserWarning):
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_clashing_columns_and_repeated_rows(spark, tmp_path):
    text = lambda i: "\n".join(" ".join(f"{chr(97 + (i * 7 + j * 3 + m) % 26)}{(i * 31 + j * 17 + m * m) % 997}x" for m in range(9)) + ", so." for j in range(9))
    rows = [(i, text(i), "en", "a", "b", "c") for i in range(30)] + [(3, text(3), "en", "a", "b", "c")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred string, kept string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "score", "lang_pred", "kept"], name
    assert sorted(r.doc_id for r in docs.collect()) == list(range(30))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(30))
