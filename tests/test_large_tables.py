"""Rows that only larger tables hold, against the SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from maskwright import queries, registry
from maskwright.functions import markup
from maskwright.operators import entities, masking, tables
from tests import test_masking
from tests.test_registry import rows

#: A short Latin text, where an address's placeholder alone gave 2 % of Han characters, so that a password was taken for a WeChat id.
DOCUMENTS = [(1, "Erheinin orhe, 28.64.188.47 thon the ndhe password=a83228eea2efca149c ndoning onreth. bfe.18@mail9.example.com"), (2, None), (3, "a@b.com, 13800138000 abc123456")]


def compare(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(folder)).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["audit_counts", "mapping_values", "mask_stats_by_type", "mask_totals", "restore_roundtrip", "value_frequency"])
def test_short_latin_texts(spark, tmp_path, name):
    compare(spark, tmp_path, name, documents=(DOCUMENTS, "doc_id long, text string"))


def test_scan_counts_valid_accounts(spark, tmp_path):
    """Runs of digits in a token: one that fails Luhn, beginning like a year, and one that passes it inside of what looks like a WeChat id."""
    texts = [(1, 'token = "f699e44f19092102589454a79f5d9b63dbf9557a" a@b.com'), (2, "password=a46c79961747285376 x"), (3, None)]
    compare(spark, tmp_path, "scan_documents", documents=(texts, "doc_id long, text string"))


@pytest.mark.parametrize("name", ["eval_macro", "eval_scores"])
def test_evaluation_of_long_keys(spark, tmp_path, name):
    """Keys of six digits and more: what is kept of a case is no piece of what must go."""
    compare(spark, tmp_path, name, customer=([(k,) for k in (7, 99_999, 100_000, 300_001, 899_999, 12_345_678)], "c_custkey long"))


@pytest.mark.parametrize("name", ["long_spans", "more_rules"])
def test_keys_of_one_small_file_are_spread(spark, sf, name):
    """Texts made from a table whose file is a single piece are masked on all cores, not on one."""
    assert registry.QUERIES[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_hold_what_matches_need(spark):
    """No rule matches a text that lacks the characters for which the rule's search is left out; joints are set once."""
    rules = [(r.pattern, r.needs) for r in masking.RULES if r.pattern and r.needs] + list(zip(entities.COMPANIES, entities.COMPANY_NEEDS, strict=True))
    made = [f"{a}1985年1月9日{z}" for a, *_, z, _ in queries.MORE_SENTENCES.values()]
    df = spark.createDataFrame([(t,) for t, _ in test_masking.CASES if t] + [(t,) for t in made], "t string")
    lacks = [F.count_if(F.col("t").rlike(p) & ~markup.holds_any(F.col("t"), needs)) for p, needs in rules]
    meets = [F.count_if(F.col("t").rlike(p)) for p, _ in rules]
    got = df.agg(F.array(*lacks).alias("lacks"), F.array(*meets).alias("meets")).first()
    assert sum(got.lacks) == 0 and sum(n > 0 for n in got.meets) > 20
    once = markup.jointed(F.lit(markup.OPEN + "a" * 5000 + markup.CLOSE))
    assert spark.range(1).select(once.alias("a"), markup.jointed(once).alias("b")).where("a = b").count() == 1


#: Cells of a remark, a column of names, an amount, a date and a column without a kind; equal values stand in several.
CELLS = [("摘要", "附言", "付5000元"), ("户名", "户名", "付5000元"), ("户名", "户名", "王建军"), ("日期", "日期", "34069040"), ("x", None, "34069040"), ("x", None, None)]


def test_equal_cells_are_masked_once(spark, monkeypatch):
    """A value goes through the rules once for each kind of column it stands in, however many cells hold it, by the rules of that kind."""
    seen, plain = spark.sparkContext.accumulator(0), tables.preprocess

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    monkeypatch.setattr(tables, "preprocess", lambda c: plain(counted(c)))
    data = [(doc, row, col, *cell) for doc in range(20) for row in range(5) for col, cell in enumerate(CELLS)]
    df = spark.createDataFrame(data, "doc_id long, row_idx long, col_idx int, header string, col_type string, value string")
    got = tables.mask_table(df).collect()
    want = ["付5000元", "付[金额]", "[当事人_1]", "34069040", "[金额]", ""]
    assert len(got) == len(data) and {(r.col_idx, r.masked) for r in got} == set(enumerate(want))
    assert seen.value == len(CELLS)


def test_names_meet_cells_by_a_merge(spark, sf):
    """Cells that repeat are much larger than their files, by whose size a table of them was broadcast."""
    plan = registry.QUERIES["table_companies"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
