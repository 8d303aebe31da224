"""Precision and recall of masking against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import OPEN
from ..functions.synthetic import LEAST_HAN, SLOTS
from ..functions.text import leaks
from .entities import by_role_word
from .masking import CODES


def run_cases(cases: DataFrame) -> DataFrame:
    """A row for each expectation of each masked case, with ``ok``.

    ``cases`` has id, masked, mapping and the arrays expect_masked and expect_kept of struct<type, value>
    and expect_absent of strings. A value to be masked must be in the mapping or gone, and no piece of
    it may survive; a kept one must stand in the text and not in the mapping.
    """
    mapped = F.transform("mapping", lambda m: m["original"])
    base = cases.withColumn("_mapped", mapped)
    item = lambda kind, col: base.select("id", "masked", "_mapped", F.lit(kind).alias("kind"), F.explode_outer(col).alias("x")).where("x IS NOT NULL")
    masked = item("masked", "expect_masked").select("id", "kind", F.col("x.type").alias("type"), F.col("x.value").alias("value"), ((F.array_contains("_mapped", F.col("x.value")) | ~F.contains("masked", "x.value")) & ~leaks(F.col("masked"), F.col("x.value"))).alias("ok"))
    kept = item("kept", "expect_kept").select("id", "kind", F.coalesce("x.type", F.lit("保留项")).alias("type"), F.col("x.value").alias("value"), (F.contains("masked", "x.value") & ~F.array_contains("_mapped", F.col("x.value"))).alias("ok"))
    absent = item("absent", "expect_absent").select("id", "kind", F.lit("泄露检查").alias("type"), F.col("x").alias("value"), (~F.contains("masked", "x")).alias("ok"))
    return masked.unionByName(kept).unionByName(absent)


def scores(checks: DataFrame) -> DataFrame:
    """TP, FP, FN, precision, recall, F1 and support by type, and for all types together (MICRO).

    A missed value counts as FN of its type, a wrongly masked one as FP.
    """
    counts = checks.where("kind IN ('masked', 'kept')").rollup("type").agg(
        F.count_if((F.col("kind") == "masked") & F.col("ok")).alias("tp"),
        F.count_if((F.col("kind") == "kept") & ~F.col("ok")).alias("fp"),
        F.count_if((F.col("kind") == "masked") & ~F.col("ok")).alias("fn"),
    )
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    p = counts.select(F.coalesce("type", F.lit("MICRO")).alias("type"), "tp", "fp", "fn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), (F.col("tp") + F.col("fn")).alias("support"))
    both = F.col("precision") + F.col("recall")
    return p.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def macro_f1(table: DataFrame) -> DataFrame:
    return table.where("type <> 'MICRO'").agg(F.avg("f1").alias("macro_f1"))


def template_faults(template: Column) -> Column:
    """Why a template is refused: no slot, slots that no generator fills, a name outside of slots, too little Han text."""
    slots = F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))
    bare = F.regexp_replace(template, r"\{\w+\}", "。")
    return F.filter(
        F.array(
            F.when(F.size(slots) == 0, "no slot"),
            F.when(F.size(F.array_except(slots, F.array(*map(F.lit, SLOTS)))) > 0, "unknown slot"),
            F.when(F.contains(by_role_word(bare, CODES), F.lit(OPEN)), "name"),
            F.when(F.length(F.regexp_replace(template, "[^一-龥]", "")) < LEAST_HAN, "not Han"),
        ),
        lambda x: x.isNotNull(),
    )
