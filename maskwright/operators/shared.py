"""One identity for a person over a whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import written


def people(masked: DataFrame, order_col: str = "doc_id") -> DataFrame:
    """name, number, role, roles_seen and documents of all people, numbered by first appearance.

    Mentions are reduced to a row a name before anything is ordered; numbers then come from a sort by
    ranges and the sizes of its partitions, so no task sees all names.
    """
    rows = masked.select(order_col, F.posexplode_outer("mapping").alias("at", "m"), "names").where("m IS NOT NULL AND m.type = '人名'")
    named = rows.select(
        order_col, "at", F.regexp_replace("m.original", "[ \t]", "").alias("name"),
        F.get(F.filter("names", lambda n: n["ord"] == F.col("at")), 0)["role"].alias("role"),
    )
    place = F.struct(F.col(order_col), F.col("at"))
    per = named.groupBy("name").agg(
        F.min(place).alias("first"),
        F.min_by(F.when(F.col("role") != "", F.col("role")), F.when(F.col("role") != "", place)).alias("role"),
        F.array_sort(F.collect_set(F.when(F.col("role") != "", F.col("role")))).alias("roles_seen"),
        F.count_distinct(order_col).alias("documents"),
    )
    dealt = per.repartitionByRange("first", "name").withColumn("_part", F.spark_partition_id())
    ranked = written(dealt)  # written, so a row's partition stays what it was
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("first", "name"))
    return ranked.join(F.broadcast(starts), "_part").withColumn("number", F.col("_start") + within).drop("first", "_part", "_start")
