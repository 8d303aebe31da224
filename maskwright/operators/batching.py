"""Resumable batches: what is left to do, whether inputs changed, and the report over a run log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(files: DataFrame, log: DataFrame, path_col: str = "path") -> DataFrame:
    """Files that no run has finished."""
    return files.join(log.where("status = 'done'").select(path_col).distinct(), path_col, "left_anti")


def fingerprint(files: DataFrame, content_col: str = "content", path_col: str = "path") -> DataFrame:
    return files.select(path_col, F.octet_length(content_col).cast("long").alias("size"), F.sha2(F.col(content_col).cast("binary"), 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame, path_col: str = "path") -> DataFrame:
    """Paths whose size or digest differs, or that are on one side only."""
    a, b = before.alias("a"), after.alias("b")
    same = F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.sha256").eqNullSafe(F.col("b.sha256"))
    return a.join(b, F.col(f"a.{path_col}") == F.col(f"b.{path_col}"), "full").where(~same).select(F.coalesce(f"a.{path_col}", f"b.{path_col}").alias(path_col))


def report(log: DataFrame) -> DataFrame:
    """Files, replacements and failures by status."""
    return log.groupBy("status").agg(F.count("*").alias("files"), F.sum("replaced").alias("replaced"))


def masked_names(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds ``masked_name``: the path with its file's name masked; folder and extension stay."""
    from .masking import mask

    folder, rest = F.regexp_extract(path_col, r"^(.*/)?", 0), F.regexp_extract(path_col, r"([^/]*)$", 1)
    stem, ext = F.regexp_extract(rest, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(rest, r"^.+?(\.[^.]*)$", 1)
    out = mask(files.withColumn("_stem", stem), "_stem").withColumn("masked_name", F.concat(folder, "masked", ext))
    return out.select(*files.columns, "masked_name")


def needs_review(log: DataFrame, tiers: DataFrame, path_col: str = "path") -> DataFrame:
    """A row for each file that someone must look at: failed, or with critical residues, or both."""
    told = log.join(tiers.select(path_col, "n_critical"), path_col, "left")
    reasons = F.filter(F.array(F.when(F.col("status") != "done", "failed"), F.when(F.col("n_critical") > 0, "critical")), lambda x: x.isNotNull())
    return told.withColumn("reasons", reasons).where(F.size("reasons") > 0).select(path_col, "reasons")


def warnings(values: Column) -> Column:
    """Warning values without repeats, sorted."""
    return F.array_sort(F.array_distinct(values))


def safe_names(files: DataFrame, name_col: str = "masked_name", id_col: str = "doc_id") -> DataFrame:
    """Output names that stay apart where masked names coincide."""
    stem, ext = F.regexp_extract(name_col, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name_col, r"(\.[^.]*)$", 1)
    return files.withColumn("output", F.concat(stem, F.lit("_"), F.col(id_col).cast("string"), F.when(F.lower(ext).isin(".pdf", ".png", ".jpg", ".jpeg"), ".txt").otherwise(ext)))


def run(spark, source: str, target: str, log_path: str, text_col: str = "text", path_col: str = "path") -> DataFrame:
    """Mask what earlier runs haven't finished, append results and a log row for each, and return the log.

    Source, target and log are Parquet tables. A run writes into a folder of its own and logs it last, so a
    run that dies leaves inputs that are pending again and results that no log row names; ``results`` reads the named ones.
    """
    from .masking import mask

    files = spark.read.parquet(source)
    schema = f"{path_col} string, status string, replaced long, run string"
    try:
        log = spark.read.schema(schema).parquet(log_path)
    except Exception as e:  # the first run has no log yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log = spark.createDataFrame([], schema)
    todo, run_id = pending(files, log, path_col), uuid.uuid4().hex
    mask(todo, text_col).drop(text_col, "names").write.parquet(f"{target}/run={run_id}")
    done = spark.read.parquet(f"{target}/run={run_id}").dropDuplicates([path_col])
    done.select(path_col, F.lit("done").alias("status"), F.size("mapping").cast("long").alias("replaced"), F.lit(run_id).alias("run")).write.mode("append").parquet(log_path)
    return spark.read.schema(schema).parquet(log_path)


def results(spark, target: str, log_path: str, path_col: str = "path") -> DataFrame:
    """Results of finished runs, a row a path."""
    logged = spark.read.parquet(log_path).where("status = 'done'").select(path_col, "run")
    return spark.read.parquet(target).join(logged, [path_col, "run"], "left_semi").dropDuplicates([path_col]).drop("run")
