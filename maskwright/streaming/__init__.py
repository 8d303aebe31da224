"""Masking of streams: a document needs nothing but itself, so the batch chain runs as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.masking import Options, mask


def mask_stream(rows: DataFrame, text_col: str = "text", options: Options = Options()) -> DataFrame:
    """A streaming DataFrame with masked texts and their mappings."""
    return mask(rows, text_col, options)


def mask_new_files(spark: SparkSession, source: str, schema, target: str, checkpoint: str, text_col: str = "text"):
    """Mask the Parquet files that no earlier call has seen, and wait; the checkpoint is the run log."""
    rows = spark.readStream.schema(schema).parquet(source)
    out = mask_stream(rows, text_col).drop(text_col, "normal", "names")
    query = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
