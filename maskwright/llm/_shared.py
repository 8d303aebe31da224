"""Helpers that several corpus operators use: shared storage and column handling."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for cut lineages.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and all runs in one process,
    as in tests, a folder of this machine is set instead; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(configured)
        return configured
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="maskwright-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder; later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """As ``cut``, by a Parquet table in the shared folder.

    Reads take only the columns they need. A checkpoint keeps the planner's estimate of its size, and
    in iterated joins such estimates are products of products: numbers that fill a driver after a few rounds.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers live on, and share an executor with a JVM."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Rows of an Arrow batch where the session leaves Spark's default of ten thousand. Batches lie outside
#: the heap, several copies of them, and texts are long.
BATCH_ROWS = 1000
_ROWS_KEY, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def bounded_batches(spark: SparkSession) -> None:
    if spark.conf.get(_ROWS_KEY, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))
