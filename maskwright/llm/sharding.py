"""Sharding by fixed virtual slots.

Every record is hashed into one of a fixed number of virtual slots, thousands of them whatever the
number of shards. Bytes and rows are aggregated per slot, a table of bounded size, and a versioned
map, stored as a table, gives each slot its shard. The first version deals slots round robin, before any
record is seen. Rebalancing edits the newest version for the loads that were measured and stores the next: it
moves slots, never single records. Records are placed by the map as it is stored.

Defined results: a null text counts no bytes, and its checksum is that of an empty text. A null id is
hashed by its text. Repeated rows are rows of their own with their own positions; their order among
themselves doesn't matter, they are alike. Columns of the input other than id and text are ignored,
so clashing names do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 8192
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map. ``moved`` lists the slots that the last edit moved."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())

    def to_rows(self) -> list[tuple[int, int, int, int]]:
        return [(self.version, self.n_shards, slot, shard) for slot, shard in enumerate(self.shard_of)]


MAP_SCHEMA = "version int, n_shards int, vslot int, shard int"


def store_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append a version of the map to the Parquet table at ``path``; older versions stay readable."""
    spark.createDataFrame(slot_map.to_rows(), MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def has_map(spark: SparkSession, path: str) -> bool:
    """Whether a map is stored at ``path``, on whatever file system that is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The given version of a stored map, or its newest."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).orderBy("vslot").collect()  # one row a slot
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of every row; the texts themselves go no further."""
    text = F.col(text_col)
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        slot_of(F.col(id_col), text, slots).alias("vslot"),
    )


def slot_loads(recs: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of each slot. The aggregate has a row a slot at most, so collecting it is bounded."""
    loads = [(0, 0)] * slots
    for r in recs.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        loads[r["vslot"]] = (r["b"], r["n"])
    return loads


def first_map(n_shards: int, slots: int = SLOTS) -> SlotMap:
    """The version before any load is known: slots round robin."""
    return SlotMap(1, n_shards, tuple(slot % n_shards for slot in range(slots)))


def rebalance(slot_map: SlotMap, loads: list[tuple[int, int]], n_shards: int | None = None, slack: float = 0.0005) -> SlotMap:
    """The next version of the map, for new loads or a larger number of shards.

    Slots move from the fullest shard to the emptiest while that narrows the gap between them and
    either is off the mean by more than ``slack``; all others keep their shard. New shards are the only
    ones that take slots when the number grows.
    """
    n_shards = n_shards or slot_map.n_shards
    if n_shards < slot_map.n_shards:
        raise ValueError("a shard can't be dropped here: its slots would have nowhere agreed to go")
    held: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(slot_map.shard_of):
        held[shard].append(slot)
    totals = [sum(loads[s][0] for s in h) for h in held]
    for h in held:
        h.sort(key=lambda s: (loads[s][0], s))
    mean, moved, shard_of = sum(totals) / n_shards, [], list(slot_map.shard_of)
    targets = range(slot_map.n_shards, n_shards) or range(n_shards)
    for _ in range(len(loads)):
        top, low = max(range(n_shards), key=totals.__getitem__), min(targets, key=totals.__getitem__)
        gap = totals[top] - totals[low]
        fits = [s for s in held[top] if 0 < loads[s][0] < gap]
        if (totals[top] <= mean * (1 + slack) and totals[low] >= mean * (1 - slack)) or not fits:
            break
        slot = min(fits, key=lambda s: (abs(loads[s][0] - gap / 2), s))
        held[top].remove(slot)
        held[low].append(slot)
        totals[top] -= loads[slot][0]
        totals[low] += loads[slot][0]
        shard_of[slot] = low
        moved.append(slot)
    return SlotMap(slot_map.version + 1, n_shards, tuple(shard_of), tuple(moved))


def place(recs: DataFrame, slot_map: SlotMap, loads: list[tuple[int, int]]) -> DataFrame:
    """Each record's shard and its position there, gapless from 0.

    A shard's positions are its slots' ranges one after another; within a slot rows are numbered by a
    window over that slot alone, so no task needs a whole shard. The joined map has a row a slot.
    """
    start, rows = [0] * slot_map.n_shards, []
    for vslot, shard in enumerate(slot_map.shard_of):
        rows.append((vslot, shard, start[shard]))
        start[shard] += loads[vslot][1]
    table = recs.sparkSession.createDataFrame(rows, "vslot int, shard int, first long")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        recs.withColumn("n", F.row_number().over(within))
        .join(F.broadcast(table), "vslot")
        .withColumn("slot", F.col("first") + F.col("n") - 1)
        .drop("n", "first")
    )


def shard(docs: DataFrame, n_shards: int, map_path: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """All rows of ``docs`` dealt to ``n_shards`` shards of nearly equal bytes.

    The map at ``map_path`` is begun where there is none, edited for the loads of ``docs``, and read again.
    """
    spark = docs.sparkSession
    recs = records(docs, id_col, text_col, slots)
    loads = slot_loads(recs, slots)
    if not has_map(spark, map_path):
        store_map(spark, first_map(n_shards, slots), map_path)
    before = load_map(spark, map_path)
    after = rebalance(before, loads, n_shards)
    if after.moved or after.n_shards != before.n_shards:
        store_map(spark, after, map_path)
    return place(recs, load_map(spark, map_path), loads)


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run begins its own map, so that its result depends on the table alone."""
    from ._shared import documents, ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    return shard(documents(spark, sf_dir), 40, path).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
