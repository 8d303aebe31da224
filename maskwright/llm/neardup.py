"""Near-duplicate detection: banded MinHash, odd sketches, exact confirmation, components.

1.  Each text becomes its set of distinct word shingles, hashed to 64 bits. Texts with equal sets form a
    class, and its smallest id stands for it from here on, so thousands of copies cost one row a band.
2.  128 MinHash samples of a set give band keys of four samples each, and, folded into a parity bitmap
    of 512 bits, an odd sketch. The XOR of two sketches keeps the samples in which two sets differ, so
    its population count tells high similarities precisely. The whole set is folded into a second
    bitmap; there the count never exceeds the size of the symmetric difference, so it refuses pairs
    that can't reach the threshold and never one that does.
3.  In each bucket the smallest and the largest id are compared with all members: that is linear, and
    all there is in buckets of up to three. Pairs that pass both bitmaps are confirmed on full sets.
4.  Larger buckets that still hold several components are searched further: members outside a bucket's
    most frequent component against the members of other components, on bitmaps inside the join, so
    that only close pairs leave it. Nothing is capped or sampled; in a large group of near copies most
    members are linked in step 3 and drop out here.
5.  Components of the confirmed links by alternating large-star and small-star steps.

Wherever rows meet by a key, keys that hold more than a small part of all rows are dealt to several
tasks (``spread_join``). Texts and ids meet by a shuffle, whatever their number: nothing that grows with the
corpus is broadcast or collected.

The number of bands follows the threshold: a pair at the threshold shares no bucket in one of ten
million cases.

Defined results: a text without words, or a null one, has an empty set and is linked with nothing. Rows
with a null id are returned unlinked, with a null component, and kept. Repeated rows get equal results;
rows that share an id but not a text are one node. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, give_back, table

SAMPLES = 128
BAND_ROWS = 4
MISS = 1e-7
SKETCH_BITS = 512
#: Bits of the bitmap of a whole set.
SET_BITS = 2048
#: Standard deviations of the sketch's estimate that a pair may lie below the threshold and still be confirmed.
SLACK_SIGMAS = 5.0
#: A join key with more than one in ``HOT`` of a join's rows, and with more than ``SPREAD``, is dealt to several tasks.
HOT, SPREAD = 1000, 256
#: Bits, as a power of two, of the largest bit map of ids that is broadcast: 64 MB.
FILTER_BITS = 29
#: Characters of text that are hashed at a time.
CHUNK_CHARS = 1_000_000
#: Rows of a batch that are turned into Python strings at a time.
SLICE_ROWS = 256

_SEEDS = np.random.default_rng(20240607)
_A = (_SEEDS.integers(0, 2**32, SAMPLES, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _SEEDS.integers(0, 2**32, SAMPLES, np.uint64).astype(np.uint32)[:, None]
_SALT = _SEEDS.integers(0, 2**63, SAMPLES, np.uint64)


def bands_for(percent: int) -> int:
    return min(SAMPLES // BAND_ROWS, math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** BAND_ROWS)))


def most_odd_bits(percent: int) -> int:
    """Set bits in the XOR of two sketches up to which a pair may be at the threshold.

    The number of samples that differ varies, and so does the number of bits on which they leave an odd count.
    """
    t = percent / 100
    differ = 2 * SAMPLES * (1 - t)
    odd = (1 - (1 - 2 / SKETCH_BITS) ** differ) / 2
    of_samples = 2 * math.sqrt(SAMPLES * t * (1 - t)) * (1 - 2 * odd)
    of_bits = math.sqrt(SKETCH_BITS * odd * (1 - odd))
    return math.ceil(SKETCH_BITS * odd + SLACK_SIGMAS * math.hypot(of_samples, of_bits))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z are lower-cased, words end at ASCII white space."""
    import xxhash

    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars + len(texts[end]) <= CHUNK_CHARS):
            chars += len(texts[end])
            end += 1
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts[start:end], pa.large_string())))
        flat = lists.flatten()
        bounds = np.asarray(lists.offsets, np.int64)
        words = np.asarray(pc.greater(pc.binary_length(flat), 0))
        counts = np.concatenate([[0], np.cumsum(words)])[bounds]
        coded = flat.dictionary_encode()
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        word = hashes[np.asarray(coded.indices)[words]] if len(hashes) else np.zeros(0, np.uint64)
        rolled = np.full(max(0, len(word) - k + 1), k, np.uint64)
        for j in range(k):
            rolled = _mix(rolled ^ word[j : j + len(rolled)]) * np.uint64(0x9E3779B97F4A7C15)
        for a, b in zip(counts[:-1], counts[1:], strict=True):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for w in word[a:b]:
                    short = _mix(short ^ w) * np.uint64(0x9E3779B97F4A7C15)
                yield short
            else:
                yield np.zeros(0, np.uint64)
        start = end


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, 2**32 - 1, np.uint32)
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(small), 2048):
        np.minimum(low, (_A * small[i : i + 2048] + _B).min(axis=1), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parities of how many samples hash to each bit."""
    at = (_mix(samples.astype(np.uint64) ^ _SALT) >> np.uint64(32)) & np.uint64(SKETCH_BITS - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Parities of how many of all shingles fall on each bit."""
    at = (shingles & np.uint64(SET_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SET_BITS) & 1).astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    rows = samples[: bands * BAND_ROWS].astype(np.uint64).reshape(bands, BAND_ROWS)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(BAND_ROWS):
        key = _mix(key ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
    give_back()


def signatures(docs: DataFrame, k: int, percent: int, keep_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, c1 and c2 (which name the class of the set), bands, sketch, parity, and the text if asked for."""
    bands = bands_for(percent)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in sliced(batches):
            n, classes, keys, sketches, whole = [], [], [], [], []
            for s in shingle_sets([t or "" for t in batch.column(1).to_pylist()], k):
                n.append(len(s))
                if not len(s):
                    classes.append((0, 0))
                    keys.append(None)
                    sketches.append(None)
                    whole.append(None)
                    continue
                classes.append(tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()))
                samples = minhash(s)
                keys.append(band_keys(samples, bands))
                sketches.append(odd_sketch(samples))
                whole.append(parities(s))
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), *(pa.array([c[i] for c in classes], pa.int64()) for i in (0, 1)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(whole, pa.list_(pa.int64())), *([batch.column(1)] if keep_text else [])],
                ["doc_id", "n_shingles", "c1", "c2", "bands", "sketch", "parity", *(["text"] if keep_text else [])],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>, sketch array<long>, parity array<long>" + ", text string" * keep_text)


def odd_bits(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketches."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_BITS // 64)))


def all_odd_bits(a: Column, b: Column) -> Column:
    """As ``odd_bits`` for long bitmaps; few pairs get here, and a join's compiled condition stays small."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def close(a: str, b: str, percent: int) -> Column:
    """Whether sketches a (struct of n, sketch, parity) and b let a pair reach the threshold."""
    of = lambda x, field: F.col(f"{x}.{field}")
    most = (of(a, "n") + of(b, "n")) * (100 - percent)
    return (
        (F.abs(of(a, "n") - of(b, "n")) * (100 + percent) <= most)
        & (odd_bits(of(a, "sketch"), of(b, "sketch")) <= most_odd_bits(percent))
        & (all_odd_bits(of(a, "parity"), of(b, "parity")) * (100 + percent) <= most)
    )


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that is sorted and merged, never broadcast by the planner: dozens of small broadcasts fill a driver."""
    return side.hint("merge")


def spread_join(rows: DataFrame, other: DataFrame, keys: list[str], by: str, how: str = "inner", counts: DataFrame | None = None, least: int | None = None) -> DataFrame:
    """``rows`` joined with ``other`` on ``keys``; a key with many rows is dealt to several tasks by a hash of ``by``.

    Only the other side's rows of such a key are copied, to as many parts as the key has. Fewer than ``HOT``
    keys can hold more than one in ``HOT`` of the rows, so the list of them is bounded whatever the input.
    ``counts`` has the keys and ``n``, where that is known already; ``least`` stands for ``SPREAD`` where the
    other side's rows are many and copies dear.
    """
    counts = counts if counts is not None else rows.groupBy(*keys).agg(F.count("*").alias("n"))
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    each = max(SPREAD if least is None else least, (total or 0) // HOT)
    if (most or 0) <= each:
        return rows.join(merged(other), keys, how)
    hot = counts.where(F.col("n") > each).select(*keys, F.ceil(F.col("n") / each).cast("int").alias("_mw_parts")).collect()
    parts = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*keys, F.lit(0).alias("_mw_parts")).schema))
    left = rows.join(parts, keys, "left").withColumn("_mw_part", F.coalesce(F.pmod(F.xxhash64(by), "_mw_parts"), F.lit(0).cast("long"))).drop("_mw_parts")
    right = other.join(parts, keys, "left").withColumn("_mw_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_mw_parts", F.lit(1)) - 1))).drop("_mw_parts")
    return left.join(merged(right), [*keys, "_mw_part"], how).drop("_mw_part")


def marked_by(docs: DataFrame, ids: DataFrame, name: str = "_mw_hit") -> DataFrame:
    """Adds ``name``: whether a row's doc_id is among ``ids``; of other rows a few are marked as well.

    The ids are hashed to a bit map of ``FILTER_BITS`` at most, whatever their number, and only that is
    broadcast: 64 MB at most. Beyond that size more other rows are marked, and none is missed. ``ids`` must be written.
    """
    bits = 1 << max(15, min(FILTER_BITS, (16 * max(1, ids.count())).bit_length()))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    cell, at = (F.floor(place / 32768)).cast("int"), (place % 32768).cast("int")
    maps = ids.select(cell.alias("_mw_cell"), at.alias("at")).groupBy("_mw_cell").agg(F.bitmap_construct_agg("at").alias("_mw_map"))
    bit = F.expr("shiftright(cast(conv(hex(substring(_mw_map, cast(_mw_at div 8 AS int) + 1, 1)), 16, 10) AS int), cast(_mw_at % 8 AS int)) & 1") == 1
    keyed = docs.withColumn("_mw_cell", cell).withColumn("_mw_at", at).join(F.broadcast(maps), "_mw_cell", "left")
    return keyed.withColumn(name, F.coalesce(bit, F.lit(False))).select(*docs.columns, name)


def sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """doc_id and s, the shingle sets of the texts of some ids; a row for each different set. ``ids`` must be written.

    Texts and ids meet by a shuffle of those texts that a bit map of the ids lets through.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = marked_by(narrow, ids).where("_mw_hit").select("doc_id", "text").join(merged(ids), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in sliced(batches):
            sets = [s.view(np.int64) for s in shingle_sets([t or "" for t in batch.column(1).to_pylist()], k)]
            names = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(names), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "h", "s"])

    sets = table(texts.mapInArrow(run, "doc_id long, h long, s array<long>"))
    if sets.groupBy("doc_id", "h").count().where("count > 1").take(1):  # rows that are alike need to meet only once
        sets = table(sets.dropDuplicates(["doc_id", "h"]))
    return sets.select("doc_id", "s")


def ends(pairs: DataFrame) -> DataFrame:
    return table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b), which must be written, whose full sets reach the threshold."""
    of = lambda side: sets.select(F.col("doc_id").alias(side), F.col("s").alias(f"s{side}"))
    one = spread_join(pairs.select("a", "b"), of("a"), ["a"], "b")
    both = spread_join(one, of("b"), ["b"], "a", counts=pairs.groupBy("b").agg(F.count("*").alias("n"))).withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return table(both.where(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b").distinct())


def linked(near: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links among ``near`` pairs, enough to tell the components, and each node's component.

    First every node meets its smallest partner, which links most of a large group with one pair a
    node; then all pairs that still lie in different components are confirmed.
    """
    first = table(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = confirm(first, sets, percent)
    labels = table(components(links))
    apart = table(across_labels(near, labels).join(merged(first), ["a", "b"], "left_anti"))
    if apart.take(1):
        found = confirm(apart, sets, percent)
        if found.take(1):
            links = links.unionByName(found)
            labels = table(components(links))
    return links, labels


def across_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends have different components."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"l{side}"))
    one = spread_join(pairs.select("a", "b"), of("a"), ["a"], "b", "left")
    both = spread_join(one, of("b"), ["b"], "a", "left", counts=pairs.groupBy("b").agg(F.count("*").alias("n")))
    return both.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes that links (a, b) mention.

    Large-star and small-star steps in turn, each a grouped minimum and an equi-join on links alone,
    until all components are stars. Every round is written, so its plan stays small and lost executors cost no
    more than a reread.
    """
    edges = table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = table(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = spread_join(both.where("v > u"), low.select("u", "m"), ["u"], "v", counts=low.where("n > 0").select("u", "n"))
        large = table(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, low.select("u", "m"), ["u"], "v", counts=low.select("u", "n"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = table(small.where("u <> v").distinct())
        # stars, whose nodes have one edge up and whose centres have none, can't change any more
        ends_of = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends_of.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").take(1):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    return _labelled(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``near_duplicates`` with c1 and c2, the class of each row's set."""
    signed = table(signatures(docs, k, percent).withColumn("at", F.monotonically_increasing_id()))  # written, so ``at`` stays
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a class: its smallest id, and one row that has it
    stands = table(real.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.min_by("at", "doc_id").alias("at"), F.count("*").alias("n")))
    first = table(real.join(merged(stands.select("at", "rep")), "at").select("rep", "bands", F.struct(F.col("n_shingles").alias("n"), "sketch", "parity").alias("maps")))

    rows = first.select(F.explode("bands").alias("key"), "rep")
    hubs = table(rows.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n")).where("lo <> hi"))
    met = table(spread_join(rows, hubs, ["key"], "rep", counts=hubs.select("key", "n")))
    stars = met.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("rep").alias("b")), F.struct(F.col("rep").alias("a"), F.col("hi").alias("b")))).alias("p"))
    stars = table(stars.select("p.a", "p.b").where("a <> b").distinct())
    sketches = first.select("rep", "maps")
    one = spread_join(stars, sketches.select(F.col("rep").alias("a"), F.col("maps").alias("x")), ["a"], "b")
    both = spread_join(one, sketches.select(F.col("rep").alias("b"), F.col("maps").alias("y")), ["b"], "a", counts=stars.groupBy("b").agg(F.count("*").alias("n")))
    near = table(both.where(close("x", "y", percent)).select("a", "b").distinct())
    links, labels = linked(near, sets_of(ends(near), docs, k), percent)

    more = table(_across(met.where("n > 3").select("key", "rep"), labels, sketches, percent).join(merged(near), ["a", "b"], "left_anti"))
    if more.take(1):
        found, _ = linked(more, sets_of(ends(more), docs, k), percent)
        if found.take(1):
            labels = table(components(links.unionByName(found)))

    classes = table(stands.join(merged(labels.withColumnRenamed("node", "rep")), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id"), "n"))
    narrow = ["doc_id", "n_shingles", "c1", "c2"]
    joined = spread_join(real.select(*narrow, "at"), classes.drop("n"), ["c1", "c2"], "at", counts=classes.select("c1", "c2", "n")).select(*narrow, "component_id")
    alone = signed.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select(*narrow, F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _across(rows: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Close pairs between different components of a bucket.

    A bucket's most frequent component never meets itself; buckets of one component are gone before.
    """
    told = table(rows.join(merged(labels.withColumnRenamed("node", "rep")), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label")))
    open_keys = (
        told.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key")
        .agg(F.count("*").alias("labels"), F.max_by("label", "n").alias("main")).where("labels > 1").select("key", "main")
    )
    held = table(spread_join(told, table(open_keys), ["key"], "rep")).join(merged(sketches), "rep")
    left = held.where("label <> main").select("key", F.col("rep").alias("a"), F.col("label").alias("la"), F.col("maps").alias("x"))
    right = held.select("key", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("maps").alias("y"), (F.col("label") == F.col("main")).alias("is_main"))
    met = spread_join(right, left, ["key"], "b", least=4 * SPREAD).where((F.col("la") != F.col("lb")) & (F.col("is_main") | (F.col("a") < F.col("b"))) & close("x", "y", percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, with its columns.

    Rows without an id can't be linked and stay. Where rows share an id but not a set, those that are
    kept stay, one of each set.
    """
    labelled = _labelled(docs, k, percent).where("doc_id IS NOT NULL")
    per_id = labelled.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    # ids that are dropped or come again; all other rows stay where they are
    odd = table(per_id.where("NOT kept OR n > 1"))
    told = marked_by(docs, odd.select("doc_id"))
    maybe = told.where("_mw_hit").select(*docs.columns)
    ids = merged(odd.select(F.col("doc_id").alias("_mw_id")))
    out = told.where("NOT _mw_hit").select(*docs.columns).unionByName(maybe.join(ids, F.col("doc_id").cast("long") == F.col("_mw_id"), "left_anti"))
    again = odd.where("n > 1 AND kept").select("doc_id")
    if not again.take(1):
        return out
    only = lambda ids: maybe.join(ids.select(F.col("doc_id").alias("_mw_id")), F.col("doc_id").cast("long") == F.col("_mw_id"), "left_semi").select(*docs.columns)
    # of ids that repeat, the id doesn't tell the rows apart: their texts' sets are named once more
    classes = table(labelled.where("kept").join(again, "doc_id", "left_semi").select("doc_id", "c1", "c2").distinct())
    rows_again = only(again)
    texts = signatures(rows_again, k, percent, keep_text=True).select(F.col("doc_id").alias("_mw_id"), F.col("text").alias("_mw_text"), F.col("c1").alias("_mw_c1"), F.col("c2").alias("_mw_c2")).distinct()
    named = rows_again.join(texts, (F.col("doc_id").cast("long") == F.col("_mw_id")) & F.col("text").cast("string").eqNullSafe(F.col("_mw_text")))
    same = classes.select(F.col("doc_id").alias("_mw_id"), F.col("c1").alias("_mw_c1"), F.col("c2").alias("_mw_c2"))
    one = named.join(same, ["_mw_id", "_mw_c1", "_mw_c2"], "left_semi").dropDuplicates(["_mw_id", "_mw_c1", "_mw_c2"])
    return out.unionByName(one.select(*docs.columns))


def op1_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import documents

    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), k=3, percent=85)
