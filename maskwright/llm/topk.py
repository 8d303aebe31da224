"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each dimension of a block of candidates is a list sorted by its component; a query reads it from the
end that its own component's sign asks for. All lists are read in step, slice after slice, by many queries
together: one product adds a slice to the sums of its candidates, and nothing else of a candidate is
looked at. A candidate's
score lies between a lower bound, with the list's worst value for each component not read, and an upper
bound, with the value at the depth. A query stops reading a block when, apart from a few candidates,
upper bounds are below the k-th largest score that is certain: of the lower bounds of this block, or of
the final scores of blocks read before, which is carried along. The few that may still qualify get their
final scores; a query that nobody in the block can satisfy ends without any.

Queries and candidates are dealt to a grid of cells of bounded size: the stated queries against all rows,
in blocks. A cell is a unit of work and reads its blocks one after another; only k rows a query leave it.

Defined results: vectors that are null or hold nulls or non-finite numbers take no part, nor do rows
with a null id; vectors meet only vectors of equal length. A query's own rows, those with its id, are
no candidates. Repeated query rows count once, repeated candidates each, up to k; ties go to the smaller
vec_id. With fewer than k candidates all are returned. Sums are exact whatever the size of the numbers; a
score outside 64 bits is given as the nearest that fits. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries that read a block together, candidates of a block, and of a cell's first block.
QUERY_BATCH = 512
BLOCK, FIRST_BLOCK = 8192, 1024
#: Most and fewest queries and candidates of a cell.
QUERY_CELL, LEAST_QUERY_CELL = 8192, 256
CANDIDATE_CELL, LEAST_CANDIDATE_CELL = 65_536, 4096
#: Parts of the lists at which bounds are looked at; the last is all.
DEPTHS = (0.5, 0.68, 0.78, 0.86, 0.93, 1.0)
#: A query stops reading when this part of the candidates may still qualify, or k of them if that is more.
RESOLVE = 1 / 16
#: Bounds are kept in single precision and widened by this part of the largest possible sum.
ERROR = 1e-4
_LEAST, _MOST = -(2**63), 2**63 - 1


def exact(values: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides, whole numbers that came as doubles, in a type in which their inner products are exact."""
    largest = int(max(float(np.abs(side).max(initial=0)) for side in (values, queries)))
    bound = largest * largest * max(1, values.shape[1])
    if bound < 2**53:
        return values, queries
    if bound < 2**63:
        return values.astype(np.int64), queries.astype(np.int64)
    return tuple(np.array([int(v) for v in side.ravel()], object).reshape(side.shape) for side in (values, queries))


class SortedLists:
    """A block's sorted lists, of components divided by ``scale``. ``read`` counts the entries that queries read."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, scale: float):
        self.ids, self.x = ids, (values / scale).astype(np.float32)
        order = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, order, axis=0)
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)
        self.largest = np.maximum(np.abs(self.sorted[0]), np.abs(self.sorted[-1]))
        self.slices: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.read = 0

    def slice(self, done: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries between two depths, from the lists' tops and then from their ends, and what lies below them as 0 or 1."""
        if (done, depth) not in self.slices:
            n, place = len(self.ids), self.place
            top, end = (place >= n - depth) & (place < n - done), (place < depth) & (place >= done)
            new = np.hstack([np.where(top, self.x, np.float32(0)), np.where(end, self.x, np.float32(0))])
            self.slices[done, depth] = new, np.hstack([place < n - depth, place >= depth]).astype(np.float32)
        return self.slices[done, depth]

    def may_qualify(self, queries: np.ndarray, certain: np.ndarray, own: list[tuple[int, int, int]], k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query, places of the candidates that may qualify), as the queries stop reading.

        ``certain`` is a score that k candidates read before reach, or minus infinity; ``own`` names the
        places (query, from, to) of queries' own rows.
        """
        n = len(self.ids)
        sides = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
        slack = (ERROR * (np.abs(queries) @ self.largest))[:, None]
        reads = np.count_nonzero(queries, axis=1)
        active, sums, done = np.arange(len(queries)), np.zeros((len(queries), n), np.float32), 0
        for part in DEPTHS:
            depth = n if part == 1.0 else max(1, int(part * n))
            if depth <= done:
                continue
            new, unread = self.slice(done, depth)
            self.read += (depth - done) * int(reads[active].sum())
            sums += sides[active] @ new.T
            done = depth
            bound = lambda top, end: sums + (sides[active] * np.hstack([top, end])) @ unread.T  # noqa: B023, E731
            least = certain[active]
            mine = [(j, a, b) for j, (q, a, b) in zip(np.searchsorted(active, [q for q, _, _ in own]).tolist(), own, strict=True) if j < len(active) and active[j] == q]
            if np.isneginf(least).any() and n >= k:
                lower = bound(self.sorted[0], self.sorted[-1]) - slack[active]
                for j, a, b in mine:
                    lower[j, a:b] = -np.inf
                least = np.maximum(least, np.partition(lower, n - k, axis=1)[:, n - k])
            open_ = bound(self.sorted[n - depth], self.sorted[depth - 1]) + slack[active] >= least[:, None]
            for j, a, b in mine:
                open_[j, a:b] = False
            stops = (open_.sum(axis=1) <= max(k, RESOLVE * n)) | (depth == n)
            for j in np.flatnonzero(stops).tolist():
                yield int(active[j]), np.flatnonzero(open_[j])
            if stops.all():
                return
            active, sums = active[~stops], sums[~stops]


class Cell:
    """The best k of each query over the blocks read so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in query_ids]  # (-score, id), sorted
        self.read = self.resolved = 0

    def take(self, ids: np.ndarray, values: np.ndarray) -> None:
        """Read a block of candidates."""
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        scale = max(float(np.abs(side).max(initial=0)) for side in (values, self.queries)) or 1.0
        lists, (values, queries) = SortedLists(ids, values, scale), exact(values, self.queries)
        first, last = np.searchsorted(ids, self.query_ids, "left"), np.searchsorted(ids, self.query_ids, "right")
        for a in range(0, len(queries), QUERY_BATCH):
            batch = range(a, min(a + QUERY_BATCH, len(queries)))
            certain = np.array([-b[-1][0] / scale / scale if len(b) == self.k else -np.inf for b in self.best[a : batch.stop]], np.float32)
            own = [(q - a, int(first[q]), int(last[q])) for q in batch if first[q] < last[q]]
            for q, places in lists.may_qualify((self.queries[a : batch.stop] / scale).astype(np.float32), certain, own, self.k):
                if len(places):
                    scores = values[places] @ queries[a + q]
                    self.resolved += len(places)
                    found = sorted((-int(s), int(ids[p])) for s, p in self._best_of(scores, places))
                    self.best[a + q] = sorted(self.best[a + q] + found)[: self.k]
        self.read += lists.read

    def _best_of(self, scores: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int]]:
        """Scores and places of the k largest scores and of those that tie with them."""
        if len(scores) > self.k and scores.dtype != object:
            at = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, places = scores[at], places[at]
        return zip(scores.tolist(), places.tolist(), strict=True)

    def rows(self) -> list[tuple[int, int, int]]:
        """(query id, id, score)."""
        return [(int(q), i, min(max(-s, _LEAST), _MOST)) for q, best in zip(self.query_ids, self.best, strict=True) for s, i in best]


def top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int, block: int = BLOCK) -> Cell:
    """A cell's queries against all its candidates, a short block first, which makes scores certain, then block after block."""
    cell, at = Cell(query_ids, queries, k), 0
    while at < len(ids):
        to = at + (block if at else min(block, FIRST_BLOCK))
        cell.take(ids[at:to], values[at:to])
        at = to
    return cell


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v, the floors of the scaled components as doubles, of the rows that take part."""
    wide = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return wide.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True))).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")
    )


def _cells(rows: DataFrame, mine: int, other: int, prefix: str, turned: bool) -> DataFrame:
    """Packed parts of ``rows``, dealt by a hash to ``mine`` stripes, each copied to the ``other`` side's stripes.

    Rows must be distinct, so a hash of id and vector deals them evenly.
    """
    packed = (
        rows.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(mine)).cast("int").alias("own"))
        .agg(F.collect_list(F.struct("vec_id", "v", "copies")).alias("rows"))
        .withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    )
    row, column = ("met", "own") if turned else ("own", "met")
    return packed.select(
        "dim", F.col(row).alias("cell_row"), F.col(column).alias("cell_column"), F.col("rows.vec_id").alias(f"{prefix}_ids"), F.flatten("rows.v").alias(f"{prefix}_values"), F.col("rows.copies").alias(f"{prefix}_copies")
    )


def _stripes(n: int, tasks: int, least: int, most: int) -> int:
    """Into how many stripes n rows go: enough for the tasks, none under ``least`` or over ``most`` rows on average."""
    return max(1, -(-n // min(most, max(least, -(-n // tasks)))))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score; both sides have vec_id and v as from ``quantised``.

    Repeated rows are counted before they are dealt, so a vector that fills a third of the table is one row.
    """
    tasks = max(1, candidates.sparkSession.sparkContext.defaultParallelism)
    held = candidates.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    asked = queries.select("vec_id", "v", F.lit(1).alias("copies")).dropDuplicates(["vec_id", "v"])
    n_rows = _stripes(candidates.count(), tasks, LEAST_CANDIDATE_CELL, CANDIDATE_CELL)
    n_columns = _stripes(queries.count(), max(1, tasks // n_rows), LEAST_QUERY_CELL, QUERY_CELL)
    left, right = _cells(held, n_rows, n_columns, "c", False), _cells(asked, n_columns, n_rows, "q", True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                ids, values, copies, query_ids, asked_values = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("c_ids", "c_values", "c_copies", "q_ids", "q_values"))
                where = np.repeat(np.arange(len(ids)), copies)
                rows = top(query_ids, asked_values.reshape(-1, dim), ids[where], values.reshape(-1, dim)[where], k).rows()
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], ["query_id", "vec_id", "score"])

    met = left.join(right, ["dim", "cell_row", "cell_column"]).mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows, 5)
