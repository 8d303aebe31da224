"""Packing token sequences by minimum bin slack.

Each document's ids are cut into whole sequences, and the rest waits in a pool. A sequence takes the
longest piece of the pool; a bitset dynamic programme over the multiset of the other lengths finds
the reachable sum closest to what is left, and backtracking through its steps gives how many pieces
of each length to take. Where even the best sum leaves more than ``SLACK`` free, the longest piece
that is left is cut to fill the gap. What a task has left at its end is cut into sequences whose
lengths are powers of two, which need no padding.

A task packs what it reads: nothing is shuffled, a pool holds a bounded number of pieces, and a task
that runs again makes the same sequences with the same ids.

Ids come from a table of distinct words per worker, as the tokenizer drops white space between them.

Defined results: a null or empty text has the end id only; null ids of documents pass through;
repeated rows are documents of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._shared import bounded_batches, give_back

CAPACITY = 4096
END_ID = 2
#: Pieces in a pool at most, and how many stay when it is packed, so that sums keep their choice.
POOL, POOL_LEFT = 2048, 512
#: Free ids of a sequence that are padded rather than filled by a cut.
SLACK = 8
WORD_ENTRIES = 250_000
WORD_CHARS = 64
_KEPT = "\x1c\x1d\x1e\x1f"
_WORD = re.compile(r"[^\x20\x09-\x0d]+")


class WordTable:
    """word -> its ids as little-endian 32-bit bytes.

    Two generations of bounded size: when the young one is full it becomes the old one, and words met
    again move to the young one, so frequent words stay.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.marks = {m: self._encode([m])[0] for m in ".,"}
        #: The model's letters for those characters that stay one pre-token with their neighbours.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x130) if chr(c).isalpha() and chr(c) == chr(c).lower()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters, with one full stop or comma at most: the letters are one
        pre-token that normalisation only lower-cases, so the model can be asked directly."""
        tail = self.marks.get(word[-1], b"")
        head = word[:-1] if tail else word
        if not head.isalpha() or not (head.isascii() or max(head) <= "\u012f"):
            return None
        head = head.lower()
        known = self.young.get(head)
        if known is None:
            letters = head if head.isascii() else head.translate(self.letters)
            known = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return known + tail

    def ids(self, text: str) -> bytes:
        # str.split() also splits at four control characters that the tokenizer keeps, and at other
        # white space that the tokenizer drops as well
        words = _WORD.findall(text) if any(c in text for c in _KEPT) else text.split()
        young = self.young
        rest = []
        missing = set(words).difference(young)
        for w in missing:
            ids = self.old.get(w) or self._plain(w)
            if ids is None:
                rest.append(w)
            else:
                young[w] = ids
        if rest:
            young.update(zip(rest, self._encode(rest), strict=True))
        out = b"".join(map(young.__getitem__, words))
        for w in missing:
            if len(w) > WORD_CHARS:
                del young[w]
        if len(young) > WORD_ENTRIES:
            self.young, self.old = {}, young
        return out


_TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]


def closest_sum(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as large as ``room`` allows.

    Bit s of the set says that some multiset sums to s. Lengths are added from the longest, doubling
    how many of a length one step adds; the first step that reaches ``room`` ends the search.
    """
    full, sums = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((k for k in counts if k <= room), reverse=True):
        left, step = counts[length], 1
        while left and not sums >> room & 1:
            n = min(step, left, room // length)
            if not n:
                break
            steps.append((length, n, sums))
            sums |= (sums << (length * n)) & full
            left, step = left - n, step * 2
        if sums >> room & 1:
            break
    at, taken = sums.bit_length() - 1, defaultdict(int)
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            taken[length] += n
            at -= length * n
    return taken


class Packer:
    """Deals (document, start, ids) pieces out to sequences of at most ``capacity`` ids."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.sequences = capacity, 0
        self.pool: dict[int, list] = defaultdict(list)
        self.held = 0

    def _put(self, piece: tuple) -> None:
        self.pool[len(piece[2]) // 4].append(piece)
        self.held += 1

    def _take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.held -= 1
        return piece

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids in pieces:
            yield doc, start, ids, self.sequences, offset
            offset += len(ids) // 4
        self.sequences += 1

    def _cut(self, piece: tuple, length: int) -> tuple[tuple, tuple]:
        doc, start, ids = piece
        return (doc, start, ids[: 4 * length]), (doc, start + length, ids[4 * length :])

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        whole = len(ids) // 4 // self.capacity
        for k in range(whole):
            yield from self._emit([(doc, k * self.capacity, ids[4 * k * self.capacity : 4 * (k + 1) * self.capacity])])
        if rest := ids[4 * whole * self.capacity :]:
            self._put((doc, whole * self.capacity, rest))
        if self.held >= POOL:
            yield from self.pack(POOL_LEFT)

    def pack(self, left: int) -> Iterator[tuple]:
        """Fill sequences while the pool holds more than ``left`` pieces and enough ids for one."""
        total = sum(k * len(v) for k, v in self.pool.items())
        while self.held > left and total >= self.capacity:
            pieces = [self._take(max(self.pool))]
            room = self.capacity - len(pieces[0][2]) // 4
            for length, n in closest_sum({k: len(v) for k, v in self.pool.items()}, room).items():
                pieces += [self._take(length) for _ in range(n)]
                room -= length * n
            if room > SLACK:
                head, tail = self._cut(self._take(max(self.pool)), room)
                pieces.append(head)
                self._put(tail)
            total -= sum(len(p[2]) // 4 for p in pieces)
            yield from self._emit(pieces)

    def finish(self) -> Iterator[tuple]:
        yield from self.pack(0)
        rest = [p for k in sorted(self.pool, reverse=True) for p in self.pool[k]]
        total = sum(len(p[2]) // 4 for p in rest)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            pieces = []
            while room:
                piece = rest.pop(0)
                if len(piece[2]) // 4 > room:
                    piece, tail = self._cut(piece, room)
                    rest.insert(0, tail)
                pieces.append(piece)
                room -= len(piece[2]) // 4
            yield from self._emit(pieces)
        self.pool.clear()
        self.held = 0


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: where it came from, where it lies, and with ``with_ids`` its ids as bytes.

    sequence_id holds the task's number above bit 32 and the task's count below it.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    bounded_batches(docs.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, base = word_table(tokenizer_path), Packer(capacity), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))]
            rows.clear()
            return pa.record_batch(cols, names)

        def note(dealt: Iterator[tuple]) -> None:
            for (doc, n), start, ids, sequence, offset in dealt:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, base + sequence, offset) + ((ids,) if with_ids else ()))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + end
                note(packer.add((doc_id, len(ids) // 4), ids))
                if len(rows) >= 4096:
                    yield flush()
        note(packer.finish())
        if rows:
            yield flush()
        give_back()

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def op6_min_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ._shared import documents

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
