"""SentencePiece encoding and decoding through a table of distinct chunks.

The model's pieces hold a white-space marker only at their beginning and no line break at all, so no
piece crosses the place before a marker or a line break. The texts of a slice are cut there and their
chunks dictionary-encoded: each distinct one is segmented by the library once, and ids and surfaces are
taken back by the chunks' positions and joined text by text. Chunks that were segmented before, in other
slices, are kept in a table. The table is per Python worker, not per cluster: words by position would be
a shuffle many times the size of the texts, and a worker meets most of its words again anyway. It
has two generations of bounded size: when the young one is full it becomes the old one, and chunks
met again move to the young one, so frequent ones stay and memory is bounded. A very long text is
taken in parts that end before a chunk.

The method is right only for models of this kind, so ``ChunkTable`` checks the model's vocabulary and
normalisation first and refuses others.

Defined results: a null text counts as empty and has no ids; literal marker characters count as
spaces, as in the library; null ids of documents pass through; repeated rows give equal results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ._shared import bounded_batches

MARK = "▁"
#: Distinct chunks that a generation of a worker's table holds; a longer chunk than this isn't kept.
TABLE_ENTRIES = 300_000
TABLE_CHUNK_CHARS = 64
#: Characters of text whose chunks are taken together.
SLICE_CHARS = 500_000
_CHUNK = re.compile(r"[ \n]+[^ \n]*")
_BORDER = re.compile(r"(?<=[^ \n])[ \n]")


def check_model(processor) -> None:
    """Raise if a piece could cross a chunk border or the text would be normalised."""
    for i in range(processor.vocab_size()):
        piece = processor.id_to_piece(i)
        if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i)) and (MARK in piece.lstrip(MARK) or "\n" in piece):
            raise ValueError(f"piece {piece!r} crosses white space")
    probe = "a  é é Ａ\t　ﬁ "
    if processor.decode(processor.encode(probe)) != probe:
        raise ValueError("the model normalises its input")


class ChunkTable:
    """chunk -> (ids in decimal, joined by commas; decoded text)."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        check_model(self.processor)
        self.mark_id = self.processor.piece_to_id(MARK)
        size = range(self.processor.vocab_size())
        self.decimal = [str(i) for i in size]
        self.bytes = {i: int(self.processor.id_to_piece(i)[3:5], 16) for i in size if self.processor.is_byte(i)}
        self.surface = ["" if i in self.bytes else self.processor.id_to_piece(i).replace(MARK, " ") for i in size]
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def _segment(self, chunks: list[str]) -> None:
        """The library adds a marker before each text; a chunk that begins with a space has that one already."""
        for chunk, ids in zip(chunks, self.processor.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1), strict=True):
            if not ids:  # one marker only: the library makes nothing of an empty text
                ids = [self.mark_id]
            elif chunk[0] == "\n":
                ids = ids[1:]
            text = self.decode(ids)
            self.young[chunk] = ",".join([self.decimal[i] for i in ids]), chunk if text == chunk else text

    def decode(self, ids: list[int]) -> str:
        """The text of ids, with the marker that the library adds to a text still at its beginning."""
        if self.bytes.keys().isdisjoint(ids):
            return "".join([self.surface[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.surface[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def _look_up(self, distinct: list[str]) -> list[tuple[str, str]]:
        fresh = []
        for c in distinct:
            if c not in self.young:
                if c in self.old:
                    self.young[c] = self.old[c]
                else:
                    fresh.append(c)
        if fresh:
            self._segment(fresh)
        found = [*map(self.young.__getitem__, distinct)]
        for c in fresh:
            if len(c) > TABLE_CHUNK_CHARS:
                del self.young[c]
        if len(self.young) > TABLE_ENTRIES:
            self.young, self.old = {}, self.young
        return found

    def _slice(self, marked: list[str]) -> tuple[list[str], list[str]]:
        """Joined ids and surfaces of texts with the library's marker before them, or of a text's parts."""
        lists = [_CHUNK.findall(t) for t in marked]
        coded = pa.array([c for chunks in lists for c in chunks], pa.string()).dictionary_encode()
        found = self._look_up(coded.dictionary.to_pylist())
        offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
        joined = lambda k, by: pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([f[k] for f in found], pa.string()).take(coded.indices)), by).to_pylist()
        return joined(0, ","), joined(1, "")

    def _long(self, marked: str) -> tuple[str, str]:
        ids, surfaces, at = [], [], 0
        while at < len(marked):
            border = _BORDER.search(marked, at + SLICE_CHARS)
            to = border.start() if border else len(marked)
            (part,), (surface,) = self._slice([marked[at:to]])
            ids.append(part)
            surfaces.append(surface)
            at = to
        return ",".join(ids), "".join(surfaces)

    def run(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Decimal ids joined by commas, and decoded text."""
        held, chars = [], 0

        def flush() -> Iterator[tuple[str, str]]:
            if held:
                for ids, surface in zip(*self._slice(held), strict=True):
                    yield ids, surface[1:]
                held.clear()

        for text in texts:
            marked = " " + text.replace(MARK, " ") if text else ""
            if len(marked) > 2 * SLICE_CHARS or chars + len(marked) > SLICE_CHARS:
                yield from flush()
                chars = 0
            if len(marked) > 2 * SLICE_CHARS:
                ids, surface = self._long(marked)
                yield ids, surface[1:]
            else:
                held.append(marked)
                chars += len(marked)
        yield from flush()


_TABLES: dict[str, ChunkTable] = {}


def table(model_path: str) -> ChunkTable:
    """The worker's table for a model; it outlives a task."""
    if model_path not in _TABLES:
        _TABLES[model_path] = ChunkTable(model_path)
    return _TABLES[model_path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of every text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [[int(x) for x in joined.split(",")] if joined else [] for joined, _ in own.run(texts)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of what ``encode`` gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table(model_path)
        for batch in batches:
            texts = [own.decode(ids)[1:] for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the text decoded from them."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table(model_path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for joined, decoded in own.run([t or "" for t in batch.column(1).to_pylist()]):
                n.append(joined.count(",") + 1 if joined else 0)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ._shared import documents

    return digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
