"""Language identification with string kernels.

A text is the set of its character n-grams of one to three letters, the blended spectrum, and two texts
are compared by the presence kernel: common n-grams over the geometric mean of their numbers. N-grams
are hashed to ``FEATURES`` positions. A bounded sample of labelled rows trains the model: ``LANDMARKS``
of them span the Nyström approximation, and kernel ridge regression fits one function per language
against the rest. As the kernel is a scaled inner product of presence vectors, a function's landmark
expansion folds into one weight per position, and a batch of texts is scored by one matrix product.

``TRAIN_ROWS`` bounds the sample: the rows with the smallest hash of id and text, as many for each
language as the bound allows, and of rare languages all. Their features are computed by the executors,
so only bits come to the driver.

Defined results: a null text, or one without letters, is ``und`` with score 0. Null languages teach
nothing; without any labelled row every text is ``und``. Null ids teach nothing and pass through;
repeated rows get equal results; an empty table gives an empty result. ``predict`` keeps all columns and
replaces those with the names that it is asked to give; ``identify`` ignores other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import bounded_batches, give_back

FEATURES = 1 << 14
TRAIN_ROWS = 1600
LANDMARKS = 256
RIDGE = 1e-2
#: Rows that every language has a share of, however many languages divide the sample.
LEAST_SHARE = 4
#: Languages beyond this are refused by an error: such labels name something else.
LANGUAGES = 4000
UNDEFINED = "und"
#: Code points that are featurised at a time.
CHUNK_CHARS = 2_000_000
_ROWS = 64


def _letters() -> np.ndarray:
    """A hash of each UTF-16 unit's folded letter. ASCII characters that are no letters count as one separator."""
    folded = np.arange(1 << 16, dtype=np.uint32)
    for c in range(0x2000):
        low = chr(c).lower()
        folded[c] = ord(low) if len(low) == 1 else c
        if c < 0xAA and not chr(c).isalpha():
            folded[c] = 32
    x = (folded + np.uint32(1)) * np.uint32(0x9E3779B1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return x ^ (x >> np.uint32(13))


_LETTERS = _letters()
_SHIFT = np.uint32(32 - (FEATURES.bit_length() - 1))


def _grams(texts: list[str]) -> np.ndarray:
    """Presence of hashed n-grams as 0 or 1, a row a text."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts, strict=True):
        for at in range(0, len(text), CHUNK_CHARS):
            units = np.frombuffer(f" {text[max(0, at - 2) : at + CHUNK_CHARS]} ".encode("utf-16-le", "surrogatepass"), np.uint16)
            one = _LETTERS[units]
            two = one[:-1] * np.uint32(0xC2B2AE35) ^ one[1:]
            three = two[:-1] * np.uint32(0xC2B2AE35) ^ one[2:]
            for rolled in (one, two, three):
                row[(rolled * np.uint32(0x27D4EB2F)) >> _SHIFT] = 1
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # FEATURES x languages
    slope: float

    def __post_init__(self):
        object.__setattr__(self, "with_count", np.hstack([self.weights, np.ones((FEATURES, 1), np.float32)]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNDEFINED] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for a in range(0, len(known), _ROWS):
            rows = known[a : a + _ROWS]
            present = _grams([texts[i] for i in rows])
            product = present @ self.with_count
            values = product[:, :-1] / np.sqrt(product[:, -1:])
            p = np.exp(self.slope * (values - values.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for i, b, row in zip(rows, best.tolist(), p, strict=True):
                langs[i], scores[i] = self.languages[b], float(row[b])
        return langs, scores


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(present: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features K(x, L) W^(-1/2), ridge regression on them, folded into weights by position."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return Model((), np.zeros((FEATURES, 0), np.float32), 1.0)
    y = np.array([[1.0 if lang == other else -1.0 for other in languages] for lang in labels])
    size = np.sqrt(np.maximum(1, present.sum(axis=1))).astype(np.float32)
    unit = present.astype(np.float32) / size[:, None]
    chosen = np.unique(np.linspace(0, len(unit) - 1, min(landmarks, len(unit))).astype(int))
    marks = unit[chosen]
    w = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(w)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = (unit @ marks.T).astype(np.float64) @ root
    per_class = 1 / np.maximum(1, np.array([labels.count(lang) for lang in languages]))
    weight = np.array([per_class[languages.index(lang)] for lang in labels]) * len(labels) / len(languages)
    mean = np.average(y, axis=0, weights=weight)
    beta = np.linalg.solve(phi.T @ (phi * weight[:, None]) + ridge * len(labels) * np.eye(phi.shape[1]), phi.T @ ((y - mean) * weight[:, None]))
    weights = (marks.T @ (root @ beta)).astype(np.float32)
    values = unit @ weights
    best = (1.0, -np.inf)
    at = np.array([languages.index(lang) for lang in labels])
    for slope in (1, 2, 4, 8, 16, 32):
        z = slope * values
        z -= z.max(axis=1, keepdims=True)
        fit_at = float((z[np.arange(len(at)), at] - np.log(np.exp(z).sum(axis=1))).mean())
        if fit_at > best[1]:
            best = (float(slope), fit_at)
    return Model(languages, weights, best[0])


def _features(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), _ROWS):
                bits = np.packbits(_grams(texts[a : a + _ROWS]).astype(bool), axis=1)
                yield pa.record_batch([batch.column(0)[a : a + _ROWS], pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "bits"])

    return rows.mapInArrow(run, "lang string, bits binary")


def training_rows(docs: DataFrame, teaches: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """lang and text of the sample: for each language those rows with the smallest hash of id and text.

    The sample holds ``rows`` rows in equal shares, or ``LEAST_SHARE`` of each language where that is more.
    The counts by language set a cut of the hash that keeps a little more than a share, so the texts of
    other rows are never sorted or moved.
    """
    ok = docs.where(teaches & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = ok.groupBy("lang").count().orderBy("lang").limit(LANGUAGES + 1).collect()  # bounded by LANGUAGES
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} distinct values of lang")
    share = max(LEAST_SHARE, -(-rows // max(1, len(counts))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    u = F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 30))
    least = {r["lang"]: int(min(1.0, (share + 4 * share**0.5 + 8) / r["count"]) * (1 << 30)) for r in counts}
    cuts = docs.sparkSession.createDataFrame(sorted(least.items()), "lang string, _mw_least long")
    near = ok.select("lang", text.alias("text"), u.alias("u"), "doc_id").join(F.broadcast(cuts), "lang").where("u < _mw_least")
    first = Window.partitionBy("lang").orderBy("u", "doc_id", "text")
    return near.withColumn("_mw_rank", F.row_number().over(first)).where(F.col("_mw_rank") <= share).select("lang", "text")


def train(docs: DataFrame, teaches: Column, rows: int = TRAIN_ROWS) -> Model:
    got = _features(training_rows(docs, teaches, rows)).collect()  # 2 KB a row; rows as training_rows bounds them
    got.sort(key=lambda r: (r["lang"], r["bits"]))
    present = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), -1), axis=1).astype(bool) if got else np.zeros((0, FEATURES), bool)
    return fit(present, [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents with the predicted language and its score, which replace columns so named. The model, a weight a position and language, is in the closure."""
    docs = docs.drop(*names)
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])
        give_back()

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; rows that aren't held out teach."""
    model = train(docs, ~held_out(), rows)
    found = predict(docs.select("doc_id", F.col("text").cast("string")), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import documents

    return identify(documents(spark, sf_dir))
