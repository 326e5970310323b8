"""Quality by compression: two zstandard dictionaries, one trained on good and one on bad labelled texts.

A text is cut into pieces, all of them compressed with either dictionary. The bad size less the good one over the larger is
large and positive where a text is like the good ones. The differences of the whole text, of its worst piece and of the share
of pieces nearer to the bad texts, and the sizes a byte, which tell repetition, are standardised and calibrated by a logistic
regression with squares, fitted by Newton's method.

Labels are learned only from documents whose crc32(doc_id) mod FOLDS is not HELD_OUT. What is fitted on is bounded:
``SAMPLE`` texts of each label of at most ``SAMPLE_CHARS`` characters for the dictionaries, and ``CALIBRATED`` other rows of
both labels in their natural shares, whole, for the calibration; both are the least by a hash of the id. Every text is scored
whole.

Defined results: a null text is scored as an empty one; a null doc_id has no label and is not held out; an id with both
labels, a null label or one other than 0 and 1 is not learned from; rows that repeat an id are scored each, and the smallest
of their texts is learned from; without texts of both labels every score is the share of label 1 (with one of each added);
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.storage import small_batches
from barloom.llm.text import buffers

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Bounds of what the model is fitted on; size of a dictionary, of a piece of text, and the level of compression.
SAMPLE, SAMPLE_CHARS, CALIBRATED = 800, 20_000, 6_000
DICTIONARY, PIECE, LEVEL, SEED = 112_640, 1024, 3, 13
FEATURES = 7


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the pieces; where there is too little to train on, the texts themselves."""
    parts = [p for t in texts for p in pieces(t)]
    size = min(DICTIONARY, max(1024, sum(map(len, parts)) // 8))
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:size]


class Sizes:
    """Compressed sizes of texts under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [self._compressor(x) for x in (good, bad)]

    @staticmethod
    def _compressor(data: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(data)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, text: bytes) -> np.ndarray:
        """Difference of the whole, of the worst piece, good and bad size a byte, log length, share nearer to bad, least size a byte."""
        parts = pieces(text)
        n = np.array([max(1, len(p)) for p in parts], float)
        good, bad = (np.array([len(c.compress(p)) for p in parts], float) for c in self.by)
        d = (bad - good) / np.maximum(bad, good)
        g, b, size = good.sum(), bad.sum(), n.sum()
        return np.array([(b - g) / max(b, g), d.min(), g / size, b / size, np.log(size), n[d < 0].sum() / size, (good / n).min()])


class Calibration:
    """A logistic regression on standardised features, their squares and their products with the first."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, ridge: float = 0.1):
        self.mean, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-9
        x = self._terms(features)
        self.weights = np.zeros(x.shape[1])
        for _ in range(50):
            p = self._chance(x)
            curve = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(self.weights))
            step = np.linalg.solve(curve, x.T @ (labels - p) - ridge * self.weights)
            self.weights += step / max(1.0, np.abs(step).max() / 4)
            if np.abs(step).max() < 1e-8:
                break

    def _terms(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, z * z, z[:, :1] * z[:, 1:]])

    def _chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self._chance(self._terms(features))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, at = buffers(batch.column(batch.schema.get_field_index("text")))
    for i in range(batch.num_rows):
        yield data[at[i] : at[i + 1]].tobytes()


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[tuple[bytes, bytes], Calibration] | float:
    """Both dictionaries and the calibration, or the score of every text where one of the labels has no texts."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most").drop("_most")
    mark = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    half = F.pmod(mark, F.lit(2))
    least = lambda d, n: d.orderBy(mark, "doc_id").limit(n)
    chosen = [least(known.filter((half == 0) & (F.col("quality") == q)), SAMPLE) for q in (0, 1)]
    # ids that are sent to every task are bounded by the limits
    one = lambda ids: docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    short = one(chosen[0].unionByName(chosen[1])).filter(F.length("text") <= SAMPLE_CHARS).orderBy("doc_id").collect()
    texts = [[r["text"].encode() for r in short if r["quality"] == q] for q in (0, 1)]
    counted = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counted.get(1, 0) + 1) / (counted.get(0, 0) + counted.get(1, 0) + 2)
    if not all(any(t) for t in texts):
        return prior
    bad, good = map(dictionary, texts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            rows = [sizes.features(t).tolist() for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "quality", "features"])

    rest = one(least(known.filter(half == 1), CALIBRATED)).mapInArrow(measure, "doc_id long, quality int, features array<double>").orderBy("doc_id").collect()
    labels_ = np.array([r["quality"] for r in rest], float)
    if len(set(labels_)) < 2:
        return prior
    return (good, bad), Calibration(np.array([r["features"] for r in rest]), labels_)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    small_batches(docs.sparkSession)
    model = fitted(docs, labels)
    rows = docs.select("doc_id", "text")
    if isinstance(model, float):
        out = rows.select("doc_id", F.lit(model).alias("score"))
    else:
        (good, bad), calibration = model

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes = Sizes(good, bad)
            for batch in batches:
                x = np.array([sizes.features(t) for t in _texts(batch)]).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(calibration.scores(x))], ["doc_id", "score"])

        out = rows.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op13_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
