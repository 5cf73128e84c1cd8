"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Training sees a bounded sample of labelled rows, the ``max_rows`` with the
smallest hash of their id, in one task; the weights (``1 << bits`` floats) come
to the driver and go out as one broadcast variable.  Scoring is a sparse dot
product per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import q, releasing

#: Odd multipliers that spread the word hashes of the n-grams.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def features(text: str | None, bits: int, orders: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values: counts of hashed word 1..``orders``-grams, damped and of unit length."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    grams, cur = [], np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(orders, len(h))):
            cur = (cur[: len(h) - k] * np.uint64(MIX[2])) + (h[k:] + np.uint64(k + 1)) * np.uint64(MIX[0])
            mixed = (cur ^ (cur >> np.uint64(29))) * np.uint64(MIX[1])
            grams.append(mixed >> np.uint64(64 - bits))
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0)
    at, n = np.unique(np.concatenate(grams).astype(np.int64), return_counts=True)
    x = np.sqrt(n)
    return at, x / np.sqrt(x @ x)


class Ftrl:
    """Follow-the-regularised-leader with a learning rate per coordinate; the last coordinate is the bias."""

    def __init__(self, bits: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit_quality(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 16384,
    bits: int = 18,
    epochs: int = 6,
) -> np.ndarray:
    """Weights of the n-grams, the bias last.

    Learns from at most ``max_rows`` labelled ids, those with the smallest hash:
    the choice depends on nothing but the ids.  Labels other than 0 and 1 and
    null ids are passed over; of an id's labels and of its texts the smallest
    count; without labels all weights are 0 and every score is 0.5.
    """
    chosen = (
        labels.where(q(label_col).isin(0, 1) & q(id_col).isNotNull())
        .groupBy(q(id_col).alias("lid"))
        .agg(F.min(q(label_col)).cast("double").alias("y"))
        .orderBy(F.xxhash64("lid"), "lid")
        .limit(max_rows)
    )
    rows = (
        df.select(q(id_col).alias("rid"), q(text_col).alias("text"))
        .join(F.broadcast(chosen), F.col("rid") == F.col("lid"))  # at most max_rows ids
        .groupBy("lid")
        .agg(F.min("text").alias("text"), F.first("y").alias("y"))
        .select(F.xxhash64("lid").alias("h"), "lid", "text", "y")
        .repartition(1)
        .sortWithinPartitions("h", "lid", "text")
    )

    # max_rows rows at most
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(bits), []
        for batch in batches:
            for text, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                at, x = features(text, bits)
                seen.append((at.astype(np.int32), x.astype(np.float32), y))
        for _ in range(epochs):
            for at, x, y in seen:
                model.update(at, x, y)
        w = model.weights(slice(None)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    got = rows.mapInArrow(releasing(train), "w binary").collect()  # one row of 4 << bits bytes
    return np.frombuffer(got[0].w, np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def score_quality(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and score.  A null text scores as the empty one, by the bias alone."""
    bits = (len(weights) - 1).bit_length() - 1
    held = df.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            out = _scores(batch.column(1), w, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [id_col, "score"])

    return df.select(q(id_col), q(text_col)).mapInArrow(releasing(run), schema)


def _scores(texts: pa.Array, w: np.ndarray, bits: int) -> np.ndarray:
    s = np.empty(len(texts))
    for i, t in enumerate(texts.to_pylist()):
        at, x = features(t, bits)
        s[i] = w[at] @ x + w[-1]
    return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def keep_quality(
    df: DataFrame, weights: np.ndarray, text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """The rows of ``df`` with a score of ``least`` or more, all columns as they were."""
    bits = (len(weights) - 1).bit_length() - 1
    held = df.sparkSession.sparkContext.broadcast(weights)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(place), w, bits) >= least))

    return df.mapInArrow(releasing(run), df.schema)


def held_out(id_: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))
