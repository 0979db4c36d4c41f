"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import text_bytes

BITS = 20
# The model is fitted on a sample of this many labelled rows at most (those with the smallest hash of doc_id). Only the
# fit is bounded; every document is scored.
TRAIN_ROWS = 20_000
# Per-coordinate learning rate alpha / (beta + sqrt(n)), L1 and L2 strength.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
EPOCHS = 4
PREDICT_AT = 0.7

# Letters and digits stay, A-Z become small, all other ASCII becomes a space; bytes of other scripts stay.
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BIGRAM, _SKIP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def features(raw: bytes | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct buckets of the words, word pairs, and pairs with one word between, of a whole text."""
    words = (raw or b"").translate(_WORDS).split()
    if not words:
        return np.array([], "i8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    grams = np.concatenate([h, h[:-1] * _BIGRAM + h[1:], h[:-2] * _SKIP + h[2:] * _BIGRAM])
    grams = (grams ^ (grams >> np.uint64(29))) * _MIX
    return np.unique((grams >> np.uint64(64 - bits)).astype("i8"))


class Ftrl:
    """FTRL-proximal logistic regression; most weights stay at zero."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One example: `at` holds its buckets, the last index is the intercept."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of the weights that are not zero; the last index is the intercept."""
        every = self.weights(np.arange(len(self.z)))
        kept = np.flatnonzero(every)
        return kept, every[kept]


def train(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = TRAIN_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (index, value) learned from labelled rows that are not held out.

    `labels` has doc_id and toxic (0/1; null: not used). `held_out` is a condition on doc_id. The sample's ids, bounded by
    `rows`, are broadcast; one task learns from the sample's texts in a fixed order, so results repeat.
    """
    chosen = (labels.selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic")
              .where(F.col("toxic").isin(0, 1) & ~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    def learn(batches):
        ftrl, sample, last = Ftrl(1 << bits), [], None
        for batch in batches:
            for doc_id, label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch, "text")):
                # Repeated rows stand next to each other and count once.
                if (doc_id, raw) != last:
                    sample.append((label, features(raw, bits).astype("i4")))
                last = doc_id, raw
        # With balanced weights each class is seen equally often: the rarer one is repeated.
        toxic = sum(label for label, _ in sample)
        often = max(1, min(20, round((len(sample) - toxic) / max(1, toxic))))
        for _ in range(EPOCHS):
            for label, at in sample:
                for _ in range(often if label else 1):
                    ftrl.learn(at, label)
        index, value = ftrl.model()
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(value, pa.float64())], names=["index", "value"])

    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    fitted = ordered.mapInArrow(learn, "index long, value double").toPandas()
    return fitted["index"].to_numpy("i8"), fitted["value"].to_numpy("f8")


def scores(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """Per row: doc_id, score between 0 and 1, predicted.

    A null or empty text has the intercept's score, a null doc_id stays null, repeated rows are scored each; no
    other column is read. An empty table gives an empty table.
    """
    index, value = weights

    def run(batches):
        dense = np.zeros((1 << bits) + 1)
        dense[index] = value
        for batch in batches:
            found = []
            for raw in text_bytes(batch, "text"):
                found.append(dense[features(raw, bits)].sum() + dense[-1])
            score = 1 / (1 + np.exp(-np.clip(found, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= PREDICT_AT).astype("i4"), pa.int32())],
                names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, score double, predicted int")


def held_out_rows(doc_id: Column) -> Column:
    """The fixed fold that labels are never learned from: crc32 of the id as text, remainder 1 of 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Without labels of both kinds scores are those of the prior alone."""
    weights = train(docs, labels, held_out_rows(F.col("doc_id")), rows, bits)
    return scores(docs, weights, bits).withColumn("held_out", held_out_rows(F.col("doc_id"))).select(
        "doc_id", "held_out", "score", "predicted")
