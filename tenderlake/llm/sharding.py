"""Sharding: a uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows every partition sends to every target is drawn first, as a uniform permutation of all rows would deal them.
Then each partition permutes its rows and cuts them by its row of that matrix, rows are exchanged, and every target is permuted
again. The matrix is never held: a task draws its own row by halving the partitions, and tasks on the same path draw the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.llm.common import stored

SHARDS, SEED = 24, 20240229
# Rows of a target of the exchange. A shard has as many targets as it needs, so no task sorts a whole shard.
TARGET_ROWS = 1 << 18
# Numpy draws from urns below this size; larger ones are drawn here.
_URN = 10 ** 9


def _log_ratio(a: int, b: int) -> float:
    """log(a! / b!), exact to some 1e-9 where the difference of two logarithms of factorials would not be."""
    if min(a, b) < 100:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    a, b = a + 1, b + 1
    step = a - b
    return step * math.log(b) + (a - 0.5) * math.log1p(step / b) - step + (1 / a - 1 / b) / 12


def draw_large(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """Number of good ones among n drawn from an urn without putting back; for urns of any size, by ratio of uniforms."""
    if min(good, bad, n, good + bad - n) <= 10:
        if n > good + bad - n:
            return good - draw_large(good, bad, good + bad - n, rng)
        if n > 10:  # good and drawn change places without changing the law
            return draw_large(n, good + bad - n, good, rng) if good <= bad else n - draw_large(n, good + bad - n, bad, rng)
        found = 0
        for i in range(n):
            found += int(rng.integers(good + bad - i)) < good - found
        return found
    size = good + bad
    mode = (n + 1) * (good + 1) // (size + 2)
    share = good / size
    spread = math.sqrt((size - n) / (size - 1) * n * share * (1 - share) + 0.5)
    # Constants of the method: Stadlober, The ratio of uniforms approach for generating discrete random variates, 1990.
    middle, width = n * share + 0.5, 1.7155277699214135 * spread + 0.8989161620588988
    while True:
        u, v = rng.random(), rng.random()
        x = middle + width * (v - 0.5) / u if u else -1
        if not max(0, n - bad) <= x < min(good, n) + 1:
            continue
        k = int(x)
        ratio = _log_ratio(mode, k) + _log_ratio(good - mode, good - k) + _log_ratio(n - mode, n - k) + _log_ratio(bad - n + mode, bad - n + k)
        if 2 * math.log(u) <= ratio:
            return k


def draw(colours: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each colour are among n drawn without putting back."""
    if colours.sum() < _URN:
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    out, left = np.zeros_like(colours), int(colours.sum())
    for i, colour in enumerate(colours.tolist()):
        left -= colour
        out[i] = draw_large(colour, left, n, rng) if n and left else min(n, colour)
        n -= int(out[i])
    return out


def matrix_row(sources: np.ndarray, targets: np.ndarray, source: int, seed: int) -> np.ndarray:
    """Row `source` of the matrix whose margins are the rows of all sources and of all targets.

    The sources are halved until one is left; each half's share of every target is drawn with a seed of its own place.
    """
    before = np.concatenate([[0], np.cumsum(sources)])
    lo, hi, left = 0, len(sources), np.asarray(targets, "i8")
    while hi - lo > 1:
        mid = (lo + hi) // 2
        drawn = draw(left, int(before[mid] - before[lo]), np.random.default_rng([seed, lo, hi]))
        lo, hi, left = (lo, mid, drawn) if source < mid else (mid, hi, left - drawn)
    return left


def target_sizes(rows: int, shards: int, target_rows: int = TARGET_ROWS) -> tuple[np.ndarray, int]:
    """Rows of every target, shard by shard, and the number of targets of a shard; shards differ by one row at most."""
    per = max(1, -(-(-(-rows // shards)) // target_rows))
    sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
    return np.array([n // per + (j < n % per) for n in sizes for j in range(per)], "i8"), per


def _numbered(df: DataFrame) -> DataFrame:
    """Rows as a struct, with the number of their partition and their place in it."""
    schema = T.StructType([T.StructField("source", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("row", df.schema["row"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]):
        source, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, source, "i4")), pa.array(np.arange(at, at + n)), batch.column(0)], names=["source", "place", "row"])
            at += n

    return df.mapInArrow(run, schema)


def _dealt(rows: DataFrame, numbers: np.ndarray, counts: np.ndarray, targets: np.ndarray, seed: int) -> DataFrame:
    """Rows with their target: the targets of a partition's row of the matrix, permuted over its places."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, dealt = None, None
        for batch in batches:
            source, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = np.empty(len(source), "i4")
            for number in np.unique(source).tolist():
                if number != held:
                    row = matrix_row(counts, targets, int(np.searchsorted(numbers, number)), seed)
                    dealt = np.random.default_rng([seed, number]).permutation(np.repeat(np.arange(len(targets), dtype="i4"), row))
                    held = number
                mine = source == number
                out[mine] = dealt[place[mine]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=["source", "place", "row", "target"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("target", T.IntegerType())]))


def shuffled(df: DataFrame, shards: int = SHARDS, seed: int = SEED, target_rows: int = TARGET_ROWS) -> DataFrame:
    """All rows and columns, and shard (from 0) and slot (place in the shard, from 0 without gaps).

    Every order of the rows is equally likely, and shards differ by one row at most; rows with equal or null values count
    like others. Rows are written with partition and place first, so a task that runs again deals the same rows alike; seed and
    layout of the input fix the result. Columns named shard or slot are replaced. An empty table gives an empty table, and
    shards without rows are empty. The driver holds one count for each partition.
    """
    rows = stored(_numbered(df.select(F.struct("*").alias("row"))), "numbered")
    found = sorted((r.source, r.n) for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect())
    numbers, counts = np.array([s for s, _ in found], "i8"), np.array([n for _, n in found], "i8")
    total = int(counts.sum())
    targets, per = target_sizes(total, shards, target_rows)
    dealt = _dealt(rows, numbers, counts, targets, seed)
    order = Window.partitionBy("target").orderBy(F.xxhash64(F.lit(seed), "source", "place"), "source", "place")
    shard, turn = F.expr(f"cast(target div {per} as int)"), F.expr(f"target % {per}")
    size = F.lit(total // shards) + (shard < total % shards).cast("bigint")
    before = turn * F.floor(size / per) + F.least(turn, size % per)
    keep = [F.col("row").getField(n).alias(n) for n in df.columns if n.lower() not in ("shard", "slot")]
    return dealt.withColumn("slot", F.row_number().over(order) - 1).select(*keep, shard.alias("shard"), (before + F.col("slot")).cast("bigint").alias("slot"))


def sized(docs: DataFrame) -> tuple[Column, Column]:
    """size (UTF-8 bytes of the text plus 8) and text_crc32 of documents; a null text counts as empty."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")


def document_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law (`rows`), shard, slot and grown_shard (null: that is for the law `key`).

    Only doc_id and the two measures of the text are shuffled. Null texts count as empty, null and repeated doc_ids as rows
    like others; other columns are not read. Equal texts are dealt like different ones, as the law of equal counts asks.
    """
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), *sized(docs))
    return shuffled(narrow, shards, seed, target_rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
