"""Repeated substrings: content-defined chunks of a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import text_bytes

# A boundary needs MASK_BITS zero bits: a chunk has MINIMUM bytes and then 2 ** MASK_BITS on average, MAXIMUM at most. A
# repeated passage of 50 words (some 300 bytes) so holds several whole chunks whatever stands before it.
MINIMUM, MASK_BITS, MAXIMUM = 24, 5, 512
# A run of repeated chunks goes from this many bytes on, or if it is the whole text: single chunks are stock phrases that
# independent texts share. A passage of over 50 words keeps a longer run whatever stands around it.
RUN = 128
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype="u8").astype("u4")


def boundaries(raw: bytes, minimum: int = MINIMUM, bits: int = MASK_BITS, maximum: int = MAXIMUM) -> np.ndarray:
    """End offsets of the chunks of a text; the last one is its length.

    The gear hash h = (h << 1) + gear[byte] on 32 bits sees the last 32 bytes only; it is built by doubling, all
    positions at once. A place is a boundary by the high bits, so that inserted bytes shift none of the later ones.
    """
    n = len(raw)
    if not n:
        return np.array([], "i8")
    h = _GEAR[np.frombuffer(raw, "u1")]
    for width in (1, 2, 4, 8, 16):
        if n > width:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    places = (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    ends, start = [], 0
    for place in places:
        while place - start > maximum:
            start += maximum
            ends.append(start)
        if place - start >= minimum:
            ends.append(place)
            start = place
    while n - start > maximum:
        start += maximum
        ends.append(start)
    if start < n:
        ends.append(n)
    return np.array(ends, "i8")


def compared(raw: bytes, minimum: int = MINIMUM, bits: int = MASK_BITS, maximum: int = MAXIMUM) -> list[tuple[int, int]]:
    """Spans (start, end) of a text that are looked for in other texts; together they cover all of its bytes.

    These are its chunks. Only the last one may have less than `minimum` bytes: a few bytes alone would be found anywhere, so
    it counts together with the chunk before it, which is looked for by itself too. A text of one short chunk counts whole.
    """
    ends = boundaries(raw, minimum, bits, maximum).tolist()
    spans = list(zip([0, *ends], ends))
    if len(spans) > 1 and spans[-1][1] - spans[-1][0] < minimum:
        spans[-1] = spans[-2][0], len(raw)
    return spans


def chunks(docs: DataFrame, minimum: int = MINIMUM, bits: int = MASK_BITS, maximum: int = MAXIMUM) -> DataFrame:
    """Per compared span: hi and lo (128-bit digest), doc_id, start, n (bytes)."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch, "text")
            for lo in range(0, len(ids), 64):
                digests, owners, starts, sizes = [], [], [], []
                for doc_id, raw in zip(ids[lo:lo + 64], texts[lo:lo + 64]):
                    if doc_id is None or not raw:
                        continue
                    for start, end in compared(raw, minimum, bits, maximum):
                        digests.append(hashlib.blake2b(raw[start:end], digest_size=16).digest())
                        owners.append(doc_id)
                        starts.append(start)
                        sizes.append(end - start)
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])),
                     pa.array(owners, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                    names=["hi", "lo", "doc_id", "start", "n"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        run, "hi long, lo long, doc_id long, start long, n long")


def repeated_chunks(docs: DataFrame, **sizes: int) -> DataFrame:
    """Chunks to remove: doc_id, start, n, hi, lo of every chunk whose digest also occurs in a smaller doc_id.

    The first document of each digest is found with partial aggregates, so a passage in a third of all documents is one
    row of each task; joined back, its rows are split by adaptive execution.
    """
    found = chunks(docs, **sizes)
    first = (found.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
             .where("first < last").select("hi", "lo", "first"))
    return found.join(first, ["hi", "lo"]).where("doc_id > first").select("doc_id", "start", "n", "hi", "lo")


def runs(spans: list[tuple[int, int]], size: int, shortest: int) -> list[tuple[int, int]]:
    """Maximal runs (start, n) of spans that touch or overlap, of `shortest` bytes or the whole text."""
    out: list[list[int]] = []
    for start, n in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n)
        else:
            out.append([start, start + n])
    return [(a, b - a) for a, b in out if b - a >= min(shortest, size)]


def substring_dedup(docs: DataFrame, run_bytes: int = RUN, **sizes: int) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), text (what is left), duplicated (n_removed > 0).

    A chunk is repeated when a document with a smaller doc_id has it too, and runs of repeated chunks go from `run_bytes` bytes
    on; the first document keeps them. A last chunk of less than `minimum` bytes goes with the chunk before it, a shorter
    text as a whole (see `compared`): exact copies lose all their bytes. Chunks end on any byte, so a removed run is widened to whole code points first. A null text stays null and has no bytes; rows without
    a doc_id are left as they are; repeated rows of a doc_id
    are one document, each is returned and loses the chunks that it has itself. Extra columns are
    not read. An empty table gives an empty table.
    """
    gone = repeated_chunks(docs, **sizes).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "hi", "lo")).alias("gone"))
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").join(gone, "doc_id", "left")

    def run(batches):
        for batch in batches:
            ids, spans = batch.column(0), batch.column(batch.schema.get_field_index("gone")).to_pylist()
            raws = text_bytes(batch, "text")
            out = [cut(raw or b"", runs(own(raw or b"", found or ()), len(raw or b""), run_bytes)) for raw, found in zip(raws, spans)]
            texts = [None if raw is None else kept for raw, (kept, _, _) in zip(raws, out)]
            size = [len(raw or b"") for raw in raws]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()),
                 pa.array(texts, pa.binary()).cast(pa.string()), pa.array([o[1] > 0 for o in out])],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "text", "duplicated"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, text string, duplicated boolean")


def own(raw: bytes, found) -> list[tuple[int, int]]:
    """The spans that this text really has: rows of one doc_id may hold different texts."""
    if not found:
        return []
    return [(s["start"], s["n"]) for s in found if _halves(raw[s["start"]:s["start"] + s["n"]]) == (s["hi"], s["lo"])]


def _halves(chunk: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(chunk, digest_size=16).digest())


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside the spans (start, size), how many went, and in how many runs."""
    if not spans:
        return raw, 0, 0
    gone = np.zeros(len(raw) + 2, "i1")
    for start, n in spans:
        gone[start + 1:min(start + n, len(raw)) + 1] = 1
    data = np.frombuffer(raw, "u1")
    # A code point's later bytes go or stay with its first byte.
    first = (data & 0xC0) != 0x80
    owner = np.maximum.accumulate(np.where(first, np.arange(len(raw)), 0))
    gone[1:-1] = gone[1:-1][owner]
    kept = data[gone[1:-1] == 0].tobytes()
    return kept, len(raw) - len(kept), int((np.diff(gone) == 1).sum())
