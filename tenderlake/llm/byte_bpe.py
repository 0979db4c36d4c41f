"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tenderlake.llm.common import text_bytes

# Texts longer than this are cut at safe boundaries, so that one call of the library stays small.
PIECE_CHARS = 1 << 16
# Between a word character and a space or line feed: no match of the pattern reaches over this place, and
# none looks back, so both sides split as the whole does.
_SAFE = re.compile(r"(?<=\w)(?=[ \n])")
# White space as the pattern's \s knows it. A long run of it is more than the library's pattern matcher can hold: all
# but its last sign are one match (all of it at the end of a text), which needs no matching.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_WHITE = re.compile(f"[{_WHITE}]{{1000,}}")

ENCODED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.BinaryType()),
])
DIGESTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])


def read_ranks(path: str) -> bytes:
    """The rank file (one base64 token and its rank a line), read by the driver and shipped with the task."""
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes, pattern: str):
    """The library's encoder, made once per task; without special tokens."""
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(encoder, text: str, size: int = PIECE_CHARS) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit integers."""
    out, at = [], 0
    for run in _LONG_WHITE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += _encoded(encoder, text[at:run.start()], size)
        out.append(np.asarray(encoder._encode_single_piece(text[run.start():end]), "<u4"))
        at = end
    return np.concatenate(out + _encoded(encoder, text[at:], size))


def _encoded(encoder, text: str, size: int) -> list[np.ndarray]:
    return [np.asarray(encoder.encode_to_numpy(p, disallowed_special=()), "<u4") for p in pieces(text, size)]


def _mapped(docs: DataFrame, ranks: bytes, pattern: str, schema: T.StructType, finish) -> DataFrame:
    def run(batches):
        encoder = encoding(ranks, pattern)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            # Few rows at a time leave the task, so that ids and texts of a batch never pile up.
            for lo in range(0, len(doc_ids), 256):
                rows = []
                for doc_id, raw in zip(doc_ids[lo:lo + 256], text_bytes(batch.slice(lo, 256), "text")):
                    ids = encode_text(encoder, (raw or b"").decode("utf-8"))
                    rows.append((doc_id, len(ids), *finish(ids, encoder.decode_bytes(ids.tolist()))))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids, and the bytes that the ids decode to.

    A null or empty text has no ids and decodes to nothing; a null doc_id stays null; repeated rows are encoded
    each; other columns are not read. An empty table gives an empty table.
    """
    return _mapped(docs, ranks, pattern, ENCODED, lambda ids, raw: (ids.astype("i8"), raw))


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """As `encode`, with SHA-256 digests in place of the ids (little-endian, 32 bits) and of the decoded bytes."""
    return _mapped(docs, ranks, pattern, DIGESTS,
                   lambda ids, raw: (hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
