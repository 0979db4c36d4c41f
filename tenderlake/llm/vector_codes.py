"""Vector code compression: product codes from Lloyd rounds over partition-local cover trees.

Vectors are cut into equal parts, and every part is coded by the index of the nearest entry of its codebook. Each task keeps
its vectors in blocks, and every block has one cover tree for each part, built once and stored: nodes hold their count and
the sum of their points. In a round an entry gets a whole subtree where the triangle inequality leaves it no rival; only
ambiguous nodes are opened, down to exact comparisons of single points. What leaves a task is one sum for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Vectors of a block: bounds the memory of a task and the work of building a tree, which grows with its square.
BLOCK_ROWS = 1024
# Squares and products of integers up to this bound are exact in double precision.
_EXACT = 2.0 ** 53
# Rounding of square roots is far below this share.
_MARGIN = 1e-9

_TREE = T.StructType([T.StructField(name, T.BinaryType()) for name in ("first", "copy", "up", "center", "radius", "count", "total")])


def _limit(width: int) -> int:
    """Largest component whose squared distances over a part fit into a long."""
    return int(np.sqrt(2.0 ** 62 / max(width, 1))) // 2


def _squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points (rows) to all entries (columns)."""
    most = max(np.abs(points).max(initial=0), np.abs(book).max(initial=0))
    if 4.0 * points.shape[1] * float(most) ** 2 < _EXACT:
        p, b = points.astype("f8"), book.astype("f8")
        return np.einsum("ij,ij->i", p, p)[:, None] - 2 * (p @ b.T) + np.einsum("ij,ij->i", b, b)
    return np.stack([((points - entry) ** 2).sum(axis=1) for entry in book], axis=1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a.astype("f8") - b) ** 2).sum(axis=-1))


def cover_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """The cover tree of a block's points (rows of integers).

    Points are inserted farthest first, so those inserted above a radius of 2 ** k are a net: more than 2 ** k apart, and no
    point is farther from all of them. A point hangs below its nearest point of the next coarser net. Nodes 0 to m - 1 are the
    m different points; then come the inner nodes, finest first, the root last. first: row of each point; copy: point of
    each row; up: parent of each node; center (point), radius (to its farthest point), count and total of each inner node.
    """
    distinct, first, copy, weight = np.unique(points, axis=0, return_index=True, return_inverse=True, return_counts=True)
    m, copy = len(distinct), copy.reshape(-1)
    x = distinct.astype("f8")
    norm = np.einsum("ij,ij->i", x, x)
    start = int(np.argmin(_distance(x, x.mean(axis=0))))
    gap, owner = _distance(x, x[start]), np.full(m, start)
    gap[start] = -1
    hangs, level, net, k = np.full(m, -1), np.zeros(m, "i4"), owner.copy(), None
    for _ in range(m - 1):
        far = int(gap.argmax())
        scale = int(np.floor(np.log2(max(gap[far], 0.5))))
        if k is None or scale < k:
            k, net = scale, owner.copy()
        hangs[far], level[far] = net[far], k
        away = np.sqrt(np.maximum(norm + norm[far] - 2 * (x @ x[far]), 0))
        closer = away < gap
        gap[closer], owner[closer] = away[closer], far
        gap[far] = -1

    up, top, holder = np.full(2 * m, -1), np.arange(m), np.arange(m)
    center, radius, count, total = [np.arange(m)], [np.zeros(m)], [weight.astype("i8")], [distinct.astype("i8") * weight[:, None]]
    size = m
    for k in sorted(set(level[hangs >= 0].tolist())):
        kids = np.flatnonzero((level == k) & (hangs >= 0))
        heads, group = np.unique(hangs[kids], return_inverse=True)
        new = size + np.arange(len(heads))
        up[top[heads]], up[top[kids]] = new, new[group]
        counts, totals = np.concatenate(count), np.concatenate(total)
        n, s = counts[top[heads]], totals[top[heads]]
        np.add.at(n, group, counts[top[kids]])
        np.add.at(s, group, totals[top[kids]])
        holder = np.where(up[holder] >= 0, up[holder], holder)
        moved = np.flatnonzero(holder >= size)
        r = np.zeros(len(heads))
        np.maximum.at(r, holder[moved] - size, _distance(x[moved], x[heads[holder[moved] - size]]))
        for part, values in zip((center, radius, count, total), (heads, r, n, s)):
            part.append(values)
        top[heads] = new
        size += len(heads)
    return {"first": first, "copy": copy, "up": up[:size], "center": np.concatenate(center)[m:], "radius": np.concatenate(radius)[m:],
            "count": np.concatenate([weight, *count[1:]]), "total": np.concatenate(total)[m:]}


_KINDS = {"first": "<i4", "copy": "<i4", "up": "<i4", "center": "<i4", "radius": "<f8", "count": "<i4", "total": "<i8"}


class Block:
    """Vectors of one block as integers (rows), and a tree for each part."""

    def __init__(self, ints: np.ndarray, parts: int, trees: list[dict[str, np.ndarray]] | None = None):
        self.parts = [np.ascontiguousarray(p) for p in np.split(ints, parts, axis=1)]
        self.trees = trees or [cover_tree(p) for p in self.parts]

    def chosen(self, part: int, book: np.ndarray) -> np.ndarray:
        """The entry of each decided node, -1 for opened nodes and for those below decided ones."""
        tree, points = self.trees[part], self.parts[part][self.trees[part]["first"]]
        m, up = len(points), tree["up"]
        center, radius = np.concatenate([np.arange(m), tree["center"]]), np.concatenate([np.zeros(m), tree["radius"]])
        below = np.argsort(up, kind="stable")
        begins = np.searchsorted(up[below], np.arange(len(up) + 1))
        choice, front = np.full(len(up), -1), np.array([len(up) - 1])
        while len(front):
            d = _squares(points[center[front]], book)
            best = d.argmin(axis=1)
            nearest = d[np.arange(len(front)), best]
            rivals = d.astype("f8")
            rivals[np.arange(len(front)), best] = np.inf
            reach = np.sqrt(nearest.astype("f8")) + 2 * radius[front]
            sure = (radius[front] == 0) | (np.sqrt(rivals.min(axis=1)) * (1 - _MARGIN) > reach * (1 + _MARGIN))
            choice[front[sure]] = best[sure]
            opened = front[~sure]
            front = np.concatenate([below[begins[i]:begins[i + 1]] for i in opened]) if len(opened) else opened
        return choice

    def sums(self, part: int, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry: the number of points, and the sum of their components."""
        tree, choice = self.trees[part], self.chosen(part, book)
        m, found = len(tree["first"]), np.flatnonzero(choice >= 0)
        counts, totals = np.zeros(len(book), "i8"), np.zeros(book.shape, "i8")
        np.add.at(counts, choice[found], tree["count"][found])
        leaves, inner = found[found < m], found[found >= m]
        points = self.parts[part][tree["first"]].astype("i8")
        np.add.at(totals, choice[leaves], points[leaves] * tree["count"][leaves][:, None])
        np.add.at(totals, choice[inner], tree["total"][inner - m])
        return counts, totals

    def codes(self, part: int, book: np.ndarray) -> np.ndarray:
        """The entry of each row: that of its nearest decided ancestor."""
        tree, choice = self.trees[part], self.chosen(part, book)
        node = np.arange(len(tree["first"]))
        while (open_ := choice[node] < 0).any():
            node[open_] = tree["up"][node[open_]]
        return choice[node][tree["copy"]]


def _integers(vectors: pa.Array, width: int, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) of list values, filled up with zeros to `width`, in the smallest integer type that holds them."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = np.zeros((len(sizes), width))
    with np.errstate(over="ignore"):
        values[np.arange(width) < sizes[:, None]] = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype("f8"))
    most = _limit(width // parts)
    ints = np.clip(values, -most, most).astype("i8")
    return ints.astype(np.min_scalar_type(-1 - int(np.abs(ints).max(initial=0))))


def _blocks(kept: DataFrame, width: int, parts: int, scale: int, rows: int) -> DataFrame:
    """One row a block: vec_ids, labels, its integers and its trees; every partition by itself, without a shuffle."""
    label = kept.schema["label"].dataType
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("kind", T.StringType()),
        T.StructField("ints", T.BinaryType()), T.StructField("trees", T.ArrayType(_TREE))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def block(rows: pa.Table) -> pa.RecordBatch:
        ints = _integers(rows.column("vector").combine_chunks(), width, parts, scale)
        trees = [{k: v.astype(_KINDS[k]).tobytes() for k, v in t.items()} for t in Block(ints, parts).trees]
        return pa.RecordBatch.from_pylist([{
            "ids": rows.column("vec_id").to_pylist(), "labels": rows.column("label").to_pylist(), "kind": ints.dtype.str,
            "ints": ints.tobytes(), "trees": trees}], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]):
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch])
            held = held if rest is None else pa.concat_tables([rest, held])
            full = len(held) - len(held) % rows
            for at in range(0, full, rows):
                yield block(held.slice(at, rows).combine_chunks())
            rest = held.slice(full)
        if rest is not None and len(rest):
            yield block(rest.combine_chunks())

    return kept.mapInArrow(run, schema)


def _read(batch: pa.RecordBatch, width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for i, row in enumerate(batch.select(["kind", "ints", "trees"]).to_pylist()):
        ints = np.frombuffer(row["ints"], row["kind"]).reshape(-1, width)
        trees = [{k: np.frombuffer(v, _KINDS[k]) for k, v in t.items()} for t in row["trees"]]
        for tree in trees:
            tree["total"] = tree["total"].reshape(-1, width // parts)
        yield batch.slice(i, 1), Block(ints, parts, trees)


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round. Tasks return one sum for each part, entry and place; Spark adds them up."""
    parts, entries, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]):
        sums = np.zeros((parts, entries, w + 1), "i8")
        for batch in batches:
            for _, block in _read(batch, parts * w, parts):
                for p in range(parts):
                    counts, totals = block.sums(p, books[p])
                    sums[p, :, 0] += counts
                    sums[p, :, 1:] += totals
        p, e = np.nonzero(sums[:, :, 0])
        at = (p * entries + e).repeat(w + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.tile(np.arange(w + 1), len(p)), pa.int32()),
                                          pa.array(sums[p, e].reshape(-1), pa.int64())], names=["at", "place", "total"])

    found = blocks.mapInArrow(run, "at int, place int, total bigint").groupBy("at", "place").agg(F.sum("total").alias("total"))
    # At most parts x entries x (width + 1) numbers, whatever the size of the table.
    rows = np.array([tuple(r) for r in found.collect()], "i8").reshape(-1, 3)
    sums = np.zeros((parts * entries, w + 1), "i8")
    sums[rows[:, 0], rows[:, 1]] = rows[:, 2]
    sums = sums.reshape(parts, entries, w + 1)
    counts = sums[:, :, :1]
    return np.where(counts > 0, sums[:, :, 1:] // np.maximum(counts, 1), books)


def _coded(blocks: DataFrame, books: np.ndarray, label: T.DataType) -> DataFrame:
    parts, _, w = books.shape
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row, block in _read(batch, parts * w, parts):
                codes = np.stack([block.codes(p, books[p]) for p in range(parts)], axis=1)
                errors = sum(((block.parts[p].astype("i8") - books[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                yield pa.RecordBatch.from_arrays([
                    row.column("ids").flatten(), row.column("labels").flatten(),
                    pa.array(["".join(f"{c:02x}" for c in r) for r in codes.tolist()]), pa.array(errors, pa.int64())],
                    names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, schema)


def vector_codes(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per vector: vec_id, code (two hex digits a part), error (squared distance), label_error (sum over equal labels) and
    codebooks_sha256 (of the final integer components by part, entry and place).

    Components count as floor(scale * x). Codebooks begin with the parts of the vectors with the smallest ids (null ids last,
    equal ids by their vectors), and `rounds` times every entry moves to the floored mean of its points; unused ones stay.

    Rows whose vector is null or holds null, NaN or infinite components go. Repeated rows and ids count each; null ids and
    labels stay, null labels count as equal. Vectors of unequal length are filled up with zeros to the longest, and that to a
    multiple of `parts`. Scaled components beyond the range whose squared distances fit into a long (2 ** 28 at 16
    components a part) are held at its ends; a label_error beyond a long is null. Other columns are not read. No kept rows
    give an empty table. On the driver are only the codebooks, whose size the parameters fix.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold 1 to 256 entries")
    kept = vectors.select(
        vectors[f"`{id_}`"].cast("bigint").alias("vec_id"), vectors[f"`{vector}`"].cast("array<double>").alias("vector"), vectors[f"`{label}`"].alias("label"),
    ).where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = parts * max(1, -(-longest // parts))
    starts = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not starts:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
                           F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    first = _integers(pa.array([r.vector for r in starts], pa.list_(pa.float64())), width, parts, scale).astype("i8")
    books = first.reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    blocks = stored(_blocks(kept, width, parts, scale, block_rows), "vector-blocks")
    for _ in range(rounds):
        books = _round(blocks, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    codes = stored(_coded(blocks, books, kept.schema["label"].dataType), "vector-codes")
    errors = codes.groupBy(F.col("label").alias("same")).agg(F.try_sum("error").alias("label_error"))
    return codes.join(errors, F.col("label").eqNullSafe(F.col("same")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
