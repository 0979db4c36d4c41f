"""Near-duplicate documents: bottom-k sketches of one hash function, inverted lists, exact Jaccard.

1. Every document gets its distinct shingle hashes, the k smallest of them (the sketch) and a digest of the whole set.
   Documents with equal sets form a class; only the class's smallest doc_id goes on.
2. Sketches with similarity s share about s * k values. With at least `SHARED` of a sketch's size shared, two sketches have
   a value in common among all but their SHARED * size - 1 most frequent values, so only these (rarest first) go into
   the inverted lists. Frequent passages stay out of them.
3. A list is not paired with itself. One member (the pivot, which has most in common with other documents) is compared
   with the others, by the union of the sketches first, by the whole sets then, and leaves the list. Jaccard distance is a
   metric: members near the pivot and members far from it cannot be linked, so the list falls into a near and a far
   list, and lists within one component end.
4. Documents in lists that are left after some rounds are joined by their whole sets: of two linked sets the smaller one has
   a value in common with the larger among its rarest seventh, and the places of that value bound how much they can
   share. Altered copies of one text that are no near-duplicates of each other meet in next to no list then.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import stored, text_bytes

WORDS, K = 5, 64
# Sketches of linked documents share 0.75 k values, with a deviation of 3.5 at k = 64: 0.45 k is 5.5 deviations below.
SHARED = 0.45
# Smallest estimate that is verified, as far below: a link at 0.75 is estimated lower with a chance of 1.0e-7.
ESTIMATE = 0.45
# Estimated distances from a pivot up to which a text is near it, and beyond which it is far from it; texts between the two
# are both. Linked texts are 0.25 apart at most; at k = 64 they part (one near only, one far only) with a chance of 0.8e-7.
NEAR, FAR = 0.75, 0.12
ROUNDS = 2
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], "u8")


def shingle_set(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than a shingle count as one."""
    # Bytes: lower() and split() know ASCII letters and ASCII white space only.
    tokens = (raw or b"").lower().split()
    n = len(tokens)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens))] if n else [], "u8").view("i8")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), "u8", n)
    mixed = np.zeros(n - words + 1, "u8")
    for j in range(words):
        mixed += hashes[j:n - words + 1 + j] * _ODD[j % len(_ODD)] * np.uint64(2 * (j // len(_ODD)) + 1)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view("i8"))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the whole set, sketch (the k smallest hashes, sorted)."""

    def run(batches):
        for batch in batches:
            sizes, digests, heads = [], [], []
            for raw in text_bytes(batch, "text"):
                s = shingle_set(raw, words)
                sizes.append(len(s))
                digests.append(set_digest(s))
                heads.append(s[:k].copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(heads, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sketch"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def full_sets(wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, shingles) of rows (doc_id, digest, text): all hashes of the sets that have the digest."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(raw, words) for raw in text_bytes(batch, "text")]
            own = [i for i, (s, d) in enumerate(zip(found, batch.column(1).to_pylist())) if set_digest(s) == d]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own, pa.int64())), pa.array([found[i] for i in own], pa.list_(pa.int64()))],
                names=["id", "shingles"])

    return wanted.select("doc_id", "digest", "text").mapInArrow(run, "id long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b): the smallest id reachable.

    Rounds of neighbour minimum and pointer jumping over stored tables; only a count reaches the driver.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")), "labels")
    while True:
        near = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("n"))
        step = label.join(near, "a").select("a", F.col("l").alias("old"), F.least("l", "n").alias("l"))
        up = step.select(F.col("a").alias("l"), F.col("l").alias("up"))
        label = stored(step.join(up, "l", "left").select("a", "old", F.coalesce("up", "l").alias("l")), "labels")
        changed = label.where("l <> old").limit(1).count()
        label = label.select("a", "l")
        if not changed:
            return label.select(F.col("a").alias("id"), F.col("l").alias("component"))


def _lists(reps: DataFrame) -> DataFrame:
    """(list, id, weight): the inverted lists of the rarer sketch values, lists of one left out.

    The weight tells how much of a document occurs elsewhere: a text that others were copied from has more of it than
    its altered copies.
    """
    values = reps.select("id", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ranked = values.join(often, "v").groupBy("id", "s").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # Values of one document only come first in the order and find nobody.
    least = F.ceil(F.col("s") * F.lit(SHARED)).cast("int")
    # Bits of frequency: a line that everybody has weighs little more than one of a few hundred copies.
    weight = F.aggregate("vs", F.lit(0).cast("long"), lambda total, x: total + F.round(F.log2(x["df"]) * 16).cast("long"))
    kept = ranked.withColumn("n", F.size("vs") - least + 1).where("n > 0").withColumn("weight", weight)
    return kept.select(F.explode(F.slice("vs", 1, F.col("n"))).alias("x"), "id", "weight").select(F.col("x.v").alias("list"), "id", "weight")


def _estimated(pairs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) with the similarity that the union of the two sketches shows, and both set sizes."""
    one = reps.select(F.col("id").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("na"))
    two = reps.select(F.col("id").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("nb"))
    union = F.slice(F.sort_array(F.array_union("x", "y")), 1, k)
    both = pairs.join(two, "b").join(one, "a").withColumn("u", union)
    shared = F.size(F.array_intersect("u", F.array_intersect("x", "y")))
    return both.select("a", "b", "na", "nb", (shared / F.size("u")).alias("j"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    second = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = second.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("i", shared).where(F.expr(f"100 * i >= {percent} * (na + nb - i)")).select("a", "b")


def _sets_of(docs: DataFrame, reps: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of some representatives; a repeated row of a document is read once."""
    wanted = reps.join(ids.distinct(), "id", "left_semi").select(F.col("id").alias("doc_id"), "digest")
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return full_sets(texts.join(wanted, "doc_id").dropDuplicates(["doc_id", "text"]), words)


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): pairs of different components c that may be linked, by the rarest values of the whole sets.

    With the values of all sets in one order, rarest first, the smaller set a and the larger b of a linked pair have
    their first common value at places i and j with at most min(na - i, nb - j) common values behind it.
    """
    need = 2 * percent / (100 + percent)
    values = sets.select("id", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ranked = values.join(often, "v").groupBy("id", "c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # Values of one set only come first in the order.
    at = ranked.withColumn("single", F.col("n") - F.size("vs")).select("id", "c", "n", "single", F.posexplode("vs").alias("k", "x"))
    placed = at.select("id", "c", "n", (F.col("single") + F.col("k")).alias("i"), F.col("x.v").alias("v"))
    probing = placed.where(f"i <= n - ceil({percent / 100} * n - 1e-9)")
    small = probing.where(f"i <= n - ceil({need} * n - 1e-9)").toDF("a", "ca", "na", "i", "v")
    large = probing.toDF("b", "cb", "nb", "j", "v")
    fits = (f"ca <> cb and (na < nb or (na = nb and a < b)) and 100 * na >= {percent} * nb "
            f"and least(na - i, nb - j) >= ceil({percent} * (na + nb) / {100 + percent} - 1e-9)")
    return small.join(large, "v").where(fits).select("a", "b", "na", "nb").distinct()


def near_duplicates(docs: DataFrame, k: int = K, words: int = WORDS, percent: int = 75, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Empty and null texts have no shingles and are linked with nothing. Rows without a doc_id are linked with nothing
    either: component_id is null and they are kept. Repeated rows of a doc_id count as one document, and each row
    is returned; should their texts differ, the one with the smallest digest stands for the document. Other columns
    are not read. An empty table gives an empty table.
    """
    table = stored(sketches(docs, k, words), "sketches")
    named = table.where("doc_id is not null and n_shingles > 0")
    documents = stored(named.groupBy("doc_id").agg(F.min("digest").alias("digest")), "texts")
    classes = stored(documents.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    first = classes.select("id", F.col("digest").alias("own"))
    reps = stored(
        named.withColumnRenamed("doc_id", "id").join(first, "id").where("digest = own").drop("own").dropDuplicates(["id"]),
        "representatives")
    lists = stored(_lists(reps).withColumn("c", F.col("id")).withColumn("done", F.lit(None).cast("long")), "lists")
    # Only documents in some list go on.
    reps = stored(reps.join(lists.select("id").distinct(), "id", "left_semi"), "listed")
    edges = tested = comp = None
    for number in range(rounds):
        # The pivot is outside the component of the pivot before, if any: two of one component need no comparison.
        order = F.struct((F.col("c") != F.coalesce("done", F.lit(-1))).alias("fresh"), "weight", (-F.col("id")).alias("low"))
        pivots = lists.groupBy("list").agg(F.max(order).alias("p")).select("list", (-F.col("p.low")).alias("a"))
        members = stored(lists.join(pivots, "list").where("id <> a").withColumnRenamed("id", "b"), "members")
        # A pair is one, whichever of the two was the pivot.
        pairs = members.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        estimates = stored(_estimated(pairs, reps, k), "estimates")
        close = estimates.where(f"j >= {ESTIMATE} and 100 * least(na, nb) >= {percent} * greatest(na, nb)")
        if comp is not None:
            labels = comp.select("id", "component")
            close = (close.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
                     .where("coalesce(ca, a) <> coalesce(cb, b)").drop("ca", "cb"))
        close = stored(close, "close")
        sets = stored(_sets_of(docs, reps, close.select(F.col("a").alias("id")).union(close.select("b")), words), "sets")
        found = _verified(close, sets, percent)
        edges = stored(found if edges is None else edges.unionByName(found), "edges")
        comp = components(edges)
        tested = estimates if tested is None else stored(tested.unionByName(estimates), "tested")
        # |d(a, x) - d(a, y)| <= d(x, y): beyond 0.25 and an allowance for the estimates no link is possible.
        far = tested.select(F.col("a").alias("lo"), F.col("b").alias("hi"), (1 - F.col("j")).alias("far"))
        gone = (members.drop("c").withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(far, ["lo", "hi"])
                .select("list", F.col("b").alias("id"), "weight", "far", "a"))
        near = gone.where(f"far <= {NEAR}").withColumn("list", F.xxhash64("list", F.lit("near")))
        beyond = gone.where(f"far > {FAR}").withColumn("list", F.xxhash64("list", F.lit("far")))
        labels = comp.select("id", "component")
        left = (near.unionByName(beyond).join(labels, "id", "left").join(labels.toDF("a", "ca"), "a", "left")
                .select("list", "id", "weight", F.coalesce("component", "id").alias("c"), F.coalesce("ca", "a").alias("done")))
        mixed = left.groupBy("list").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("list")
        lists = stored(left.join(mixed, "list", "left_semi"), "lists")
        if not lists.limit(1).count():
            break
    else:
        open_ids = stored(lists.groupBy("id").agg(F.min("c").alias("c")), "open")
        sets = stored(_sets_of(docs, reps, open_ids.select("id"), words), "open-sets")
        found = _verified(stored(_prefix_pairs(sets.join(open_ids, "id"), percent), "pairs"), sets, percent)
        edges = stored(found if edges is None else edges.unionByName(found), "edges")
        comp = components(edges)
    groups = classes.join(comp, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    found = documents.join(groups, "digest").select("doc_id", "component")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = table.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, **options: int) -> DataFrame:
    """`docs` with one document of each group of near-duplicates, that of the smallest doc_id, and one row of it."""
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    named = docs.where("doc_id is not null").select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"))
    left = named.join(gone, F.col("id") == F.col("gone"), "left_anti")
    # Rows that repeat a doc_id: the first by the order of their columns, of what has no order as JSON.
    order = [F.to_json(F.struct(F.col("doc").getField(f.name).alias("x"))) if re.search("map<|variant", f.dataType.simpleString())
             else F.col("doc").getField(f.name) for f in docs.schema.fields]
    first = left.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("n = 1").select("doc.*")
    return first.unionByName(docs.where("doc_id is null"))
