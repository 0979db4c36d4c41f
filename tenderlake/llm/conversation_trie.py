"""Conversation prefix trie by hashes of fixed-length blocks of turns.

Every conversation is cut into blocks of BLOCK turns. Conversations are grouped by the digest of all blocks up to one, so a
group is a node of a trie of blocks. Where a block has no sibling, its turns are a chain that all its conversations share;
only siblings, where conversations part, are refined to turns. Nothing walks the trie: a node has its smallest conversation
as owner, an owner's nodes are the end of its path, and sums over a subtree are sums over the owners among its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import stored, white_words

# Turns of a block.
BLOCK = 4
# Rows of one key that a window holds; a key's further rows get the sums of the chunks before them.
CHUNK = 1024
# Ids of one text that is hashed; longer lists are hashed text by text.
IDS = 4096
# Conversations that share the first turns of one, and the most turns they take from it.
FAMILY, HEAD = 20, 3


def _running(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Sums of columns over the rows of a key up to each row, by a whole number from 0 that orders them.

    A window sees one chunk of a key, and one row for each chunk: a key may hold any share of the rows.
    """
    df = df.withColumn("chunk", F.floor(F.col(order) / CHUNK))
    inside = Window.partitionBy(key, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = df.groupBy(key, "chunk").agg(*(F.sum(c).alias(f"{c}_chunk") for c in columns))
    chunks = chunks.select(key, "chunk", *(F.coalesce(F.sum(f"{c}_chunk").over(earlier), F.lit(0)).alias(f"{c}_before") for c in columns))
    summed = df.withColumns({c: F.sum(c).over(inside) for c in columns}).join(chunks, [key, "chunk"])
    return summed.withColumns({c: F.col(c) + F.col(f"{c}_before") for c in columns}).drop("chunk", *(f"{c}_before" for c in columns))


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest (128 bits of role and text) and words of every turn of a conversation with an id.

    By turn, null first; equal turns by their digests. Turns are dealt by ranges of id and turn, so a conversation of any
    length is spread, and numbered by counts of its turns in earlier ranges.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        conversations["conv_id"].cast("bigint").alias("conv_id"), conversations["turn"].cast("bigint").alias("turn"),
        _digest(F.concat_ws(":", F.length(role), role, text)).alias("digest"), F.size(white_words(text)).cast("bigint").alias("words"),
    ).where("conv_id is not null")
    order = ["conv_id", "turn", "digest"]
    rows = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "digest", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).select("conv_id", "part", "shift")
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, family: int = FAMILY, most: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Turns (as of `ordered_turns`) and conversations (conv_id, length) after the heads are shared.

    A conversation c takes the first h turns of conversation c - c % family (all if it has fewer, none if it is absent) in
    place of its own first h; h is the unsigned CRC-32 of c in decimal, modulo `most` + 1.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % family
    bases = sizes.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = sizes.select("conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h"))
    heads = heads.join(bases, "base", "left").select("conv_id", "n", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") <= most)).withColumnRenamed("conv_id", "base")
    head = first.join(heads.select("conv_id", "base", "h"), "base").where("pos <= h").select("conv_id", "pos", "digest", "words")
    own = turns.join(heads.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    return head.unionByName(own), heads.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


_LANES = ["lane0", "lane1", "lane2", "lane3"]
_ROOT = "0-0-0-0"


def blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for every block of a conversation: conv_id, b (from 0), up and key (digests of all turns before it, and up to
    its end), turns (digest and words of each).

    The digest of a path is the sum of its blocks' numbered 128-bit digests in four lanes, so that paths of any length are summed in parts.
    """
    b = F.floor((F.col("pos") - 1) / block)
    rows = turns.groupBy("conv_id", b.alias("b")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"))
    digest = F.sha2(F.concat_ws(":", "b", F.array_join(F.col("turns.digest"), "")).cast("binary"), 256)
    lanes = {c: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i, c in enumerate(_LANES)}
    rows = rows.withColumns(lanes).withColumns({f"own{i}": F.col(c) for i, c in enumerate(_LANES)})
    rows = _running(rows, "conv_id", "b", _LANES)
    return rows.select(
        "conv_id", "b", F.concat_ws("-", *(F.col(c) - F.col(f"own{i}") for i, c in enumerate(_LANES))).alias("up"),
        F.concat_ws("-", *_LANES).alias("key"), F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def _turns_of(groups: DataFrame, *values: str) -> DataFrame:
    """A row for each turn t (from 0) of a group's block, with its words and the digests of the block's turns up to and before it."""
    start = lambda n: F.sha2(F.array_join(F.slice(F.col("turns.digest"), 1, n), "").cast("binary"), 256)
    return groups.select("b", "up", *values, "turns", F.posexplode("turns.words").alias("t", "words")).select(
        "b", "up", *values, "t", "words", start(F.col("t") + 1).alias("till"), start(F.col("t")).alias("since"))


def _ids_digests(lists: DataFrame) -> DataFrame:
    """conv_id, depth and SHA-256 of the texts of a node (conv_id, depth, part, ids) in order, joined by commas; one text at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]):
        node, state, done = None, None, []
        for batch in batches:
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if (conv, depth) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (conv, depth), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [[]] * 3, kinds)], names=names)
            done = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), kinds)], names=names)

    kinds, names = (pa.int64(), pa.int64(), pa.string()), ["conv_id", "depth", "ends_sha256"]
    order = ["conv_id", "depth", "part"]
    return lists.select(*order, "ids").repartition("conv_id", "depth").sortWithinPartitions(*order).mapInArrow(
        run, "conv_id bigint, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of conversations: turns (conv_id, pos from 1 without gaps, digest, words) and lengths (conv_id, length).

    Per distinct sequence of first turns: conv_id (its smallest member), depth, parent_conv_id (null at the root), n_convs
    (members), n_children, n_leaves (childless nodes in its subtree), saved_tokens (over its subtree, members beyond the first
    times words of the last turn) and ends_sha256 (of the ids, in order and joined by commas, that end there). conv_id and
    depth name a node. No conversations give no nodes, not even a root.
    """
    whole = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    paths = stored(blocks(turns, block), "paths")
    groups = paths.groupBy("b", "up", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("turns").alias("turns"))
    groups = stored(groups, "groups")
    siblings = groups.groupBy("b", "up").agg(F.count("*").alias("siblings"))
    above = groups.select((F.col("b") + 1).alias("b"), F.col("key").alias("up"), F.col("conv_id").alias("above"))
    # A block that very many others follow is one row on the right. Both sides of the join are read from tables and its
    # rows are written at once, so that Spark may split the many rows on the left at run time.
    parents = stored(siblings.join(above, ["b", "up"], "left"), "parents")
    kin = groups.join(parents, ["b", "up"])
    kin = stored(kin.withColumn("above", F.when(F.col("b") == 0, F.lit(whole.conv_id)).otherwise(F.col("above"))), "kin")
    alone, parting = kin.where("siblings = 1"), kin.where("siblings > 1")
    depth = (F.col("b") * block + F.col("t") + 1).alias("depth")

    # A block without siblings: its turns have the same members.
    chains = alone.select("b", "key", "conv_id", "n", "above", F.posexplode("turns.words").alias("t", "words")).select(
        "conv_id", depth, F.when(F.col("t") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "words")
    # Siblings: their turns are grouped by what stands before and up to them.
    split = stored(_turns_of(parting, "conv_id", "n", "above").groupBy("b", "up", "t", "till").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("words").alias("words"),
        F.first("since").alias("since"), F.first("above").alias("above")), "split")
    before = split.select("b", "up", (F.col("t") + 1).alias("t"), F.col("till").alias("since"), F.col("conv_id").alias("before"))
    refined = split.join(before, ["b", "up", "t", "since"], "left").select(
        "conv_id", depth, F.when(F.col("t") == 0, F.col("above")).otherwise(F.col("before")).alias("parent_conv_id"), "n_convs", "words")
    root = lengths.sparkSession.createDataFrame(
        [(whole.conv_id, 0, None, whole.n, 0)] if whole.n else [], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, words bigint")
    nodes = chains.unionByName(refined).unionByName(root)
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("words")}).drop("words")
    nodes = stored(nodes, "nodes")

    # What an owner's nodes add to every node on its path; a node's own owner adds only what lies from there on.
    owners = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaves"))
    weight = paths.select("conv_id", "b", "key").join(owners, "conv_id").groupBy("b", "key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    weighed = kin.join(weight, ["b", "key"])
    below = weighed.where("siblings = 1").select("conv_id", "b", "saved", "leaves", F.posexplode("turns.words").alias("t", "words")).select(
        "conv_id", depth, "saved", "leaves")
    below = below.unionByName(_turns_of(weighed.where("siblings > 1"), "conv_id", "saved", "leaves").groupBy("b", "up", "t", "till").agg(
        F.min("conv_id").alias("conv_id"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).select("conv_id", depth, "saved", "leaves"))
    everything = owners.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).where("leaves is not null")
    below = below.unionByName(everything.select(F.lit(whole.conv_id).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), "saved", "leaves"))
    passed = _running(nodes.select("conv_id", "depth", "saved", F.col("saved").alias("own")), "conv_id", "depth", ["saved"]).select(
        "conv_id", "depth", (F.col("saved") - F.col("own")).alias("passed"))

    # Ends: short lists of ids, each as one text, and one node's texts in order.
    ids = lambda: F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    part = F.expr(f"conv_id div {IDS}").alias("part")
    last = paths.join(lengths, "conv_id").where((F.col("b") + 1) * block >= F.col("length")).groupBy("b", "key", part).agg(ids())
    end_of = kin.select("b", "key", "up", "siblings", F.size("turns").alias("m"), "conv_id",
                        F.sha2(F.array_join(F.col("turns.digest"), "").cast("binary"), 256).alias("till"))
    ending = split.select("b", "up", F.expr("t + 1").alias("m"), "till", F.col("conv_id").alias("owner"))
    end_of = end_of.join(ending, ["b", "up", "m", "till"], "left").select(
        "b", "key", F.coalesce("owner", "conv_id").alias("conv_id"), (F.col("b") * block + F.col("m")).alias("depth"))
    lists = last.join(end_of, ["b", "key"]).select("conv_id", "depth", "part", "ids")
    at_root = lengths.where("length = 0").groupBy(part).agg(ids()).select(
        F.lit(whole.conv_id).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), "part", "ids")
    ends = _ids_digests(lists.unionByName(at_root))

    here = ["conv_id", "depth"]
    return nodes.drop("saved").join(below, here, "left").join(passed, here, "left").join(ends, here, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(0)).alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) - F.col("passed")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, family: int = FAMILY, most: int = HEAD, block: int = BLOCK) -> DataFrame:
    """The trie (see `prefix_trie`) of conversations (conv_id, turn, role, text) whose heads are shared (see `rebuilt`).

    Turns without conv_id belong to no conversation. A null role or text counts as empty, a null turn comes first, equal
    turns of a conversation stay, ordered by their digests, and a repeated row is another turn. Texts are hashed whole and
    not kept. Other columns are not read. An empty table gives an empty table.
    """
    turns = stored(ordered_turns(conversations), "ordered")
    path, lengths = rebuilt(turns, family, most)
    return prefix_trie(path, stored(lengths, "lengths"), block)
