"""Vector codes, conversation tries and sharding against brute force, and on edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import conversation_trie, queries, sharding, vector_codes

SMALL = "/root/testdata/sf0.001"


# --- 11 vector codes

def _brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, integers) in any order; exact Python integers."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(rows[0][1]) // parts
    cut = lambda v: [v[p * width:(p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v in ordered[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v in rows:
                members[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i])] if members[i] else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v in rows:
        found = [near(cut(v)[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, digest


@pytest.mark.parametrize("seed,entries,block", [(1, 256, 1024), (2, 5, 7), (3, 3, 1)])
def test_codes_equal_brute_force(spark, seed, entries, block):
    rng = random.Random(seed)
    centers = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    data = []
    for i in range(120):
        base = rng.choice(centers)
        data.append((rng.randrange(100), [round(x + rng.choice([0, 0, 0.01, -0.3]) * rng.random(), 3) for x in base], rng.choice([None, 1, 2])))
    data += [(500 + i, data[0][1], 1) for i in range(60)]
    got = vector_codes.vector_codes(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3),
                                    entries=entries, block_rows=block).collect()
    want, digest = _brute_codes([(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in data], entries=entries)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(want)
    errors = defaultdict(int)
    for (_, _, label), (_, _, e) in zip(data, want):
        errors[label] += e
    assert {r.codebooks_sha256 for r in got} == {digest}
    assert sorted((r.error, r.label_error) for r in got) == sorted((e, errors[label]) for (_, _, label), (_, _, e) in zip(data, want))


def test_cover_trees_cover_and_separate():
    rng = np.random.default_rng(5)
    points = rng.integers(-50, 50, (300, 3))
    points[100:150] = points[0]
    tree = vector_codes.cover_tree(points)
    first, up = tree["first"], tree["up"]
    m, distinct = len(first), points[first]
    assert len({tuple(p) for p in distinct}) == m and (distinct[tree["copy"]] == points).all()
    assert tree["count"][-1] == 300 and (tree["total"][-1] == points.sum(axis=0)).all() and up[-1] == -1
    center = np.concatenate([np.arange(m), tree["center"]])
    for node in range(len(up) - 1):
        assert up[node] > node
    for i in range(m):
        node = up[i]
        while node >= 0:
            assert np.sqrt(((distinct[i] - distinct[center[node]]) ** 2).sum()) <= tree["radius"][node - m] + 1e-9
            node = up[node]


def test_subtrees_are_assigned_whole(monkeypatch):
    """Far groups need few comparisons, and the sums are those of single points."""
    rng = np.random.default_rng(6)
    groups = rng.integers(-100_000, 100_000, (8, 4))
    points = np.concatenate([g + rng.integers(-20, 20, (200, 4)) for g in groups])
    block, seen = vector_codes.Block(points, 1), []
    exact = vector_codes._squares
    monkeypatch.setattr(vector_codes, "_squares", lambda p, b: seen.append(len(p)) or exact(p, b))
    counts, totals = block.sums(0, groups)
    assert sum(seen) < 100
    owner = exact(points, groups).argmin(axis=1)
    assert (counts == np.bincount(owner, minlength=8)).all() and (totals == np.stack([points[owner == e].sum(axis=0) for e in range(8)])).all()


def test_codes_on_odd_vectors(spark):
    rows = [(1, [0.5, 1.0], "a"), (1, [0.5, 1.0], "a"), (None, [0.25, -0.5, 3.0], None), (2, None, "a"), (3, [1.0, None], "a"), (4, [float("nan")], "a"),
            (5, [float("inf"), 1.0], "a"), (6, [], None), (7, [1e30, -1e300, 5.0, 0.0, 2.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for name in ("code", "error", "labels", "ids", "same", "kept", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    got = vector_codes.vector_codes(df).collect()
    assert sorted(repr(r.vec_id) for r in got) == sorted(map(repr, [1, 1, None, 6, 7])) and all(len(r.code) == 8 and r.error == 0 for r in got)
    assert len({r.codebooks_sha256 for r in got}) == 1
    empty = vector_codes.vector_codes(df.where("vec_id = 2"))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    assert vector_codes.vector_codes(df.limit(0)).count() == 0


# --- 12 conversation trie

def _brute_trie(turns):
    """turns: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn, mark, (role, text)))
    own = {c: [x[3] for x in sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2]))] for c, rows in own.items()}
    paths = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + rows[h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    words = lambda text: len([w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w])
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * (words(node[-1][1]) if node else 0)
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in who if len(paths[c]) == len(node))
        out.append((who[0], len(node), members[node[:-1]][0] if node else None, len(who), children[node], leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _conversations(seed, n=70):
    rng, rows = random.Random(seed), []
    lines = ["hello there", "yes", "", None, "a  b\tc", "system prompt of some words"]
    scripts = [[(rng.choice(["user", "bot", None]), rng.choice(lines)) for _ in range(rng.randint(1, 11))] for _ in range(9)]
    for c in range(n):
        script = list(rng.choice(scripts))[:rng.randint(1, 11)]
        if rng.random() < 0.4:
            script[rng.randrange(len(script))] = ("user", f"own words {rng.randrange(5)}")
        if c not in (20, 40):
            rows += [(c, t if rng.random() > 0.05 else None, role, text) for t, (role, text) in enumerate(script)]
    rows += [(None, 0, "user", "nobody"), (60, 0, "user", "again"), (60, 0, "user", "again")]
    rows += [(1000 + c, t, "bot", f"copy {t}") for c in range(30) for t in range(9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 4), (2, 1), (3, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(conversation_trie, "CHUNK", 2)
    monkeypatch.setattr(conversation_trie, "IDS", 7)
    rows = _conversations(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("pos", "b", "key", "up", "words", "depth", "part", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    got = conversation_trie.conversation_trie(df, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute_trie(rows)


def test_trie_without_turns(spark):
    df = spark.createDataFrame([(21, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert conversation_trie.conversation_trie(df.limit(0)).count() == 0
    # The first turns are those of a conversation that is not there, so nothing is left.
    rows = [(c, 0, "user", "a") for c in range(21, 40)]
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, df.schema)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _brute_trie(rows)
    none = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    one = conversation_trie.conversation_trie(spark.createDataFrame([(none[0], 0, "user", "a")], df.schema)).collect()
    assert [tuple(r)[:7] for r in one] == [(none[0], 0, None, 1, 0, 1, 0)]


# --- 13 sharding

def test_shards_are_whole_and_even(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = queries.shards(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "rows", None) for r in got)


def test_shuffle_keeps_rows_in_small_targets(spark):
    rows = [(i % 50, None if i % 7 == 0 else f"t{i % 3}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    for name in ("shard", "slot", "source", "place", "row", "target", "a.b"):
        df = df.withColumn(name, F.lit(7))
    got = sharding.shuffled(df, 3, target_rows=20)
    assert got.columns == ["doc_id", "text", "source", "place", "row", "target", "a.b", "shard", "slot"]
    found = got.collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in found))) == sorted(map(repr, rows))
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(n)) for s, n in ((0, 334), (1, 333), (2, 333)))
    again = {(r.shard, r.slot): (r.doc_id, r.text) for r in sharding.shuffled(df, 3, seed=1, target_rows=20).collect()}
    assert sum(again[r.shard, r.slot] == (r.doc_id, r.text) for r in found) < 200
    few = sharding.shuffled(spark.createDataFrame([(1,), (1,)], "doc_id long"), 24).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0)]
    assert sharding.shuffled(df.limit(0), 3).count() == 0


def test_matrix_has_its_margins():
    sources, targets = np.array([5, 1, 700, 33, 2, 90, 4]), sharding.target_sizes(835, 24, 10)[0]
    rows = [sharding.matrix_row(sources, targets, p, 3) for p in range(len(sources))]
    assert (np.sum(rows, axis=1) == sources).all() and (np.sum(rows, axis=0) == targets).all()
    sizes, per = sharding.target_sizes(835, 24, 10)
    assert per == 4 and sizes.sum() == 835 and sizes.max() <= 10
    shards = sizes.reshape(24, 4).sum(axis=1)
    assert shards.max() - shards.min() <= 1


def test_matrix_is_drawn_as_a_permutation_deals():
    """Frequencies of one cell over many seeds against the hypergeometric law."""
    sources, targets = np.array([6, 4, 10]), np.array([7, 7, 6])
    cells = Counter(int(sharding.matrix_row(sources, targets, 1, seed)[0]) for seed in range(4000))
    rng = np.random.default_rng(0)
    deck = np.repeat([0, 1, 2], targets)
    want = Counter(int((rng.permutation(deck)[6:10] == 0).sum()) for _ in range(4000))
    assert all(abs(cells[k] - want[k]) < 5 * np.sqrt(2 * max(want[k], 20)) for k in range(5))


@pytest.mark.parametrize("good,bad,n", [(30, 50, 20), (5, 400, 100), (4000, 6000, 3000), (100, 3, 50), (12, 12, 24)])
def test_large_draws_follow_the_law(good, bad, n):
    rng = np.random.default_rng(9)
    got = np.array([sharding.draw_large(good, bad, n, rng) for _ in range(4000)])
    want = rng.hypergeometric(good, bad, n, 4000)
    spread = max(want.std(), 0.01)
    assert abs(got.mean() - want.mean()) < 0.12 * spread and abs(got.std() - want.std()) < 0.08 * spread + 0.01
    low, high = np.quantile(want, [0.1, 0.9])
    assert abs((got <= low).mean() - (want <= low).mean()) < 0.05 and abs((got <= high).mean() - (want <= high).mean()) < 0.05


def test_draws_from_very_large_urns():
    rng = np.random.default_rng(2)
    colours = np.array([4 * 10 ** 10, 10 ** 10, 5 * 10 ** 10])
    drawn = sharding.draw(colours, 10 ** 10, rng)
    assert drawn.sum() == 10 ** 10 and (np.abs(drawn - colours / 10) < 10 ** 6).all()
    assert sharding.draw(colours, int(colours.sum()), rng).tolist() == colours.tolist()


def test_every_place_is_equally_likely(spark):
    """Where the first row of a table goes, over many seeds."""
    df = spark.range(0, 12, numPartitions=3).cache()
    seen = Counter()
    for seed in range(24):
        for r in sharding.shuffled(df, 2, seed, target_rows=3).collect():
            seen[r.id // 4, r.shard] += 1
    assert all(abs(n - 48) < 25 for n in seen.values()) and sum(seen.values()) == 24 * 12
