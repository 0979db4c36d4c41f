"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import (byte_bpe, decontamination, html_extraction, minhash_dedup, quality_rules, queries, secret_scans,
                            substring_dedup, suffix_dedup, toxicity, url_filters)

LONG = " ".join(f"w{i % 700}" for i in range(60_000))
PASSAGE = "a passage of more than fifty bytes that several of the documents share word for word"
TEXTS = [
    (1, f"Intro one. {PASSAGE} and its own end"), (2, f"Another start, {PASSAGE} with another end"), (3, None), (4, ""),
    (5, " \t\n "), (None, f"nobody {PASSAGE}"), (6, "twice the same row"), (6, "twice the same row"), (7, LONG), (8, LONG + " tail"),
    (9, "ééé ßß 漢字 🎉 " * 30), (10, "#$%&|<> * ** x"), (11, "A b C d"), (12, "a B c D"),
]
# Columns that the operators use inside.
CLASH = ("words", "n", "id", "key", "digest", "found", "doc", "weights", "text_key", "hash", "window", "value", "list", "gone", "items", "a", "b")


def documents(spark, rows=TEXTS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASH:
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text"))


def labels(spark, rows=((1, 1, 0), (2, 1, 1), (None, 1, 1), (3, None, None), (6, 0, 0), (6, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items(spark, rows=((1, PASSAGE), (2, None), (3, ""), (None, "twice the same row"), (4, "c d"), (4, "c d"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_quality_measures(spark):
    got = quality_rules.quality(documents(spark), labels(spark)).collect()
    assert len(got) == len(TEXTS)
    want = sorted((repr((d, *brute.base_measures(t))) for d, t in TEXTS))
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_without_rows_or_labels(spark):
    assert quality_rules.quality(documents(spark).limit(0), labels(spark)).count() == 0
    got = quality_rules.quality(documents(spark), labels(spark).limit(0))
    assert got.where("kept = base_failed").count() == 0
    kept = quality_rules.keep(documents(spark), labels(spark))
    assert kept.columns == documents(spark).columns


def test_repeated_windows(spark):
    rows = [(i, t) for i, t in enumerate(["a a a a", "a b c a b c", "a b c x a b c d", "a b", "x y z " * 40, "p q r s p q r t q r s"])]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark)).collect()}
    assert got == {d: brute.base_measures(t)[4] for d, t in rows}


def test_contamination(spark):
    got = decontamination.contamination(documents(spark), items(spark)).collect()
    for r in got:
        text = [t for d, t in TEXTS if d == r.doc_id][0]
        words, hit, found = brute.contamination([(0, text)], [(1, PASSAGE), (None, "twice the same row"), (4, "c d")])[0]
        assert (r.n_words, r.n_hit, r["items"]) == (words, hit, found), r
    assert len(got) == len(TEXTS)
    assert {r.doc_id: r.n_hit for r in got}[6] == 4 and {r.doc_id: r.n_hit for r in got}[11] == 2
    assert decontamination.contamination(documents(spark).limit(0), items(spark)).count() == 0
    assert decontamination.contamination(documents(spark), items(spark).limit(0)).where("n_hit > 0").count() == 0


def test_decontaminate_documents_and_spans(spark):
    docs = documents(spark)
    kept = decontamination.decontaminate(docs, items(spark))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 7, 8, 9, 10}
    cut = decontamination.decontaminate(docs, items(spark), remove="spans")
    assert cut.columns == docs.columns and cut.count() == len(TEXTS)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == "Intro one. and its own end" and texts[2] == "Another start, with another end" and texts[11] == "A b "
    assert texts[7] == LONG and texts[3] is None


def test_a_full_hash_set_lets_the_join_decide(spark, monkeypatch):
    table = decontamination.hash_set
    monkeypatch.setattr(decontamination, "hash_set", lambda items, n: table(items, n, 64))
    got = decontamination.contamination(documents(spark), items(spark))
    assert {r.doc_id for r in got.where("n_hit > 0").collect()} == {1, 2, None, 6, 11, 12}


SECRET = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def test_secrets(spark):
    rows = [*TEXTS, (20, f'x token = "{SECRET}" y'), (20, f'x token = "{SECRET}" y'), (21, f"api_key: {SECRET.upper()}"),
            (22, "a perfectlyharmlesslongword here"), (23, "number 4952935900253052 here")]
    rows += [(100 + i, f'k token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and extraordinarilylong{"abcdefgh"[i % 8]}word') for i in range(40)]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in secret_scans.redacted(docs).collect()}
    assert got[20].n_secrets == 1 and got[20].text == 'x token = "[SECRET]" y'
    assert got[21].text == "api_key: [SECRET]" and got[22].n_secrets == 0 and got[23].n_secrets == 0
    assert all(got[100 + i].n_secrets == 1 for i in range(40))
    assert got[3].text is None and got[4].text == "" and got[7].text == LONG
    whole = secret_scans.redact(docs)
    assert whole.columns == docs.columns and whole.count() == len(rows)
    assert whole.where(F.col("text").contains(SECRET)).count() == 0
    assert secret_scans.redacted(docs.limit(0)).count() == 0


def test_secrets_without_both_labels(spark):
    docs = documents(spark, [(1, f'token = "{SECRET}"'), (2, "words only")])
    assert {r.doc_id: r.n_secrets for r in secret_scans.redacted(docs).collect()} == {1: 1, 2: 0}
    given = spark.createDataFrame([(SECRET, 0)], "value string, label int")
    assert secret_scans.scan(docs, given).count() == 1


PAGES = [(1, "https://www.Example.com/en/148.html?x#y", "<p>a"), (2, "http://m.site.net/es/5/", None), (3, None, ""), (4, "no scheme", "<div>"),
         (None, "x://host", "<article><p>b</article>"), (5, "http://example.com/en/1", "a < b"), (5, "http://example.com/en/1", "a < b"),
         (6, "http://com/", "&lt;p&gt;"), (7, "http://notexample.com/en/1", "<p>c"), (8, "http://a.net#/es/", "x")]


def pages(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "path", "rule", "template", "n", "good", "wrapper", "text", "verdict"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def test_url_rules(spark):
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filters.url_verdicts(pages(spark)).collect()}
    assert got[1, "www.example.com", "/en/148.html"] == ("www.example.com/en/", "allow")
    assert got[2, "m.site.net", "/es/5/"] == ("net/es/", "block")
    assert got[3, "", ""] == (None, "allow") and got[4, "", ""] == (None, "allow") and got[None, "host", ""] == (None, "allow")
    assert got[5, "example.com", "/en/1"] == ("example.com/en/", "block")
    assert got[6, "com", "/"] == ("com/", "allow") and got[7, "notexample.com", "/en/1"] == ("com/", "allow")
    assert got[8, "a.net", ""] == (None, "allow")
    assert url_filters.url_verdicts(pages(spark)).count() == len(PAGES)
    assert url_filters.url_verdicts(pages(spark).limit(0)).count() == 0


def test_url_templates(spark):
    rows = [(i, f"http://h.org/spam/{i}/x", "") for i in range(40)] + [(100 + i, f"http://h.org/good/{i}", "") for i in range(40)]
    rows += [(200, "http://h.org/spam/999/y", ""), (201, "http://h.org/rare", "")]
    given = spark.createDataFrame([(u, 0 if "spam" in u else 1) for i, u, _ in rows if i < 200 and i % 2], "url string, good int")
    got = {r.page_id: r for r in url_filters.url_verdicts(pages(spark, rows), labels=given).collect()}
    assert got[2].verdict == "block" and got[2].template == "/spam/*/x" and got[102].verdict == "allow"
    assert got[102].template == "/good/*" and got[201].verdict == "allow" and got[200].verdict == "allow"


def test_labels_reach_branches_without_any(spark):
    """Sections of one shape and size are judged together; one of another shape, or of far more pages, is not."""
    rows = [(1000 * k + i, f"http://h.net/{s}/{i}.html", "") for k, s in enumerate(("es", "fr", "it")) for i in range(20)]
    rows += [(5000 + i, f"http://h.net/docs/{i}/intro", "") for i in range(20)] + [(6000 + i, f"http://h.net/big/{i}.html", "") for i in range(900)]
    got = url_filters.url_verdicts(pages(spark, rows))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "template"]
    found = {r.page_id: (r.verdict, r.template) for r in got.collect()}
    rows = [(i, u, h) for i, u, h in rows if i < 6000]
    alone = {r.page_id: (r.verdict, r.template) for r in url_filters.url_verdicts(pages(spark, rows)).collect()}
    assert alone[2000] == ("block", "/*/*") and alone[5000][0] == "allow" and found[6000][0] == "allow"


def test_extraction(spark):
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extraction.main_texts(pages(spark)).collect()}
    assert got[1, PAGES[0][1]] == ("a", 1) and got[2, PAGES[1][1]] == ("", 0) and got[3, None] == ("", 0)
    assert got[None, "x://host"] == ("b", 1) and got[5, PAGES[5][1]] == ("a < b", 5) and got[6, "http://com/"] == ("<p>", 3)
    assert html_extraction.main_texts(pages(spark)).count() == len(PAGES)
    assert html_extraction.main_texts(pages(spark).limit(0)).count() == 0


def test_substrings(spark):
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(documents(spark)).collect()}
    want = brute.covered([(d, t) for d, t in dict(TEXTS).items() if d is not None])
    for d, (size, removed, spans, sha) in want.items():
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, hashlib.sha256(bytes(got[d].kept)).hexdigest()) == (size, removed, spans, sha), d
    assert got[None].n_removed == 0 and got[2].n_removed > 50
    assert suffix_dedup.suffix_dedup(documents(spark)).count() == len(TEXTS)
    assert suffix_dedup.suffix_dedup(documents(spark).limit(0)).count() == 0


def test_chunks(spark):
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(documents(spark)).collect()}
    assert got[8].n_removed > 0.9 * len(LONG) and got[7].n_removed < got[7].n_bytes
    assert got[3].text is None and got[4].text == "" and not got[None].duplicated and not got[1].duplicated
    assert substring_dedup.substring_dedup(documents(spark)).count() == len(TEXTS)
    assert substring_dedup.substring_dedup(documents(spark).limit(0)).count() == 0


def test_toxicity(spark):
    got = toxicity.toxicity(documents(spark), labels(spark))
    assert got.count() == len(TEXTS) and got.where("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    assert toxicity.toxicity(documents(spark), labels(spark).limit(0)).where("score <> 0.5").count() == 0
    assert toxicity.toxicity(documents(spark).limit(0), labels(spark)).count() == 0


def test_encoding(spark):
    pytest.importorskip("tiktoken")
    got = byte_bpe.encode(documents(spark), *queries.tokenizer()).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        text = [t for d, t in TEXTS if d == r.doc_id][0] or ""
        assert bytes(r.decoded).decode() == text and r.n_tokens == len(r.ids) and (r.n_tokens > 0) == bool(text)
    assert byte_bpe.digests(documents(spark).limit(0), *queries.tokenizer()).count() == 0


def test_near_duplicates(spark):
    got = minhash_dedup.near_duplicates(documents(spark)).collect()
    assert len(got) == len(TEXTS)
    want = brute.near_duplicates([(d, t) for d, t in dict(TEXTS).items() if d is not None])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert want[8][1] == 7 and want[12][1] == 11
    kept = minhash_dedup.keep(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, [1, 2, 3, 4, 5, None, 6, 7, 9, 10, 11]))
    assert minhash_dedup.near_duplicates(documents(spark).limit(0)).count() == 0


WHOLE_PAGES = {
    "form": "<body><form><nav>menu</nav><article><p>One.</p><p>Two.</p></article><button>b</button></form></body>",
    "layout": '<body class="page with-sidebar"><article><p>One.</p><p>Two.</p></article><div class="sidebar">x</div></body>',
    "state": '<html class="cookie-accepted"><body><article><p>One.</p><p>Two.</p></article></body></html>',
    "paragraphs": '<article><p class="ad-hoc">One.</p><p class="share-price">Two.</p><p class="advert">buy</p></article>',
    "wrapper": '<div class="with-sidebar"><main><p>One.</p><p>Two.</p><div class="comments"><p>c</p></div></main><aside>a</aside></div>',
    "unmarked": '<body class="page with-sidebar"><form><div class="menu">m</div><div><p>One.</p><p>Two.</p></div><div class="widget-box">w</div></form></body>',
}


@pytest.mark.parametrize("kind", WHOLE_PAGES)
def test_boxes_are_judged_below_what_holds_the_article(kind):
    assert html_extraction.extract(WHOLE_PAGES[kind], None) == "One.\n\nTwo."


def test_unmarked_pages_in_forms(spark):
    page = '<html><body class="with-sidebar"><form><div class="menu">m</div><div><p>text {0} of a page</p><p>more {0}</p></div><div class="ads">a</div></form></body></html>'
    got = html_extraction.main_texts(pages(spark, [(i, "http://x.org/a", page.format(i)) for i in range(5)]))
    assert {r.page_id: r.text for r in got.collect()} == {i: f"text {i} of a page\n\nmore {i}" for i in range(5)}


def _strange(df):
    """Columns with a dot in their name, names that operators use inside, and a map."""
    for name in ("a.b", "hit_id", "hit__id", "hit_key", "hit_spans", "doc", "id", "gone", "n", "key", "places", "shard", "x y"):
        df = df.withColumn(name, F.lit("kept"))
    return df.withColumn("facts", F.create_map(F.lit("k"), F.col("doc_id")))


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "decontaminate", "spans", "redact", "encode", "shards"])
def test_strange_columns_pass_through(spark, stage):
    from tenderlake.llm import sharding

    rows = [(i, f"text {i} " + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(6)] + [(6, "twice"), (6, "twice"), (None, None)]
    docs = _strange(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {
        "quality": lambda: quality_rules.keep(docs, labels(spark)), "near_duplicates": lambda: minhash_dedup.keep(docs),
        "decontaminate": lambda: decontamination.decontaminate(docs, items(spark)),
        "spans": lambda: decontamination.decontaminate(docs, items(spark), remove="spans"), "redact": lambda: secret_scans.redact(docs),
        "encode": lambda: byte_bpe.digests(docs, *queries.tokenizer()), "shards": lambda: sharding.shuffled(docs, 2),
    }[stage]()
    if stage == "encode":
        assert got.count() == len(rows)
        return
    assert got.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"] if stage == "shards" else got.columns == docs.columns
    found = got.collect()
    assert found and all(r["a.b"] == r["hit_id"] == r["x y"] == "kept" and r["facts"] == {"k": r["doc_id"]} for r in found)


def test_long_texts_of_windows(spark):
    """Windows of a long text are rows of their own words only: 300,000 words are no trouble."""
    words = [f"w{i % 977}x{i % 89}" for i in range(300_000)]
    words[200_000:200_010] = PASSAGE.split()[:10]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "c d " * 1000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(PASSAGE.split()[:10])), (2, "c d"), (3, "d c d")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.contamination(docs, bench).collect()}
    assert got == {1: (300_000, 10, ["1"]), 2: (2000, 2000, ["2", "3"])}


@pytest.mark.parametrize("n", range(1, 11))
def test_windows_of_every_size(spark, n):
    rng = __import__("random").Random(n)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for i in range(40)]
    bench = [(1, " ".join(rng.choice("abc") for _ in range(n))), (2, "a"), (3, "b c a"), (4, " ".join(rng.choice("abc") for _ in range(14)))]
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    want = brute.contamination(rows, bench)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == {d: tuple(want[d]) for d, _ in rows}


def test_long_candidates(spark):
    run = "".join("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"[(i * i + 7 * i) % 64] for i in range(1_000_000))
    docs = spark.createDataFrame([(1, f"data:image/png;base64,{run} end"), (2, f'token = "{SECRET}"'), (3, "x" * 500_000)], "doc_id long, text string")
    assert secret_scans.redacted(docs).where("n_secrets is null").count() == 0
