"""Benchmark decontamination: a broadcast hash set of test n-grams, verified hits, removal of spans or documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import LOWER, UPPER

N = 10
# Bits of the broadcast hash set at most: 8 MB.
TABLE_BITS = 1 << 26
_OTHER = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def benchmark_words(text: Column) -> Column:
    """Words of ASCII letters, digits and all other scripts, A-Z lower-cased; a null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + _OTHER, LOWER + " " * len(_OTHER))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _named(value: Column, use) -> Column:
    """`use` of a value that is computed once: a lambda over a list of one gives it a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_hashes(words: Column, sizes: Sequence[int], use) -> Column:
    """`use` of a dictionary: for each size the hashes of all windows of that many words, by place.

    Words are hashed once. Hashes of 2, 4 and 8 words come from two neighbours of half the length, those of other sizes from
    neighbours of the powers of two that add up to them.
    """
    def joined(left: Column, right: Column, reach: int, n: int, count: Column) -> Column:
        size = F.greatest(count - (n - 1), F.lit(0))
        return F.zip_with(F.slice(left, 1, size), F.slice(right, reach + 1, size), lambda a, b: F.xxhash64(a, b))

    def level(power: int, known: dict[int, Column], count: Column) -> Column:
        if 2 * power <= max(sizes):
            return _named(joined(known[power], known[power], power, 2 * power, count), lambda h: level(2 * power, {**known, 2 * power: h}, count))
        found = {}
        for n in sizes:
            h, reach = None, 0
            for p in sorted(known, reverse=True):
                if n & p:
                    h = known[p] if h is None else joined(h, known[p], reach, reach + p, count)
                    reach += p
            found[n] = h
        return use(found)

    one = F.transform(words, lambda w: F.xxhash64(w))
    return _named(one, lambda h: level(1, {1: h}, F.size(h)))


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(size, hash, window, item): n words each, or all words of a shorter item."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), benchmark_words(F.col("text").cast("string")).alias("words"))
    sized = words.where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(n)))
    at = sized.select("item", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    cut = at.select("item", "size", F.slice("words", F.col("at"), F.col("size")).alias("w"))
    hashed = with_hashes(F.col("w"), range(1, n + 1), lambda found: F.get(F.element_at(
        F.array(*[found[k] for k in range(1, n + 1)]), F.col("size")), F.lit(0)))
    return cut.select("size", hashed.alias("hash"), F.array_join("w", " ").alias("window"), "item").distinct()


def hash_set(items: DataFrame, windows_: int, most: int = TABLE_BITS) -> tuple[Column, int]:
    """The windows' hashes as a table of bits (a scalar array of longs), and its number of bits: 16 for each window, `most` at most.

    A larger benchmark fills the table more and lets more windows through to the join, which decides.
    """
    bits = min(most, max(1 << 10, 1 << (16 * windows_).bit_length()))
    slot = F.pmod("hash", F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
    set_ = items.groupBy(F.floor(slot / 64).alias("word")).agg(F.bit_or(one).alias("bits"))
    filled = items.sparkSession.range(bits // 64).join(set_, F.col("id") == F.col("word"), "left")
    one_row = filled.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("t"))
    return one_row.select(F.col("t.bits")).scalar(), bits


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, text_key, at, size, item): every verified occurrence of a window in a document.

    One scan for all sizes. A document's windows are tested against the hash set inside one expression, and only those
    that it may hold become rows, with their own words and not the document's: work and rows grow with the text.
    """
    from tenderlake.llm.common import stored

    items = stored(windows(benchmark, n), "windows")
    sizes = {r["size"]: r["c"] for r in items.groupBy("size").agg(F.count("*").alias("c")).collect()}
    table, bits = hash_set(items, sum(sizes.values()))
    words = benchmark_words(F.col("text").cast("string"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text")
    ).withColumn("table", table)

    def held(words: Column, hashes: dict[int, Column]) -> Column:
        def tested(size: int):
            def one(h: Column, i: Column) -> Column:
                slot = F.pmod(h, F.lit(bits))
                bit = F.getbit(F.get(F.col("table"), F.floor(slot / 64).cast("int")), (slot % 64).cast("int"))
                window = F.array_join(F.slice(words, i + 1, size), " ")
                return F.when(bit == 1, F.struct(i.alias("at"), F.lit(size).alias("size"), h.alias("hash"), window.alias("window")))
            return one
        lists = [F.filter(F.transform(hashes[k], tested(k)), lambda x: x.isNotNull()) for k in sorted(sizes)]
        return F.concat(*lists) if len(lists) > 1 else lists[0]

    if not sizes:
        return items.limit(0).select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), F.lit(0).alias("at"), "size", "item")
    found = _named(words, lambda w: with_hashes(w, sorted(sizes), lambda hashes: held(w, hashes)))
    return rows.select("doc_id", "text_key", F.explode(found).alias("x")).select("doc_id", "text_key", "x.*").join(
        items, ["size", "hash", "window"]).select("doc_id", "text_key", "at", "size", "item")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per row: doc_id, text_key, n_words, n_hit, items (sorted), spans (start, end of the hit words, merged).

    A null or empty text has no words and no hits. A null doc_id stays null; repeated rows are judged each. Benchmark
    items without words hit nothing; those without an item_id hit words but are not listed; rows that repeat an item
    count once. Other columns are not read. Empty tables give no hits or no rows.
    """
    from pyspark.sql import Window

    from tenderlake.llm.common import stored

    found = stored(hits(docs, benchmark, n), "hits")
    key = ["doc_id", "text_key"]
    items = found.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = found.select(*key, "at", (F.col("at") + F.col("size")).alias("end")).distinct()
    order = Window.partitionBy(*key).orderBy("at", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("fresh", F.coalesce((F.col("at") > before).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("fresh").over(order)).groupBy(*key, "run").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    merged = runs.groupBy(*key).agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"),
        F.size(benchmark_words(F.col("text").cast("string"))).cast("long").alias("n_words"))
    def alike(left: str, right: str) -> Column:
        return reduce(Column.__and__, [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in key])

    named = items.select(*[F.col(k).alias(f"item_{k}") for k in key], "items")
    hit = merged.select(*[F.col(k).alias(f"hit_{k}") for k in key], "n_hit", "spans").join(named, alike("hit_", "item_"))
    joined = counted.join(hit, alike("", "hit_"), "left")
    return joined.select(
        *key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the hit words and what follows each up to the next word."""
    inside = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
    other = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
    units = F.regexp_extract_all(text, F.lit(f"({inside}+{other}*)"), F.lit(1))
    kept = F.filter(units, lambda u, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])))
    return F.concat(F.regexp_extract(text, f"^({other}*)", 1), F.array_join(kept, ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents") -> DataFrame:
    """`docs` without contaminated documents, or without the hit spans of their texts (`remove="spans"`)."""
    found = contamination(docs.select("doc_id", "text"), benchmark, n).where("n_hit > 0").select(
        F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), F.col("spans").alias("hit_spans"))
    found = found.dropDuplicates(["hit_id", "hit_key"])
    # Other columns travel in a struct, so none can clash.
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    same = F.col("id").eqNullSafe(F.col("hit_id")) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col("hit_key"))
    if remove == "documents":
        return whole.join(found, same, "left_anti").select("doc.*")
    cut = F.when(F.col("hit_spans").isNull(), F.col("text")).otherwise(without_spans(F.col("text"), F.col("hit_spans")))
    return whole.join(found, same, "left").select(*[
        cut.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
