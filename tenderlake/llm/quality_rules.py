"""Quality rules: simple base rules, then a hashed n-gram log-likelihood ratio of trusted text against the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import stored, white_words

SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 16
# The trusted multinomial is fitted on this many labelled rows at most (smallest hash of doc_id). The corpus multinomial and
# the verdicts cover every document.
TRUSTED_ROWS = 20_000
# Pseudo counts that draw a bucket's trusted share to its share in the corpus, so that the words that only one clean
# document has do not count against it where few rows are trusted.
SMOOTHING = 10.0
# Verdict: mean log-likelihood ratio of an n-gram, in nats.
THRESHOLD = -0.12
# Weights are whole millionths of a nat, so that sums do not depend on the order of addition.
SCALE = 1_000_000


def n_grams(words: Column) -> Column:
    """Buckets of the words and of the pairs of neighbouring words."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    first = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    two = F.transform(first, lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def repeat_words(words: Column, n: Column, windows: Column) -> Column:
    """Words inside 3-word windows that a text has twice or more; `windows` holds the windows' hashes.

    A hash is rounded down to a multiple of n and the place added, so that one sort brings equal windows together
    without losing their places; neighbours count only if their words agree.
    """
    def place(k: Column) -> Column:
        return F.pmod(k, n).cast("int")

    def same(a: Column, b: Column) -> Column:
        alike = (a - F.pmod(a, n)) == (b - F.pmod(b, n))
        for j in range(3):
            alike = alike & (F.get(words, place(a) + j) == F.get(words, place(b) + j))
        return F.coalesce(alike, F.lit(False))

    keyed = F.sort_array(F.transform(windows, lambda h, i: h - F.pmod(h, n) + i))

    def repeated(sorted_keys: Column) -> Column:
        twice = F.filter(sorted_keys, lambda k, j: same(k, F.get(sorted_keys, j - 1)) | same(k, F.get(sorted_keys, j + 1)))
        places = F.sort_array(F.transform(twice, place))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, p: F.struct(
            (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")))["n"]

    # A lambda over a list of one gives the sorted list a name, so that it is sorted once.
    found = F.transform(F.array(keyed), repeated)[0]
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(F.lit(0))


def _measured(docs: DataFrame) -> DataFrame:
    """`docs` as a struct column doc, with words (array) and the base measures."""
    text = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Not deterministic for the optimizer: a filter on the measures stays above the lists and does not build them anew
    # for every element that it looks at.
    once = F.monotonically_increasing_id() >= 0
    split = text.withColumn("words", F.when(once, white_words(F.col("text")))).withColumn("n_words", F.size("words").cast("long"))
    first = F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0)))
    windows = F.transform(first, lambda w, i: F.shiftright(
        F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)), 1))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x09-\x0D\x20]"))
    bare = F.col("text")
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    listed = split.withColumns({"windows": F.when(once, windows), "lines": F.when(once, lines)})
    return listed.select(
        "doc", "words", "n_words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(bare)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words"), F.col("n_words"), F.col("windows")).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def ratios(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """(bucket, weight): log of the trusted share over the corpus share of each bucket, at most `BUCKETS` rows.

    `labels` has doc_id and quality (1: trusted). One scan counts both multinomials; the ids of the trusted sample are
    broadcast, `trusted_rows` of them at most.
    """
    trusted = (labels.select(F.col("doc_id").cast("long").alias("id")).where(F.col("quality") == 1).where("id is not null")
               .distinct().orderBy(F.xxhash64("id"), "id").limit(trusted_rows).withColumn("t", F.lit(1)))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), white_words(F.col("text").cast("string")).alias("words"))
    marked = words.join(F.broadcast(trusted), F.col("doc_id") == F.col("id"), "left")
    counts = (marked.select("t", F.explode(n_grams(F.col("words"))).alias("bucket")).groupBy("bucket")
              .agg(F.count("*").alias("c"), F.count("t").alias("t")))
    counts = stored(counts, "buckets")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    share = F.col("c") / F.lit(max(1, totals["c"]))
    ratio = F.log((F.col("t") + SMOOTHING) / (F.lit(totals["t"]) * share + SMOOTHING))
    return counts.select("bucket", F.round(ratio * SCALE).cast("long").alias("weight"))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """`docs` as a struct column doc, with the measures and the verdict of `quality`. Scoring shuffles nothing."""
    spark, weights = docs.sparkSession, ratios(docs, labels, trusted_rows)
    # All weights in one array of BUCKETS numbers, a scalar of the plan.
    filled = spark.range(BUCKETS).join(F.broadcast(weights), F.col("id") == F.col("bucket"), "left")
    one = filled.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("weight", F.lit(0)).alias("weight")))).alias("w"))
    looked_up = one.select(F.col("w.weight")).scalar()
    summed = F.aggregate(n_grams(F.col("words")), F.lit(0).cast("long"), lambda total, b: total + F.get(F.col("weights"), b))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    scored = _measured(docs).withColumn("weights", looked_up).withColumn("ratio_sum", summed).withColumn("n_grams", grams).drop("words", "weights")
    fair = F.col("ratio_sum") >= F.lit(round(threshold * SCALE)) * F.col("n_grams")
    return scored.withColumn("kept", ~F.col("base_failed") & fair)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """Per row: doc_id, the base measures, base_failed, ratio_sum, n_grams, kept.

    kept: not base_failed, and the mean ratio of the row's n-grams is at least `threshold`. A null or empty text has no
    words and fails the base rules. A null doc_id stays null. Repeated rows are judged each. No labels: all ratios are
    about 0 and the base rules decide alone. Other columns are not read. An empty table gives an empty table.
    """
    found = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, threshold, trusted_rows)
    return found.select("doc.doc_id", *[c for c in found.columns if c != "doc"])


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """The rows of `docs` that `quality` keeps, with all their columns."""
    return judged(docs, labels, threshold, trusted_rows).where("kept").select("doc.*")
