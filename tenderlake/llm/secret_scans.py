"""Secret scans: candidate strings, judged by a random forest that removes false positives."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import stored

# A bare candidate: a run of 16 or more characters of keys and tokens, with the name it is assigned to.
VALUE = "[A-Za-z0-9+/_-]{16,}"
ASSIGNED = "[A-Za-z_]++ ?[:=] ?[\"']?"
# A name that ends like a credential's (token, db_password, apiKey2, secret-key_prod) with the sign of an assignment behind it.
_ENDING = ("(?i:token|secret|passw(?:or[dt]|d)?|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credential|bearer)"
           "s?(?:[_-]?(?i:key))?(?:[_-][A-Za-z0-9]{1,16})?[0-9]{0,4}")
NAMED = (f"[A-Za-z0-9+/_-]++(?=[\"']?\\]?[ \\t]{{0,3}}[:=])(?<={_ENDING})[\"']?\\]?[ \\t]{{0,3}}(?:=>|:=|==?|:(?!:))[ \\t]{{0,3}}"
         "(?:(?i:bearer|basic|token) )?")
# user: of user:password@host, in a url or alone; mail addresses are none.
IN_URL = "[A-Za-z][A-Za-z0-9+-]*+://[^\\s/:\"'<>]*+:"
IN_LOGIN = "(?<![^\\s\"'`(<=,])(?=[A-Za-z0-9._%+-]++:)(?!(?i:mailto|e-?mail|mail|from|to|cc|bcc|contact|sips?|xmpp|acct):)[A-Za-z0-9._%+-]++:"
HOST = "(?=@[A-Za-z0-9\\[])"
# The value behind a credential's name has any length and any signs, up to the closing quote or white space. A quoted
# text of several words counts whole unless one of them is a candidate itself.
_QUOTED = "|".join(f"{q}(?:(?:[^{q}\\\\\\s]++|\\\\\\S)++|(?![^{q}\\n]*{VALUE})[^{q}\\n]+)(?={q})" for q in "\"'")
CREDENTIAL_VALUE = f"(?:{_QUOTED}|[\"'`]?[^\\s\"'`]+)"
URL_VALUE = f"(?:[^\\s/\"'<>]+|(?![0-9]{{1,5}}/)[^\\s@\"'<>]+){HOST}"
# Looked for first, as few words have it: the sign that a url's scheme and a credential's name are followed by.
_SIGN = "(?=[A-Za-z0-9+/_-]++[\"']?\\]?[ \\t]{0,3}[:=])"
CANDIDATE = (f"(?<![A-Za-z0-9+/_-])(?:{_SIGN}(?:{IN_URL}{URL_VALUE}|{NAMED}{CREDENTIAL_VALUE})|{IN_LOGIN}[^\\s/\"'<>]+{HOST}|(?:{ASSIGNED})?{VALUE})")
# What stands before the value of a candidate.
PREFIX = f"^(?:{IN_URL}(?=.)|{NAMED}[\"'`]?(?=.)|{ASSIGNED}(?={VALUE}$)|{IN_LOGIN}(?=.)|)"
# Stands for a value that is filled in elsewhere.
PLACEHOLDER = "^(\\$\\{[A-Za-z_][^}]*\\}|\\$[A-Z_]+|<[^<>]*>|\\{\\{.*\\}\\}|%\\([a-z_]+\\)s|[*.]+)$"
# Names and neighbouring words of credentials.
CREDENTIAL = "(?i)(token|secret|passw|pwd|api_?key|access_?key|private_?key|auth|credential|bearer)"
# Fixed formats of well-known issuers.
KNOWN = "^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{20,})$"
MARKER = "[SECRET]"
# The forest is fitted on this many labelled findings of each kind at most, by smallest hash. Candidates of all documents are
# judged. The dictionary holds letter triples that are this share of those of all documents.
FINDINGS, DICTIONARY_SHARE = 4_000, 2.3e-6
TREES, DEPTH, THRESHOLD = 24, 6, 0.5
LETTERS = 26
FEATURES = ("length", "digits", "capitals", "hexadecimal", "distinct", "transitions", "coverage", "slashes", "assigned", "quoted",
            "named", "near_name", "near_words")


def dictionary(docs: DataFrame, share: float = DICTIONARY_SHARE) -> DataFrame:
    """(code, n): letter triples of the words of all documents that are this share of all triples and no single ones, 26 ** 3 rows at most."""
    texts = docs.select(F.lower(F.col("text").cast("string")).alias("t"))
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit("[a-z]{3,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    triples = words.select(F.explode(triple_codes(F.col("w"))).alias("code"), "c")
    counted = stored(triples.where("code is not null").groupBy("code").agg(F.sum("c").alias("n")), "triples")
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total), (F.col("n") > 1) & (F.col("n") >= share * F.col("total"))).select("code", "n")


def triple_codes(word: Column) -> Column:
    """Codes of the letter triples of an ASCII word, null where a triple holds anything else."""
    letters = F.transform(F.split(F.lower(word), ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97))
    # A lambda over a list of one gives the letters a name, so that they are listed once and not for every triple.
    return F.get(F.transform(F.array(letters), lambda codes: F.transform(
        F.slice(codes, 1, F.greatest(F.size(codes) - 2, F.lit(0))), lambda a, i: (
            a * LETTERS * LETTERS + F.get(codes, i + 1) * LETTERS + F.get(codes, i + 2)))), F.lit(0))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, place, found, value, before, after): all candidates, by their place in the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), text.alias("t"))
    matched = listed.withColumn("m", F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0))).where(F.size("m") > 0)
    parts = matched.withColumn("p", F.transform(F.split("t", CANDIDATE), lambda x: F.struct(F.left(x, F.lit(40)).alias("l"), F.right(x, F.lit(40)).alias("r"))))
    at = parts.select("doc_id", "text_key", F.posexplode(F.transform("m", lambda m, i: F.struct(
        m.alias("found"), F.get(F.col("p.r"), i).alias("before"), F.get(F.col("p.l"), i + 1).alias("after")))).alias("place", "c"))
    return at.select("doc_id", "text_key", "place", "c.found", _value("c.found").alias("value"), "c.before", "c.after")


def _prefix(found: Column | str) -> Column:
    return F.regexp_extract(found, PREFIX, 0)


def _value(found: str) -> Column:
    return F.right(F.col(found), F.length(found) - F.length(_prefix(found)))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the numbers that the forest looks at, and what the fixed rules say (label; null: open).

    `placed` is a clear value in a credential's place that no bare string of 20 or more characters is: there the place decides.
    """
    spark, v, name = found.sparkSession, F.col("value"), F.col("name")
    filled = spark.range(LETTERS ** 3).join(F.broadcast(words), F.col("id") == F.col("code"), "left")
    known = filled.agg(F.sort_array(F.collect_list(F.struct("id", F.col("n").isNotNull().cast("int").alias("k")))).alias("d")).select(F.col("d.k")).scalar()
    named = found.withColumn("name", F.expr("left(found, length(found) - length(value))")).withColumn("known", known)

    def coverage(word: Column) -> Column:
        codes = triple_codes(word)
        hit = F.aggregate(codes, F.lit(0), lambda n, c: n + F.coalesce(F.get(F.col("known"), c), F.lit(0)))
        return hit / F.greatest(F.size(codes), F.lit(1))

    length = F.length(v)
    close = F.regexp_extract("before", r"([^\s]*)\s*$", 1)
    following = F.regexp_extract("after", r"^[^A-Za-z]*([A-Za-z]*)", 1)
    numbers = {
        "length": length, "digits": _count(v, "[0-9]") / length, "capitals": _count(v, "[A-Z]") / length,
        "hexadecimal": _count(v, "[0-9a-fA-F]") / length, "distinct": F.size(F.array_distinct(F.split(v, ""))) / length,
        "transitions": _count(v, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])") / length,
        "coverage": coverage(v), "slashes": _count(v, "/") / length,
        "assigned": name.rlike("[:=]").cast("int"), "quoted": name.rlike("[\"']$").cast("int"), "named": name.rlike(CREDENTIAL).cast("int"),
        "near_name": F.concat(F.col("before"), F.lit(" "), F.left("after", F.lit(20))).rlike(CREDENTIAL).cast("int"),
        "near_words": coverage(F.regexp_replace(F.concat(close, following), "[^A-Za-z]", "")),
    }
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    bare, in_url = v.rlike(f"^{VALUE}$"), name.rlike(f"^{IN_URL}$")
    in_place = name.rlike(f"^{NAMED}[\"'`]?$") | (name.rlike(f"^{IN_LOGIN}$") & ~bare)
    # Signs at the end may belong to the sentence. Words with a hyphen, a stop or an apostrophe are open.
    inner = F.regexp_replace(v, "[.,;:!?)\\]}>]+$", "")
    varied = (inner.rlike("[0-9]") & inner.rlike("[A-Za-z]")) | (inner.rlike("[A-Za-z0-9]") & inner.rlike("[!@#$%^&*=+~|?\\\\]"))
    placed = (in_url | (in_place & varied & ~v.rlike("\\s") & (~bare | (length < 20)))) & ~v.rlike(PLACEHOLDER)
    label = (F.when(v.rlike(KNOWN) | (name.rlike(CREDENTIAL) & mixed & bare & (length >= 20)) | placed, 1)
             .when(~mixed & bare, 0))
    return named.select("doc_id", "text_key", "place", "value", *[x.cast("double").alias(k) for k, x in numbers.items()],
                        label.alias("label"), placed.alias("placed"))


def fit(found: DataFrame, findings: int = FINDINGS, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest fitted on labelled findings, `findings` of each label at most; None without both labels.

    `found` has the columns of FEATURES and label (1 secret, 0 none, null open).
    """
    # A secret copied into thousands of documents counts as one finding.
    once = found.where("label is not null").groupBy("label", "value").agg(*[F.min(c).alias(c) for c in FEATURES])
    order = [F.xxhash64("value"), F.col("value")]
    sample = reduce(DataFrame.unionByName, [once.where(F.col("label") == k).orderBy(*order).limit(findings) for k in (0, 1)])
    sample = stored(sample.repartition(1).sortWithinPartitions(*order, "label"), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt", cacheNodeIds=False)
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, place, value, probability, secret): every candidate and the forest's verdict.

    `findings` (value, label 0/1) are labelled findings; without them the fixed rules label the clear cases: known
    formats and mixed strings assigned to a credential's name are secrets, bare strings without a digit or without a letter
    are none. The forest decides all the rest and may overrule. It knows little of short and punctuated values, so without
    `findings` it does not overrule passwords in urls, and short or punctuated values of letters with digits or signs behind
    a credential's name or in user:value@host. With findings of one kind only no forest can be fitted:
    the labels decide and open candidates are no secrets. Null and empty texts have no candidates.
    """
    every = stored(described(candidates(docs), dictionary(docs)), "candidates")
    known = every
    if findings is not None:
        given = findings.groupBy("value").agg(F.max("label").alias("label"))
        # Each label's share in the order of hashes: an order of the texts would take one kind of them.
        given = reduce(DataFrame.unionByName, [
            given.where(F.col("label") == k).orderBy(F.xxhash64("value"), "value").limit(FINDINGS) for k in (0, 1)])
        known = every.drop("label").join(F.broadcast(given), "value")
    model = fit(known)
    if model is None:
        judged = every.withColumn("probability", F.coalesce("label", F.lit(0)).cast("double"))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(every)
        judged = model.transform(vectors).withColumn("probability", vector_to_array("probability")[1])
    if findings is None:
        judged = judged.withColumn("probability", F.when(F.col("placed"), 1.0).otherwise(F.col("probability")))
    return judged.select("doc_id", "text_key", "place", "value", "probability", (F.col("probability") >= threshold).alias("secret"))


def _with_places(docs: DataFrame, findings: DataFrame | None, threshold: float) -> DataFrame:
    """`docs` as a struct column doc, with text, n_candidates and the places of secrets."""
    verdicts = scan(docs, findings, threshold).groupBy("doc_id", "text_key").agg(
        F.countDistinct("place").alias("n_candidates"), F.collect_set(F.when(F.col("secret"), F.col("place"))).alias("places"))
    verdicts = verdicts.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "n_candidates", "places")
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    whole = whole.withColumn("key", F.xxhash64("text"))
    # One plan at every size: the findings grow with the documents.
    return whole.join(verdicts.hint("merge"), F.col("id").eqNullSafe(F.col("found_id")) & F.col("key").eqNullSafe(F.col("found_key")), "left")


def _marked(text: Column, places: Column) -> Column:
    """The text with the values at the given places replaced by the marker; names before them stay."""
    # Candidates and places are named once: the lambda over the parts would look for them again at every part.
    both = F.array(F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.map_from_arrays(
        places, F.transform(places, lambda _: F.lit(True))).alias("secret")))
    parts = F.get(F.transform(both, lambda b: F.transform(F.split(text, CANDIDATE), lambda part, i: F.concat(part, F.coalesce(
        F.when(F.try_element_at(b["secret"], i), F.concat(_prefix(F.get(b["found"], i)), F.lit(MARKER)))
        .otherwise(F.get(b["found"], i)), F.lit(""))))), F.lit(0))
    return F.when(F.size(places) > 0, F.array_join(parts, "")).otherwise(text)


def redacted(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_candidates, n_secrets, text (secrets replaced by a marker).

    A null text stays null, an empty one empty. A null doc_id stays null; repeated rows are judged each. Other columns
    are not read. An empty table gives an empty table.
    """
    joined = _with_places(docs.select("doc_id", "text"), findings, threshold)
    return joined.select(
        F.col("id").alias("doc_id"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        F.greatest(F.size("places"), F.lit(0)).cast("long").alias("n_secrets"), _marked(F.col("text"), F.col("places")).alias("text"))


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with all rows and columns, and the secrets in `text` replaced by a marker."""
    joined = _with_places(docs, findings, threshold)
    columns = [F.col("doc").getField(c).alias(c) if c != "text" else _marked(F.col("text"), F.col("places")).alias("text") for c in docs.columns]
    return joined.select(*columns)
