"""Record linkage across feeds.

Nothing here compares all pairs. Prefix and containment joins explode the pieces of one key
into rows and become equi joins; both sides are reduced to distinct keys before they meet, and
fallback tiers run only on what the better tier left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.dates import fiscal_window, fiscal_year, parse_any, parse_mdy
from tenderlake.functions.keys import (
    WILDCARDS,
    base_key,
    comparable_name,
    compact_key,
    fallback_pattern,
    hyphenless,
    hyphenless_upper,
    leading_segment,
    like,
    longest_literal,
)
from tenderlake.functions.money import amount, exact_sum
from tenderlake.functions.text import truncated
from tenderlake.operators.ledger import contract_profiles, newest_first
from tenderlake.operators.ranking import cut_days, first_per_key, last_per_key, ranked, since_cut, top_per_group
from tenderlake.operators.search import filled
from tenderlake.session import stored

# Source tags and statuses of a merged contract list.
REGISTER_ONLY = "MOCS"
IN_BOTH = "MOCS & Checkbook"
LEDGER_ONLY = "Checkbook"
LEDGER_STATUS = "Checkbook Only"

GRAM = 8
BUCKETS = 32
# Lengths of the piece that a name is looked up by.
PIECES = (8, 4, 2, 1)
# Characters at the beginning of an id, and values of their hash, that its pieces are told by before they are joined.
HEAD, HEADS = 4, 4096


# The right side of every semi and anti join is distinct: a key that holds many of its rows is
# combined before the shuffle.


def lookup(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Left join to a table with one row per key; a hot key of `left` is split at run time."""
    return left.join(right, on, "left")


def with_pieces(df: DataFrame, text: str, lengths: Column, piece: str, heads: Column | None = None) -> DataFrame:
    """One row per piece of `text` that has one of the lengths (an array) and, where given, a head among `heads`.

    The result is many times its source, which size estimates do not see: joins shuffle it and
    never broadcast it.
    """
    n, size = F.col("_n"), F.length(text)
    cut = df.withColumn("_n", F.explode(lengths)).filter(n <= size)
    starts = F.when(n == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))))
    cut = cut.withColumn("_i", F.explode(starts)).withColumn(piece, F.substr(text, F.col("_i"), n))
    if heads is not None:
        cut = cut.filter(F.get(heads, _head(piece)))
    return cut.drop("_n", "_i").hint("merge")


def _head(text: str) -> Column:
    return F.pmod(F.xxhash64(F.substring(text, 1, HEAD)), F.lit(HEADS)).cast("int")


def heads_of(df: DataFrame, text: str) -> Column:
    """Whether a text of a column begins with characters of that hash: an array of HEADS truth values.

    Equal texts have equal heads, so pieces with another head need not be shuffled to be refused.
    """
    found = df.filter(F.col(text).isNotNull()).agg(F.collect_set(_head(text)).alias("_found"))
    return found.select(F.transform(F.sequence(F.lit(0), F.lit(HEADS - 1)), lambda i: F.array_contains("_found", i))).scalar()


def with_prefixes(df: DataFrame, text: str, lengths: Column, prefix: str) -> DataFrame:
    """One row per leading part of `text` that has one of the lengths (an array)."""
    n = F.col("_n")
    cut = df.withColumn("_n", F.explode(lengths)).filter(n <= F.length(text))
    return cut.withColumn(prefix, F.substr(text, F.lit(1), n)).drop("_n").hint("merge")


def lengths_of(df: DataFrame, text: str) -> Column:
    """The text lengths that occur in a column, as one small array."""
    return df.agg(F.collect_set(F.length(text))).scalar()


# ---- vendors and entities ----------------------------------------------------------------


def match_entities(entities: DataFrame, vendors: DataFrame, match_blank: bool = False,
                   order: str = "passport_supplier_id") -> DataFrame:
    """Entity to vendor by equal normalised name, score 1.0; the last vendor of a name wins.

    `order` says which is last: the id, or the input order that the feed reader can keep.
    """
    named = vendors.select(
        comparable_name("name").alias("_name"), "passport_supplier_id", F.col(order).alias("_last")
    )
    if not match_blank:
        named = named.filter(F.col("_name") != "")
    ids = last_per_key(named, "_name", ["_last"])
    out = entities.withColumn("normalized_name", comparable_name("organization_name"))
    out = lookup(out, ids, out["normalized_name"] == ids["_name"])
    return out.select(
        *entities.columns, "normalized_name",
        F.col("passport_supplier_id").alias("matched_vendor_id"),
        F.when(F.col("passport_supplier_id").isNotNull(), F.lit(1.0)).alias("match_score"),
    )


def unmatched_vendors(vendors: DataFrame, matched: DataFrame) -> DataFrame:
    ids = matched.select(F.col("matched_vendor_id").alias("passport_supplier_id")).distinct()
    return vendors.join(ids, "passport_supplier_id", "left_anti")


def matched_vendors(vendors: DataFrame, matched: DataFrame) -> DataFrame:
    ids = matched.select(F.col("matched_vendor_id").alias("passport_supplier_id")).distinct()
    return vendors.join(ids, "passport_supplier_id", "left_semi")


def with_membership(vendors: DataFrame, matched: DataFrame, marker: str = "in_entities") -> DataFrame:
    """TRUE for vendors that an entity was matched to, FALSE for the others."""
    ids = matched.filter(F.col("matched_vendor_id").isNotNull()).select(
        F.col("matched_vendor_id").alias("_id")
    ).distinct()
    out = lookup(vendors, ids, vendors["passport_supplier_id"] == ids["_id"])
    return out.withColumn(marker, F.col("_id").isNotNull()).drop("_id")


def with_contract_stats(vendors: DataFrame, contracts: DataFrame) -> DataFrame:
    """Number and total of a vendor's contracts by name; no contract gives 0 and NULL."""
    stats = contracts.groupBy("vendor_name").agg(
        F.count("*").alias("_count"), exact_sum("award_amount").alias("total_awarded")
    )
    out = lookup(vendors, stats, vendors["name"] == stats["vendor_name"])
    return out.withColumn("contract_count", F.coalesce("_count", F.lit(0))).drop("_count", "vendor_name")


def contract_vendor(contracts: DataFrame, vendors: DataFrame, order: str = "passport_supplier_id") -> DataFrame:
    """Contract to its vendor by exact name, the first vendor of a name."""
    named = vendors.select("name", "passport_supplier_id", F.col(order).alias("_first"))
    first = first_per_key(named, "name", [F.col("_first")], keep_null=False).drop("_first")
    return lookup(contracts, first, contracts["vendor_name"] == first["name"]).drop("name").withColumnRenamed(
        "passport_supplier_id", "vendor_id"
    )


# ---- notices -----------------------------------------------------------------------------


def notice_keys(notices: DataFrame, normalised: bool) -> DataFrame:
    """Notices per key; a key shared by many notices is one row here."""
    key = hyphenless_upper("PIN") if normalised else F.col("PIN")
    return notices.filter(F.col("PIN").isNotNull()).groupBy(key.alias("_key")).agg(F.count("*").alias("notices"))


def solicitation_notices(notices: DataFrame, solicitations: DataFrame, normalised: bool) -> DataFrame:
    """Solicitations with notices: number of notices by exact or normalised key."""
    keys = notice_keys(notices, normalised)
    on = solicitations["normalized_epin" if normalised else "epin"] == keys["_key"]
    return solicitations.join(keys, on).select("epin", "agency", "notices")


def sample_links(notices: DataFrame, solicitations: DataFrame, n: int = 5) -> DataFrame:
    """A few linked rows to look at, in key order."""
    rows = notices.withColumn("_key", hyphenless_upper("PIN")).join(solicitations, F.col("_key") == F.col("normalized_epin"))
    return rows.orderBy("epin", "RequestID").limit(n).select(
        "epin", truncated("procurement_name", 50).alias("title"), "RequestID", "TypeOfNoticeDescription"
    )


def sample_keys(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """A few distinct non-empty keys, in order."""
    return df.filter(filled(column)).select(column).distinct().orderBy(column).limit(n)


def contract_notices(notices: DataFrame, contracts: DataFrame, normalised: bool) -> DataFrame:
    """Contract keys with notices: contracts and notices behind each key, never their pairs."""
    column = "normalized_epin" if normalised else "epin"
    per_key = contracts.groupBy(F.col(column).alias("_epin")).agg(
        F.countDistinct("contract_id").alias("contracts")
    )
    keys = notice_keys(notices, normalised)
    return per_key.join(keys, per_key["_epin"] == keys["_key"]).select(
        F.col("_epin").alias("epin"), "contracts", "notices"
    )


def notices_by_segment(contracts: DataFrame, notices: DataFrame, key: Column | None = None,
                       normalised: bool = False) -> DataFrame:
    """Notices whose key equals the text before the first hyphen of the contract id.

    `key` puts another contract key in its place.
    """
    keyed = contracts.withColumn("_segment", leading_segment("contract_id") if key is None else key)
    keys = notice_keys(notices, normalised).withColumnRenamed("_key", "_segment")
    return keyed.join(keys, "_segment").select("ctr_id", F.col("_segment").alias("link_key"), "notices")


def masked(text: Column, mask: Column) -> Column:
    """`text` with _ wherever `mask`, of the same length, has it."""
    return F.array_join(F.zip_with(F.split(text, ""), F.split(mask, ""), lambda c, m: F.when(m == "_", m).otherwise(c)), "")


def partial_links(notices: DataFrame, solicitations: DataFrame, length: int = GRAM) -> DataFrame:
    """Notices whose first 8 key characters occur in some solicitation key.

    Only distinct pieces take part, and the notices are read again only by a semi join on the piece. Plain pieces meet the
    exploded pieces of the solicitation keys, cut to the lengths that occur. In a piece with _, which stands for any one
    character, the places of _ are a mask: the few masks that occur are laid over the windows of the keys too, and masked
    pieces and windows are joined as equals. Only a piece with %, which has no fixed length, meets the keys by its longest
    literal part and is then checked as a pattern.
    """
    piece = F.substring(hyphenless_upper("PIN"), 1, length)
    wanted = notices.select(piece.alias("_piece")).filter(F.col("_piece").isNotNull()).distinct()
    keys = solicitations.filter(F.col("normalized_epin").isNotNull()).select("normalized_epin").distinct()
    plain = wanted.filter(~F.col("_piece").rlike(WILDCARDS))
    hidden = wanted.filter(F.col("_piece").contains("_") & ~F.col("_piece").contains("%")).withColumn(
        "_mask", F.regexp_replace("_piece", "[^_]", "."))
    open_ended = wanted.filter(F.col("_piece").contains("%")).withColumn("_literal", longest_literal("_piece"))

    windows = with_pieces(keys, "normalized_epin", lengths_of(plain, "_piece"), "_piece").select("_piece").distinct()
    equal = plain.join(windows, "_piece", "left_semi")

    masks = hidden.agg(F.collect_set("_mask")).scalar()
    windows = with_pieces(keys, "normalized_epin", lengths_of(hidden, "_piece"), "_window").select("_window").distinct()
    laid = windows.withColumn("_mask", F.explode(masks)).filter(F.length("_mask") == F.length("_window")).select(
        "_mask", masked(F.col("_window"), F.col("_mask")).alias("_piece")).distinct()
    covered = hidden.join(laid.hint("merge"), ["_piece", "_mask"], "left_semi").select("_piece")

    # A short literal part occurs in many keys: they are spread over buckets, and each of the few patterns asks every bucket.
    w = open_ended.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1)))).alias("w")
    p = with_pieces(keys, "normalized_epin", lengths_of(open_ended, "_literal"), "_literal").withColumn(
        "_bucket", F.pmod(F.hash("normalized_epin"), F.lit(BUCKETS))).alias("p")
    pattern = F.concat(F.lit("%"), F.col("w._piece"), F.lit("%"))
    same = (F.col("w._literal") == F.col("p._literal")) & (F.col("w._bucket") == F.col("p._bucket"))
    patterns = w.join(p, same & like(F.col("p.normalized_epin"), pattern), "left_semi").select("_piece").distinct()

    linked = equal.select("_piece").union(covered).union(patterns)
    return notices.withColumn("_piece", piece).join(linked, "_piece", "left_semi").drop("_piece")


def linkage_quality(notices: DataFrame, solicitations: DataFrame, contracts: DataFrame) -> DataFrame:
    """Linked solicitations and contracts by link kind, and notices linked by a part of their key."""
    parts = []
    for kind, normalised in (("exact", False), ("normalised", True)):
        s = solicitation_notices(notices, solicitations, normalised).agg(F.countDistinct("epin").alias("linked"))
        parts.append(s.select(F.lit("solicitations").alias("linked_to"), F.lit(kind).alias("kind"), "linked"))
        column = "normalized_epin" if normalised else "epin"
        keys = notice_keys(notices, normalised)
        linked = contracts.join(keys, contracts[column] == keys["_key"], "left_semi")
        c = linked.agg(F.countDistinct("contract_id").alias("linked"))
        parts.append(c.select(F.lit("contracts").alias("linked_to"), F.lit(kind).alias("kind"), "linked"))
    p = partial_links(notices, solicitations).agg(F.count("*").alias("linked"))
    parts.append(p.select(F.lit("notices").alias("linked_to"), F.lit("partial").alias("kind"), "linked"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- solicitations and contracts ---------------------------------------------------------


def contracts_with_solicitation(contracts: DataFrame, solicitations: DataFrame) -> DataFrame:
    keys = solicitations.select(F.col("normalized_epin").alias("base_epin")).distinct()
    return contracts.join(keys, "base_epin", "left_semi")


def solicitations_with_contract(solicitations: DataFrame, contracts: DataFrame) -> DataFrame:
    keys = contracts.select(F.col("base_epin").alias("normalized_epin")).distinct()
    return solicitations.join(keys, "normalized_epin", "left_semi")


def _prefix_rows(solicitations: DataFrame, per_key: DataFrame) -> DataFrame:
    """Contract keys joined to the solicitations whose key they start with."""
    s = solicitations.filter(F.col("normalized_epin").isNotNull()).select(
        F.col("normalized_epin").alias("_prefix"), "epin"
    )
    pieces = with_prefixes(per_key, "normalized_epin", lengths_of(s, "_prefix"), "_prefix")
    return s.join(pieces, "_prefix")


def solicitation_contracts(solicitations: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contracts whose key starts with the solicitation's key: count and total.

    Contracts are summed by key, then by the prefixes of the key that are as long as some
    solicitation key, so that a prefix is one row however many contracts share it.
    """
    per_key = contracts.filter(F.col("normalized_epin").isNotNull()).groupBy("normalized_epin").agg(
        F.count("*").alias("_n"), F.sum(amount("award_amount")).alias("_amount")
    )
    per_prefix = with_prefixes(
        per_key.withColumnRenamed("_n", "_count"), "normalized_epin", lengths_of(solicitations, "normalized_epin"), "_prefix"
    ).groupBy("_prefix").agg(F.sum("_count").alias("contract_count"), F.sum("_amount").alias("_amount"))
    return solicitations.join(per_prefix, solicitations["normalized_epin"] == per_prefix["_prefix"], "left").select(
        "epin", "agency", F.coalesce("contract_count", F.lit(0)).alias("contract_count"),
        F.coalesce(F.col("_amount").cast("double"), F.lit(0.0)).alias("total_awarded"),
    )


def solicitation_first_contracts(solicitations: DataFrame, contracts: DataFrame, n: int = 5) -> DataFrame:
    """The first contracts of every solicitation.

    The first rows of a union are among the first rows of its parts: `n` per key are enough.
    """
    keyed = contracts.filter(F.col("normalized_epin").isNotNull()).select(
        "normalized_epin", F.col("ctr_id").cast("long").alias("_order"), "ctr_id", "contract_id", "vendor_name", "award_amount"
    )
    few = top_per_group(keyed, ["normalized_epin"], [F.col("_order"), F.col("ctr_id")], n).drop("rank")
    rows = _prefix_rows(solicitations, few)
    return top_per_group(rows, ["epin"], [F.col("_order"), F.col("ctr_id")], n).select(
        "epin", "rank", "ctr_id", "contract_id", "vendor_name", "award_amount"
    )


def two_tier_solicitation(contracts: DataFrame, solicitations: DataFrame) -> DataFrame:
    """Contract to solicitation: equal key, else the key's first ten characters.

    The tiers are decided on distinct contract keys; contracts then read the result by key.
    """
    first = first_per_key(
        solicitations.select("normalized_epin", "epin"), "normalized_epin", [F.col("epin")], keep_null=False
    )
    keys = contracts.filter(F.col("normalized_epin").isNotNull()).select("normalized_epin").distinct()
    exact = first.select(F.col("normalized_epin").alias("_full"), F.col("epin").alias("_exact"))
    short = first.select(F.col("normalized_epin").alias("_base"), F.col("epin").alias("_short"))
    base = F.when(F.length("normalized_epin") > 10, base_key("normalized_epin"))
    resolved = (
        keys.join(exact, F.col("normalized_epin") == F.col("_full"), "left")
        .join(short, base == F.col("_base"), "left")
        .select(
            F.col("normalized_epin").alias("_key"),
            F.coalesce("_exact", "_short").alias("solicitation_epin"),
            F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_short").isNotNull(), "base").alias("tier"),
        )
    )
    out = lookup(contracts, resolved, contracts["normalized_epin"] == resolved["_key"])
    return out.select(
        "ctr_id", "contract_id", contracts["normalized_epin"], "solicitation_epin",
        F.coalesce("tier", F.lit("none")).alias("tier"),
    )


# ---- contracts and ledger ----------------------------------------------------------------


def reconcile_contracts(contracts: DataFrame, ledger: DataFrame, vendors: DataFrame) -> DataFrame:
    """A vendor's contracts and the contracts its payments name, merged.

    A ledger id matches a contract of the same vendor by equal compact id, else by containment
    either way (the smallest contract id that fits), else it becomes a row of its own.
    Containment is an equi join between the ids of one side and the exploded pieces of the
    other, cut to the lengths that occur there. The join only keeps pieces that are ids, so a
    hot vendor yields no pairs beyond its matches.
    """
    names = vendors.select(F.col("name").alias("_vendor")).distinct()
    listed = contracts.withColumnRenamed("vendor_name", "_vendor").join(names, "_vendor", "left_semi").withColumn(
        "_nid", compact_key("contract_id")
    )
    paid = (
        ledger.filter((F.col("contract_id") != "") & F.col("payee_name").isNotNull())
        .select(F.col("payee_name").alias("_vendor"), F.col("contract_id").alias("_raw")).distinct()
        .join(names, "_vendor", "left_semi")
        .withColumn("_nid", compact_key("_raw"))
    )
    # Every id once, with the side it occurs on (1 register, 2 ledger, 3 both). The narrow tables of ids are written once:
    # every step below reads them, and none goes back to the ledger.
    paid = stored(paid, "paid-ids")
    ids = stored(
        listed.filter(F.col("_nid") != "").select("_vendor", "_nid", F.lit(1).alias("_side"))
        .unionByName(paid.select("_vendor", "_nid", F.lit(2).alias("_side")))
        .groupBy("_vendor", "_nid").agg(F.bit_or("_side").alias("_side")), "contract-ids")
    exact = ids.filter("_side = 3").select("_vendor", "_nid")
    own = ids.filter("_side <> 2").select("_vendor", "_nid")
    open_ids = ids.filter("_side = 2").select("_vendor", "_nid")
    inside = (
        with_pieces(own, "_nid", lengths_of(open_ids, "_nid"), "_piece", heads_of(open_ids, "_nid"))
        .join(open_ids.withColumnRenamed("_nid", "_piece"), ["_vendor", "_piece"], "left_semi")
        .select("_vendor", F.col("_piece").alias("_nid"), F.col("_nid").alias("_hit"))
    )
    around = (
        with_pieces(open_ids, "_nid", lengths_of(own, "_nid"), "_hit", heads_of(own, "_nid"))
        .join(own.withColumnRenamed("_nid", "_hit"), ["_vendor", "_hit"], "left_semi")
        .select("_vendor", "_nid", "_hit")
    )
    # Ids that fit nowhere stay with a NULL hit; both outcomes read this one aggregate.
    resolved = stored(inside.unionByName(around).unionByName(
        open_ids.withColumn("_hit", F.lit(None).cast("string"))
    ).groupBy("_vendor", "_nid").agg(F.min("_hit").alias("_hit")), "resolved-ids")

    hits = exact.union(resolved.filter("_hit is not null").select("_vendor", "_hit")).distinct().withColumn(
        "_seen", F.lit(True)
    )
    merged = listed.join(hits, ["_vendor", "_nid"], "left").select(
        "ctr_id", "contract_id", F.col("_vendor").alias("vendor_name"), "agency", "agency_id",
        F.col("award_amount").cast("double").alias("award_amount"),
        parse_any("start_date").cast("string").alias("start_date"),
        parse_any("end_date").cast("string").alias("end_date"),
        "status",
        F.when(F.col("_seen"), F.lit(IN_BOTH)).otherwise(F.lit(REGISTER_ONLY)).alias("source"),
    )
    # Only what is left over is profiled: other payments fall out before they are summed.
    left_over = paid.join(resolved.filter("_hit is null").select("_vendor", "_nid"), ["_vendor", "_nid"], "left_semi")
    wanted = left_over.select(F.col("_raw").alias("contract_id")).distinct()
    stats = contract_profiles(ledger.join(wanted, "contract_id", "left_semi")).drop("main_payee_name")
    ledger_rows = left_over.join(stats, left_over["_raw"] == stats["contract_id"], "left").select(
        F.col("_raw").alias("ctr_id"), F.col("_raw").alias("contract_id"), F.col("_vendor").alias("vendor_name"),
        F.col("main_agency").alias("agency"), F.lit(None).cast("string").alias("agency_id"),
        F.col("total").alias("award_amount"), F.col("first_date").alias("start_date"),
        F.col("last_date").alias("end_date"), F.lit(LEDGER_STATUS).alias("status"), F.lit(LEDGER_ONLY).alias("source"),
    )
    return merged.unionByName(ledger_rows)


def latest_contracts_first(merged: DataFrame) -> DataFrame:
    """Merged list by start date, newest first, undated last."""
    return merged.orderBy(parse_any("start_date").desc_nulls_last(), "ctr_id")


def fiscal_windows(contracts: DataFrame, current_fy: Column, fallback_years: int = 5) -> DataFrame:
    """First and last fiscal year in which a contract can have records."""
    start, end = fiscal_year(parse_mdy("start_date")), fiscal_year(parse_mdy("end_date"))
    first, last = fiscal_window(start, end, current_fy, fallback_years)
    return contracts.withColumn("first_fy", first).withColumn("last_fy", last)


def in_span(ledger: DataFrame, windows: DataFrame) -> DataFrame:
    """The ledger's years from the first to the last year of all windows: a filter on the partition column, found at run time."""
    span = windows.agg(F.min("first_fy").alias("a"), F.max("last_fy").alias("b"))
    year = F.col("fiscal_year")
    return ledger.filter((year >= span.select("a").scalar()) & (year <= span.select("b").scalar()))


def contract_spending(contracts: DataFrame, ledger: DataFrame, current_fy: Column) -> DataFrame:
    """Payments per contract and fiscal year within its window, and over all of them.

    Years that lie in no window are not read, and the ledger is reduced to (contract, year) rows before the join.
    """
    windows = fiscal_windows(contracts, current_fy).select(
        "ctr_id", hyphenless("contract_id").alias("_id"), "first_fy", "last_fy"
    )
    paid = in_span(ledger, windows).groupBy(F.col("contract_id").alias("_id"), "fiscal_year").agg(
        F.sum(amount("check_amount")).alias("_amount"), F.count("*").alias("_n")
    )
    rows = windows.join(paid, "_id").filter(F.col("fiscal_year").between(F.col("first_fy"), F.col("last_fy")))
    return rows.groupingSets([[F.col("ctr_id"), F.col("fiscal_year")], [F.col("ctr_id")]], "ctr_id", "fiscal_year").agg(
        F.sum("_amount").cast("double").alias("total"), F.sum("_n").alias("tx_count")
    ).select("ctr_id", F.coalesce(F.col("fiscal_year").cast("string"), F.lit("ALL")).alias("fiscal_year"), "total", "tx_count")


def contract_transactions(contracts: DataFrame, ledger: DataFrame, current_fy: Column, n: int = 500) -> DataFrame:
    """Latest payments per contract.

    For contracts of more than `n` payments counts by day, from narrow columns of the ledger, tell from which day on they are
    among the latest. Whole rows are joined once and ranked once, in one shuffle where a contract has one id.
    """
    windows = fiscal_windows(contracts, current_fy).select(
        "ctr_id", hyphenless("contract_id").alias("contract_id"), "first_fy", "last_fy")
    paid, keys = in_span(ledger, windows), ["contract_id", "fiscal_year"]
    busy = paid.groupBy("contract_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > n).select("contract_id")

    large = windows.join(busy, "contract_id", "left_semi").withColumn(
        "fiscal_year", F.explode(F.sequence("first_fy", "last_fy"))).drop("first_fy", "last_fy")
    days = large.join(paid.select(*keys, "issue_date"), keys).groupBy("ctr_id", "issue_date").agg(F.count("*").alias("_n"))
    cut = windows.filter("first_fy is not null and last_fy is not null").join(cut_days(days, ["ctr_id"], "issue_date", n), "ctr_id", "left")
    inside = F.col("fiscal_year").between(F.least("first_fy", "last_fy"), F.greatest("first_fy", "last_fy"))
    rows = cut.hint("merge").join(paid, "contract_id").filter(inside & since_cut("issue_date")).select(
        *keys, "ctr_id", *[c for c in paid.columns if c not in keys])
    # A contract's rows lie where the join has put them, unless another row of the contract has another id.
    several = windows.groupBy("ctr_id").agg(F.min("contract_id").alias("a"), F.max("contract_id").alias("b")).filter("a <> b")
    groups = ["ctr_id"] if several.head(1) else ["contract_id", "ctr_id"]
    return ranked(rows, groups, newest_first(rows.drop("ctr_id")), n)


def contract_metadata(contracts: DataFrame, records: DataFrame, current_fy: Column) -> DataFrame:
    """One contract record per contract, by normalised or raw id within its fiscal window.

    The earliest year wins, then the smallest id.
    """
    joined_id = F.coalesce(F.nullif(F.col("normalized_contract_id"), F.lit("")), hyphenless("contract_id"))
    ids = fiscal_windows(contracts, current_fy, 0).select(
        "ctr_id", "first_fy", "last_fy",
        F.explode(F.array_distinct(F.array(joined_id, F.col("contract_id")))).alias("prime_contract_id"),
    )
    details = [c for c in records.columns if c not in ("prime_contract_id", "fiscal_year")]
    one = records.groupBy("prime_contract_id", "fiscal_year").agg(F.min(F.struct(*details)).alias("_details"))
    found = ids.join(one, "prime_contract_id").filter(F.col("fiscal_year").between(F.col("first_fy"), F.col("last_fy")))
    best = found.groupBy("ctr_id").agg(F.min(F.struct("fiscal_year", "prime_contract_id", "_details")).alias("_b"))
    return best.select("ctr_id", "_b.prime_contract_id", "_b.fiscal_year", "_b._details.*")


# ---- vendor names and payees -------------------------------------------------------------


def names_containing(wanted: DataFrame, payees: DataFrame) -> DataFrame:
    """Pairs (name, payee) where the payee contains the name, % and _ in the name being wildcards.

    Every name looks for one piece of its longest literal part: the rarest among the payees, of the largest length in
    PIECES that fits. So a name of few letters meets the payees that hold its rarest letters, not all pieces of all payees.
    What the pieces let through is checked as a pattern.
    """
    names = wanted.select("name").distinct().withColumn("_text", longest_literal("name"))
    size = F.lit(0)
    for n in sorted(PIECES):
        size = F.when(F.length("_text") >= n, F.lit(n)).otherwise(size)
    names = names.withColumn("_size", size)
    texts = payees.select("payee_name").filter(F.col("payee_name").isNotNull()).distinct()
    sizes = names.agg(F.collect_set("_size")).scalar()
    grams = with_pieces(texts, "payee_name", sizes, "_gram").select("payee_name", "_gram").distinct()
    frequency = grams.groupBy("_gram").agg(F.count("*").alias("_count"))
    rarest = (
        with_pieces(names, "_text", F.array("_size"), "_gram").select("name", "_gram")
        .join(frequency, "_gram", "left")
        .groupBy("name")
        .agg(F.min(F.struct(F.coalesce("_count", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r"))
        .filter(F.col("_r.n") > 0)
        .select("name", F.col("_r.gram").alias("_gram"))
    )
    # A short piece stands in very many payees: they are spread over buckets, and the names that ask for it ask every bucket.
    short = F.length("_gram") < GRAM
    asked = rarest.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.when(short, F.lit(BUCKETS - 1)).otherwise(F.lit(0)))))
    spread = grams.hint("merge").withColumn("_bucket", F.when(short, F.pmod(F.hash("payee_name"), F.lit(BUCKETS))).otherwise(F.lit(0)))
    pattern = F.concat(F.lit("%"), F.col("name"), F.lit("%"))
    found = asked.join(spread, ["_gram", "_bucket"])
    return found.filter(like("payee_name", pattern)).select("name", "payee_name").distinct()


def vendor_payees(vendors: DataFrame, payees: DataFrame) -> DataFrame:
    """Payments of every vendor: payee of the same name, else payees that contain the name.

    `payees` has one row per payee (`payee_totals`); ledger rows never reach a join.
    """
    names = vendors.select("name").distinct()
    exact = names.join(payees, names["name"] == payees["payee_name"]).withColumn("tier", F.lit("exact"))
    rest = names.join(payees.select(F.col("payee_name").alias("name")), "name", "left_anti")
    contains = names_containing(rest, payees).join(payees, "payee_name").withColumn("tier", F.lit("contains"))
    matched = exact.unionByName(contains).groupBy("name", "tier").agg(
        F.count("*").alias("payees"), F.sum("tx_count").alias("tx_count"),
        F.sum("amount").cast("double").alias("total"), F.max("last_day").cast("string").alias("last_date"),
    )
    v = vendors.select("passport_supplier_id", F.col("name").alias("vendor_name"))
    return lookup(v, matched, F.col("vendor_name") == F.col("name")).select(
        "passport_supplier_id", "vendor_name", F.coalesce("tier", F.lit("none")).alias("tier"),
        F.coalesce("payees", F.lit(0)).alias("payees"), F.coalesce("tx_count", F.lit(0)).alias("tx_count"),
        "total", "last_date",
    )


def vendor_transactions(vendors: DataFrame, ledger: DataFrame, payees: DataFrame, n: int = 500) -> DataFrame:
    """Latest payments of every vendor, by the best tier of its name.

    `payees` has one row per payee (`payee_totals`). For vendors of more than `n` payments counts by day tell from which day
    on they are among the latest. Whole rows are joined once and ranked once.
    """
    names = vendors.select("name").distinct()
    exact = names.join(payees, names["name"] == payees["payee_name"], "left_semi").select(
        "name", F.col("name").alias("payee_name")
    )
    rest = names.join(payees.select(F.col("payee_name").alias("name")), "name", "left_anti")
    pairs = stored(exact.unionByName(names_containing(rest, payees)), "vendor-payees")
    named = pairs.withColumnRenamed("name", "vendor_name")
    counts = named.join(payees.select("payee_name", "tx_count"), "payee_name").groupBy("vendor_name").agg(F.sum("tx_count").alias("_n"))
    large = named.join(counts.filter(F.col("_n") > n).select("vendor_name"), "vendor_name", "left_semi")
    days = large.join(ledger.select("payee_name", "issue_date"), "payee_name").groupBy("vendor_name", "issue_date").agg(F.count("*").alias("_n"))
    cut = named.join(cut_days(days, ["vendor_name"], "issue_date", n), "vendor_name", "left")
    order = newest_first(ledger.select("payee_name", *[c for c in ledger.columns if c != "payee_name"]))

    def latest(some: DataFrame, group: str) -> DataFrame:
        rows = some.join(ledger, "payee_name").filter(since_cut("issue_date")).drop("_cut")
        return ranked(rows, [group], order, n)

    # A vendor has payees of its own name or others, never both. Under its own name the rows stay where the join has put them.
    same = F.col("vendor_name") == F.col("payee_name")
    own = latest(cut.filter(same).drop("vendor_name"), "payee_name").withColumn("vendor_name", F.col("payee_name"))
    return own.unionByName(latest(cut.filter(~same), "vendor_name")).select("vendor_name", *ledger.columns, "rank")


def award_years(vendors: DataFrame, records: DataFrame) -> DataFrame:
    """Awards per vendor and start year from contract records.

    A contract counts once, with its first start and largest amount. Vendors without a record
    of their exact name use the wildcard form of the name; its literal head is joined to the
    exploded prefixes of the recorded names, then checked as a pattern. Years without a total are dropped.
    """
    per_contract = records.filter(F.col("prime_contract_start_date").isNotNull()).groupBy(
        "prime_vendor", "prime_contract_id"
    ).agg(
        F.min(parse_any("prime_contract_start_date")).alias("_start"),
        F.max(amount("prime_contract_original_amount")).alias("_amount"),
    )
    names = vendors.select("name").distinct()
    recorded = per_contract.select("prime_vendor").filter(F.col("prime_vendor").isNotNull()).distinct()
    exact = names.join(recorded, names["name"] == recorded["prime_vendor"]).select(
        "name", "prime_vendor", F.lit("exact").alias("tier")
    )
    rest = names.join(recorded, names["name"] == recorded["prime_vendor"], "left_anti").withColumn(
        "_pattern", fallback_pattern("name")
    ).filter(F.col("_pattern").isNotNull()).withColumn("_head", F.element_at(F.split("_pattern", WILDCARDS), 1))
    heads = with_prefixes(recorded, "prime_vendor", lengths_of(rest, "_head"), "_head")
    wildcard = rest.join(heads, "_head").filter(like("prime_vendor", "_pattern")).select(
        "name", "prime_vendor", F.lit("wildcard").alias("tier")
    )
    per_vendor = exact.unionByName(wildcard).join(per_contract, "prime_vendor").groupBy(
        "name", "tier", "prime_contract_id"
    ).agg(F.min("_start").alias("_start"), F.max("_amount").alias("_amount"))
    return per_vendor.groupBy(F.col("name").alias("vendor_name"), "tier", F.year("_start").alias("year")).agg(
        F.sum("_amount").cast("double").alias("total")
    ).filter(F.col("year").isNotNull() & (F.col("total") != 0))
