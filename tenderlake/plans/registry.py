"""Every query of the repository over the given tables, by name."""

from __future__ import annotations

import glob
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.dates import fiscal_year, iso_to_mdy_text, parse_mdy, strip_midnight
from tenderlake.functions.keys import compact_key, contained_either_way, hyphenless, leading_segment, normalized_key
from tenderlake.functions.money import clean_money, count_text, currency_text, exact_sum, millions_text, percent, percent_text
from tenderlake.functions.text import excerpt, fy_label, key_label, or_default, plain_text, truncated
from tenderlake.operators import ledger as led
from tenderlake.operators import linkage, pages, profiles, quality, rollups
from tenderlake.operators.ranking import first_per_key
from tenderlake.operators.search import numeric_sort_key, rows_after
from tenderlake.plans import tools
from tenderlake.plans.views import Views, customer_name
from tenderlake.session import scratch_path
from tenderlake.sources import exports, feeds, landing, ledger as ledger_files, paged, posts, progress
from tenderlake.streaming import ledger_stream

Query = Callable[[SparkSession, str], DataFrame]

# Rows of a file of XML that is landed, some 30 MB.
XML_ROWS = 200_000
# Posts that a task writes.
POSTS = 250
# Reports that depend on today take a fixed day, so that they can be compared.
AS_OF = "2025-06-30"
CURRENT_FY = 2026


def _current_fy():
    return F.lit(CURRENT_FY)


def _view(build: Callable[[Views], DataFrame]) -> Query:
    return lambda spark, folder: build(Views(spark, folder))


def money_key_cleaning(v: Views) -> DataFrame:
    """Every word of the documents through the key and money rules."""
    words = v.table("documents").select(F.explode(F.split("text", r"\s+")).alias("token")).filter(F.col("token") != "")
    counted = words.groupBy("token").agg(F.count("*").alias("occurrences"))
    return counted.select(
        "token", "occurrences", normalized_key("token").alias("normalized_key"), clean_money("token").alias("money"),
        compact_key("token").alias("compact_key"), hyphenless("token").alias("hyphenless"),
    )


def _title(c: str):
    return F.regexp_extract(c, r"(?is)<title>(.*?)</title>", 1)


def post_excerpts(v: Views) -> DataFrame:
    text = plain_text("html")
    return v.table("pages").select("page_id", _title("html").alias("title"), text.alias("_text")).select(
        "page_id", "title", F.length("_text").alias("text_length"), excerpt(None, F.col("_text")).alias("excerpt")
    )


def _raw_posts(v: Views) -> DataFrame:
    """Pages written as posts with front matter."""
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 366).cast("int"))
    return v.table("pages").select(
        F.col("page_id").cast("string").alias("slug"),
        F.concat(F.lit("Title: "), _title("html"), F.lit("\nDate: "), day.cast("string"), F.lit("\n\n"), "html").alias("raw"),
    )


def posts_newest(v: Views) -> DataFrame:
    return posts.newest(posts.parse_posts(_raw_posts(v)), 3).select("slug", "title", "date")


def display_labels(v: Views) -> DataFrame:
    start = parse_mdy("start_date")
    return v.contracts().select(
        "ctr_id", currency_text("award_amount").alias("amount_text"), truncated("contract_id", 12).alias("title"),
        F.date_format(start, "MM/dd/yyyy").alias("start_text"), or_default("status", "N/A").alias("status_text"),
        fy_label(fiscal_year(start)).alias("fy_label"), key_label(F.lit("procurement_method")).alias("method_label"),
        F.lit(linkage.REGISTER_ONLY).alias("source"), count_text(F.col("ctr_id").cast("long")).alias("count_text"),
    )


def first_wins_dedupe(v: Views) -> DataFrame:
    c = v.contracts().withColumn("_order", F.col("ctr_id").cast("long"))
    return first_per_key(c, "normalized_epin", [F.col("_order")]).select("normalized_epin", "ctr_id", "contract_id", "agency")


def agency_dimension(v: Views) -> DataFrame:
    s = v.solicitations().withColumn("_seq_key", F.col("epin"))
    c = v.contracts().withColumn("_seq_key", F.col("ctr_id"))
    return feeds.agency_dimension(s, c, "_seq_key")


def numeric_aware_sort_key(v: Views) -> DataFrame:
    cells = v.ledger().groupBy(F.col("check_amount").alias("cell")).agg(F.count("*").alias("cells"))
    number, text = numeric_sort_key("cell")
    return cells.select("cell", number.alias("number_key"), text.alias("text_key"), "cells")


# ---- queries that write first ------------------------------------------------------------


def parquet_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger written per fiscal year, one year with an extra column, read back by name."""
    root = scratch_path(spark, "ledger")
    rows = Views(spark, folder).ledger().select("issue_date", "payee_name", "check_amount", "fiscal_year")
    plain, extended = rows.filter("fiscal_year <> 2025"), rows.filter("fiscal_year = 2025")
    ledger_files.write_ledger(plain, root)
    ledger_files.write_ledger(extended.withColumn("department", F.lit("Parks")), root)
    return ledger_files.read_ledger(spark, root).groupBy("fiscal_year").agg(
        F.count("*").alias("tx_count"), exact_sum("check_amount").alias("total"),
        F.count("department").alias("with_department"),
    )


def _as_feed(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """A view under the headers of its feed, missing fields empty."""
    return df.select(*[
        (F.col(c).cast("string") if c in df.columns else F.lit("")).alias(h) for h, c in headers.items()
    ])


def _roundtrip(spark: SparkSession, df: DataFrame, headers: dict[str, str], label: str) -> str:
    path = scratch_path(spark, label)
    ledger_files.write_csv(_as_feed(df, headers), path)
    return path


def csv_vendors_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    v = Views(spark, folder).vendors()
    return feeds.read_vendors(spark, _roundtrip(spark, v, feeds.VENDORS, "vendors")).select(*v.columns)


def csv_contracts_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    c = Views(spark, folder).contracts().withColumn("epin", F.lower("normalized_epin")).withColumn(
        "award_amount", F.concat(F.lit("$"), F.format_number("award_amount", 2))
    )
    return feeds.read_contracts(spark, _roundtrip(spark, c, feeds.CONTRACTS, "contracts")).select(
        "ctr_id", "contract_id", "normalized_contract_id", "normalized_epin", "base_epin", "vendor_name", "award_amount", "start_date"
    )


def csv_solicitations_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    s = Views(spark, folder).solicitations()
    return feeds.read_solicitations(spark, _roundtrip(spark, s, feeds.SOLICITATIONS, "solicitations")).select(
        "epin", "normalized_epin", "procurement_name", "agency", "rfx_status", "release_date"
    )


def csv_valid_notices(spark: SparkSession, folder: str) -> DataFrame:
    n = Views(spark, folder).notices()
    return feeds.read_notices(spark, _roundtrip(spark, n, feeds.NOTICES, "notices"), only_valid=True).select("RequestID", "PIN")


def csv_line_counts(spark: SparkSession, folder: str) -> DataFrame:
    v = Views(spark, folder)
    parts = []
    for label, df, headers in (("vendors", v.vendors(), feeds.VENDORS), ("contracts", v.contracts(), feeds.CONTRACTS)):
        path = _roundtrip(spark, df, headers, f"lines-{label}")
        parts.append(feeds.line_count(spark, path).select(F.lit(label).alias("dataset"), "record_count"))
    return parts[0].unionByName(parts[1])


def freshness_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Progress files per fiscal year, half of the last year still to come."""
    rows = Views(spark, folder).ledger().groupBy("fiscal_year").agg(
        F.count("*").alias("total_records"), F.max("issue_date").alias("last_updated")
    )
    done = F.when(F.col("fiscal_year") == CURRENT_FY, F.floor(F.col("total_records") / 2)).otherwise(F.col("total_records"))
    path = scratch_path(spark, "progress")
    progress.write_progress(rows.withColumn("last_record_downloaded", done).drop("fiscal_year"), path)
    state = progress.read_progress(spark, path).withColumn("dataset", F.lit("ledger"))
    return quality.freshness(state, F.lit("2026-01-01 12:00:00").cast("timestamp_ntz"), "dataset")


def csv_entities_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    e = Views(spark, folder).entities()
    path = _roundtrip(spark, e, feeds.ENTITIES, "entities")
    return feeds.read_entities(spark, path).select("organization_name", "normalized_name")


def csv_people_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    p = Views(spark, folder).table("supplier").select(
        F.col("s_suppkey").cast("string").alias("mocs_peopleid"), customer_name(F.col("s_suppkey")).alias("organization_name"),
        F.col("s_name").alias("last_name"))
    return feeds.read_people(spark, _roundtrip(spark, p, feeds.PEOPLE, "people")).select("mocs_peopleid", "last_name", "normalized_org_name")


def csv_notices_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """All notices, every one delivered twice: the first of a request stays."""
    n = Views(spark, folder).notices()
    path = _roundtrip(spark, n.unionByName(n), feeds.NOTICES, "all-notices")
    return feeds.read_notices(spark, path).select("RequestID", "TypeOfNoticeDescription", "PIN")


def csv_contract_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts have no key: rows delivered twice stay twice."""
    c = Views(spark, folder).contracts().withColumn("epin", F.col("normalized_epin"))
    path = _roundtrip(spark, c.unionByName(c.filter("status = 'F'")), feeds.CONTRACTS, "twice")
    return feeds.read_contracts(spark, path).groupBy("status").agg(F.count("*").alias("rows"), F.countDistinct("ctr_id").alias("contracts"))


def csv_evaluations_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    e = Views(spark, folder).evaluations()
    back = feeds.read_child(spark, _roundtrip(spark, e, feeds.EVALUATIONS, "evaluations"), "evaluations")
    return back.groupBy("vendor_name", "rating").agg(F.count("*").alias("evaluations"), F.max("contract_id").alias("last_id"))


def ledger_year_files(spark: SparkSession, folder: str) -> DataFrame:
    """Two years of a ledger read as an explicit list of folders."""
    root = scratch_path(spark, "ledger-files")
    ledger_files.write_ledger(Views(spark, folder).ledger().select("agency", "check_amount", "fiscal_year"), root)
    rows = ledger_files.read_files(spark, [f"{root}/fiscal_year={y}" for y in (2022, 2023)], root)
    return rows.groupBy("fiscal_year", "agency").agg(F.count("*").alias("tx_count"), exact_sum("check_amount").alias("total"))


def contract_record_years(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "records")
    ledger_files.write_ledger(Views(spark, folder).contract_records(), root)
    rows = ledger_files.read_contract_records(spark, root)
    return rows.groupBy("fiscal_year").agg(F.count("*").alias("records"), F.countDistinct("prime_vendor").alias("vendors"))


def landing_json(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows landed as JSON."""
    path = scratch_path(spark, "landing-json")
    Views(spark, folder).ledger().select("payee_name", "check_amount", F.col("fiscal_year").cast("string")).write.json(path)
    rows = landing.read_landing(spark, path, "json", feeds.text_schema(["payee_name", "check_amount", "fiscal_year"]))
    return rows.groupBy("fiscal_year").agg(F.count("*").alias("tx_count"), exact_sum("check_amount").alias("total"))


def export_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """A result stored on first use, then exported as CSV and read back."""
    v, path = Views(spark, folder), scratch_path(spark, "export")
    kept = exports.read_through(spark, f"{path}/totals", lambda: rollups.status_breakdown(v.contracts()))
    exports.export_csv(kept, path, "totals.csv")
    back = spark.read.option("header", True).csv(f"{path}/totals.csv")
    return back.select("status", F.col("count").cast("long").alias("count"))


def post_by_slug(v: Views) -> DataFrame:
    return posts.by_slug(posts.parse_posts(_raw_posts(v)), "7").select("slug", "title", "date")


def _two_drops(spark: SparkSession, folder: str, columns: list[str], load: Callable[[str], None]) -> None:
    """Land the ledger in two drops and run the load after each, and once more with nothing new."""
    rows = Views(spark, folder).ledger().select(*columns)
    drop = scratch_path(spark, "landing")
    for part in (0, 1):
        ledger_files.write_csv(rows.filter(F.col("fiscal_year") % 2 == part), drop)
        load(drop)
    load(drop)


def ledger_stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    target, checkpoint = scratch_path(spark, "stream-ledger"), scratch_path(spark, "stream-ledger-state")
    columns = ["payee_name", "check_amount", "fiscal_year", "issue_date", "contract_id"]
    schema = feeds.text_schema(columns)
    _two_drops(spark, folder, columns, lambda drop: ledger_stream.ingest(spark, drop, target, checkpoint, schema=schema))
    return ledger_files.read_ledger(spark, target).groupBy("fiscal_year").agg(
        F.count("*").alias("tx_count"), exact_sum("check_amount").alias("total"),
        F.countDistinct("contract_id").alias("contract_ids"), F.countDistinct("payee_name").alias("payees"),
    )


def ledger_stream_monthly(spark: SparkSession, folder: str) -> DataFrame:
    rollup, checkpoint = scratch_path(spark, "stream-months"), scratch_path(spark, "stream-months-state")
    columns = ["check_amount", "fiscal_year", "issue_date"]
    schema = feeds.text_schema(columns)
    _two_drops(spark, folder, columns,
               lambda drop: ledger_stream.maintain_monthly(spark, drop, rollup, checkpoint, schema=schema))
    return ledger_stream.read_monthly(spark, rollup)


def ledger_stream_broken_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A batch whose write breaks after half of the fiscal years, and the run that repeats it."""
    target, checkpoint, drop = (scratch_path(spark, f"broken-{x}") for x in ("ledger", "state", "landing"))
    columns = ["payee_name", "check_amount", "fiscal_year", "issue_date", "contract_id"]
    ledger_files.write_csv(Views(spark, folder).ledger().select(*columns), drop)

    def half(batch: DataFrame, root: str, name: str) -> None:
        ledger_stream.write_batch(batch.filter(F.col("fiscal_year") % 2 == 0), root, name)
        raise OSError("the write broke half way")

    schema = feeds.text_schema(columns)
    try:
        ledger_stream.ingest(spark, drop, target, checkpoint, schema=schema, write=half)
    except StreamingQueryException:
        ledger_stream.ingest(spark, drop, target, checkpoint, schema=schema)
    return ledger_files.read_ledger(spark, target).groupBy("fiscal_year").agg(
        F.count("*").alias("tx_count"), exact_sum("check_amount").alias("total"), F.countDistinct("payee_name").alias("payees"))


def ledger_stream_folded_months(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly totals over a batch for each landed file, three batches folded into one."""
    rollup, checkpoint, drop = (scratch_path(spark, f"fold-{x}") for x in ("months", "state", "landing"))
    columns = ["check_amount", "fiscal_year", "issue_date"]
    ledger_files.write_csv(Views(spark, folder).ledger().select(*columns).repartition(8), drop)
    ledger_stream.maintain_monthly(
        spark, drop, rollup, checkpoint, schema=feeds.text_schema(columns), fold=3, files_per_trigger=1)
    return ledger_stream.read_monthly(spark, rollup)


def paged_delta_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger from an interface of pages: half of its rows, a restart, and what was added meanwhile."""
    root, target, checkpoint = (scratch_path(spark, f"paged-{x}") for x in ("files", "ledger", "state"))
    columns = ["payee_name", "check_amount", "fiscal_year", "issue_date"]
    rows = Views(spark, folder).ledger().select(*[F.col(c).cast("string").alias(c) for c in columns])
    local = root.removeprefix("file://").removeprefix("file:")
    source = paged.paged_source(
        "ledger_pages", feeds.text_schema(columns), *paged.parquet_pages(lambda: sorted(glob.glob(f"{local}/drop=*/*.parquet"))))
    for part in (0, 1):
        rows.filter(F.col("fiscal_year") % 2 == part).write.parquet(f"{root}/drop={part}")
        ledger_stream.ingest_stream(paged.stream_pages(spark, source), target, checkpoint, write=ledger_stream.write_pages)
    return ledger_files.read_ledger(spark, target).groupBy("fiscal_year").agg(
        F.count("*").alias("tx_count"), exact_sum("check_amount").alias("total"))


def landing_xml(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows landed as XML."""
    path, columns = scratch_path(spark, "landing-xml"), ["payee_name", "check_amount", "fiscal_year"]
    rows = Views(spark, folder).ledger().select(*[F.col(c).cast("string").alias(c) for c in columns])
    # A file is read by one task, so its rows are bounded.
    rows.write.format("xml").option("rowTag", landing.ROW_TAG).option("rootTag", "transactions").option(
        "maxRecordsPerFile", XML_ROWS).save(path)
    back = landing.read_landing(spark, path, "xml", feeds.text_schema(columns))
    return back.groupBy("fiscal_year").agg(F.count("*").alias("tx_count"), exact_sum("check_amount").alias("total"))


def ledger_source_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Two ledgers, even and odd years, each read because the session's settings name it."""
    rows, found = Views(spark, folder).ledger().select("payee_name", "check_amount", "fiscal_year"), []
    prefix = "spark.tenderlake.ledger"
    for k, kind in enumerate(("local", "remote")):
        root = scratch_path(spark, f"{kind}-ledger")
        ledger_files.write_ledger(rows.filter(F.col("fiscal_year") % 2 == k), root)
        spark.conf.set(f"{prefix}.{kind}", root)
    for kind, remote in (("local", "false"), ("remote", "true")):
        spark.conf.set(f"{prefix}.useRemote", remote)
        found.append(ledger_files.configured_ledger(spark).groupBy("fiscal_year").agg(
            F.count("*").alias("tx_count")).withColumn("source", F.lit(kind)))
    for name in ("local", "remote", "useRemote"):
        spark.conf.unset(f"{prefix}.{name}")
    return found[0].unionByName(found[1])


def dataset_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Exported datasets and one that is not there, with their numbers of records."""
    v, path = Views(spark, folder), scratch_path(spark, "datasets")
    for name, df in (("vendors.csv", v.vendors()), ("contracts.csv", v.contracts())):
        exports.export_csv(df, path, name)
    found = {"Vendors": f"{path}/vendors.csv", "Contracts": f"{path}/contracts.csv", "Nothing": f"{path}/nothing.csv"}
    return exports.dataset_info(spark, found, F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")).select(
        "name", "record_count", "next_update", (F.col("last_updated") == "Not Found").alias("not_found"))


def post_files(spark: SparkSession, folder: str) -> DataFrame:
    """Posts written to a folder each and read as whole files."""
    path, raw = scratch_path(spark, "posts"), _raw_posts(Views(spark, folder))
    # A post takes a file and a folder, so many more tasks than the bytes ask for write them.
    posts.write_post_files(raw, path, max(1, -(-raw.count() // POSTS)))
    return posts.parse_posts(posts.read_post_files(spark, path)).select("slug", "title", "date", "author")


def amount_labels(v: Views) -> DataFrame:
    """Awards by program: share and millions as text, with the day of the last one."""
    totals = v.contracts().groupBy("program").agg(
        exact_sum("award_amount").alias("total"), F.max(parse_mdy("start_date")).cast("string").alias("last_day"))
    whole = v.contracts().agg(exact_sum("award_amount")).scalar()
    return totals.select(
        key_label("program").alias("program_label"), percent_text(percent("total", whole)).alias("share_text"),
        millions_text("total").alias("millions_text"), iso_to_mdy_text("last_day").alias("last_text"))


def entity_last_vendor(v: Views) -> DataFrame:
    """Every fifth vendor registered twice under one name: entities match the last registration."""
    k, again = F.col("passport_supplier_id").cast("long"), F.concat("passport_supplier_id", F.lit("-2"))
    vendors = v.vendors().select("passport_supplier_id", "name")
    twice = vendors.unionByName(vendors.filter(k % 5 == 0).withColumn("passport_supplier_id", again))
    return linkage.match_entities(v.entities(), twice).select("entity_id", "matched_vendor_id")


def award_years_of_corps(v: Views) -> DataFrame:
    """Every seventh vendor under its name with CORP, which the records do not have: found by the wildcard form."""
    name = F.concat("name", F.lit(" CORP")).alias("name")
    return linkage.award_years(v.vendors().filter(F.col("passport_supplier_id").cast("long") % 7 == 0).select(name), v.contract_records())


def reconcile_cut_ids(v: Views) -> DataFrame:
    """Payments that name a contract without its last digit, where that is a 3: the contract's id holds theirs."""
    cut = F.when(F.col("contract_id").endswith("3"), F.expr("left(contract_id, length(contract_id) - 1)")).otherwise(F.col("contract_id"))
    return linkage.reconcile_contracts(v.contracts(), v.ledger().withColumn("contract_id", cut), v.vendors())


def key_containment(v: Views) -> DataFrame:
    """Whether the contract key and the agency number hold one another."""
    return v.contracts().filter(F.col("normalized_epin").isNotNull()).select(
        "ctr_id", contained_either_way("normalized_epin", "agency_id").alias("contained"))


def registry_numbers(v: Views) -> DataFrame:
    """Nested numbers of registry JSON by typed paths; every seventh text is broken."""
    k = F.col("c_custkey")
    text = F.to_json(F.struct(
        F.col("c_name").alias("name"), F.struct(k.alias("number"), F.struct((k % 50 + 1970).alias("year")).alias("filed")).alias("company")))
    matches = v.table("customer").select(
        k.cast("string").alias("passport_vendor_id"), F.when(k % 7 == 0, F.concat(F.lit("{"), text)).otherwise(text).alias("raw_data"))
    return profiles.registry_fields(matches, {
        "registered_name": ("$.name", "string"), "company_number": ("$.company.number", "bigint"), "filed_year": ("$.company.filed.year", "int"),
        "missing": ("$.company.closed", "int")})


def _matched(v: Views) -> DataFrame:
    return linkage.match_entities(v.entities(), v.vendors())


VIEW_QUERIES: dict[str, Callable[[Views], DataFrame]] = {
    # agencies and contracts
    "agency_rollup_top_vendor": lambda v: rollups.agency_rollup(v.agencies(), v.contracts()),
    "table_counts": lambda v: rollups.table_counts(v.counted()),
    "database_overview": lambda v: rollups.overview(v.contracts(), v.solicitations()),
    "distinct_agencies_union": lambda v: rollups.distinct_agencies(v.contracts(), v.solicitations()),
    "award_by_start_year": lambda v: rollups.award_by_start_year(v.contracts()),
    "top_vendors_by_award": lambda v: rollups.top_by_award(v.contracts(), "vendor_name"),
    "top_agencies_by_award": lambda v: rollups.top_by_award(v.contracts(), "agency"),
    "top_industries": lambda v: rollups.top_by_award(v.contracts(), "industry", 6, allow_blank=False),
    "top_methods": lambda v: rollups.top_by_count(v.contracts(), "procurement_method", 6),
    "total_award": lambda v: rollups.total_award(v.contracts()),
    "contract_stats_filtered": lambda v: rollups.contract_stats(v.contracts(), "nation_1", 2023),
    "contract_status_breakdown": lambda v: rollups.status_breakdown(v.contracts()),
    "agency_top10_by_count": lambda v: rollups.top_agencies_by_count(v.contracts()),
    "agency_summary": lambda v: rollups.agency_summary(v.contracts()),
    "agency_top_vendors": lambda v: rollups.agency_top_vendors(v.contracts(), 10, 2021),
    "agency_recent": lambda v: rollups.agency_recent(v.contracts()),
    "agency_vendor_table": lambda v: rollups.agency_vendor_table(v.contracts(), v.vendors()),
    "agency_timeline": lambda v: rollups.agency_timeline(v.contracts(), v.solicitations()),
    "agency_year_stats": lambda v: rollups.agency_year_stats(v.contracts()),
    "agency_yearly": lambda v: rollups.agency_yearly(v.contracts()),
    "vendor_stats_breakdown": lambda v: rollups.vendor_stats(v.vendors()),
    "solicitation_stats_breakdown": lambda v: rollups.solicitation_stats(v.solicitations()),
    "yearly_trends": lambda v: rollups.yearly_trends(v.contracts(), v.solicitations()),
    # search and pages
    # one record and what belongs to it
    "vendor_profile_tool": lambda v: tools.get_vendor_profile(v.vendors(), v.contracts(), "7").withColumn(
        "recent", F.array_join("recent", ", ")),
    "contract_details": lambda v: tools.get_contract_details(v.contracts(), v.solicitations(), "15"),
    "solicitation_details": lambda v: tools.get_solicitation_details(v.solicitations(), v.contracts(), "00000-0012Y").select(
        "epin", "procurement_name", "contract_count", "total_awarded"),
    "agency_contracts_top_vendors": lambda v: tools.get_agency_contracts(v.contracts(), "nation_3")["top_vendors"],
    "agency_contracts_recent": lambda v: tools.get_agency_contracts(v.contracts(), "nation_3")["recent"].select(
        "ctr_id", "agency", "vendor_name", "start_date"),
    "vendor_detail_contracts": lambda v: tools.vendor_detail(
        v.vendors(), v.contracts(), v.ledger(), "7", v.children())["contracts"],
    "vendor_detail_transactions": lambda v: tools.vendor_detail(
        v.vendors(), v.contracts(), v.ledger(), "10", v.children())["transactions"].select("vendor_name", "payee_name", "issue_date", "check_amount", "rank"),
    "contract_detail_spending": lambda v: tools.contract_detail(
        v.contracts(), v.solicitations(), v.notices(), v.ledger(), v.contract_records(), "15", _current_fy())["spending"],
    "contract_or_ledger": lambda v: tools.contract_or_ledger(v.contracts(), v.ledger(), "15"),
    "chart_contracts_by_agency": lambda v: tools.get_chart_data(v.contracts(), v.ledger(), "contracts_by_agency"),
    "chart_contracts_by_status": lambda v: tools.get_chart_data(v.contracts(), v.ledger(), "contracts_by_status"),
    "chart_series_industries": lambda v: rollups.chart_series(
        rollups.top_by_award(v.contracts(), "industry", 6, allow_blank=False), F.col("total"), "industry", "total").select(
            F.array_join("labels", "|").alias("labels"), F.size("data_values").alias("n")),
    "contract_title_search": lambda v: pages.contracts_page(v.contracts(), v.solicitations(), q="services 1").select(
        "ctr_id", "contract_title", "total_rows", "total_pages"),
    "solicitation_industry_page": lambda v: pages.solicitations_page(v.solicitations(), v.contracts(), industry="INDUSTRY_2").select(
        "epin", "industry", "total_rows", "total_pages"),
    "contracts_page_after": lambda v: rows_after(
        v.contracts().select("ctr_id", "award_amount", "agency"), {"award_amount": False, "ctr_id": True},
        {"award_amount": 200000.0, "ctr_id": ""}, 50),
    "notice_links_segment": lambda v: linkage.notices_by_segment(
        v.contracts().withColumn("contract_id", F.concat("base_epin", F.lit("-"), "contract_id")), v.notices(), normalised=True),
    "contract_notice_links_exact": lambda v: linkage.contract_notices(v.notices(), v.contracts(), False),
    "post_by_slug": post_by_slug,
    "vendor_search": lambda v: tools.search_vendors(v.vendors(), "customer#%7", 100),
    "contract_search": lambda v: tools.search_contracts(v.contracts(), "ct1", "customer", "nation_2", "O", 100),
    "solicitation_search": lambda v: tools.search_solicitations(v.solicitations(), "ring", "Closed", "nation", 100),
    "vendor_page": lambda v: pages.vendors_page(
        v.vendors(), v.contracts(), _matched(v), v.digital(), q="customer", linked="yes", mwbe="WBE",
        sort="amount", order="desc", page=2),
    "vendor_membership": lambda v: linkage.with_membership(v.vendors(), _matched(v)).select("passport_supplier_id", "in_entities"),
    "key_checks": lambda v: v.contracts().select(
        "ctr_id", leading_segment("contract_id").alias("segment"), contained_either_way("normalized_epin", "base_epin").alias("contained")),
    "release_days": lambda v: v.solicitations().select("epin", strip_midnight("release_date").alias("released")),
    "vendors_unmatched": lambda v: linkage.unmatched_vendors(v.vendors(), _matched(v)),
    "contracts_page": lambda v: pages.contracts_page(
        v.contracts(), v.solicitations(), status="F", connected="solicitations", page=2
    ).withColumn("start_day", parse_mdy("start_date")),
    "solicitations_page": lambda v: pages.solicitations_page(v.solicitations(), v.contracts(), connected="contracts"),
    "contracts_with_solicitation": lambda v: linkage.contracts_with_solicitation(
        v.contracts(), v.solicitations()).groupBy("agency").agg(F.count("*").alias("contracts")),
    "solicitations_with_contract": lambda v: linkage.solicitations_with_contract(
        v.solicitations(), v.contracts()).select("epin", "normalized_epin", "agency"),
    # digital vendors
    "digital_summary": lambda v: rollups.digital_summary(v.contracts(), v.digital()),
    "digital_trend": lambda v: rollups.digital_trend(v.contracts(), v.digital()),
    "digital_by_agency": lambda v: rollups.digital_by_agency(v.contracts(), v.digital()),
    "digital_vendor_table": lambda v: pages.digital_vendors_page(v.vendors(), v.digital(), v.contracts()),
    "digital_contract_table": lambda v: pages.digital_contracts_page(v.contracts(), v.digital()),
    "expiring_contracts": lambda v: pages.expiring_page(v.contracts(), v.digital(), F.to_date(F.lit(AS_OF)), page=2),
    "expiring_by_year": lambda v: rollups.expiring_by_year(v.contracts(), v.digital()),
    "expiring_by_agency": lambda v: rollups.expiring_by_agency(v.contracts(), v.digital()),
    "classification_stats": lambda v: rollups.classification_stats(v.digital()),
    "fy_trend_unpivot": lambda v: rollups.fy_trend(v.digital()),
    "vendor_fy_series": lambda v: rollups.vendor_fy_series(v.digital()),
    "class_top10": lambda v: rollups.class_top(v.digital()),
    "contract_characteristics": lambda v: rollups.contract_characteristics(v.contract_records(), v.digital()),
    # linkage
    "entity_vendor_match": _matched,
    "matched_entities": lambda v: rollups.matched_entities(_matched(v)),
    "notice_links_exact": lambda v: linkage.solicitation_notices(v.notices(), v.solicitations(), False),
    "notice_links_normalised": lambda v: linkage.solicitation_notices(v.notices(), v.solicitations(), True),
    "contract_notice_links": lambda v: linkage.contract_notices(v.notices(), v.contracts(), True),
    "notice_links_partial": lambda v: linkage.partial_links(v.notices(), v.solicitations()),
    "notice_links_contract_prefix": lambda v: linkage.notices_by_segment(
        v.contracts(), v.notices(), F.col("base_epin"), normalised=True),
    "linkage_sample": lambda v: linkage.sample_links(v.notices(), v.solicitations()),
    "notice_key_sample": lambda v: linkage.sample_keys(v.notices(), "PIN"),
    "linkage_quality": lambda v: linkage.linkage_quality(v.notices(), v.solicitations(), v.contracts()),
    "notice_key_valid": lambda v: v.notices().select("RequestID", "PIN", quality.valid_notice_key().alias("valid")),
    "load_verification": lambda v: quality.load_verification(v.notices(), v.solicitations()),
    "solicitation_contracts": lambda v: linkage.solicitation_contracts(v.solicitations(), v.contracts()),
    "solicitation_first_contracts": lambda v: linkage.solicitation_first_contracts(v.solicitations(), v.contracts()),
    "contract_solicitation_two_tier": lambda v: linkage.two_tier_solicitation(v.contracts(), v.solicitations()),
    "contract_ledger_reconcile": lambda v: linkage.reconcile_contracts(
        v.contracts(), v.ledger(), v.vendors()),
    "vendor_payee_match": lambda v: linkage.vendor_payees(v.vendors(), v.payees()),
    "vendor_latest_transactions": lambda v: linkage.vendor_transactions(v.vendors(), v.ledger(), v.payees()),
    "contract_fy_spending": lambda v: linkage.contract_spending(
        v.contracts(), v.ledger(), _current_fy()),
    "contract_latest_transactions": lambda v: linkage.contract_transactions(v.contracts(), v.ledger(), _current_fy()),
    "checkbook_details_link": lambda v: linkage.contract_metadata(v.contracts(), v.contract_records(), _current_fy()),
    "unique_contract_year_totals": lambda v: linkage.award_years(v.vendors(), v.contract_records()),
    "vendor_award_years": lambda v: profiles.vendor_award_years(v.contracts()),
    "contract_vendor_link": lambda v: linkage.contract_vendor(v.contracts(), v.vendors()).select(
        "ctr_id", "contract_id", "vendor_name", "vendor_id"),
    "contract_vendor_recent": lambda v: profiles.vendors_with_recent(v.vendors(), v.contracts()).withColumn(
        "recent", F.array_join("recent", ", ")),
    "vendor_profile": lambda v: profiles.vendor_profile(
        v.vendors(), v.contracts(), _matched(v), v.people(), v.entity_summary(), v.registry_matches(), v.digital(), v.children()),
    "vendor_profile_children": lambda v: profiles.vendor_children(v.vendors(), v.children()),
    # ledger
    "ledger_contract_profiles": lambda v: led.contract_profiles(
        v.ledger()),
    "ledger_search": lambda v: led.ledger_page(v.ledger(), "econ", 2, 100),
    "ledger_deep_page": lambda v: led.ledger_page(v.ledger(), "", 401, 100),
    "ledger_recent_search": lambda v: led.search_transactions(v.ledger(), "corp", 500, led.DEFAULT_YEARS),
    "vendor_ledger_by_year": lambda v: led.payee_by_year(
        v.ledger()),
    "vendor_ledger_summary": lambda v: led.vendor_summary(v.ledger(), "corp"),
    "vendor_ledger_years": lambda v: led.vendor_by_year(v.ledger(), "corp"),
    "ledger_by_year_agency": lambda v: led.by_year_and_agency(v.ledger()),
    "chart_spending_by_agency": lambda v: led.spending_by_agency(v.ledger()),
    "chart_spending_by_year": lambda v: led.spending_by_year(v.ledger()),
    "ledger_monthly_last12": lambda v: led.latest_months(led.monthly_totals(v.ledger())),
    "ledger_latest_per_payee": lambda v: led.latest_per_payee(v.ledger()),
    "numeric_aware_sort_key": numeric_aware_sort_key,
    # cleaning and text
    "first_wins_dedupe": first_wins_dedupe,
    "agency_dimension": agency_dimension,
    "money_key_cleaning": money_key_cleaning,
    "post_excerpts": post_excerpts,
    "posts_newest": posts_newest,
    "display_labels": display_labels,
    "amount_labels": amount_labels,
    "key_containment": key_containment,
    "award_years_of_corps": award_years_of_corps,
    "reconcile_cut_ids": reconcile_cut_ids,
    "entity_last_vendor": entity_last_vendor,
    "registry_numbers": registry_numbers,
    "vendor_category_page": lambda v: pages.vendors_page(
        v.vendors(), v.contracts(), _matched(v), v.digital(), category="BUILDING", categories=("BUILDING", "MACHINERY"), page=2),
    "expiring_today": lambda v: pages.expiring_page(v.contracts(), v.digital()).select(
        "contract_id", "ctr_id", "end_date", "classification", "total_rows"),
}

FILE_QUERIES: dict[str, Query] = {
    "parquet_sources": parquet_sources,
    "csv_vendors_roundtrip": csv_vendors_roundtrip,
    "csv_contracts_roundtrip": csv_contracts_roundtrip,
    "csv_solicitations_roundtrip": csv_solicitations_roundtrip,
    "csv_valid_notices": csv_valid_notices,
    "csv_line_counts": csv_line_counts,
    "csv_entities_roundtrip": csv_entities_roundtrip,
    "csv_people_roundtrip": csv_people_roundtrip,
    "csv_notices_roundtrip": csv_notices_roundtrip,
    "csv_contract_duplicates": csv_contract_duplicates,
    "csv_evaluations_roundtrip": csv_evaluations_roundtrip,
    "ledger_year_files": ledger_year_files,
    "contract_record_years": contract_record_years,
    "landing_json": landing_json,
    "export_roundtrip": export_roundtrip,
    "freshness_rollup": freshness_rollup,
    "ledger_stream_ingest": ledger_stream_ingest,
    "ledger_stream_monthly": ledger_stream_monthly,
    "ledger_stream_broken_batch": ledger_stream_broken_batch,
    "ledger_stream_folded_months": ledger_stream_folded_months,
    "paged_delta_ingest": paged_delta_ingest,
    "landing_xml": landing_xml,
    "ledger_source_choice": ledger_source_choice,
    "post_files": post_files,
    "dataset_listing": dataset_listing,
}


def queries() -> dict[str, Query]:
    return {**{name: _view(build) for name, build in VIEW_QUERIES.items()}, **FILE_QUERIES}
