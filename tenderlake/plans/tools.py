"""Named tools and detail pages as functions over domain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.dates import parse_any
from tenderlake.functions.keys import base_key
from tenderlake.functions.text import or_default
from tenderlake.operators import ledger as led
from tenderlake.operators import linkage, pages, profiles, rollups
from tenderlake.operators.search import all_of, capped, equals, matches_any, partial
from tenderlake.sources.posts import newest


def search_vendors(vendors: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return vendors.filter(matches_any(["name"], query)).orderBy("name").limit(capped(limit, 100)).select(
        "passport_supplier_id", "name", or_default("certification_type", "None").alias("certification"),
        or_default("ethnicity", "N/A").alias("ethnicity"), or_default("business_category", "N/A").alias("category"),
    )


def search_contracts(contracts: DataFrame, query: str | None = None, vendor: str | None = None,
                     agency: str | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
    """Latest contracts that meet all given conditions."""
    found = contracts.filter(all_of([
        matches_any(["contract_id", "contract_title"], query),
        partial("vendor_name", vendor), partial("agency", agency), equals("status", status),
    ]))
    latest = found.orderBy(parse_any("start_date").desc_nulls_last(), "ctr_id").limit(capped(limit, 100))
    return latest.select("contract_id", "contract_title", "vendor_name", "agency", "award_amount", "status", "start_date")


def search_solicitations(solicitations: DataFrame, query: str | None = None, status: str | None = None,
                         agency: str | None = None, limit: int = 20) -> DataFrame:
    found = solicitations.filter(all_of([
        matches_any(["epin", "procurement_name"], query), equals("rfx_status", status), partial("agency", agency),
    ]))
    latest = found.orderBy(parse_any("release_date").desc_nulls_last(), "epin").limit(capped(limit, 100))
    return latest.select("epin", "procurement_name", "agency", "rfx_status", "release_date", "procurement_method")


def get_vendor_profile(vendors: DataFrame, contracts: DataFrame, vendor_id: str) -> DataFrame:
    one = vendors.filter(F.col("passport_supplier_id") == vendor_id)
    own = contracts.join(one.select(F.col("name").alias("vendor_name")), "vendor_name", "left_semi")
    return profiles.vendors_with_recent(one, own).join(
        one.select("passport_supplier_id", or_default("certification_type", "None").alias("certification"),
                   or_default("ethnicity", "N/A").alias("ethnicity"),
                   or_default("business_category", "N/A").alias("category")),
        "passport_supplier_id",
    )


def get_contract_details(contracts: DataFrame, solicitations: DataFrame, contract_id: str) -> DataFrame:
    """A contract by either id, with its solicitation."""
    one = profiles.contract_by_either_id(contracts, contract_id)
    link = linkage.two_tier_solicitation(one, solicitations).select("ctr_id", "solicitation_epin", "tier")
    return one.join(link, "ctr_id")


def get_solicitation_details(solicitations: DataFrame, contracts: DataFrame, epin: str) -> DataFrame:
    """A solicitation with count and total of its contracts."""
    one = solicitations.filter(F.col("epin") == epin)
    stats = linkage.solicitation_contracts(one, contracts).select("epin", "contract_count", "total_awarded")
    return one.join(stats, "epin")


def get_agency_contracts(contracts: DataFrame, agency: str, limit: int = 10) -> dict[str, DataFrame]:
    """Summary, five leading vendors and latest contracts of the agencies matching a text."""
    found = contracts.filter(all_of([partial("agency", agency)]))
    top = found.groupBy("vendor_name").agg(
        F.count("*").alias("count"), rollups.exact_sum("award_amount").alias("total")
    ).orderBy(F.desc("total"), "vendor_name").limit(5)
    recent = found.orderBy(parse_any("start_date").desc_nulls_last(), "ctr_id").limit(capped(limit, 50))
    return {"summary": rollups.agency_summary(contracts, agency), "top_vendors": top, "recent": recent}


def get_contract_stats(contracts: DataFrame, agency: str | None = None, fiscal_year: int | None = None) -> dict[str, DataFrame]:
    out = {
        "stats": rollups.contract_stats(contracts, agency, fiscal_year),
        "by_status": rollups.status_breakdown(contracts, agency, fiscal_year),
    }
    if not agency:
        out["top_agencies"] = rollups.top_agencies_by_count(contracts, 10, agency, fiscal_year)
    return out


def get_vendor_spending(ledger: DataFrame, vendor_name: str, fiscal_year: int | None = None) -> dict[str, DataFrame]:
    return {
        "summary": led.vendor_summary(ledger, vendor_name, fiscal_year),
        "by_year": led.vendor_by_year(ledger, vendor_name),
    }


def get_spending_by_year(ledger: DataFrame, fiscal_year: int) -> DataFrame:
    """Total of a fiscal year with its ten leading agencies."""
    return led.by_year_and_agency(led.in_years(ledger, fiscal_year))


def search_transactions(ledger: DataFrame, query: str, limit: int = 50, years: Sequence[int] | None = led.DEFAULT_YEARS) -> DataFrame:
    """Latest matches of the named years; `None` searches all."""
    return led.search_transactions(ledger, query, limit, years)


def get_vendor_stats(vendors: DataFrame) -> DataFrame:
    return rollups.vendor_stats(vendors)


def get_solicitation_stats(solicitations: DataFrame, agency: str | None = None) -> DataFrame:
    return rollups.solicitation_stats(solicitations, agency)


def get_yearly_trends(contracts: DataFrame, solicitations: DataFrame) -> DataFrame:
    return rollups.yearly_trends(contracts, solicitations)


def get_database_overview(agencies: DataFrame, vendors: DataFrame, contracts: DataFrame,
                          solicitations: DataFrame) -> dict[str, DataFrame]:
    tables = {"agencies": agencies, "vendors": vendors, "contracts": contracts, "solicitations": solicitations}
    return {"counts": rollups.table_counts(tables), "overview": rollups.overview(contracts, solicitations)}


def tech_spending(digital: DataFrame) -> dict[str, DataFrame]:
    return {
        "classes": rollups.classification_stats(digital),
        "top": rollups.class_top(digital),
        "trend": rollups.fy_trend(digital).orderBy("year"),
    }


def digital_report(vendors: DataFrame, contracts: DataFrame, digital: DataFrame, records: DataFrame,
                   as_of: Column | None = None) -> dict[str, DataFrame]:
    return {
        "vendors": pages.digital_vendors_page(vendors, digital, contracts),
        "contracts": pages.digital_contracts_page(contracts, digital),
        "expiring": pages.expiring_page(contracts, digital, as_of),
        "expiring_by_year": rollups.expiring_by_year(contracts, digital),
        "expiring_by_agency": rollups.expiring_by_agency(contracts, digital),
        "summary": rollups.digital_summary(contracts, digital),
        "trend": rollups.digital_trend(contracts, digital),
        "by_agency": rollups.digital_by_agency(contracts, digital),
        "characteristics": rollups.contract_characteristics(records, digital),
    }


def get_chart_data(contracts: DataFrame, ledger: DataFrame, data_type: str, fiscal_year: int = 2024,
                   limit: int = 10) -> DataFrame:
    """Label and value of one of four charts."""
    if data_type == "spending_by_agency":
        return led.spending_by_agency(ledger, fiscal_year, limit)
    if data_type == "spending_by_year":
        return led.spending_by_year(ledger)
    if data_type == "contracts_by_agency":
        top = rollups.top_by_count(contracts, "agency", limit, allow_blank=True)
        return top.select(F.substring("agency", 1, 25).alias("label"), F.col("count").alias("value"))
    if data_type == "contracts_by_status":
        return rollups.status_breakdown(contracts).select(F.col("status").alias("label"), F.col("count").alias("value"))
    raise ValueError(f"unknown data type: {data_type}")


def dashboard(contracts: DataFrame, solicitations: DataFrame, vendors: DataFrame, posts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of the front page; `posts` are parsed posts, of which the newest three are shown."""
    return ({} if posts is None else {"posts": newest(posts, 3)}) | {
        "counts": rollups.table_counts({"vendors": vendors, "contracts": contracts, "solicitations": solicitations}),
        "agencies": rollups.distinct_agencies(contracts, solicitations),
        "spending": rollups.total_award(contracts),
        "time": rollups.award_by_start_year(contracts),
        "vendors": rollups.top_by_award(contracts, "vendor_name").withColumn("label", F.substring("vendor_name", 1, 30)),
        "top_agencies": rollups.top_by_award(contracts, "agency"),
        "industry": rollups.top_by_award(contracts, "industry", 6, allow_blank=False),
        "method": rollups.top_by_count(contracts, "procurement_method", 6),
    }


def contract_or_ledger(contracts: DataFrame, ledger: DataFrame, contract_id: str) -> DataFrame:
    """A contract by its register id; without one, what the ledger says about that contract id."""
    columns = ["ctr_id", "contract_id", "agency", "vendor_name", "award_amount", "start_date", "end_date", "status"]
    listed = contracts.filter(F.col("ctr_id") == contract_id).select(*columns)
    paid = led.contract_profiles(ledger.filter(F.col("contract_id") == contract_id)).select(
        F.col("contract_id").alias("ctr_id"), "contract_id", F.col("main_agency").alias("agency"),
        F.col("main_payee_name").alias("vendor_name"), F.col("total").alias("award_amount"),
        F.col("first_date").alias("start_date"), F.col("last_date").alias("end_date"),
        F.lit("Checkbook Record").alias("status"),
    )
    return listed.unionByName(paid.join(listed.select("ctr_id"), "ctr_id", "left_anti"))


def agency_detail(contracts: DataFrame, solicitations: DataFrame, vendors: DataFrame, agency_id: str) -> dict[str, DataFrame]:
    c = contracts.filter(F.col("agency_id") == agency_id)
    s = solicitations.filter(F.col("agency_id") == agency_id)
    return {
        "stats": rollups.agency_year_stats(c),
        "timeline": rollups.agency_timeline(c, s).orderBy("month"),
        "yearly": rollups.agency_yearly(c).orderBy("year"),
        "top_vendors": rollups.agency_top_vendors(c, 10, 2021),
        "vendors": rollups.agency_vendor_table(c, vendors).orderBy(F.desc("amount"), "vendor_name"),
    }


def solicitation_notices_detail(solicitations: DataFrame, notices: DataFrame, epin: str) -> DataFrame:
    one = solicitations.filter(F.col("epin") == epin).select(F.col("epin").alias("PIN"))
    return notices.join(one, "PIN", "left_semi")


def vendor_detail(vendors: DataFrame, contracts: DataFrame, ledger: DataFrame, vendor_id: str,
                  children: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Merged contracts and child records of one vendor; the filter reaches every scan by name."""
    one = vendors.filter(F.col("passport_supplier_id") == vendor_id)
    return {
        "contracts": linkage.latest_contracts_first(linkage.reconcile_contracts(contracts, ledger, one)),
        "years": profiles.vendor_award_years(
            contracts.join(one.select(F.col("name").alias("vendor_name")), "vendor_name", "left_semi")
        ),
        "transactions": linkage.vendor_transactions(one, ledger, led.payee_totals(ledger)),
        "children": profiles.vendor_children(one, children),
    }


def contract_detail(contracts: DataFrame, solicitations: DataFrame, notices: DataFrame, ledger: DataFrame,
                    records: DataFrame, ctr_id: str, current_fy: Column) -> dict[str, DataFrame]:
    one = contracts.filter(F.col("ctr_id") == ctr_id)
    return {
        "contract": contract_or_ledger(contracts, ledger, ctr_id),
        "solicitation": linkage.two_tier_solicitation(one, solicitations),
        "notices": linkage.notices_by_segment(one, notices),
        "notices_by_key": linkage.notices_by_segment(one, notices, base_key("normalized_epin"), normalised=True),
        "spending": linkage.contract_spending(one, ledger, current_fy),
        "transactions": linkage.contract_transactions(one, ledger, current_fy),
        "record": linkage.contract_metadata(one, records, current_fy),
    }
