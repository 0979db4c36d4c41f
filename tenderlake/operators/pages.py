"""List pages: filter, sort, page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.dates import parse_any, parse_mdy
from tenderlake.operators.linkage import (
    contracts_with_solicitation,
    matched_vendors,
    solicitations_with_contract,
    unmatched_vendors,
    with_contract_stats,
    with_membership,
)
from tenderlake.operators.search import (
    BUSINESS_CATEGORIES,
    DIGITAL_CLASSES,
    all_of,
    allowed,
    certification,
    equals,
    matches_any,
    page_at,
    page_rows,
    sort_order,
    with_totals,
)

LIST_SIZE = 50
REPORT_SIZE = 10


def vendors_page(vendors: DataFrame, contracts: DataFrame, entities: DataFrame, digital: DataFrame,
                 q: str | None = None, category: str | None = None, linked: str | None = None,
                 tag: str | None = None, mwbe: str | None = None, sort: str = "name", order: str = "asc",
                 page: int = 1, categories=BUSINESS_CATEGORIES) -> DataFrame:
    """Vendor list with entity marker and contract statistics.

    Sorted by name, only the vendors of the page get statistics; sorted by a statistic,
    contracts are summed once for all.
    """
    found = vendors.filter(all_of([
        certification(mwbe),
        matches_any(["name", "passport_supplier_id", "fms_vendor_code"], q),
        equals("business_category", allowed(category, categories)),
    ]))
    if linked in ("yes", "mocs"):
        found = matched_vendors(found, entities)
    elif linked == "no":
        found = unmatched_vendors(found, entities)
    if allowed(tag, DIGITAL_CLASSES):
        ids = digital.filter(F.col("classification") == tag).select(
            F.col("matched_passport_id").alias("passport_supplier_id")
        ).distinct()
        found = found.join(ids, "passport_supplier_id", "left_semi")
    found = found.distinct()
    columns = {"name": "name", "contracts": "contract_count", "amount": "total_awarded"}
    by = sort_order(columns, sort, "name", order, ["passport_supplier_id"])
    if columns.get(sort, "name") == "name":
        shown = page_rows(found, by, page, LIST_SIZE)
        own = contracts.join(shown.select(F.col("name").alias("vendor_name")).distinct(), "vendor_name", "left_semi")
        shown = with_contract_stats(shown, own)
    else:
        shown = page_rows(with_contract_stats(found, contracts), by, page, LIST_SIZE)
    shown = with_membership(shown, entities)
    return with_totals(shown, found, LIST_SIZE, F.countDistinct("passport_supplier_id"))


def contracts_page(contracts: DataFrame, solicitations: DataFrame, q: str | None = None, status: str | None = None,
                   method: str | None = None, industry: str | None = None, connected: str | None = None,
                   page: int = 1) -> DataFrame:
    """Contract list, latest start first."""
    found = contracts.filter(all_of([
        matches_any(["contract_id", "normalized_contract_id", "contract_title"], q), equals("status", status), equals("procurement_method", method), equals("industry", industry),
    ]))
    if connected == "solicitations":
        found = contracts_with_solicitation(found, solicitations)
    dated = found.withColumn("_day", parse_any("start_date"))
    shown = page_at(dated, [("_day", False), ("ctr_id", True)], page, LIST_SIZE).drop("_day")
    return with_totals(shown, found, LIST_SIZE)


def solicitations_page(solicitations: DataFrame, contracts: DataFrame, q: str | None = None, status: str | None = None,
                       method: str | None = None, industry: str | None = None, connected: str | None = None,
                       page: int = 1) -> DataFrame:
    """Solicitation list, latest release first."""
    found = solicitations.filter(all_of([
        matches_any(["epin", "procurement_name"], q), equals("rfx_status", status),
        equals("procurement_method", method), equals("industry", industry),
    ]))
    if connected == "contracts":
        found = solicitations_with_contract(found, contracts)
    dated = found.withColumn("_day", parse_any("release_date"))
    shown = page_at(dated, [("_day", False), ("epin", True)], page, LIST_SIZE).drop("_day")
    return with_totals(shown, found, LIST_SIZE)


def _digital_contracts(contracts: DataFrame, digital: DataFrame) -> DataFrame:
    tags = digital.filter(F.col("classification").isin(*DIGITAL_CLASSES)).select(
        "vendor_name", "classification", "matched_passport_id"
    )
    return contracts.join(tags, "vendor_name")


def _tagged_page(contracts: DataFrame, digital: DataFrame, by: Sequence[Column], page: int) -> DataFrame:
    """One page of contracts with the tags of their vendors, and the number of all of them.

    Narrow rows tell which contracts come up to the end of the page; only those meet the tags as a whole. The total is
    counted by vendor, so no contract is joined for it.
    """
    needed = [c for c in contracts.columns if c in ("ctr_id", "vendor_name", "award_amount", "_start", "_end")]
    upto = _digital_contracts(contracts.select(*needed), digital).orderBy(*by).limit(max(page, 1) * REPORT_SIZE)
    ids = upto.select(F.col("ctr_id").alias("_id"), F.col("vendor_name").alias("_vendor")).distinct()
    few = contracts.join(ids, F.col("ctr_id").eqNullSafe(F.col("_id")) & (F.col("vendor_name") == F.col("_vendor")), "left_semi")
    shown = page_rows(_digital_contracts(few, digital), by, page, REPORT_SIZE)
    own = contracts.groupBy("vendor_name").agg(F.count("*").alias("_contracts"))
    tags = digital.filter(F.col("classification").isin(*DIGITAL_CLASSES)).groupBy("vendor_name").agg(F.count("*").alias("_tags"))
    rows = F.coalesce(F.sum(F.col("_contracts") * F.col("_tags")), F.lit(0))
    return with_totals(shown, own.join(tags, "vendor_name"), REPORT_SIZE, rows)


def digital_vendors_page(vendors: DataFrame, digital: DataFrame, contracts: DataFrame, sort: str = "contracts",
                         order: str = "desc", page: int = 1) -> DataFrame:
    tags = digital.filter(F.col("classification").isin(*DIGITAL_CLASSES)).select(
        "classification", F.col("matched_passport_id").alias("passport_supplier_id")
    )
    found = vendors.join(tags, "passport_supplier_id")
    columns = {"name": "name", "contracts": "contract_count", "amount": "total_awarded", "classification": "classification"}
    by = sort_order(columns, sort, "contracts", order, ["passport_supplier_id"])
    shown = page_rows(with_contract_stats(found, contracts), by, page, REPORT_SIZE)
    return with_totals(shown, found, REPORT_SIZE)


def digital_contracts_page(contracts: DataFrame, digital: DataFrame, sort: str = "amount", order: str = "desc",
                           page: int = 1) -> DataFrame:
    """All contracts of digital vendors; dates sort as dates."""
    dated = contracts.withColumn("_start", parse_mdy("start_date")).withColumn("_end", parse_mdy("end_date"))
    columns = {"vendor": "vendor_name", "amount": "award_amount", "date": "_start", "end_date": "_end", "classification": "classification"}
    by = sort_order(columns, sort, "amount", order, ["ctr_id", "classification"])
    return _tagged_page(dated, digital, by, page).drop("_start", "_end")


def _expiring(contracts: DataFrame, as_of: Column, before: int) -> DataFrame:
    end = parse_mdy("end_date")
    return contracts.filter(
        (F.length("end_date") == 10) & (end >= as_of) & (F.year(end) < before) & (F.col("award_amount") > 0)
    )


def expiring(contracts: DataFrame, digital: DataFrame, as_of: Column, before: int = 2030) -> DataFrame:
    """Contracts of digital vendors that end on or after `as_of` and before the year `before`."""
    return _digital_contracts(_expiring(contracts, as_of, before), digital).select(
        "contract_id", "ctr_id", "vendor_name", "end_date", "award_amount", "classification", "matched_passport_id"
    )


def expiring_page(contracts: DataFrame, digital: DataFrame, as_of: Column | None = None, sort: str = "date",
                  order: str = "asc", page: int = 1, before: int = 2030) -> DataFrame:
    """Soonest end first unless sorted by amount; an unknown direction means upwards."""
    kept = _expiring(contracts, F.current_date() if as_of is None else as_of, before)
    dated = kept.select("contract_id", "ctr_id", "vendor_name", "end_date", "award_amount", parse_mdy("end_date").alias("_end"))
    by = sort_order({"date": "_end", "amount": "award_amount"}, sort, "date",
                    allowed(order, ("asc", "desc"), "asc"), ["ctr_id", "classification"])
    shown = _tagged_page(dated, digital, by, page)
    return shown.select(
        "contract_id", "ctr_id", "vendor_name", "end_date", "award_amount", "classification", "matched_passport_id",
        "total_rows", "total_pages")
