"""Payment ledger: search, totals by year, agency, month and payee."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.dates import first_day, last_day, parse_iso
from tenderlake.functions.keys import contains_text
from tenderlake.functions.money import amount, amount_value, billions, exact_sum
from tenderlake.operators.ranking import latest_per_group, top_per_group
from tenderlake.operators.search import LEDGER_PAGE_SIZES, allowed, any_contains, capped, page_at_with_next

DEFAULT_YEARS = (2022, 2023, 2024)
SUMMARY_YEARS = (2020, 2021, 2022, 2023, 2024)

# Ledger fields and the names that the list view gives them.
PAGE_FIELDS = {
    "issue_date": "issue_date", "agency": "agency_name", "payee_name": "vendor_name",
    "contract_id": "contract_id", "expense_category": "expense_category",
    "check_amount": "check_amount", "fiscal_year": "fiscal_year", "industry": "industry",
    "spending_category": "spending_category", "department": "department",
    "budget_code": "budget_code", "sub_vendor": "sub_vendor",
    "associated_prime_vendor": "associated_prime_vendor",
}


def in_years(ledger: DataFrame, fiscal_year: int | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """Literal filter on the partition column: other years are not read. Neither given: all years."""
    wanted = [fiscal_year] if fiscal_year else years
    return ledger if wanted is None else ledger.filter(F.col("fiscal_year").isin(*wanted))


def newest_first(df: DataFrame) -> list[Column]:
    """Latest first; the remaining columns make the order total."""
    return [F.col("issue_date").desc_nulls_last(), *[F.col(c) for c in df.columns if c != "issue_date"]]


def ledger_page(ledger: DataFrame, q: str, page: int = 1, limit: int = 20) -> DataFrame:
    """Search over payee, agency, contract and expense category, with look-ahead paging to any depth."""
    size = allowed(limit, LEDGER_PAGE_SIZES, 20)
    found = ledger.filter(any_contains(["payee_name", "agency", "contract_id", "expense_category"], q))
    rows = found.select(*[
        (amount_value(c) if c == "check_amount" else F.col(c)).alias(name) for c, name in PAGE_FIELDS.items()
    ])
    keys = [("issue_date", False), *[(c, True) for c in rows.columns if c != "issue_date"]]
    return page_at_with_next(rows, keys, page, size)


def search_transactions(ledger: DataFrame, q: str, limit: int = 50, years: Sequence[int] | None = None) -> DataFrame:
    """Latest matches of the given years (all without), with the sum over the rows shown."""
    found = in_years(ledger, years=years).filter(any_contains(["payee_name", "agency", "contract_id"], q)).select(
        "issue_date", "agency", "payee_name", "contract_id", "expense_category",
        amount_value("check_amount").alias("check_amount"),
    )
    shown = found.orderBy(*newest_first(found)).limit(capped(limit, 200))
    return shown.withColumn("total_shown", shown.agg(F.coalesce(exact_sum("check_amount"), F.lit(0.0))).scalar())


def vendor_summary(ledger: DataFrame, name: str, fiscal_year: int | None = None) -> DataFrame:
    """Payments to payees whose name contains `name`; all years unless one is given."""
    rows = ledger.filter(contains_text("payee_name", name))
    if fiscal_year:
        rows = rows.filter(F.col("fiscal_year") == fiscal_year)
    return rows.agg(
        F.count("*").alias("tx_count"),
        exact_sum("check_amount").alias("total"),
        first_day("issue_date").alias("first_tx"),
        last_day("issue_date").alias("last_tx"),
    )


def vendor_by_year(ledger: DataFrame, name: str, years=SUMMARY_YEARS) -> DataFrame:
    """Totals per fiscal year, newest first; years without payments are left out."""
    rows = in_years(ledger, years=years).filter(contains_text("payee_name", name))
    return rows.groupBy("fiscal_year").agg(exact_sum("check_amount").alias("total")).filter(
        F.col("total") != 0
    ).orderBy(F.desc("fiscal_year"))


def payee_totals(ledger: DataFrame) -> DataFrame:
    """One row per payee: what linking payees to vendors needs of the ledger."""
    return ledger.filter(F.col("payee_name").isNotNull()).groupBy("payee_name").agg(
        F.count("*").alias("tx_count"),
        F.sum(amount("check_amount")).alias("amount"),
        F.max(parse_iso("issue_date")).alias("last_day"),
    )


def payee_by_year(ledger: DataFrame) -> DataFrame:
    """The summary of every payee and year at once."""
    return ledger.groupBy("payee_name", "fiscal_year").agg(
        F.count("*").alias("tx_count"),
        exact_sum("check_amount").alias("total"),
        first_day("issue_date").alias("first_tx"),
        last_day("issue_date").alias("last_tx"),
    )


def by_year_and_agency(ledger: DataFrame, n: int = 10) -> DataFrame:
    """Fiscal-year totals with the leading agencies of each year."""
    per_agency = ledger.groupBy("fiscal_year", "agency").agg(
        F.count("*").alias("_n"), F.sum(amount("check_amount")).alias("_amount")
    )
    years = per_agency.groupBy("fiscal_year").agg(
        F.sum("_n").alias("tx_count"), F.sum("_amount").cast("double").alias("year_total")
    )
    order = [F.col("_amount").desc_nulls_last(), F.col("agency")]
    top = top_per_group(per_agency, ["fiscal_year"], order, n)
    return top.join(years, "fiscal_year").select(
        "fiscal_year", "rank", "agency", F.col("_amount").cast("double").alias("total"), "tx_count", "year_total"
    )


def spending_by_agency(ledger: DataFrame, fiscal_year: int = 2024, n: int = 10) -> DataFrame:
    """Chart rows in billions."""
    totals = in_years(ledger, fiscal_year).groupBy("agency").agg(exact_sum("check_amount").alias("total"))
    top = totals.orderBy(F.col("total").desc_nulls_last(), "agency").limit(n)
    return top.select(F.substring("agency", 1, 30).alias("label"), billions("total").alias("value"))


def spending_by_year(ledger: DataFrame, years=SUMMARY_YEARS) -> DataFrame:
    totals = in_years(ledger, years=years).groupBy("fiscal_year").agg(exact_sum("check_amount").alias("total"))
    return totals.select(
        F.concat(F.lit("FY"), F.col("fiscal_year").cast("string")).alias("label"),
        F.coalesce(billions("total"), F.lit(0.0)).alias("value"),
    )


def monthly_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.substring("issue_date", 1, 7).alias("month")).agg(exact_sum("check_amount").alias("total"))


def latest_months(monthly: DataFrame, n: int = 12) -> DataFrame:
    """The latest months in ascending order; a missing month is dropped after the limit."""
    latest = monthly.orderBy(F.col("month").desc_nulls_last()).limit(n)
    return latest.filter(F.col("month").isNotNull() & (F.col("month") != "")).orderBy("month")


def contract_profiles(ledger: DataFrame) -> DataFrame:
    """First and last payment, total and most frequent agency and payee per contract id.

    The ledger is counted once by (contract, agency, payee). Both modes come from that: its groups are summed by agency and
    by payee, so no task holds a hot contract's values; the mode is the largest group, the smallest value on a tie.
    """
    day, keys = parse_iso("issue_date"), ("contract_id", "agency", "payee_name")
    counted = ledger.select(*keys, day.alias("_day"), amount("check_amount").alias("_amount")).groupBy(*keys).agg(
        F.min("_day").alias("_first"), F.max("_day").alias("_last"), F.sum("_amount").alias("_amount"), F.count("*").alias("_n"),
    )
    sets = [[F.col("contract_id"), F.col("agency")], [F.col("contract_id"), F.col("payee_name")]]
    groups = counted.groupingSets(sets, *keys).agg(
        F.grouping("payee_name").alias("_by_agency"),
        F.min("_first").alias("_first"), F.max("_last").alias("_last"),
        F.sum("_amount").alias("_amount"), F.sum("_n").alias("_n"),
    )
    by_agency = F.col("_by_agency") == 1

    def mode(column: str, group: Column) -> Column:
        size = F.when(group & F.col(column).isNotNull(), F.struct(-F.col("_n"), F.col(column)))
        return F.min(size)[column].alias(f"main_{column}")

    return groups.groupBy("contract_id").agg(
        F.min("_first").cast("string").alias("first_date"), F.max("_last").cast("string").alias("last_date"),
        F.sum(F.when(by_agency, F.col("_amount"))).cast("double").alias("total"),
        mode("agency", by_agency), mode("payee_name", ~by_agency),
    )


def latest_per_payee(ledger: DataFrame, n: int = 500) -> DataFrame:
    """The latest payments of every payee, with their position."""
    return latest_per_group(ledger, "payee_name", "issue_date", newest_first(ledger.drop("payee_name"))[1:], n)
