"""Aggregates over contracts, vendors and solicitations.

Money is summed as decimal, ties are broken by name, and every aggregate that feeds a join is
taken before the join, so that a hot vendor or agency reaches the join as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.dates import month_key, parse_any, parse_mdy
from tenderlake.functions.keys import contains_text, year_in_id
from tenderlake.functions.money import MONEY, amount, exact_avg, exact_sum, percent
from tenderlake.functions.text import or_default
from tenderlake.operators.ranking import last_per_key, top_per_group
from tenderlake.operators.search import DIGITAL_CLASSES, all_of, filled, partial, sort_order

FIRST_CHART_YEAR, END_CHART_YEAR = 2022, 2030


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    frames = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def distinct_agencies(contracts: DataFrame, solicitations: DataFrame) -> DataFrame:
    names = [df.filter(filled("agency")).select("agency") for df in (contracts, solicitations)]
    return names[0].union(names[1]).agg(F.countDistinct("agency").alias("agencies"))


def _per_vendor(contracts: DataFrame, *keys: str) -> DataFrame:
    return contracts.groupBy(*keys).agg(
        F.count("ctr_id").alias("_n"), F.sum(amount("award_amount")).alias("_amount")
    )


def agency_rollup(agencies: DataFrame, contracts: DataFrame, q: str | None = None,
                  sort: str = "amount", order: str = "desc") -> DataFrame:
    """Contracts, award total and leading vendor per agency; agencies without contracts stay."""
    per_vendor = _per_vendor(contracts, "agency_id", "vendor_name")
    leading = F.min_by(
        "vendor_name",
        F.struct(F.col("_amount").isNull(), -F.col("_amount"), F.col("vendor_name")),
    )
    per_agency = per_vendor.groupBy("agency_id").agg(
        F.sum("_n").alias("_count"),
        F.sum("_amount").cast("double").alias("total_amount"),
        leading.alias("top_vendor"),
    )
    chosen = agencies.filter(all_of([partial("name", q)]))
    out = chosen.join(per_agency, chosen["id"] == per_agency["agency_id"], "left").select(
        "id", "name", F.coalesce("_count", F.lit(0)).alias("contract_count"), "total_amount", "top_vendor"
    )
    columns = {"name": "name", "count": "contract_count", "amount": "total_amount"}
    return out.orderBy(*sort_order(columns, sort, "amount", order, ["id"]))


def award_by_start_year(contracts: DataFrame, first: int = FIRST_CHART_YEAR, end: int = END_CHART_YEAR) -> DataFrame:
    """Award total per start year, from year `first` to before `end`; by default what the dashboard shows."""
    c = contracts.filter(F.length("start_date") == 10).select(
        F.substring("start_date", 7, 4).try_cast("int").alias("year"), "award_amount"
    )
    return c.filter(F.col("year").between(first, end - 1)).groupBy("year").agg(
        exact_sum("award_amount").alias("total")
    )


def top_by_award(contracts: DataFrame, column: str, n: int = 10, allow_blank: bool = True) -> DataFrame:
    """Largest award totals by a column; NULL never counts, '' only where blanks are allowed."""
    keep = F.col(column).isNotNull() if allow_blank else filled(column)
    totals = contracts.filter(keep).groupBy(column).agg(exact_sum("award_amount").alias("total"))
    return totals.orderBy(F.desc("total"), column).limit(n)


def top_by_count(df: DataFrame, column: str, n: int, allow_blank: bool = False) -> DataFrame:
    kept = df if allow_blank else df.filter(filled(column))
    return kept.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)


def total_award(contracts: DataFrame) -> DataFrame:
    return contracts.agg(F.coalesce(exact_sum("award_amount"), F.lit(0.0)).alias("total"))


def contract_filter(agency: str | None = None, fiscal_year: int | None = None) -> Column:
    """The fiscal year may stand anywhere in the contract id."""
    return all_of([
        partial("agency", agency),
        contains_text("contract_id", str(fiscal_year)) if fiscal_year else None,
    ])


def contract_stats(contracts: DataFrame, agency: str | None = None, fiscal_year: int | None = None) -> DataFrame:
    return contracts.filter(contract_filter(agency, fiscal_year)).agg(
        F.count("*").alias("contract_count"),
        exact_sum("award_amount").alias("total_amount"),
        exact_avg("award_amount").alias("avg_amount"),
        F.min("award_amount").alias("min_amount"),
        F.max("award_amount").alias("max_amount"),
    )


def status_breakdown(contracts: DataFrame, agency: str | None = None, fiscal_year: int | None = None) -> DataFrame:
    return (
        contracts.filter(contract_filter(agency, fiscal_year))
        .groupBy("status")
        .agg(F.count("*").alias("count"), exact_sum("award_amount").alias("total"))
        .select(or_default("status", "Unknown").alias("status"), "count", "total")
        .orderBy(F.desc("count"), "status")
    )


def top_agencies_by_count(contracts: DataFrame, n: int = 10, agency: str | None = None,
                          fiscal_year: int | None = None) -> DataFrame:
    return (
        contracts.filter(contract_filter(agency, fiscal_year))
        .groupBy("agency")
        .agg(F.count("*").alias("count"), exact_sum("award_amount").alias("total"))
        .orderBy(F.desc("count"), "agency")
        .limit(n)
    )


def agency_summary(contracts: DataFrame, agency: str | None = None) -> DataFrame:
    """Contracts, total and distinct vendors per agency, or of all agencies matching a text."""
    keys = [] if agency else ["agency"]
    per_vendor = (
        contracts.filter(all_of([partial("agency", agency)]))
        .groupBy(*keys, "vendor_name")
        .agg(F.count("*").alias("_n"), F.sum(amount("award_amount")).alias("_amount"))
    )
    return per_vendor.groupBy(*keys).agg(
        F.sum("_n").alias("contract_count"),
        F.sum("_amount").cast("double").alias("total_amount"),
        F.count("vendor_name").alias("unique_vendors"),
    )


def agency_top_vendors(contracts: DataFrame, n: int = 10, since_year: int | None = None) -> DataFrame:
    c = contracts if since_year is None else contracts.filter(F.year(parse_mdy("start_date")) >= since_year)
    totals = c.groupBy("agency", "vendor_name").agg(
        F.count("*").alias("count"), exact_sum("award_amount").alias("total")
    )
    return top_per_group(totals, ["agency"], [F.desc("total"), F.col("vendor_name")], n)


def agency_recent(contracts: DataFrame, n: int = 10) -> DataFrame:
    """Latest contracts of every agency."""
    dated = contracts.withColumn("_start", parse_any("start_date"))
    order = [F.col("_start").desc_nulls_last(), F.col("ctr_id")]
    return top_per_group(dated, ["agency"], order, n).select(
        "agency", "rank", "ctr_id", "contract_id", "vendor_name", "award_amount", "start_date", "status"
    )


def agency_vendor_table(contracts: DataFrame, vendors: DataFrame, order: str = "passport_supplier_id") -> DataFrame:
    """Contracts and amount by agency and vendor, with the vendor's id where its name is known."""
    totals = contracts.filter(filled("vendor_name")).groupBy("agency_id", "vendor_name").agg(
        F.count("*").alias("contracts"),
        F.coalesce(exact_sum("award_amount"), F.lit(0.0)).alias("amount"),
    )
    named = vendors.select("name", "passport_supplier_id", F.col(order).alias("_last"))
    ids = last_per_key(named, "name", ["_last"])
    return totals.join(ids, totals["vendor_name"] == ids["name"], "left").select(
        "agency_id", "vendor_name", "contracts", "amount", F.col("passport_supplier_id").alias("vendor_id")
    )


def agency_timeline(contracts: DataFrame, solicitations: DataFrame, since_year: int = 2020) -> DataFrame:
    """Contracts and solicitations per agency and month; a month missing on one side counts 0.

    Both feeds are reduced to (agency, month) rows before they meet, and they meet in a union
    and a second small aggregate instead of a full outer join.
    """
    started = parse_mdy("start_date")
    released = parse_mdy(F.coalesce(F.nullif(F.col("release_date"), F.lit("")), F.col("due_date")))
    c = contracts.withColumn("_d", started).filter(F.year("_d") >= since_year).groupBy(
        "agency_id", month_key("_d").alias("month")
    ).agg(F.count("*").alias("contract_count"), F.sum(amount("award_amount")).alias("contract_amount"),
          F.lit(0).cast("long").alias("solicitation_count"))
    s = solicitations.withColumn("_d", released).filter(F.year("_d") >= since_year).groupBy(
        "agency_id", month_key("_d").alias("month")
    ).agg(F.lit(0).cast("long").alias("contract_count"), F.lit(0).cast("decimal(28,2)").alias("contract_amount"),
          F.count("*").alias("solicitation_count"))
    return c.unionByName(s).groupBy("agency_id", "month").agg(
        F.sum("contract_count").alias("contract_count"),
        F.coalesce(F.sum("contract_amount").cast("double"), F.lit(0.0)).alias("contract_amount"),
        F.sum("solicitation_count").alias("solicitation_count"),
    )


def agency_year_stats(contracts: DataFrame, year: int = 2025) -> DataFrame:
    """All-time and one-year count and amount per agency."""
    in_year = F.year(parse_mdy("start_date")) == year
    money = F.coalesce(amount("award_amount"), F.lit(0).cast(MONEY))
    return contracts.groupBy("agency_id").agg(
        F.count("*").alias("total_count"),
        F.sum(money).cast("double").alias("total_amount"),
        F.count(F.when(in_year, 1)).alias("year_count"),
        F.coalesce(F.sum(F.when(in_year, money)).cast("double"), F.lit(0.0)).alias("year_amount"),
    )


def agency_yearly(contracts: DataFrame, since_year: int = 2021) -> DataFrame:
    year = F.year(parse_mdy("start_date"))
    return contracts.groupBy("agency_id", year.alias("year")).agg(
        F.coalesce(exact_sum("award_amount"), F.lit(0.0)).alias("amount")
    ).filter(F.col("year") >= since_year)


def _breakdowns(df: DataFrame, dimensions: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """One pass over the table for several single-column breakdowns."""
    sets = [[F.col(d)] for d in dimensions]
    grouped = df.groupingSets(sets, *dimensions).agg(F.grouping_id().alias("_set"), *measures)
    # grouping_id has a 0 bit for the column that is grouped.
    every = (1 << len(dimensions)) - 1
    which = F.when(F.lit(False), F.lit(""))
    label = F.when(F.lit(False), F.lit(""))
    for i, d in enumerate(dimensions):
        bit = F.col("_set") == F.lit(every ^ (1 << (len(dimensions) - 1 - i)))
        which, label = which.when(bit, F.lit(d)), label.when(bit, F.col(d).cast("string"))
    kept = [c for c in grouped.columns if c not in (*dimensions, "_set")]
    return grouped.select(which.alias("dimension"), label.alias("label"), *kept)


def vendor_stats(vendors: DataFrame, n: int = 10) -> DataFrame:
    """Top values of three vendor attributes, with their share of all vendors."""
    counts = _breakdowns(
        vendors, ["certification_type", "ethnicity", "business_category"], [F.count("*").alias("count")]
    ).filter(filled("label"))
    total = vendors.agg(F.count("*")).scalar()
    top = top_per_group(counts, ["dimension"], [F.desc("count"), F.col("label")], n)
    return top.withColumn("percent", F.round(percent("count", total), 4))


def solicitation_stats(solicitations: DataFrame, agency: str | None = None, n: int = 10) -> DataFrame:
    """Solicitations by status (all values), method and agency (top values), with their share."""
    s = solicitations.filter(all_of([partial("agency", agency)]))
    dims = ["rfx_status", "procurement_method"] + ([] if agency else ["agency"])
    counts = _breakdowns(s, dims, [F.count("*").alias("count")]).withColumn(
        "label", or_default("label", "Unknown")
    )
    total = s.agg(F.count("*")).scalar()
    by_status = counts.filter(F.col("dimension") == "rfx_status")
    others = top_per_group(
        counts.filter(F.col("dimension") != "rfx_status"),
        ["dimension"], [F.desc("count"), F.col("label")], n,
    ).drop("rank")
    return by_status.unionByName(others).withColumn("percent", F.round(percent("count", total), 4))


def yearly_trends(contracts: DataFrame, solicitations: DataFrame, n: int = 10) -> DataFrame:
    """Latest years by contract id, by start date and by release date."""
    by_id = contracts.filter(F.col("contract_id").contains("202")).groupBy(
        year_in_id("contract_id").alias("year")
    ).agg(F.count("*").alias("count"), exact_sum("award_amount").alias("total"))
    by_start = contracts.filter(F.col("start_date").isNotNull()).groupBy(
        F.year(parse_any("start_date")).cast("string").alias("year")
    ).agg(F.count("*").alias("count"), exact_sum("award_amount").alias("total"))
    by_release = solicitations.filter(F.col("release_date").isNotNull()).groupBy(
        F.year(parse_any("release_date")).cast("string").alias("year")
    ).agg(F.count("*").alias("count"), F.lit(None).cast("double").alias("total"))
    parts = []
    for name, df in (("contract_id", by_id), ("start_date", by_start), ("release_date", by_release)):
        latest = df.orderBy(F.col("year").desc_nulls_last()).limit(n)
        parts.append(latest.filter(F.col("year").rlike("^[0-9]+$")).select(F.lit(name).alias("basis"), "year", "count", "total"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def overview(contracts: DataFrame, solicitations: DataFrame) -> DataFrame:
    """Contract totals and the five most frequent statuses of contracts and solicitations."""
    totals = contracts.agg(
        F.count("*").alias("rows"),
        exact_sum("award_amount").alias("total"),
        exact_avg("award_amount").alias("mean"),
        F.countDistinct("agency").alias("agencies"),
        F.countDistinct("vendor_name").alias("vendors"),
    )
    facts = totals.select(F.expr(
        "stack(5, 'contracts', double(rows), 'total_value', total, 'avg_value', mean,"
        " 'agencies', double(agencies), 'vendors', double(vendors)) as (label, value)"
    )).select(F.lit("summary").alias("section"), "label", "value")
    parts = [facts]
    for section, df, column in (("contract_status", contracts, "status"), ("solicitation_status", solicitations, "rfx_status")):
        top = top_by_count(df, column, 5, allow_blank=True)
        parts.append(top.select(F.lit(section).alias("section"), or_default(column, "Unknown").alias("label"),
                                F.col("count").cast("double").alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def matched_entities(entities: DataFrame) -> DataFrame:
    return entities.agg(F.count("matched_vendor_id").alias("matched"), F.count("*").alias("entities"))


# ---- digital vendors ---------------------------------------------------------------------


def _digital(digital: DataFrame) -> DataFrame:
    return digital.filter(F.col("classification").isin(*DIGITAL_CLASSES))


def digital_awards(contracts: DataFrame, digital: DataFrame, keys: dict[str, Column], kept: Column) -> DataFrame:
    """Contracts of digital vendors by `keys`.

    Contracts are first reduced to one row per vendor and key; a name listed twice as digital
    counts twice, as an inner join does.
    """
    per_vendor = contracts.filter(kept).groupBy(
        "vendor_name", *[c.alias(k) for k, c in keys.items()]
    ).agg(F.count("*").alias("_n"), F.sum(amount("award_amount")).alias("_amount"))
    joined = per_vendor.join(_digital(digital).select("vendor_name"), "vendor_name")
    return joined.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("count"),
        F.sum("_amount").cast("double").alias("total"),
    )


def year_text(column: str) -> Column:
    return F.substring(column, 7, 4)


def awarded_since(year: int = FIRST_CHART_YEAR) -> Column:
    return (F.col("award_amount") > 0) & (F.length("start_date") == 10) & (year_text("start_date") >= str(year))


def digital_summary(contracts: DataFrame, digital: DataFrame, since: int = FIRST_CHART_YEAR) -> DataFrame:
    out = digital_awards(contracts, digital, {}, awarded_since(since))
    return out.select("count", F.coalesce("total", F.lit(0.0)).alias("total"))


def digital_trend(contracts: DataFrame, digital: DataFrame, since: int = FIRST_CHART_YEAR) -> DataFrame:
    return digital_awards(contracts, digital, {"year": year_text("start_date")}, awarded_since(since)).select("year", "total")


def digital_by_agency(contracts: DataFrame, digital: DataFrame, n: int = 8, since: int = FIRST_CHART_YEAR) -> DataFrame:
    totals = digital_awards(contracts, digital, {"agency": F.col("agency")}, awarded_since(since))
    return totals.select("agency", "total").orderBy(F.desc("total"), "agency").limit(n)


def expiring_by_year(contracts: DataFrame, digital: DataFrame, first: int = 2026, last: int = 2030) -> DataFrame:
    return digital_awards(contracts, digital, {"year": year_text("end_date")}, _ends_in(first, last)).select("year", "total")


def expiring_by_agency(contracts: DataFrame, digital: DataFrame, n: int = 8, first: int = 2026, last: int = 2030) -> DataFrame:
    totals = digital_awards(contracts, digital, {"agency": F.col("agency")}, _ends_in(first, last))
    return totals.select("agency", "total").orderBy(F.desc("total"), "agency").limit(n)


def _ends_in(first: int, last: int) -> Column:
    return (F.length("end_date") == 10) & year_text("end_date").between(str(first), str(last))


def classification_stats(digital: DataFrame) -> DataFrame:
    return digital.groupBy("classification").agg(
        F.count("*").alias("count"), exact_sum("fy2025").alias("fy2025_total")
    )


FY_COLUMNS = [f"fy{y}" for y in range(2016, 2026)]


def fy_trend(digital: DataFrame) -> DataFrame:
    """Yearly totals, 'Digital' against everything else.

    The ten year columns are summed first, so the unpivot sees two rows.
    """
    is_digital = F.col("classification").eqNullSafe("Digital")
    sums = digital.groupBy(F.when(is_digital, "digital").otherwise("mixed").alias("_class")).agg(
        *[F.coalesce(exact_sum(c), F.lit(0.0)).alias(c) for c in FY_COLUMNS]
    )
    rows = sums.unpivot("_class", FY_COLUMNS, "_fy", "_total")
    return rows.groupBy(F.regexp_replace("_fy", "^fy", "").alias("year")).agg(
        F.coalesce(F.max(F.when(F.col("_class") == "digital", F.col("_total"))), F.lit(0.0)).alias("digital"),
        F.coalesce(F.max(F.when(F.col("_class") == "mixed", F.col("_total"))), F.lit(0.0)).alias("mixed"),
    )


def vendor_fy_series(digital: DataFrame) -> DataFrame:
    """Year columns as rows (vendor, year, amount), missing amounts 0."""
    rows = digital.unpivot(["vendor_name"], FY_COLUMNS, "_fy", "_amount")
    return rows.select("vendor_name", F.regexp_replace("_fy", "^fy", "").alias("year"),
                       F.coalesce("_amount", F.lit(0.0)).alias("amount"))


def class_top(digital: DataFrame, n: int = 10) -> DataFrame:
    """Largest vendors of the two digital classes by the latest year."""
    order = [F.col("fy2025").desc_nulls_last(), F.col("vendor_name")]
    return top_per_group(_digital(digital), ["classification"], order, n).select(
        "classification", "rank", "vendor_name", "matched_passport_id", "fy2025"
    )


def contract_characteristics(records: DataFrame, digital: DataFrame) -> DataFrame:
    """Contracts of digital vendors by five attributes: count and amount per value.

    A contract appears once per fiscal year; its latest record counts, with its largest amount.
    """
    dims = ["prime_contract_award_method", "prime_contract_expense_category", "prime_contract_industry",
            "prime_contract_type", "prime_vendor_mwbe_category"]
    contracts = records.groupBy("prime_vendor", "prime_contract_id").agg(
        F.max_by(F.struct(*dims), F.struct("fiscal_year", *dims)).alias("_latest"),
        F.max(amount("prime_contract_original_amount")).alias("_amount"),
    )
    names = _digital(digital).select(F.col("vendor_name").alias("prime_vendor")).distinct()
    kept = contracts.join(names, "prime_vendor", "left_semi").select("_latest.*", "_amount")
    return _breakdowns(kept, dims, [F.count("*").alias("count"), F.sum("_amount").cast("double").alias("amount")])


def chart_series(top: DataFrame, key: Column, label: str, value: str, descending: bool = True, most: int = 100) -> DataFrame:
    """The first `most` rows of a top-k result by `key`, as two parallel arrays."""
    top = top.orderBy(key.desc() if descending else key.asc(), label).limit(most)
    rows = F.sort_array(F.collect_list(F.struct(key.alias("key"), F.col(label).alias("label"), F.col(value).alias("value"))), not descending)
    return top.agg(rows.alias("_rows")).select(
        F.col("_rows.label").alias("labels"), F.col("_rows.value").alias("data_values")
    )
