"""Vendor profile: one summary row per vendor, and all its child records in long form.

Child records stay rows. Only bounded lists (the latest few contracts) become arrays, so a
vendor with millions of records never turns into one huge value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.dates import parse_any
from tenderlake.functions.keys import comparable_name
from tenderlake.functions.money import amount, exact_sum
from tenderlake.functions.text import json_path, json_value
from tenderlake.operators.linkage import lookup
from tenderlake.operators.ranking import first_per_key, top_per_group
from tenderlake.operators.search import filled


def recent_contracts(contracts: DataFrame, n: int = 5) -> DataFrame:
    """Latest contracts per vendor as an array of at most `n` ids, with count and total."""
    dated = contracts.select("vendor_name", "ctr_id", "contract_id", "award_amount", parse_any("start_date").alias("_start"))
    order = [F.col("_start").desc_nulls_last(), F.col("ctr_id")]
    few = top_per_group(dated, ["vendor_name"], order, n).groupBy("vendor_name").agg(
        F.sort_array(F.collect_list(F.struct("rank", "contract_id"))).alias("_recent")
    )
    totals = contracts.groupBy("vendor_name").agg(
        F.count("*").alias("contract_count"), exact_sum("award_amount").alias("total_awarded")
    )
    return totals.join(few, "vendor_name").withColumn("recent", F.col("_recent.contract_id")).drop("_recent")


def vendors_with_recent(vendors: DataFrame, contracts: DataFrame, n: int = 5) -> DataFrame:
    recent = recent_contracts(contracts, n)
    out = lookup(vendors.select("passport_supplier_id", "name"), recent, F.col("name") == F.col("vendor_name"))
    return out.select(
        "passport_supplier_id", "name", F.coalesce("contract_count", F.lit(0)).alias("contract_count"),
        F.coalesce("total_awarded", F.lit(0.0)).alias("total_awarded"), "recent",
    )


def contract_by_either_id(contracts: DataFrame, contract_id: str) -> DataFrame:
    """First contract with this id in either id column."""
    found = contracts.filter((F.col("ctr_id") == contract_id) | (F.col("contract_id") == contract_id))
    return found.orderBy("ctr_id").limit(1)


def tech_row(vendors: DataFrame, digital: DataFrame) -> DataFrame:
    """Digital classification of a vendor: the entry with its id, else one with its name."""
    by_id = first_per_key(digital, "matched_passport_id", [F.col("vendor_name")], keep_null=False).select(
        F.col("matched_passport_id").alias("_id"), F.col("classification").alias("_by_id")
    )
    by_name = first_per_key(digital, "vendor_name", [F.col("classification")], keep_null=False).select(
        F.col("vendor_name").alias("_name"), F.col("classification").alias("_by_name")
    )
    v = vendors.select("passport_supplier_id", "name")
    out = lookup(lookup(v, by_id, v["passport_supplier_id"] == by_id["_id"]), by_name, v["name"] == by_name["_name"])
    return out.select("passport_supplier_id", F.coalesce("_by_id", "_by_name").alias("tech_class"))


def vendor_people(vendors: DataFrame, matched: DataFrame, people: DataFrame) -> DataFrame:
    """People of a vendor's organisation, by the matched entity's normalised name, else its own."""
    entity = first_per_key(
        matched.select("matched_vendor_id", "normalized_name"), "matched_vendor_id",
        [F.col("normalized_name")], keep_null=False,
    )
    v = vendors.select("passport_supplier_id", "name")
    v = lookup(v, entity, v["passport_supplier_id"] == entity["matched_vendor_id"]).select(
        "passport_supplier_id", F.coalesce("normalized_name", comparable_name("name")).alias("normalized_org_name")
    )
    # Names without a letter or digit are blank and match nobody.
    return v.filter(filled("normalized_org_name")).join(people.filter(filled("normalized_org_name")), "normalized_org_name")


def registry_details(matches: DataFrame) -> DataFrame:
    """Registry matches with their JSON parsed into a variant; unreadable JSON gives no details."""
    return matches.withColumn("details", json_value("raw_data"))


def registry_fields(matches: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Typed columns out of the registry's JSON: name to (path, type)."""
    details = registry_details(matches)
    return details.select("passport_vendor_id", *[json_path("details", path, kind).alias(name) for name, (path, kind) in fields.items()])


def vendor_children(vendors: DataFrame, children: Mapping[str, DataFrame]) -> DataFrame:
    """Child records of all vendors in long form: vendor, section, record as JSON text.

    `children` maps a section to a table with a `vendor_name` column.
    """
    v = vendors.select("passport_supplier_id", F.col("name").alias("vendor_name"))
    out = None
    for section, child in children.items():
        fields = [c for c in child.columns if c != "vendor_name"]
        rows = child.select("vendor_name", F.lit(section).alias("section"), F.to_json(F.struct(*fields)).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return v.join(out, "vendor_name")


def vendor_profile(vendors: DataFrame, contracts: DataFrame, matched: DataFrame, people: DataFrame,
                   summary: DataFrame, registry: DataFrame, digital: DataFrame,
                   children: Mapping[str, DataFrame]) -> DataFrame:
    """One row per vendor: contract statistics, counts of child records, registry and tech class.

    Every child is counted by vendor before it is joined; all joins are on one row per key.
    """
    stats = contracts.groupBy("vendor_name").agg(
        F.count("*").alias("contract_count"), exact_sum("award_amount").alias("total_awarded")
    )
    out = vendors.select("passport_supplier_id", "name")
    out = _attach(out, "name", stats, "vendor_name", {
        "contract_count": F.coalesce("contract_count", F.lit(0)),
        "total_awarded": F.coalesce("total_awarded", F.lit(0.0)),
    })
    for section, child in children.items():
        counted = child.groupBy("vendor_name").agg(F.count("*").alias("_n"))
        out = _attach(out, "name", counted, "vendor_name", {section: F.coalesce("_n", F.lit(0))})
    counted = vendor_people(vendors, matched, people).groupBy("passport_supplier_id").agg(F.count("*").alias("_n"))
    out = _attach(out, "passport_supplier_id", counted, "passport_supplier_id", {"people": F.coalesce("_n", F.lit(0))})
    one = first_per_key(summary, "vendor_name", [F.col("city"), F.col("revenue")], keep_null=False)
    out = _attach(out, "name", one, "vendor_name", {"city": F.col("city"), "revenue": F.col("revenue")})
    details = registry_details(registry).select("passport_vendor_id", json_path("details", "$.company_number").alias("_no"))
    out = _attach(out, "passport_supplier_id", details, "passport_vendor_id", {"company_number": F.col("_no")})
    tech = tech_row(vendors, digital)
    return _attach(out, "passport_supplier_id", tech, "passport_supplier_id", {"tech_class": F.col("tech_class")})


def _attach(out: DataFrame, key: str, right: DataFrame, right_key: str, columns: Mapping[str, Column]) -> DataFrame:
    r = right.withColumnRenamed(right_key, "_key")
    kept = out.columns
    return lookup(out, r, F.col(key) == F.col("_key")).select(*kept, *[c.alias(n) for n, c in columns.items()])


def vendor_award_years(contracts: DataFrame) -> DataFrame:
    """Awards per vendor and start year from the contract register alone."""
    year = F.year(parse_any("start_date"))
    return contracts.groupBy("vendor_name", year.alias("year")).agg(
        F.sum(amount("award_amount")).cast("double").alias("total")
    ).filter(F.col("year").isNotNull() & (F.col("total") != 0))
