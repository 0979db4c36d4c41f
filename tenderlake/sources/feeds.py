"""CSV feeds: explicit schema by header, typed and cleaned columns, first row wins on keys.

An empty cell is '' and not NULL. Input order is file, block and row; it decides which of two
rows with the same key is kept.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.functions.keys import base_key, comparable_name, normalized_key
from tenderlake.functions.money import clean_money
from tenderlake.operators.quality import valid_notice_key
from tenderlake.operators.ranking import first_per_key
from tenderlake.operators.search import filled

ORDER = "_order"

# CSV header to column of every feed. A header that begins with a hyphen stands
# for the one that ends so, whoever's prefix it carries.
VENDORS = {
    "PASSPort Supplier-ID": "passport_supplier_id", "Vendor Name": "name", "FMS Vendor Code": "fms_vendor_code",
    "DUNS Number": "duns_number", "Certification Type": "certification_type", "Ethnicity": "ethnicity",
    "Business Category": "business_category", "Corporate Structure": "corporate_structure",
}
SOLICITATIONS = {
    "RFP-ID": "rfp_id", "BPM-ID": "bpm_id", "Program": "program", "Industry": "industry", "EPIN": "epin",
    "Procurement Name": "procurement_name", "Agency": "agency", "-org-id": "agency_id",
    "RFx Status": "rfx_status", "Release Date": "release_date", "Due Date": "due_date",
    "Main Commodity": "main_commodity", "Procurement Method": "procurement_method",
}
CONTRACTS = {
    "CTR-ID": "ctr_id", "EPIN": "epin", "Contract ID": "contract_id", "Contract Title": "contract_title",
    "Agency": "agency", "-org-id": "agency_id", "Vendor": "vendor_name", "Program": "program",
    "Procurement Method": "procurement_method", "Contract Type": "contract_type", "Status": "status",
    "Award Amount": "award_amount", "Current Contract Amount": "current_amount",
    "Contract Start Date": "start_date", "Contract End Date": "end_date", "Industry": "industry",
}
ENTITIES = {
    "organization_name": "organization_name", "ownership_structure_code": "ownership_structure_code",
    "organization_phone": "organization_phone", "doing_business_start_date": "start_date",
}
PEOPLE = {
    "mocs_peopleid": "mocs_peopleid", "organization_name": "organization_name", "person_name_first": "first_name",
    "person_name_last": "last_name", "relationship_type_code": "relationship_code",
}
ENTITY_SUMMARY = {
    "Vendor Name": "vendor_name", "Address Line 1": "address1", "Address  Line 2": "address2", "City": "city",
    "State": "state", "Zip Code": "zip", "Country": "country", "Telephone": "telephone",
    "Stock Exchange Symbol": "symbol", "For Profit": "for_profit", "DUNS number": "duns", "Gross Revenue": "revenue",
}
OTHER_NAMES = {
    "Vendor Name": "vendor_name", "Other Name Type": "type", "Other Name": "other_name", "From Date": "from_date",
    "To Date ": "to_date",
}
EVALUATIONS = {
    "Vendor Name": "vendor_name", "Agency": "agency", "Contract  ID": "contract_id", "Purpose": "purpose",
    "Evaluation Date": "eval_date", "Evaluation Period Start Date": "start_date",
    "Evaluation Period End Date": "end_date", "Overall Rating": "rating",
}
PRINCIPALS = {
    "Vendor Name": "vendor_name", "Principal Name": "principal_name", "Current Title": "title",
    "Principal Ownership Type": "ownership_type",
}
RELATED_ENTITIES = {
    "Vendor Name": "vendor_name", "Related Entity Name": "related_entity_name", "Address Line 1": "address1",
    "Address Line 2": "address2", "City": "city", "State": "state", "Zip Code": "zip", "Country": "country",
    "Telephone": "telephone", "Relationship to Vendor": "relationship",
}
# The notices feed misspells one header.
NOTICES = {h: h for h in (
    "RequestID", "StartDate", "EndDate", "AgencyName", "TypeOfNoticeDescription", "CategoryDescription", "ShortTitle",
    "SelectionMethodDescription", "SectionName", "SpecialCaseReasonDescription", "PIN", "DueDate", "AddressToRequest",
    "ContactName", "ContactPhone", "Email", "ContractAmount", "ContactFax", "AdditionalDescription1",
    "AdditionalDesctription2", "AdditionalDescription3", "OtherInfo1", "OtherInfo2", "OtherInfo3", "VendorName",
    "VendorAddress", "Printout1", "Printout2", "Printout3", "DocumentLinks", "EventDate", "EventBuildingName",
    "EventStreetAddress1", "EventStreetAddress2", "EventCity", "EventStateCode", "EventZipCode",
)} | {"AdditionalDesctription2": "AdditionalDescription2", "-org-name": "org_name", "-org-id": "org_id"}

CHILD_FEEDS = {
    "entity_summary": ENTITY_SUMMARY, "other_names": OTHER_NAMES, "evaluations": EVALUATIONS,
    "principals": PRINCIPALS, "related_entities": RELATED_ENTITIES,
}


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_feed(spark: SparkSession, path: str, headers: Mapping[str, str], multi_line: bool = True) -> DataFrame:
    """Feed columns as text plus the input order; a missing feed is an empty table.

    Columns are found by header name, an absent header gives NULL. `multi_line` allows line
    breaks inside quotes but reads every file in one task: large feeds should come as many
    files, or set it off when their cells hold no line breaks. All files of a feed must have the
    same header: one that differs fails. Files of another header are a read of their own,
    joined by `unionByName`.
    """
    wanted = list(headers.values())
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("enforceSchema", False)
    try:
        raw = reader.option("encoding", "UTF-8").csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], text_schema([*wanted])).withColumn(ORDER, _no_order())
    present = {c.lstrip("\ufeff"): c for c in raw.columns}
    for header in headers:
        if header.startswith("-"):
            alike = [c for h, c in present.items() if h.endswith(header) and h != header]
            if len(alike) > 1:
                raise ValueError(f"several headers end with {header}: {alike}; name the wanted one in `headers`")
            present.update({header: c for c in alike})
    columns = [
        F.coalesce(F.col(f"`{present[h]}`"), F.lit("")).alias(c) if h in present else F.lit(None).cast("string").alias(c)
        for h, c in headers.items()
    ]
    order = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")
    )
    return raw.select(*columns, order.alias(ORDER))


def _no_order() -> Column:
    return F.struct(F.lit("").alias("file_path"), F.lit(0).cast("long").alias("file_block_start"), F.lit(0).cast("long").alias("row"))


def _first(df: DataFrame, key: str, keep_order: bool = False) -> DataFrame:
    first = first_per_key(df, key, [F.col(ORDER)])
    return first if keep_order else first.drop(ORDER)


def read_vendors(spark: SparkSession, path: str, keep_order: bool = False, multi_line: bool = True) -> DataFrame:
    """Vendors, first row per id; the kept input order decides between vendors of one name."""
    return _first(read_feed(spark, path, VENDORS, multi_line), "passport_supplier_id", keep_order)


def solicitation_rows(spark: SparkSession, path: str, headers: Mapping[str, str] = SOLICITATIONS, multi_line: bool = True) -> DataFrame:
    return read_feed(spark, path, headers, multi_line).withColumn("normalized_epin", normalized_key("epin"))


def read_solicitations(spark: SparkSession, path: str, headers: Mapping[str, str] = SOLICITATIONS, multi_line: bool = True) -> DataFrame:
    return _first(solicitation_rows(spark, path, headers, multi_line), "epin")


def contract_rows(spark: SparkSession, path: str, headers: Mapping[str, str] = CONTRACTS, multi_line: bool = True) -> DataFrame:
    df = read_feed(spark, path, headers, multi_line)
    return (
        df.withColumn("award_amount", clean_money("award_amount"))
        .withColumn("current_amount", clean_money("current_amount"))
        .withColumn("normalized_contract_id", normalized_key("contract_id"))
        .withColumn("normalized_epin", normalized_key("epin"))
        .withColumn("base_epin", base_key("normalized_epin"))
    )


def read_contracts(spark: SparkSession, path: str, headers: Mapping[str, str] = CONTRACTS, multi_line: bool = True) -> DataFrame:
    """Contracts have no key: repeated rows stay."""
    return contract_rows(spark, path, headers, multi_line).drop(ORDER)


def read_entities(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_feed(spark, path, ENTITIES, multi_line).withColumn("normalized_name", comparable_name("organization_name")).drop(ORDER)


def read_people(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_feed(spark, path, PEOPLE, multi_line).withColumn("normalized_org_name", comparable_name("organization_name")).drop(ORDER)


def read_child(spark: SparkSession, path: str, feed: str, multi_line: bool = True) -> DataFrame:
    return read_feed(spark, path, CHILD_FEEDS[feed], multi_line).drop(ORDER)


def read_notices(spark: SparkSession, path: str, only_valid: bool = False, headers: Mapping[str, str] = NOTICES,
                 multi_line: bool = True) -> DataFrame:
    """Notices, first row per request; optionally only those whose key can be linked."""
    rows = read_feed(spark, path, headers, multi_line)
    return _first(rows.filter(valid_notice_key()) if only_valid else rows, "RequestID")


def agency_dimension(solicitations: DataFrame, contracts: DataFrame, order: str = ORDER) -> DataFrame:
    """Agencies named by either feed: the first name of an id, solicitations before contracts."""
    parts = [
        df.filter(filled("agency_id") & filled("agency")).select(
            F.col("agency_id").alias("id"), F.col("agency").alias("name"), F.lit(feed).alias("_feed"),
            F.col(order).alias("_seq"),
        )
        for feed, df in enumerate((solicitations, contracts))
    ]
    both = parts[0].unionByName(parts[1])
    return first_per_key(both, "id", [F.col("_feed"), F.col("_seq")], keep_null=False).select("id", "name")


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """Lines without one header per file; approximate when cells hold line breaks."""
    lines = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("_file")).agg(
        F.greatest(F.count("*") - 1, F.lit(0)).alias("_n")
    )
    return lines.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("record_count"))
