"""Procurement views derived from the given star-schema tables.

Driver dates run 1995-2001; 24 years are added so that the year literals of the reports apply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.functions.dates import fiscal_year, mdy_text, parse_mdy
from tenderlake.functions.keys import base_key, comparable_name, hyphenless, zero_pad
from tenderlake.functions.money import MONEY
from tenderlake.operators.ledger import payee_totals
from tenderlake.operators.rollups import FY_COLUMNS
from tenderlake.session import folder_state, scratch_path

MONTHS_LATER = 24 * 12


def key10(k: Column) -> Column:
    return F.concat(zero_pad(k, 9), F.lit("Y"))


def hyphenated(k: Column) -> Column:
    return F.concat(F.substring(k, 1, 5), F.lit("-"), F.substring(k, 6, 100))


def later(d: str) -> Column:
    return F.add_months(F.col(d).cast("date"), MONTHS_LATER)


def customer_name(k: Column) -> Column:
    return F.concat(F.lit("Customer#"), zero_pad(k, 9))


# Tables read or written so far, by application, data folder with the state of its files, and name. A
# known schema saves the job that would look for it in the files again.
_SCHEMAS: dict[tuple[str, str, str], T.StructType] = {}
_STORED: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


class Views:
    """Domain tables of one data folder.

    What one scan can derive is derived on the fly. The joined tables (contracts, ledger, payee totals,
    digital vendors, contract records) are loaded once per application into the shared scratch folder,
    as a load job would, and read from there with column and partition pruning.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # Replaced source files make other keys, so nothing stored from the old ones is read again.
        self.state = folder_state(spark, folder)

    def _key(self, name: str) -> tuple[str, str, str]:
        return self.spark.sparkContext.applicationId, self.state, name

    def _stored(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        key = self._key(name)
        if key not in _STORED:
            path, df = scratch_path(self.spark, name), build()
            if by:
                # Every task writes a file for each value it holds: finished rows are many times as wide as what the joins
                # shuffle, so they are not shuffled once more for the sake of fewer files.
                df.write.partitionBy(by).parquet(path)
            else:
                df.write.parquet(path)
            _STORED[key] = path, df.schema
        path, schema = _STORED[key]
        return self.spark.read.schema(schema).parquet(path)

    def load(self) -> None:
        """Write all stored tables."""
        for table in (self.contracts, self.ledger, self.payees, self.digital, self.contract_records):
            table()

    def table(self, name: str) -> DataFrame:
        path, key = f"{self.folder}/{name}.parquet", self._key(name)
        if key not in _SCHEMAS:
            _SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[key]).parquet(path)

    def agencies(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))

    def vendors(self) -> DataFrame:
        k = F.col("c_custkey")
        kinds = F.array(*[F.lit(x) for x in ("MBE", "WBE", "Non-MWBE", "", "MBE/WBE")])
        group = (k % 4).cast("int")
        return self.table("customer").select(
            k.cast("string").alias("passport_supplier_id"),
            F.col("c_name").alias("name"),
            zero_pad(k, 10).alias("fms_vendor_code"),
            F.get(kinds, (k % 5).cast("int")).alias("certification_type"),
            F.when(group == 0, "").otherwise(F.concat(F.lit("GROUP_"), group.cast("string"))).alias("ethnicity"),
            F.col("c_mktsegment").alias("business_category"),
        )

    def entities(self) -> DataFrame:
        """One organisation per customer; every second one carries a name that matches a vendor."""
        k, name = F.col("c_custkey"), F.col("c_name")
        org = F.when(k % 2 == 0, F.lower(F.replace(name, F.lit("#"), F.lit(" ")))).otherwise(F.concat(F.lit("Unknown "), name))
        return self.table("customer").select(k.cast("string").alias("entity_id"), org.alias("organization_name"))

    def solicitations(self) -> DataFrame:
        k = F.col("p_partkey")
        d = F.date_add(F.to_date(F.lit("2019-01-01")), (k % 2500).cast("int"))
        states = F.array(*[F.lit(x) for x in ("Released", "Closed", "Planned", "Archived")])
        nation = self.table("nation").select("n_nationkey", "n_name")
        return self.table("part").join(nation, F.col("n_nationkey") == k % 25).select(
            hyphenated(key10(k)).alias("epin"),
            key10(k).alias("normalized_epin"),
            F.col("p_name").alias("procurement_name"),
            F.col("p_type").alias("main_commodity"),
            F.col("p_brand").alias("procurement_method"),
            F.concat(F.lit("PROGRAM_"), (k % 5).cast("string")).alias("program"),
            F.concat(F.lit("INDUSTRY_"), (k % 6).cast("string")).alias("industry"),
            (k % 25).cast("string").alias("agency_id"),
            F.col("n_name").alias("agency"),
            F.get(states, (k % 4).cast("int")).alias("rfx_status"),
            F.concat(mdy_text(d), F.when(k % 2 == 0, " 12:00:00 AM").otherwise("")).alias("release_date"),
            F.lit("").alias("due_date"),
        )

    @staticmethod
    def _contract_id() -> Column:
        k = F.col("o_orderkey")
        return F.concat(
            F.lit("CT1-"), zero_pad(k % 1000, 3), F.lit("-"), F.year(later("o_orderdate")).cast("string"),
            F.lit("8"), zero_pad(k, 6),
        )

    def contracts(self) -> DataFrame:
        return self._stored("contracts", self._contracts)

    def _contracts(self) -> DataFrame:
        k = F.col("o_orderkey")
        start = later("o_orderdate")
        end = F.date_add(start, (k % 2000).cast("int"))
        epin = F.when(k % 13 == 0, F.lit(None).cast("string")).when(k % 11 == 0, key10(k % 200)).otherwise(
            F.concat(key10(k % 200), zero_pad(k % 7, 3))
        )
        nation = self.table("nation").select("n_nationkey", "n_name")
        customer = self.table("customer").select("c_custkey", "c_name", "c_mktsegment")
        return (
            self.table("orders")
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("n_nationkey") == k % 25)
            .select(
                k.cast("string").alias("ctr_id"),
                self._contract_id().alias("contract_id"),
                hyphenless(self._contract_id()).alias("normalized_contract_id"),
                hyphenated(epin).alias("epin"),
                epin.alias("normalized_epin"),
                base_key(epin).alias("base_epin"),
                F.concat(F.lit("Services "), "o_orderpriority").alias("contract_title"),
                F.concat(F.lit("PROGRAM_"), (k % 5).cast("string")).alias("program"),
                F.concat(F.lit("TYPE_"), (k % 4).cast("string")).alias("contract_type"),
                F.col("o_totalprice").alias("current_amount"),
                F.col("c_name").alias("vendor_name"),
                (k % 25).cast("string").alias("agency_id"),
                F.col("n_name").alias("agency"),
                F.col("o_orderpriority").alias("procurement_method"),
                F.col("o_orderstatus").alias("status"),
                F.col("c_mktsegment").alias("industry"),
                F.col("o_totalprice").alias("award_amount"),
                mdy_text(start).alias("start_date"),
                mdy_text(end).alias("end_date"),
            )
        )

    def notices(self) -> DataFrame:
        k = F.col("p_partkey")
        key = key10(k)
        kind = k % 8
        pin = (
            F.when(kind == 0, "SEE BELOW").when(kind == 1, "00000000").when(kind == 2, hyphenated(key))
            .when(kind == 3, F.lower(key)).when(kind == 4, "line 17 below").when(kind == 5, "")
            .when(k % 16 == 14, F.concat(F.substring(key, 1, 4), F.lit("_"), F.substring(key, 6, 3)))
            .when(kind == 6, "12345").otherwise(F.substring(key, 2, 8))
        )
        return self.table("part").select(
            k.cast("string").alias("RequestID"), F.col("p_type").alias("TypeOfNoticeDescription"), pin.alias("PIN")
        )

    def ledger(self) -> DataFrame:
        return self._stored("ledger", self._ledger, "fiscal_year")

    def _ledger(self) -> DataFrame:
        """Payments: line items with their order, customer, part and supplier's nation."""
        k, d = F.col("l_orderkey"), later("l_shipdate")
        customer = self.table("customer").select("c_custkey", "c_name", "c_mktsegment")
        # Customers meet the orders, which are fewer than the line items; part and supplier meet the line items while these are
        # narrow. So whole payments are never shuffled, and line items only by the keys of tables too large to broadcast.
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(
            customer, F.col("o_custkey") == F.col("c_custkey"))
        part = self.table("part").select("p_partkey", "p_type")
        nation = self.table("nation").select("n_nationkey", "n_name")
        supplier = self.table("supplier").select("s_suppkey", "s_name", "s_nationkey").join(
            nation, F.col("s_nationkey") == F.col("n_nationkey")
        )
        # Some ids are no contract's, some hold a contract's id and more.
        contract = (
            F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("PO"), zero_pad(k, 8)))
            .when((F.col("l_linenumber") == 3) & (k % 7 == 0), F.concat(hyphenless(self._contract_id()), F.lit("A")))
            .otherwise(hyphenless(self._contract_id()))
        )
        paid = F.when(k % 97 == 0, F.lit("N/A")).otherwise(F.col("l_extendedprice").cast(MONEY).cast("string"))
        return (
            self.table("lineitem")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(orders, k == F.col("o_orderkey"))
            .select(
                d.cast("string").alias("issue_date"),
                F.col("n_name").alias("agency"),
                F.concat("c_name", F.when(F.col("c_custkey") % 10 == 0, " CORP").otherwise("")).alias("payee_name"),
                contract.alias("contract_id"),
                F.col("p_type").alias("expense_category"),
                paid.alias("check_amount"),
                F.col("c_mktsegment").alias("industry"),
                F.col("l_linestatus").alias("spending_category"),
                F.concat(F.lit("DEPT_"), (F.col("l_suppkey") % 10).cast("string")).alias("department"),
                F.col("l_returnflag").alias("budget_code"),
                F.when(F.col("l_linenumber") == 2, F.col("s_name")).otherwise("").alias("sub_vendor"),
                F.when(F.col("l_linenumber") == 2, F.col("c_name")).otherwise("").alias("associated_prime_vendor"),
                fiscal_year(d).alias("fiscal_year"),
            )
        )

    def payees(self) -> DataFrame:
        """Totals per payee, a small rollup of the ledger."""
        return self._stored("payees", lambda: payee_totals(self.ledger()))

    def digital(self) -> DataFrame:
        return self._stored("digital", self._digital)

    def _digital(self) -> DataFrame:
        """Vendors with payments under their exact name, classified, with yearly totals."""
        paid = self.ledger().groupBy("payee_name").agg(*[
            F.sum(F.when(F.col("fiscal_year") == int(c[2:]), F.col("check_amount").try_cast(MONEY))).cast("double").alias(c)
            for c in FY_COLUMNS
        ])
        k = F.col("passport_supplier_id").cast("long")
        classes = F.array(*[F.lit(x) for x in ("Digital", "Mixed", "Other")])
        return self.vendors().join(paid, F.col("name") == F.col("payee_name")).select(
            F.col("name").alias("vendor_name"),
            F.when(k % 7 != 0, F.col("passport_supplier_id")).alias("matched_passport_id"),
            F.get(classes, (k % 3).cast("int")).alias("classification"),
            *FY_COLUMNS,
        )

    def contract_records(self) -> DataFrame:
        return self._stored("contract-records", self._contract_records, "fiscal_year")

    def _contract_records(self) -> DataFrame:
        """Contract metadata per fiscal year: one record, a second one for even ids."""
        c = self.contracts()
        start = parse_mdy("start_date")
        k = F.col("ctr_id").cast("long")
        years = F.when(k % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return c.withColumn("_r", F.explode(years)).select(
            F.col("normalized_contract_id").alias("prime_contract_id"),
            # Every eleventh vendor is recorded under a longer name only.
            F.when(F.substring("vendor_name", 10, 20).cast("long") % 11 == 0, F.concat("vendor_name", F.lit(" INC")))
            .otherwise(F.col("vendor_name")).alias("prime_vendor"),
            start.cast("string").alias("prime_contract_start_date"),
            (F.col("award_amount").cast(MONEY) * F.col("_r")).cast(MONEY).cast("string").alias("prime_contract_original_amount"),
            F.col("procurement_method").alias("prime_contract_award_method"),
            F.col("status").alias("prime_contract_expense_category"),
            F.col("industry").alias("prime_contract_industry"),
            F.concat(F.lit("TYPE_"), (k % 4).cast("string")).alias("prime_contract_type"),
            F.col("agency_id").alias("prime_vendor_mwbe_category"),
            (fiscal_year(start) + F.col("_r") - 1).alias("fiscal_year"),
        )

    # ---- vendor profile feeds ------------------------------------------------------------

    def entity_summary(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_name").alias("vendor_name"),
            F.concat(F.lit("CITY_"), F.col("c_nationkey").cast("string")).alias("city"),
            F.col("c_acctbal").cast(MONEY).cast("string").alias("revenue"),
        )

    def other_names(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_name").alias("vendor_name"), F.lit("DBA").alias("type"), F.upper("c_name").alias("other_name")
        )

    def evaluations(self) -> DataFrame:
        return self.contracts().select(
            "vendor_name", "agency", "contract_id", F.col("end_date").alias("eval_date"),
            F.col("procurement_method").alias("rating"),
        )

    def principals(self) -> DataFrame:
        return self.table("supplier").select(
            customer_name(F.col("s_suppkey")).alias("vendor_name"), F.col("s_name").alias("principal_name"),
            F.lit("Owner").alias("title"),
        )

    def related_entities(self) -> DataFrame:
        return self.table("part").select(
            customer_name(F.col("p_partkey")).alias("vendor_name"), F.col("p_name").alias("related_entity_name"),
            F.col("p_brand").alias("relationship"),
        )

    def children(self) -> dict[str, DataFrame]:
        return {
            "other_names": self.other_names(), "evaluations": self.evaluations(),
            "principals": self.principals(), "related_entities": self.related_entities(),
        }

    def people(self) -> DataFrame:
        org = customer_name(F.col("s_suppkey"))
        return self.table("supplier").select(
            F.col("s_name").alias("last_name"), comparable_name(org).alias("normalized_org_name")
        )

    def registry_matches(self) -> DataFrame:
        k = F.col("c_custkey")
        good = F.to_json(F.struct(zero_pad(k, 8).alias("company_number"), F.col("c_mktsegment").alias("kind")))
        return self.table("customer").select(
            k.cast("string").alias("passport_vendor_id"),
            F.when(k % 5 == 0, F.lit("{broken")).otherwise(good).alias("raw_data"),
        )

    def counted(self) -> dict[str, DataFrame]:
        return {
            "agencies": self.agencies(), "vendors": self.vendors(), "contracts": self.contracts(),
            "solicitations": self.solicitations(), "notices": self.notices(), "ledger": self.ledger(),
            "entities": self.entities(),
        }
