"""Ledger and contract-record Parquet, partitioned by fiscal year and load."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.functions.dates import fiscal_year, parse_any

# Field order of the ledger feed.
FIELDS = (
    "agency", "payee_name", "check_amount", "fiscal_year", "issue_date", "industry", "spending_category",
    "contract_id", "department", "expense_category", "budget_code", "sub_vendor", "associated_prime_vendor",
)
SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


# Column beside the fiscal year that names the load a file came with; readers of the ledger do not see it.
BATCH = "batch"
BULK = "bulk"
# Folder below a ledger that holds the columns of everything written there, one file for each different list.
COLUMNS_FOLDER = "_columns"


def read_ledger(spark: SparkSession, root: str, years: Sequence[int] | None = None) -> DataFrame:
    """All years below `root`, or only some; columns that some files lack are NULL there.

    The directory names the fiscal year, whatever a column inside the files says. The columns are those that were stored
    when the files were written, so no file is opened to find them; see `adopt` for files of other writers.
    """
    df = spark.read.schema(_stored_schema(spark, root) or _merged_schema(spark, [root])).parquet(root).drop(BATCH)
    return df if years is None else df.filter(F.col("fiscal_year").isin(*years))


def read_files(spark: SparkSession, paths: Sequence[str], root: str | None = None) -> DataFrame:
    """An explicit list of files, merged by column name; below a `root` with its stored columns."""
    schema = (root and _stored_schema(spark, root)) or _merged_schema(spark, paths, root)
    reader = spark.read.schema(schema)
    return (reader.option("basePath", root) if root else reader).parquet(*paths).drop(BATCH)


def adopt(spark: SparkSession, root: str) -> None:
    """Store the columns of files that something else wrote below `root`: the one time that all of them are opened."""
    merged = _merged_schema(spark, [root])
    _store_columns(spark, root, T.StructType([f for f in merged.fields if f.name not in ("fiscal_year", BATCH)]))


def _merged_schema(spark: SparkSession, paths: Sequence[str], root: str | None = None) -> T.StructType:
    reader = spark.read.option("mergeSchema", True)
    return (reader.option("basePath", root) if root else reader).parquet(*paths).schema


def _stored_columns(spark: SparkSession, root: str) -> T.StructType | None:
    """The stored lists of columns in the order of their age, merged by name; None if there is none."""
    try:
        lines = spark.read.text(f"{root.rstrip('/')}/{COLUMNS_FOLDER}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    found: dict[str, T.StructField] = {}
    # One line for each different list of columns.
    for _, line in sorted(map(tuple, lines.select("_metadata.file_modification_time", "value").collect())):
        for field in T.StructType.fromJson(json.loads(line)).fields:
            if found.setdefault(field.name, field).dataType != field.dataType:
                raise ValueError(f"column {field.name} was written with different types")
    return T.StructType(list(found.values()))


def _stored_schema(spark: SparkSession, root: str) -> T.StructType | None:
    columns = _stored_columns(spark, root)
    return columns and T.StructType([*columns.fields, T.StructField("fiscal_year", T.IntegerType()), T.StructField(BATCH, T.StringType())])


def _store_columns(spark: SparkSession, root: str, columns: T.StructType) -> None:
    """A list of columns goes to a file named by its content: writers at the same time cannot lose each other's."""
    known = _stored_columns(spark, root)
    if known is None or any(f.name not in known.names for f in columns.fields):
        columns = T.StructType([T.StructField(f.name, f.dataType) for f in columns.fields])
        name = hashlib.sha256(columns.json().encode()).hexdigest()[:16]
        path = f"{root.rstrip('/')}/{COLUMNS_FOLDER}/{name}"
        spark.range(0, 1, 1, 1).select(F.lit(columns.json()).alias("value")).write.mode("overwrite").text(path)


def configured_ledger(spark: SparkSession, years: Sequence[int] | None = None) -> DataFrame:
    """The ledger that the session's settings name: `spark.tenderlake.ledger.remote` if
    `spark.tenderlake.ledger.useRemote` is true, else `spark.tenderlake.ledger.local`."""
    remote = spark.conf.get("spark.tenderlake.ledger.useRemote", "false").strip().lower() == "true"
    key = f"spark.tenderlake.ledger.{'remote' if remote else 'local'}"
    root = spark.conf.get(key, None)
    if not root:
        raise ValueError(f"set {key} to the folder of the ledger")
    return read_ledger(spark, root, years)


def read_contract_records(spark: SparkSession, root: str, years: int | Sequence[int] | None = None) -> DataFrame:
    """Contract metadata of one fiscal year, of some, or of all."""
    return read_ledger(spark, root, [years] if isinstance(years, int) else years)


def with_fiscal_year(df: DataFrame) -> DataFrame:
    """Fiscal year of the row: the given one, else the one of its issue date."""
    own = fiscal_year(parse_any("issue_date"))
    given: Column = F.col("fiscal_year").try_cast("int") if "fiscal_year" in df.columns else F.lit(None).cast("int")
    return df.withColumn("fiscal_year", F.coalesce(given, own))


def write_ledger(df: DataFrame, root: str, mode: str = "append", batch: str = BULK, rebalance: bool = True) -> None:
    """Text columns, Snappy, one folder per fiscal year and batch.

    Rebalancing gives a year few files and still spreads one that holds most rows; without it each task writes a file for each
    year it holds, and no row is shuffled. `overwrite` replaces the folders that the rows go to and no other, so writing a
    named batch again leaves one copy of it.
    """
    text = [F.col(c) if c == "fiscal_year" else F.col(c).cast("string").alias(c) for c in df.columns if c != BATCH]
    rows = df.select(*text)
    _store_columns(df.sparkSession, root, T.StructType([f for f in rows.schema.fields if f.name != "fiscal_year"]))
    out = rows.withColumn(BATCH, F.lit(batch))
    (out.hint("rebalance", "fiscal_year") if rebalance else out).write.mode(mode).option("compression", "snappy").option("partitionOverwriteMode", "dynamic").partitionBy(
        "fiscal_year", BATCH).parquet(root)


def load_chunk(spark: SparkSession, path: str, root: str) -> None:
    """One CSV chunk of ledger rows appended to the ledger, all columns as text."""
    rows = spark.read.schema(SCHEMA).option("header", True).option("escape", '"').csv(path)
    write_ledger(with_fiscal_year(rows), root)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
