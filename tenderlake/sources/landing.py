"""Landing folder of new ledger rows: CSV, JSON, XML or Parquet, read as text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderlake.sources.ledger import SCHEMA

ROW_TAG = "transaction"


def _options(fmt: str) -> dict:
    return {"csv": {"header": True, "escape": '"', "enforceSchema": False}, "xml": {"rowTag": ROW_TAG}}.get(fmt, {})


def read_landing(spark: SparkSession, path: str, fmt: str = "csv", schema=SCHEMA) -> DataFrame:
    return spark.read.format(fmt).schema(schema).options(**_options(fmt)).load(path)


def stream_landing(spark: SparkSession, path: str, fmt: str = "csv", schema=SCHEMA,
                   files_per_trigger: int | None = 1000) -> DataFrame:
    """The folder as a stream; files are taken once, at most so many per batch."""
    reader = spark.readStream.format(fmt).schema(schema).options(**_options(fmt))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
