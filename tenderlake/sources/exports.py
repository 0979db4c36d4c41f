"""Stored results, exports and dataset listings."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.dates import next_daily_run
from tenderlake.functions.money import count_text
from tenderlake.sources.ledger import write_csv


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame], fmt: str = "parquet") -> DataFrame:
    """A stored result; when there is none yet, it is computed and stored first."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
    build().write.format(fmt).save(path)
    return spark.read.format(fmt).load(path)


def export_csv(df: DataFrame, folder: str, name: str) -> None:
    """A dataset as CSV for download; other names are refused."""
    if not name.endswith(".csv"):
        raise ValueError("only .csv exports")
    write_csv(df, f"{folder.rstrip('/')}/{name}", "overwrite")


def dataset_info(spark: SparkSession, datasets: Mapping[str, str], now: Column) -> DataFrame:
    """Record count, last change and next load of every dataset file or folder."""

    def one(label: str, path: str) -> DataFrame:
        try:
            lines = spark.read.text(path)
        except AnalysisException as e:
            if not _missing(e):
                raise
            return spark.range(1).select(
                F.lit(label).alias("name"), F.lit("-").alias("record_count"), F.lit("Not Found").alias("last_updated")
            )
        files = lines.groupBy(F.col("_metadata.file_path").alias("_file")).agg(
            F.greatest(F.count("*") - 1, F.lit(0)).alias("_n"), F.max("_metadata.file_modification_time").alias("_t")
        )
        return files.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), F.max("_t").alias("_t")).select(
            F.lit(label).alias("name"), count_text("_n").alias("record_count"),
            F.date_format("_t", "yyyy-MM-dd HH:mm:ss").alias("last_updated"),
        )

    listed = reduce(DataFrame.unionByName, [one(label, path) for label, path in datasets.items()])
    return listed.withColumn("next_update", F.date_format(next_daily_run(now), "yyyy-MM-dd HH:mm:ss"))
