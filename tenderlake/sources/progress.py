"""Progress files of the ledger load: one JSON document per fiscal year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("last_record_downloaded", T.LongType()),
    T.StructField("total_records", T.LongType()),
    T.StructField("chunks_completed", T.ArrayType(T.StringType())),
    T.StructField("last_updated", T.StringType()),
])


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """All progress files of a folder or glob; unreadable ones count as empty."""
    return spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(path)


def write_progress(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
