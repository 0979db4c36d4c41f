"""Helpers of the corpus operators: Arrow batches as bytes, native words, stored steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.session import scratch_path

# The six ASCII white space characters: \t \n \v \f \r and the space.
WHITE = "\t\n\x0b\x0c\r "
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def white_words(text: Column) -> Column:
    """Words between ASCII white space, in order; a null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def stored(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write a step into the shared scratch folder and read it back: cuts the lineage, survives lost executors.

    `release` has Spark remove the step's shuffle files as soon as it is written, and not when the driver's garbage goes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        # The setting holds for what is planned from here on.
        df.select("*").write.parquet(path)
    finally:
        if release:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
