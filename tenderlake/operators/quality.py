"""Key validity, load verification and dataset freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.dates import next_daily_run
from tenderlake.operators.search import filled

# Texts that stand in for a missing notice key, and how such texts begin.
NO_KEY = ("NOPINFOUND", "SEE BELOW", "LINE 17 BELOW", "SEE LINE 17 BELOW", "LINE 17")
NO_KEY_STARTS = ("see ", "line ")
MIN_KEY_LENGTH = 8


def valid_notice_key(column: str = "PIN") -> Column:
    """Whether a notice key can identify a procurement; NULL is not valid."""
    key = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    placeholder = F.upper(key).isin(*NO_KEY) | (F.translate(key, "0.", "") == "")
    for start in NO_KEY_STARTS:
        placeholder = placeholder | F.lower(key).startswith(start)
    return F.coalesce((F.length(key) >= MIN_KEY_LENGTH) & ~placeholder, F.lit(False))


def load_verification(notices: DataFrame, solicitations: DataFrame) -> DataFrame:
    """Rows, rows with a key, distinct keys, valid keys and distinct linked solicitations."""
    key = F.when(filled("PIN"), F.col("PIN"))
    linked = solicitations.join(notices.select(F.col("PIN").alias("epin")).distinct(), "epin", "left_semi").agg(
        F.countDistinct("epin")
    )
    return notices.agg(
        F.count("*").alias("total"),
        F.count(key).alias("with_key"),
        F.countDistinct(key).alias("distinct_keys"),
        F.count(F.when(valid_notice_key(), 1)).alias("valid_keys"),
    ).withColumn("linked_solicitations", linked.scalar())


def freshness(progress: DataFrame, now: Column | None = None, *keys: str) -> DataFrame:
    """Progress files to record count, latest update, status and next daily load."""
    total, done = F.coalesce(F.sum("total_records"), F.lit(0)), F.coalesce(F.sum("last_record_downloaded"), F.lit(0))
    out = progress.groupBy(*keys).agg(
        total.alias("total_records"),
        done.alias("downloaded"),
        F.coalesce(F.max(F.nullif("last_updated", F.lit(""))), F.lit("N/A")).alias("last_updated"),
    )
    status = (
        F.when((F.col("total_records") == 0) & (F.col("downloaded") == 0), "N/A")
        .when(F.col("downloaded") < F.col("total_records"), "In Progress")
        .otherwise("Up to Date")
    )
    out = out.withColumn("status", status)
    return out if now is None else out.withColumn(
        "next_update", F.date_format(next_daily_run(now), "yyyy-MM-dd HH:mm:ss")
    )
