"""First and last row per key, top rows per group and overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Parts that the rows of a group are ranked in first, for lists longer than SHORT.
PARTS, SHORT = 32, 10


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First `n` rows of every group, with their position.

    Spark limits every group before the shuffle, so a hot group sends at most `n` rows per task. Longer lists are ranked in
    parts first, so that a hot group's rows meet in many tasks and its last one sees `n` rows of each part.
    """
    if n > SHORT:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
        inner = Window.partitionBy(*groups, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn(rank, F.row_number().over(inner)).filter(F.col(rank) <= n).drop("_part", rank)
    return ranked(df, groups, order, n, rank)


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First `n` rows of every group, with their position, in one shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def cut_days(days: DataFrame, groups: Sequence[str], day: str, n: int, count: str = "_n") -> DataFrame:
    """Per group, as _cut: the day of its n-th latest row; NULL where that day is NULL or the group has fewer rows.

    `days` has the number of rows of every group and day, so a group of any size is a few narrow rows.
    """
    w = Window.partitionBy(*groups).orderBy(F.col(day).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(count).over(w)
    reached = days.withColumn("_upto", upto).withColumn("_cut", F.when((F.col("_upto") >= n) & (F.col("_upto") - F.col(count) < n), F.col(day)))
    return reached.groupBy(*groups).agg(F.max("_cut").alias("_cut"))


def since_cut(day: str) -> Column:
    """Rows that can be among the latest of their group: from its _cut on, all of a group without one."""
    return F.col("_cut").isNull() | (F.col(day) >= F.col("_cut"))


def latest_per_group(df: DataFrame, group: str, day: str, ties: Sequence[Column], n: int) -> DataFrame:
    """The `n` latest rows of every group, ties in the order of `ties`, with their position.

    Rows are counted by group first. Days are counted for groups of more than `n` rows only, and such groups lose what is
    older than their n-th latest day before they are ranked. The join and the ranking share one shuffle of whole rows.
    """
    large = df.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > n).select(group)
    days = df.select(group, day).join(large, group, "left_semi").groupBy(group, day).agg(F.count("*").alias("_n"))
    rows = df.join(cut_days(days, [group], day, n), group, "left").filter(since_cut(day)).select(*df.columns)
    return ranked(rows, [group], [F.col(day).desc_nulls_last(), *ties], n)


def first_per_key(df: DataFrame, key: str, order: Sequence[Column], keep_null: bool = True) -> DataFrame:
    """Keyed insert where the first row wins.

    A NULL key is never a duplicate, '' is a key like any other.
    """
    first = top_per_group(df.filter(F.col(key).isNotNull()), [key], order, 1, "_rank").drop("_rank")
    return first.unionByName(df.filter(F.col(key).isNull())) if keep_null else first


def last_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Lookup table where a later row overwrites an earlier one."""
    return first_per_key(df, key, [F.col(c).desc() for c in order], keep_null=False)


def append(target: DataFrame, new: DataFrame) -> DataFrame:
    """Plain append, columns by name, missing ones NULL, duplicates kept."""
    return target.unionByName(new, allowMissingColumns=True)
