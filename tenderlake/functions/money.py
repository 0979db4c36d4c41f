"""Amounts: parsing, exact sums, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake.functions.keys import _col

# Amounts are cents; decimal sums do not depend on the order in which partitions arrive.
MONEY = "decimal(18,2)"


def clean_money(c: Column | str) -> Column:
    """Digits and dots only, as double; anything unreadable is 0.0. A sign is lost."""
    digits = F.regexp_replace(_col(c), "[^0-9.]", "")
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def amount(c: Column | str) -> Column:
    """Text or number as exact money, malformed gives NULL."""
    return _col(c).try_cast(MONEY)


def amount_value(c: Column | str) -> Column:
    """Text as double, malformed gives NULL. A trailing type letter ('5d') is malformed."""
    c = F.rtrim(_col(c))
    return F.when(~F.lower(F.right(c, F.lit(1))).isin("d", "f"), c.try_cast("double"))


def exact_sum(c: Column | str) -> Column:
    return F.sum(amount(c)).cast("double")


def exact_avg(c: Column | str) -> Column:
    """Mean from an exact sum, so that it is the same on any partitioning."""
    return F.try_divide(F.sum(amount(c)).cast("double"), F.count(amount(c)).cast("double"))


def currency_text(c: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(_col(c).cast("double"), 2)), F.lit("N/A"))


def count_text(c: Column | str) -> Column:
    return F.format_number(_col(c), 0)


def percent(part: Column | str, whole: Column | str) -> Column:
    return F.lit(100.0) * _col(part) / _col(whole)


def percent_text(c: Column | str) -> Column:
    return F.format_string("%.1f%%", _col(c))


def millions_text(c: Column | str) -> Column:
    return F.format_string("$%.1fM", _col(c) / F.lit(1e6))


def billions(c: Column | str) -> Column:
    return F.round(_col(c) / F.lit(1e9), 2)
