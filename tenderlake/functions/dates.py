"""Dates arrive as MM/DD/YYYY or ISO text, sometimes with a midnight suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake.functions.keys import _col


def strip_midnight(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), " 12:00:00 [AP]M$", "")


def parse_mdy(c: Column | str) -> Column:
    """Month, day and year around slashes, with or without leading zeros.

    Rearranged for the plain date cast, which yields NULL for text that is no date. The column
    occurs once in the expression, so a filter on it does not evaluate its source repeatedly.
    """
    iso = F.regexp_replace(_col(c), r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: .*)?$|^.*$", "$3-$1-$2")
    return iso.try_cast("date")


def parse_iso(c: Column | str) -> Column:
    return _col(c).try_cast("date")


def parse_any(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: .*)?$", "$3-$1-$2").try_cast("date")


def first_day(c: Column | str) -> Column:
    """Earliest ISO day. Dates aggregate in hash tables, text would need a sort."""
    return F.min(parse_iso(c)).cast("string")


def last_day(c: Column | str) -> Column:
    return F.max(parse_iso(c)).cast("string")


def month_key(d: Column | str) -> Column:
    return F.substring(_col(d).cast("string"), 1, 7)


def fiscal_year(d: Column | str) -> Column:
    """The fiscal year starts on 1 July, six months before the calendar year of its name."""
    return F.year(F.add_months(_col(d), 6))


def fiscal_window(
    start_fy: Column, end_fy: Column, current_fy: Column, fallback_years: int, last_fy: Column | None = None
) -> tuple[Column, Column]:
    """Fiscal years in which a contract can have records.

    One year before the start to two after the end (the current year without an end), never
    beyond `last_fy`, by default the current year. Without a start: the last `fallback_years`
    years and the latest one.
    """
    newest = current_fy if last_fy is None else F.least(current_fy, last_fy)
    first_year = F.coalesce(start_fy - 1, newest - fallback_years)
    last_year = F.when(start_fy.isNotNull(), F.least(F.coalesce(end_fy + 2, newest), newest)).otherwise(newest)
    return first_year, last_year


def iso_to_mdy_text(c: Column | str) -> Column:
    """Display form of ISO text of at least ten characters; other text as it is."""
    c = _col(c)
    return F.when(
        F.length(c) >= 10,
        F.concat_ws("/", F.substring(c, 6, 2), F.substring(c, 9, 2), F.substring(c, 1, 4)),
    ).otherwise(c)


def mdy_text(d: Column | str) -> Column:
    return F.date_format(_col(d), "MM/dd/yyyy")


def next_daily_run(now: Column, hour: int = 2) -> Column:
    """Next time the daily load starts, strictly after `now`."""
    today = F.date_trunc("day", now) + F.make_interval(hours=F.lit(hour))
    return F.when(today <= now, today + F.make_interval(days=F.lit(1))).otherwise(today)
