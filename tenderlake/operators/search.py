"""Filters, sorting and paging of list and search views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions.keys import contains_text

# What the list views accept; anything else means no filter.
BUSINESS_CATEGORIES = (
    "Commercial Services", "Construction", "Distribution", "Human Services",
    "Manufacturing", "Nonprofit", "Professional Services", "Retail",
)
DIGITAL_CLASSES = ("Digital", "Mixed")
LEDGER_PAGE_SIZES = (20, 50, 100)


def allowed(value, valid: Sequence, default=None):
    return value if value in valid else default


def capped(limit: int, most: int) -> int:
    return min(limit, most)


def any_contains(columns: Sequence[str], text: str) -> Column:
    """`text` occurs in at least one of the columns, ignoring case."""
    return reduce(Column.__or__, [contains_text(c, text) for c in columns])


def all_of(conditions: Sequence[Column | None]) -> Column:
    """AND of the conditions that are given; none given keeps every row."""
    given = [c for c in conditions if c is not None]
    return reduce(Column.__and__, given) if given else F.lit(True)


def equals(column: str, value) -> Column | None:
    return None if value in (None, "") else F.col(column) == value


def partial(column: str, text: str | None) -> Column | None:
    return contains_text(column, text) if text else None


def matches_any(columns: Sequence[str], text: str | None) -> Column | None:
    return any_contains(columns, text) if text else None


def filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def certification(kind: str | None, column: str = "certification_type") -> Column | None:
    """Certification classes. 'Non-MWBE' contains 'WBE', so it counts as WBE here."""
    c = F.col(column)
    return {
        "Any MWBE": filled(column) & (c != "Non-MWBE"),
        "MBE": contains_text(column, "MBE"),
        "WBE": contains_text(column, "WBE"),
        "Non-MWBE": c == "Non-MWBE",
    }.get(kind)


def sort_order(columns: Mapping[str, str], sort: str | None, default: str, order: str | None, ties: Sequence[str]) -> list[Column]:
    """ORDER BY from an allow-list. Only 'asc' sorts upwards; `ties` make paging stable."""
    c = F.col(columns.get(sort, columns[default]))
    return [c.asc() if order == "asc" else c.desc(), *[F.col(t) for t in ties]]


def page_rows(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page; page numbers below 1 mean the first page."""
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


# Rows before a page that one task may sort away; pages beyond are found by counting.
DEEP = 10_000
# Parts that a range of numbers or dates is cut into, and characters by which a range of texts is.
CUTS, STEP = 64, 3

Keys = Sequence[tuple[str, bool]]


def by_keys(keys: Keys) -> list[Column]:
    """ORDER BY (column, ascending) with NULLs first upwards and last downwards."""
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys]


def _nan(df: DataFrame, column: str) -> Column:
    """NaN, which is the largest number, named as such: files and caches keep no bounds that hold for it."""
    return F.isnan(column) if dict(df.dtypes)[column] in ("float", "double") else F.lit(False)


def _equal(df: DataFrame, column: str, value) -> Column:
    return _nan(df, column) if value != value else F.col(column).eqNullSafe(F.lit(value))


def _beyond(df: DataFrame, column: str, value, up: bool) -> Column:
    """Rows behind a value in the direction of a key."""
    c, nan = F.col(column), _nan(df, column)
    if value is None:
        return c.isNotNull() if up else F.lit(False)
    if value != value:
        return F.lit(False) if up else ~nan | c.isNull()
    return (c > F.lit(value)) | nan if up else (c < F.lit(value)) & ~nan | c.isNull()


def _text_ranges(df: DataFrame, column: str, up: bool, length: int) -> list[tuple[Column, Column, Column, object, bool, int]]:
    """Texts by their first characters: rows of the range, from it on, up to it, its value, whether it has one only, and its rows."""
    head = F.substring(column, 1, length)
    found = df.groupBy(head.alias("_head")).agg(F.count("*").alias("_n")).orderBy(*by_keys([("_head", up)])).collect()
    out = []
    for text, n in found:
        if text is None:
            null = F.col(column).isNull()
            out.append((null, F.lit(True) if up else null, null if up else F.lit(True), None, True, n))
        else:
            behind, ahead = (head >= text, (head <= text) | head.isNull()) if up else ((head <= text) | head.isNull(), head >= text)
            out.append((head == text, behind, ahead, text, len(text) < length, n))
    return out


def _number_ranges(df: DataFrame, column: str, up: bool) -> list[tuple[Column, Column, Column, object, bool, int]]:
    """As `_text_ranges`, between quantiles; a quantile is a range of its own, so that a frequent value stands alone."""
    c, nan = F.col(column), _nan(df, column)
    points = df.agg(F.percentile_approx(F.when(~nan, c), [i / CUTS for i in range(CUTS + 1)])).first()[0] or []
    points = sorted(set(points))
    last, at = 2 * len(points), F.when(c.isNull(), -1).when(nan, 2 * len(points) + 1)
    if points:
        table = F.array(*[F.lit(p) for p in points])
        at = at.otherwise(2 * F.size(F.filter(table, lambda p: p < c)) + F.array_contains(table, c).cast("int"))
    counts = dict(df.groupBy(at.alias("_at")).agg(F.count("*").alias("_n")).collect())
    out = []
    for k in sorted(counts, reverse=not up):
        if k in (-1, last + 1):
            value, rows = (None, c.isNull()) if k < 0 else (float("nan"), nan)
            if (k < 0) == up:  # nothing stands before NULL upwards, nor before NaN downwards
                behind, ahead = F.lit(True), rows
            else:  # behind NULL there is nothing downwards, behind NaN upwards
                behind, ahead = rows, F.lit(True)
            out.append((rows, behind, ahead, value, True, counts[k]))
            continue
        single = k % 2 == 1
        lo, hi = (points[(k - 1) // 2] if k else None), (points[k // 2] if k < last else None)
        if single:
            lo = hi = points[k // 2]
        above = F.lit(True) if lo is None else (c >= F.lit(lo) if single else c > F.lit(lo))
        below = F.lit(True) if hi is None else (c <= F.lit(hi) if single else c < F.lit(hi))
        above, below = c.isNotNull() & (above | nan), c.isNotNull() & below & ~nan
        behind, ahead = (above, below | c.isNull()) if up else (below | c.isNull(), above)
        out.append((above & below, behind, ahead, lo if single else None, single, counts[k]))
    return out


def narrowed(df: DataFrame, keys: Keys, offset: int, size: int, few: int = DEEP) -> tuple[DataFrame, int]:
    """Rows from some place of an order on, and how many of them (about `few` at most) stand before row `offset`.

    Order statistics: the ranges of the first key are counted, the one that holds the row is counted in smaller ranges, a
    range of one value by the next key. The driver sees counts of ranges only; rows before the place are never gathered. `size`
    rows from `offset` on lie within the result, which also ends with the range of the first key that holds the last of them.
    """
    kinds = dict(df.dtypes)
    fixed: list[tuple[str, bool, object]] = []
    until, skip, behind = F.lit(True), offset, F.lit(True)

    def same() -> Column:
        return reduce(Column.__and__, [_equal(df, c, v) for c, _, v in fixed], F.lit(True))

    for level, (column, up) in enumerate(keys):
        if skip <= few:
            break
        inside, length, found = df.filter(same()), STEP, None
        while skip > few:
            text = kinds[column] == "string"
            ranges = _text_ranges(inside, column, up, length) if text else _number_ranges(inside, column, up)
            before = 0
            for i, found in enumerate(ranges):
                if before + found[-1] > skip:
                    break
                before += found[-1]
            else:
                return df.limit(0), 0  # the page lies behind the last row
            end = before
            for last in ranges[i:] if not level else []:
                end += last[-1]
                if end >= skip + size:
                    until = last[2]
                    break
            rows, behind, _, value, single, n = found
            skip -= before
            if single or n <= few:
                break
            inside, length = inside.filter(rows), length + STEP
        if found is None or not found[4]:
            break
        fixed.append((column, up, found[3]))
        behind = F.lit(True)
    place = F.lit(False)
    for i, (column, up, value) in enumerate(fixed):
        equal = reduce(Column.__and__, [_equal(df, c, v) for c, _, v in fixed[:i]], F.lit(True))
        place = place | (equal & _beyond(df, column, value, up))
    return df.filter(until & (place | (same() & behind))), skip


def page_at(df: DataFrame, keys: Keys, page: int, size: int, few: int = DEEP) -> DataFrame:
    """One page in the order of (column, ascending) keys. The first rows are a top-k; a deep page is found by counting ranges."""
    skip = (max(page, 1) - 1) * size
    if skip > few:
        df, skip = narrowed(df, keys, skip, size, few)
    return df.orderBy(*by_keys(keys)).offset(skip).limit(size)


def rows_after(df: DataFrame, keys: Mapping[str, bool], last: Mapping[str, object] | None, size: int) -> DataFrame:
    """The page behind the row `last`, without reading the pages before it into one task.

    `keys` maps the sort columns to True for ascending; together they identify a row and hold no NULLs. `last`
    holds their values in the last row seen, None for the first page.
    """
    found = df
    if last is not None:
        behind, same = F.lit(False), F.lit(True)
        for column, ascending in keys.items():
            value = F.lit(last[column])
            behind = behind | (same & (F.col(column) > value if ascending else F.col(column) < value))
            same = same & (F.col(column) == value)
        found = df.filter(behind)
    return found.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in keys.items()]).limit(size)


def with_totals(page: DataFrame, unpaged: DataFrame, size: int, counted: Column | None = None) -> DataFrame:
    """Number of rows behind a page and number of pages.

    Both are columns of one projection: a second one above it would hide the page's sort from its limit.
    """
    rows = F.count("*") if counted is None else counted
    pages = F.ceil(rows / F.lit(size)).cast("long")
    return page.select("*", unpaged.agg(rows).scalar().alias("total_rows"), unpaged.agg(pages).scalar().alias("total_pages"))


def page_with_next(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page and whether another follows, by reading one row more instead of counting."""
    return _with_next(df, order, (max(page, 1) - 1) * size, size)


def page_at_with_next(df: DataFrame, keys: Keys, page: int, size: int, few: int = DEEP) -> DataFrame:
    """As `page_with_next`, in the order of (column, ascending) keys; a deep page is found by counting ranges."""
    skip = (max(page, 1) - 1) * size
    if skip > few:
        df, skip = narrowed(df, keys, skip, size + 1, few)
    return _with_next(df, by_keys(keys), skip, size)


def _with_next(df: DataFrame, order: Sequence[Column], skip: int, size: int) -> DataFrame:
    ahead = df.orderBy(*order).offset(skip).limit(size + 1)
    # The window sees at most size + 1 rows.
    w = Window.orderBy(*order)
    numbered = ahead.withColumn("_n", F.row_number().over(w)).withColumn(
        "has_next", F.count("*").over(Window.partitionBy()) > size
    )
    return numbered.filter(F.col("_n") <= size).drop("_n")


def numeric_sort_key(column: str) -> tuple[Column, Column]:
    """Sort keys of a table cell: a number for '$..' or digit-led text, and the text itself."""
    cell = F.lower(F.trim(F.col(column)))
    number = F.regexp_replace(cell, "[^0-9.-]+", "").try_cast("double")
    return F.when(cell.contains("$") | cell.rlike("^[0-9]"), number), cell


def numeric_aware(column: str, ascending: bool = True) -> list[Column]:
    number, cell = numeric_sort_key(column)
    return [number.asc_nulls_last(), cell.asc()] if ascending else [number.desc_nulls_last(), cell.desc()]
