"""Key and name normalisation as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wildcards of a LIKE pattern; search text is never escaped, so these act as wildcards.
WILDCARDS = "[%_]"
# LIKE needs an escape character; this control character never occurs in the feeds.
LIKE_ESCAPE = "\x01"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized_key(c: Column | str) -> Column:
    """Upper-case, keep A-Z and 0-9. Empty input gives NULL, input without such characters ''."""
    return F.regexp_replace(F.upper(F.nullif(_col(c), F.lit(""))), "[^A-Z0-9]", "")


def comparable_name(c: Column | str) -> Column:
    """As `normalized_key`, but NULL and '' both give ''."""
    return F.coalesce(F.regexp_replace(F.upper(_col(c)), "[^A-Z0-9]", ""), F.lit(""))


def compact_key(c: Column | str) -> Column:
    """Drop hyphens and blanks, upper-case; NULL gives ''."""
    return F.coalesce(F.upper(F.translate(_col(c), "- ", "")), F.lit(""))


def hyphenless(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("-"), F.lit(""))


def hyphenless_upper(c: Column | str) -> Column:
    return F.upper(hyphenless(c))


def base_key(c: Column | str, length: int = 10) -> Column:
    """Leading part of a key; a contract key extends the key of its solicitation."""
    return F.substring(_col(c), 1, length)


def leading_segment(c: Column | str) -> Column:
    """Text before the first hyphen."""
    return F.split_part(_col(c), F.lit("-"), F.lit(1))


def year_in_id(c: Column | str) -> Column:
    """Four characters after the first hyphen that starts '-202'; without one, the first four."""
    c = _col(c)
    return F.substr(c, F.instr(c, "-202") + 1, F.lit(4))


def like(c: Column | str, pattern: Column | str) -> Column:
    """Case-sensitive LIKE without an escape character."""
    return F.like(_col(c), _col(pattern), F.lit(LIKE_ESCAPE))


def contains_text(c: Column | str, text: str) -> Column:
    """Case-insensitive search for `text` anywhere, % and _ in it being wildcards."""
    return F.ilike(_col(c), F.lit(f"%{text}%"), F.lit(LIKE_ESCAPE))


def contained_either_way(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return a.contains(b) | b.contains(a)


def longest_literal(pattern: Column | str) -> Column:
    """Longest piece of a LIKE pattern that holds no wildcard (the first one on a tie)."""
    pieces = F.split(_col(pattern), WILDCARDS)
    return F.aggregate(
        pieces,
        F.lit(""),
        lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best),
    )


def fallback_pattern(name: Column | str, min_length: int = 6) -> Column:
    """Wildcard form of a vendor name: ' CORP' becomes %, else % is appended.

    Names shorter than `min_length` have no wildcard form (NULL).
    """
    name = _col(name)
    return F.when(
        F.length(name) >= min_length,
        F.when(name.contains(" CORP"), F.replace(name, F.lit(" CORP"), F.lit("%"))).otherwise(
            F.concat(name, F.lit("%"))
        ),
    )


def zero_pad(c: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer values are kept whole."""
    text = _col(c).cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))
