"""Display text, posts and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake.functions.keys import _col

EXCERPT_LENGTH = 200


def or_default(c: Column | str, default: str) -> Column:
    """NULL and '' show as `default`."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default))


def truncated(c: Column | str, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def key_label(c: Column | str) -> Column:
    """'prime_contract_type' as 'Prime Contract Type'."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def year_label(c: Column | str) -> Column:
    """'fy2016' as '2016'."""
    return F.regexp_replace(_col(c), "^fy", "")


def fy_label(c: Column | str) -> Column:
    return F.concat(F.lit("FY"), _col(c).cast("string"))


def json_map(c: Column | str) -> Column:
    """Top-level members of a JSON object as a map; unreadable text gives an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(_col(c), "map<string,string>", {"mode": "PERMISSIVE"}), empty)


def json_value(c: Column | str) -> Column:
    """A JSON text as a variant, which keeps nested objects and numbers; unreadable or missing text gives an empty object."""
    return F.coalesce(F.try_parse_json(_col(c)), F.parse_json(F.lit("{}")))


def json_path(c: Column | str, path: str, kind: str = "string") -> Column:
    """The value at a path ($.a.b) of a variant as a type; NULL where it is missing or has another type."""
    return F.try_variant_get(_col(c), path, kind)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lines(c: Column | str) -> tuple[Column, Column]:
    """Lines of a post and the number of its first blank line (0 when there is none)."""
    lines = F.split(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")), "\n")
    blank = F.array_position(F.transform(lines, lambda x: _strip(x) == ""), True)
    return lines, blank.cast("int")


def front_matter(c: Column | str) -> Column:
    """`Key: Value` lines before the first blank line, keys in lower case."""
    lines, blank = _lines(c)
    header = F.when(blank == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(blank - 1, F.lit(0))))
    return F.transform(
        F.filter(header, lambda x: x.contains(":")),
        lambda x: F.struct(
            F.lower(_strip(F.substring_index(x, ":", 1))).alias("key"),
            _strip(F.substr(x, F.instr(x, ":") + 1)).alias("value"),
        ),
    )


def front_value(pairs: Column | str, key: str) -> Column:
    """Value of the last line with this key, NULL without one."""
    return F.try_element_at(F.filter(_col(pairs), lambda p: p["key"] == key), F.lit(-1))["value"]


def post_body(c: Column | str) -> Column:
    """Text after the first blank line, the whole text when there is none."""
    lines, blank = _lines(c)
    rest = F.slice(lines, blank + 1, F.size(lines))
    return F.array_join(rest, "\n")


def plain_text(c: Column | str) -> Column:
    """HTML to text: no script, style or comment, tags dropped, basic entities decoded."""
    text = F.regexp_replace(_col(c), r"(?is)<(script|style)\b.*?</(script|style)>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def excerpt(given: Column | None, text: Column) -> Column:
    """The excerpt given in the post, else the first 200 characters and '...'."""
    cut = F.concat(F.substring(text, 1, EXCERPT_LENGTH), F.lit("..."))
    return cut if given is None else F.coalesce(given, cut)
