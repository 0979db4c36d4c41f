"""URL filters: fixed rules, then a tree of path templates per host judged by labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import LOWER, UPPER, stored

# Path segments that make a template; what is deeper becomes one tail.
DEPTH = 3
# A segment stays as it is with at least one in this many of its parent's urls and without a digit; else it is variable.
RARE = 50
# Branches are merged if a branch's purity lies within so many standard errors of all its siblings together.
SIGMAS = 1.96
# Pseudo observations, half of them good, and the purity below which a template is rejected: it takes more than five bad
# urls and no good one, so a template without labels passes.
PRIOR, CLEAN = 5, 0.25
# A branch without labels may have this many times the pages of its siblings, or this part of them.
ALIKE = 2

# (host, path, verdict) of the default rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; nulls without one. A rule fits its host and all subdomains."""
    rule = verdict = F.lit(None).cast("string")
    # Later conditions come first in the expression, so the longest is built last.
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def templates(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per (host, path) with its number n: the path's template.

    Level by level, a segment is counted below its host and the template of its parents; rare segments and those with a
    digit become `*`. Counts are summed before they are joined, so a host with a third of all pages is many small rows.
    """
    rows = paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    for level in range(depth):
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        children = rows.where("segment is not null").groupBy("host", "template", "segment").agg(F.sum("n").alias("own"))
        parents = children.groupBy("host", "template").agg(F.sum("own").alias("of"))
        fixed = (children.where(~F.col("segment").rlike("[0-9]")).join(parents, ["host", "template"])
                 .where(F.col("own") * RARE >= F.col("of")).select("host", "template", "segment", F.lit(True).alias("fixed")))
        step = F.when(F.col("segment").isNull(), "").when(F.col("fixed"), F.concat(F.lit("/"), "segment")).otherwise("/*")
        rows = rows.join(fixed, ["host", "template", "segment"], "left").withColumn("template", F.concat("template", step)).drop("fixed", "segment")
    tail = F.when(F.size("segments") > depth, "/**").otherwise("")
    return rows.withColumn("template", F.concat("template", tail)).drop("segments")


def judged_templates(paths: DataFrame) -> DataFrame:
    """(host, template, merged, blocked) of paths with template, good and bad (labelled urls).

    Branches of a host that differ in their first segment only are siblings: they have the same depth and the same segments
    below. Those whose purity does not differ from that of all siblings are judged together. A branch without a label has
    none to differ; it is judged with its siblings if it looks like them in its pages too: it has their mean number up to a
    factor of ALIKE. Purity is smoothed towards one half, which a branch that stands alone without labels has.
    """
    own = paths.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("n").alias("pages"))
    branch = F.regexp_replace("template", "^/[^/]+", "/*")
    own = stored(own.withColumn("branch", branch), "templates")
    siblings = own.groupBy("host", "branch").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count("*").alias("branches"), F.sum("pages").alias("all_pages"))
    p = F.col("all_good") / (F.col("all_good") + F.col("all_bad"))
    n = F.col("good") + F.col("bad")
    scaled = F.col("pages") * F.col("branches")
    pure = F.abs(F.col("good") / n - p) <= SIGMAS * F.sqrt(p * (1 - p) / n)
    like = (ALIKE * scaled >= F.col("all_pages")) & (scaled <= ALIKE * F.col("all_pages"))
    several = (F.col("branches") > 1) & (F.col("all_good") + F.col("all_bad") > 0)
    alike = F.when(several & (n > 0), pure).when(several, like).otherwise(False)
    named = own.join(siblings, ["host", "branch"]).withColumn("merged", F.when(alike, F.col("branch")).otherwise(F.col("template")))
    # A branch that is `/*` itself and stands alone must not meet the merged ones.
    named = named.withColumn("alike", alike)
    groups = named.groupBy("host", "merged", "alike").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    purity = (F.col("g") + F.lit(PRIOR / 2)) / (F.col("g") + F.col("b") + F.lit(PRIOR))
    blocked = groups.select("host", "merged", "alike", (purity < CLEAN).alias("blocked"))
    return named.join(blocked, ["host", "merged", "alike"]).select("host", "template", "merged", "blocked")


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """Per row: page_id, host, path, rule, template, verdict (allow or block).

    A fitting rule decides; else the template of the path. Labelled urls are those that a rule decides, or `labels`
    (url, good) if given, which count beside them. Null urls and urls without :// have an empty host and path, fit no
    rule with a host, and have the template of an empty path. A null page_id stays null; repeated rows are judged each, and
    count as often as they occur. Other columns are not read. An empty table gives an empty table.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    counted = ruled.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"))
    if labels is not None:
        given = labels.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "good").where("good is not null")
        given = given.groupBy("host", "path").agg(F.lit(0).cast("long").alias("n"), F.count(F.when(F.col("good") == 1, 1)).alias("good"), F.count(F.when(F.col("good") == 0, 1)).alias("bad"))
        counted = counted.unionByName(given).groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
    paths = stored(templates(counted, depth), "paths")
    judged = paths.select("host", "path", "template").join(judged_templates(paths), ["host", "template"])
    decided = F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow"))
    return ruled.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", decided.alias("verdict"), F.col("merged").alias("template"))
