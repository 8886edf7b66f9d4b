"""URL filters: prefix rules, and a path-template tree learned from labelled pages. DataFrame operations only.

Template tree: each host is a root, each path segment a level, as deep as labelled paths go.
1. Pages are counted by shape: host and segments, with numbers as wildcards. All further work is on shapes.
2. Variable segments become wildcards: below a node, a segment value may be a branch only if SUPPORT labelled pages or more
   have it, whatever else the node holds; everything rarer goes to the wildcard.
3. Similar branches merge: those of a node whose shares of bad labels lie in one band are one template. Bands are equally
   wide on the arcsine scale, where the error of a share depends on the number of labels alone: Z standard errors of a branch
   with SUPPORT labels, with an edge at REJECT. So a chain of small steps doesn't merge good with bad, and what becomes of a
   branch doesn't depend on its neighbours. A template that would hold all labelled pages of its node is not parted off.
4. Templates are rejected by purity: (bad + STRENGTH * share of bad labels over all hosts) / (labelled + STRENGTH). A page is
   blocked if its template has a purity of at least REJECT.

Levels at which the labelled shapes of no node differ are passed over, so the number of rounds is that of levels that part
pages, not that of segments. Pages are counted with map-side combine, so a host that holds a third of all pages costs one row
per task and shape; a class of branches is named by its first and last member, never gathered. Pages meet the verdict of their
shape in one join, with a skewed side that Spark can split.

Edge cases: a null URL or one without :// has an empty host and path, fits no rule and belongs to the template of the empty
host. Null labels don't count. Repeated rows count each and get the same verdict. An empty table gives an empty result.
Other columns of the input are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.llm.common import cut

SUPPORT, Z, STRENGTH, REJECT = 20, 3.0, 20.0, 0.5


def _edges() -> list[float]:
    """Shares of bad labels where a band begins, one of them REJECT."""
    width, middle = Z / (2 * math.sqrt(SUPPORT)), math.asin(math.sqrt(REJECT))
    steps = range(-math.ceil(middle / width) + 1, math.ceil((math.pi / 2 - middle) / width))
    return [math.sin(middle + k * width) ** 2 if k else REJECT for k in steps]


EDGES = _edges()

#: (verdict, host, path): a rule fits its host and all subdomains, where the path starts with its own.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first :// and the next of / ? #, A-Z lower-cased. Path: from there to the next of ? #."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_name(host: str, path: str) -> str:
    return host + path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The fitting rule with the longest host, then the longest path, as (rule, verdict); null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(rule_name(own, prefix)).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """The segments of a path; numbers (with an extension or not) are wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), F.lit("*")).otherwise(s))


def _next_level(shapes: DataFrame, level: int) -> int | None:
    """The first level from this one on where labelled shapes of one node differ, if SUPPORT labelled pages get there."""
    rest = F.slice("segments", level + 1, (1 << 31) - 1)
    deep = shapes.filter((F.col("labelled") > 0) & (F.size("segments") > level)).withColumn("rest", rest)
    ends = deep.groupBy("node").agg(F.sum("labelled").alias("labelled"), F.min("rest").alias("low"), F.max("rest").alias("high"),
                                    F.min(F.size("rest")).alias("least"))
    same = F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b))
    ends = ends.filter(f"labelled >= {SUPPORT}").select(F.array_position(same, False).alias("at"))
    found = ends.filter("at > 0").agg(F.min("at")).first()[0]
    return None if found is None else level + int(found) - 1


def _parted(shapes: DataFrame, level: int) -> DataFrame:
    """shapes with the nodes that they belong to once that level is told apart."""
    totals = shapes.groupBy("node").agg(F.sum("labelled").alias("all_labelled"))
    value = F.get("segments", F.lit(level))
    values = shapes.filter((F.col("labelled") > 0) & (value != "*")).groupBy("node", value.alias("value"))
    values = values.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).filter(f"labelled >= {SUPPORT}")
    band = sum(((F.col("bad") >= F.lit(e) * F.col("labelled")).cast("int") for e in EDGES), F.lit(0))
    values = cut(values.withColumn("band", band))
    classes = values.groupBy("node", "band").agg(
        F.sum("labelled").alias("labelled"), F.count(F.lit(1)).alias("n"), F.min("value").alias("first"), F.max("value").alias("last")
    )
    name = F.when(F.col("n") == 1, F.col("first")).otherwise(F.concat("first", F.when(F.col("n") == 2, "|").otherwise("|..|"), "last"))
    classes = classes.join(totals, "node").filter("labelled < all_labelled").select("node", "band", name.alias("name"))
    branches = cut(values.select("node", "band", "value").join(classes, ["node", "band"]))
    parted = branches.select("node").distinct().withColumn("parts", F.lit(True))
    found = shapes.withColumn("value", value).join(branches, ["node", "value"], "left").join(parted, "node", "left")
    grown = [
        F.when(F.col("parts"), F.concat(c, F.lit("/"), F.coalesce(F.col(branch).cast("string"), F.lit("*")))).otherwise(F.col(c)).alias(c)
        for c, branch in (("node", "band"), ("template", "name"))
    ]
    return cut(found.select("shape", "segments", "labelled", "bad", *grown))


def template_purity(pages: DataFrame) -> DataFrame:
    """pages (host, path, bad: 1, 0 or null) with template (host, branches and wildcards) and its purity."""
    parts = segments(F.col("path"))
    shaped = pages.withColumn("shape", F.concat("host", F.lit("/"), F.array_join(parts, "/")))
    shapes = shaped.groupBy("shape").agg(
        F.first(parts).alias("segments"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        F.first("host").alias("node"),
    )
    shapes = cut(shapes.withColumn("template", F.col("node")))
    level = _next_level(shapes, 0)
    while level is not None:
        shapes = _parted(shapes, level)
        level = _next_level(shapes, level + 1)
    bad, labelled = shapes.agg(F.sum("bad"), F.sum("labelled")).first()
    base = bad / labelled if labelled else 0.0
    purity = (F.sum("bad") + F.lit(STRENGTH * base)) / (F.sum("labelled") + STRENGTH)
    nodes = shapes.groupBy("node").agg(purity.alias("purity"))
    below = F.size("segments") - F.size(F.split("template", "/")) + 1
    template = F.concat("template", F.expr("repeat('/*', below)"))
    named = shapes.withColumn("below", below).join(nodes, "node").select("shape", template.alias("template"), "purity")
    return shaped.join(cut(named), "shape", "left").drop("shape")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    pages: page_id, url; labels: page_id, bad (1 or 0), at most one row per page is used (the largest bad).
    """
    marks = labels.select("page_id", "bad").filter("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    host, path = host_and_path(F.col("url"))
    known = pages.select("page_id", host.alias("host"), path.alias("path"))
    scored = template_purity(known.join(marks, "page_id", "left"))
    found = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", found["rule"].alias("rule"), F.coalesce(found["verdict"], own).alias("verdict"),
        "template", "purity",
    )
