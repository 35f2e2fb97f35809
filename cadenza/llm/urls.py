"""URL filter: stated rules first, then a path-template tree.

Per host, paths form a tree, as deep as they are. Runs of digits become {n}; a segment that is one of many (over
MAX_CHILDREN) under its node and has less than 1 / RARE of that node's pages becomes a wildcard, and what follows the
wildcards of a node goes on as one branch. Below a node with at most MAX_CHILDREN different paths nothing can become a
wildcard, so these paths are its leaves as they are; the levels to build are those of the crowded nodes only.

Pages that a rule judges label the tree. From the deepest level up, labelled siblings stand in order of their blocked
share, and neighbours merge unless a two-proportion test tells them apart (its square above TOLERANCE). Where all
labelled children of a node merge, the node is one branch, with their counts, among its own siblings. A merged branch
with at least MIN_LABELS labels is rejected if its blocked share, smoothed towards its host's and that towards all
hosts', is at least REJECT. Branches without labels are neither merged nor rejected.

Everything is a DataFrame operation. Pages are counted by host and {n}-path before anything else; tree levels are
grouped counts of those. Hosts may be hot: joins are with staged tables, so that Spark can split their hot keys, and
windows span the children of one node, which are at most MAX_CHILDREN + RARE + 1. Only rejected shapes join the pages.

Defined cases: a null url, or one without ://, has an empty host and path and is allowed; repeated rows are judged
each; without any rule hit everything is allowed; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

#: verdict, host, path
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MAX_CHILDREN = 20
RARE = 20
SMOOTHING = 4
#: 1.96 squared: shares of one branch are told apart once in twenty.
TOLERANCE = 3.8416
MIN_LABELS = 10
REJECT = 0.5


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def _ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one. For lists of up to some hundred rules."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _shape(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "{n}")


def _tree(counts: DataFrame) -> DataFrame:
    """host, shape, labels, blocked and up, the templates from the host down to the shape's leaf, of every counted shape."""
    node, rest = F.col("node"), F.col("rest")
    parts = F.split("shape", "/")
    active = counts.select("*", F.lit("").alias("node"), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))).alias("rest"), F.array().cast("array<string>").alias("up"))
    leaves = [active.where(F.size(rest) == 0).withColumn("up", F.array(F.lit("")))]
    active = stage(active.where(F.size(rest) > 0))
    while not active.isEmpty():
        children = active.groupBy("host", "node", F.get(rest, F.lit(0)).alias("segment")).agg(F.sum("n").alias("own"), F.count("*").alias("shapes"))
        nodes = children.groupBy("host", "node").agg(F.sum("own").alias("all"), F.sum("shapes").alias("below"), F.count("*").alias("children")).where(F.col("below") > MAX_CHILDREN)
        rare = (F.col("children") > MAX_CHILDREN) & (F.col("own") * RARE < F.col("all"))
        crowded = children.join(nodes, ["host", "node"]).select(F.col("host").alias("_host"), F.col("node").alias("_node"), F.col("segment").alias("_segment"), rare.alias("rare"))
        joined = active.join(stage(crowded), (F.col("host") == F.col("_host")) & (node == F.col("_node")) & (F.get(rest, F.lit(0)) == F.col("_segment")), "left")
        few = F.col("rare").isNull()
        longer = F.concat(node, F.lit("/"), F.when(few, F.array_join(rest, "/")).when(F.col("rare"), "*").otherwise(F.get(rest, F.lit(0))))
        left = F.when(few, F.array().cast("array<string>")).otherwise(F.slice(rest, 2, F.size(rest)))
        step = stage(joined.select("host", "shape", "n", "labels", "blocked", longer.alias("node"), left.alias("rest"), F.array_append("up", longer).alias("up")))
        leaves.append(step.where(F.size(rest) == 0))
        active = step.where(F.size(rest) > 0)
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out.select("host", "shape", "labels", "blocked", "up")


def _smoothed(labels: str, blocked: str, towards: str) -> Column:
    return (F.col(blocked) + SMOOTHING * F.col(towards)) / (F.col(labels) + SMOOTHING)


def _branches(leaves: DataFrame) -> DataFrame:
    """host, template, labels, blocked: every merged branch's counts beside each template that it consists of; leaves: host, up, labels, blocked."""
    live = leaves.where("labels > 0").groupBy("host", "up").agg(F.sum("labels").alias("labels"), F.sum("blocked").alias("blocked")).withColumn("split", F.lit(False))
    live, found = stage(live), None
    siblings = Window.partitionBy("host", "parent", "split")
    ordered = siblings.orderBy(F.col("blocked") / F.col("labels"), "template")
    n1, b1, n2, b2 = (F.col(c).cast("double") for c in ("n1", "b1", "labels", "blocked"))
    apart = (b1 * n2 - b2 * n1) * (b1 * n2 - b2 * n1) * (n1 + n2) > TOLERANCE * n1 * n2 * (b1 + b2) * (n1 + n2 - b1 - b2)
    for depth in range(live.agg(F.max(F.size("up"))).first()[0] or 0, 0, -1):
        here = live.where(F.size("up") == depth).withColumns({"template": F.element_at("up", -1), "parent": F.coalesce(F.get("up", F.lit(depth - 2)), F.lit(""))})
        here = here.withColumns({"n1": F.lag("labels").over(ordered), "b1": F.lag("blocked").over(ordered)})
        here = here.withColumn("group", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(ordered))
        whole = F.max(F.col("split") | (F.col("group") > 0)).over(Window.partitionBy("host", "parent"))
        here = stage(here.withColumn("stays", whole if depth > 1 else F.lit(True)))
        branch = Window.partitionBy("host", "parent", "group")
        ends = here.where("stays and not split").select("host", "template", F.sum("labels").over(branch).alias("labels"), F.sum("blocked").over(branch).alias("blocked"))
        found = ends if found is None else found.unionByName(ends)
        if depth > 1:
            above = here.groupBy("host", F.slice("up", 1, depth - 1).alias("up")).agg(F.sum("labels").alias("labels"), F.sum("blocked").alias("blocked"), F.max("stays").alias("split"))
            live = live.where(F.size("up") < depth).unionByName(above)
    return live.select("host", F.lit("").alias("template"), "labels", "blocked").limit(0) if found is None else found


def _rejected(pages: DataFrame) -> DataFrame:
    """_host and _shape ({n}-path) of what the tree blocks; pages: host, path, verdict of the rules."""
    counts = stage(pages.groupBy("host", _shape(F.col("path")).alias("shape")).agg(F.count("*").alias("n"), F.count("verdict").alias("labels"), F.count_if(F.col("verdict") == "block").alias("blocked")))
    hosts = counts.groupBy("host").agg(F.sum("labels").alias("host_labels"), F.sum("blocked").alias("host_blocked"))
    total = counts.agg((F.sum("blocked") / F.nullif(F.sum("labels"), F.lit(0))).alias("share")).first()[0] or 0.0
    hosts = hosts.where("host_labels > 0").withColumn("share", F.lit(total)).select("host", _smoothed("host_labels", "host_blocked", "share").alias("prior"))
    leaves = _tree(counts)
    bad = _branches(leaves).where(F.col("labels") >= MIN_LABELS).join(hosts, "host").where(_smoothed("labels", "blocked", "prior") >= REJECT)
    bad = bad.select(F.col("host").alias("_host"), F.col("template").alias("_template"))
    below = leaves.select("host", "shape", F.explode("up").alias("template"))
    return stage(below.join(bad, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template")), "left_semi").select(F.col("host").alias("_host"), F.col("shape").alias("_shape")).distinct())


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    host, path = parsed(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = _ruled(F.col("host"), F.col("path"), rules)
    rows = stage(split.withColumns({"rule": rule, "verdict": verdict}))
    bad = _rejected(rows)
    joined = rows.join(bad, (rows["host"] == bad["_host"]) & (_shape(rows["path"]) == bad["_shape"]), "left")
    method = F.when(F.col("_host").isNotNull() & (F.col("host") != ""), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"))
