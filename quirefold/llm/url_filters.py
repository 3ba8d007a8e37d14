"""URL filter by a path-template tree.

Paths are counted once per host and path. Runs of digits in a segment become `#`. The tree of such segments below each host is
built level by level from the root: of a node's branches those keep their names whose share of bad labelled pages differs from
that of all their siblings, by a test of two proportions; the others merge into one branch `*`, whose children are then merged
and counted anew on the next level. What lies below DEPTH segments is one leaf, `**`. The templates that result are rejected by
their smoothed share of bad labels. Explicit rules come before templates.

Nodes and branches are counted by 64-bit hashes, in rows of fixed width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_broadcast, cut, lower_az

#: (host, path, verdict); a rule fits the host and its subdomains where the path starts with the rule's.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Segments in the tree; labels that a branch needs for the test, and its z; weight of the prior in a share, and the share that rejects.
DEPTH, MIN_LABELS, Z, PRIOR_WEIGHT, REJECT = 8, 5, 2.0, 10.0, 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lower_az(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    host, path = F.col("host"), F.col("path")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _named(rows: DataFrame) -> DataFrame:
    """The branches (hash) that keep their names: single ones, and those that differ from all their siblings; rows: (node, branch, bad, labelled)."""
    branches = rows.groupBy("node", "branch").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    nodes = branches.groupBy("node").agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"), F.count("*").alias("n"), F.min("branch").alias("only"))
    rate = F.col("all_bad") / F.col("all_labelled")
    others = F.col("all_labelled") - F.col("labelled")
    apart = F.abs(F.col("bad") / F.col("labelled") - (F.col("all_bad") - F.col("bad")) / others)
    differs = apart > Z * F.sqrt(rate * (1 - rate) * (1 / F.col("labelled") + 1 / others))
    # only branches with enough labels are joined with their node
    tested = branches.where(F.col("labelled") >= MIN_LABELS).join(nodes.where("n > 1"), "node").where("all_labelled > labelled").where(differs)
    return tested.select("branch").unionByName(nodes.where("n = 1").select(F.col("only").alias("branch")))


def templates(paths: DataFrame, depth: int = DEPTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """host, path, pages, bad, labelled and template for paths (host, path, pages, bad, labelled), host and path not null; an empty path has the empty template."""
    parts = F.split("path", "/", depth + 1)
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.transform(F.slice(parts, 1, depth), lambda s: F.regexp_replace(s, "[0-9]+", "#")))
    rows = paths.select("host", "path", "pages", "bad", "labelled", segments.alias("segments"), (F.size(parts) > depth).alias("deeper"), F.lit(None).cast("string").alias("template"))
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    ended = []
    for level in range(deepest):
        ended.append(rows.where(F.size("segments") <= level))
        rows = rows.where(F.size("segments") > level).withColumn("name", F.get("segments", F.lit(level))).withColumn("node", F.xxhash64("host", "template"))
        rows = rows.withColumn("branch", F.xxhash64("node", "name"))
        named = cut(_named(rows).select(F.col("branch").alias("named")))
        n = named.count()
        shown = rows.join(bounded_broadcast(named, n, broadcast_rows), F.col("branch") == F.col("named"), "left")
        rows = shown.withColumn("template", F.concat_ws("/", "template", F.when(F.col("named").isNotNull(), F.col("name")).otherwise("*"))).drop("name", "node", "branch", "named")
        if n > broadcast_rows:
            rows = cut(rows)
    for part in ended:
        rows = rows.unionByName(part)
    whole = F.when(F.col("deeper"), F.concat("template", F.lit("/**"))).otherwise(F.coalesce("template", F.lit("")))
    return rows.select("host", "path", "pages", "bad", "labelled", whole.alias("template"))


def filter_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, template, bad_share (smoothed), verdict.

    labels (page_id, bad: 0 or 1) are what templates are judged by; without them, the verdicts of the rules are. A url that is
    null or has no `://` has an empty host and path, and its own template. Repeated rows give a row each; a null page_id is
    kept; other columns are ignored. Paths of any length are judged; below DEPTH segments they share a template. A segment that
    is itself `*` belongs to the merged branch.
    """
    name, says = _rule(rules)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("*", name.alias("rule"), says.alias("says"))
    if labels is None:
        known = rows.withColumn("label", F.when(F.col("says") == "block", 1).when(F.col("says") == "allow", 0))
    else:
        own = labels.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("of")).agg(F.max("bad").cast("int").alias("label"))
        known = rows.join(own, F.col("page_id") == F.col("of"), "left")
    paths = known.groupBy("host", "path").agg(F.count("*").alias("pages"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"), F.count("label").alias("labelled"))
    shaped = cut(templates(cut(paths)))
    every = shaped.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("prior"))
    shaped = shaped.withColumn("leaf", F.xxhash64("host", "template"))
    judged = shaped.groupBy("leaf").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    # one row, by the nature of an aggregate without keys
    share = (F.col("bad") + PRIOR_WEIGHT * F.col("prior")) / (F.col("labelled") + PRIOR_WEIGHT)
    judged = cut(judged.join(F.broadcast(every), F.lit(True)).select("leaf", share.alias("bad_share")))
    by_path = shaped.select("host", "path", "template", "leaf").join(bounded_broadcast(judged, judged.count()), "leaf").drop("leaf")
    return rows.join(by_path, ["host", "path"]).select(
        "page_id", "host", "path", "rule", "template", "bad_share", F.coalesce("says", F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")).alias("verdict")
    )
