"""URL filters: listed rules first, then a tree of path templates judged by the rules' own labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small_side

# Verdict, host and path prefix of each rule.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A tree node with so many distinct child segments has variable ones; below DEPTH levels a path that shares its branch with
#: no other one is one wildcard from there on.
FANOUT, DEPTH = 10, 6
#: Labelled pages that the smoothing counts as much as; standard errors within which sibling branches are alike.
STRENGTH, ALIKE = 5.0, 2.0
#: A template is rejected if its smoothed share of blocked pages is above this.
REJECT = 0.5


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The fitting rule with the longest text, as a struct (rule, verdict); null if none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    return F.coalesce(
        *(
            F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in ranked
        ),
        F.lit(None),
    )


def path_templates(paths: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """paths (host, path, ...) with the branches of each path: its templates from the root, "", down to its own.

    Level by level, a segment becomes "*" if it has a digit, or if its parent, in the same host, has fanout distinct
    segments or more below it. Distinct segments are counted from partial sums; the parents with many are few, and join
    in a broadcast if their measured size allows it, so that a host with a third of all paths stays spread.
    """
    tree = paths.withColumns({"segments": F.filter(F.split("path", "/"), lambda s: s != ""), "template": F.lit(""), "branches": F.array(F.lit(""))})
    deepest = tree.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(deepest):
        if level >= depth:
            tree, more = _folded(tree, level)
            if not more:
                break
        here = F.get("segments", F.lit(level))
        tree = tree.withColumn("segment", F.when(here.rlike("[0-9]"), F.lit("*")).otherwise(here))
        wide = (
            tree.where(F.col("segment").isNotNull())
            .groupBy("host", "template")
            .agg(F.countDistinct("segment").alias("n"))
            .where(F.col("n") >= fanout)
            .select("host", "template", F.lit(True).alias("wide"))
        )
        wide = small_side(cut(wide, "wide"), F.octet_length("host") + F.octet_length("template"))
        step = F.when(F.col("wide"), F.lit("*")).otherwise(F.col("segment"))
        tree = (
            tree.join(wide, ["host", "template"], "left")
            .withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), step)))
            .withColumn("branches", F.when(F.col("segment").isNull(), F.col("branches")).otherwise(F.array_append("branches", F.col("template"))))
            .drop("wide", "segment")
        )
    return tree.drop("segments")


def _folded(tree: DataFrame, level: int) -> tuple[DataFrame, bool]:
    """tree, with the rest of every path that is the only one to go on below its branch as one wildcard, and whether any
    others go on.

    No verdict hangs on such a chain: all its branches have the counts of its one path, which a rule either fits, and
    then judges, or does not, and then no branch of the chain has a labelled page.
    """
    on = F.size("segments") > level
    tree = cut(tree, "tree")
    many = cut(tree.where(on).groupBy("host", "template").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("host", "template", F.lit(True).alias("many")), "many")
    fold, rest = on & F.col("many").isNull(), F.concat("template", F.lit("/**"))
    done = tree.join(small_side(many, F.octet_length("host") + F.octet_length("template")), ["host", "template"], "left").withColumns(
        {
            "segments": F.when(fold, F.slice("segments", 1, level)).otherwise(F.col("segments")),
            "branches": F.when(fold, F.array_append("branches", rest)).otherwise(F.col("branches")),
            "template": F.when(fold, rest).otherwise(F.col("template")),
        }
    )
    return done.drop("many"), not many.isEmpty()


def judge_templates(tree: DataFrame, strength: float = STRENGTH, alike: float = ALIKE) -> DataFrame:
    """(host, template, impurity) from tree (host, branches, template, labelled, blocked).

    Every branch of a host's tree, inner ones too, has the counts of all paths below it. Siblings are ordered by their
    smoothed share of blocked pages; neighbours within `alike` standard errors become one, and pool their counts. A
    parent has fewer than FANOUT named children, and a wildcard, so its window is small. The share of a template is
    smoothed towards that of the merged branch above it, and so on up to the host and to the share over all hosts.
    """
    leaf = cut(tree.groupBy("host", "template", "branches").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "templates")
    # Partial sums by branch: a task sends a branch of a hot host once.
    chain = leaf.select("host", "labelled", "blocked", F.posexplode("branches").alias("level", "node"), F.col("branches").alias("b"))
    parent = F.when(F.col("level") > 0, F.get("b", F.col("level") - 1)).otherwise(F.lit(None))
    nodes = chain.select("host", "level", "node", parent.alias("parent"), "labelled", "blocked").groupBy("host", "level", "node", "parent").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    share = (F.col("blocked") + 1) / (F.col("labelled") + 2)
    order = W.partitionBy("host", "level", "parent").orderBy("share", "node")
    mean = (F.col("share") + F.lag("share").over(order)) / 2
    error = F.sqrt(mean * (1 - mean) * (1 / (F.col("labelled") + 2) + 1 / (F.lag("labelled").over(order) + 2)))
    apart = F.coalesce((F.col("share") - F.lag("share").over(order) > alike * error).cast("int"), F.lit(0))
    merged = nodes.withColumn("share", share).withColumn("apart", apart).withColumn("group", F.sum("apart").over(order))
    group = W.partitionBy("host", "level", "parent", "group")
    pooled = cut(merged.select("host", "level", "node", F.sum("labelled").over(group).alias("all"), F.sum("blocked").over(group).alias("bad")), "branches")
    total, bad = leaf.agg(F.sum("labelled"), F.sum("blocked")).first()
    overall = ((bad or 0) + 1) / ((total or 0) + 2)
    side = small_side(pooled, F.octet_length("host") + F.octet_length("node") + 16)
    path = leaf.select("host", "template", F.posexplode("branches").alias("level", "node")).join(side, ["host", "level", "node"])
    steps = path.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", "all", "bad"))).alias("steps"))
    impurity = F.aggregate("steps", F.lit(overall), lambda above, s: (s["bad"] + F.lit(strength) * above) / (s["all"] + F.lit(strength)))
    return steps.select("host", "template", impurity.alias("impurity"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template and impurity of each row of pages (page_id, url).

    Pages that a rule fits carry its verdict, and are the labels of the template tree; the others are blocked if their
    template's smoothed impurity is above `reject`. Pages are first counted by (host, path), so a host or a path with
    a third of all rows sends a row a task.

    A null url, or one without "://", has an empty host and path, which no rule with a host fits; such pages share one
    template. Hosts without any labelled page go by the share over all hosts. Repeated rows count, and each get a row.
    Siblings of equal share become one branch. Long urls are taken whole: the tree is as deep as different paths of a host go together, with
    a round a level, and what is left of a path alone is one wildcard, which no verdict hangs on. An empty table gives
    no rows. Other columns are left aside.
    """
    rules = RULES if rules is None else rules
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    paths = rows.groupBy("host", "path").agg(F.count("found.verdict").alias("labelled"), F.count_if(F.col("found.verdict") == "block").alias("blocked"))
    tree = cut(path_templates(cut(paths, "paths")), "tree")
    templates = cut(judge_templates(tree), "judged")
    judged = tree.select("host", "path", "template").join(small_side(templates, F.octet_length("host") + F.octet_length("template")), ["host", "template"])
    verdict = F.coalesce("found.verdict", F.when(F.col("impurity") > reject, F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(judged, ["host", "path"], "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "impurity")
