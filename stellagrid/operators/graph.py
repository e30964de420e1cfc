"""Connected components and forest roots over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut_lineage, drop

#: Edges, or nodes, that a task of an iteration handles at least: small graphs run in few tasks.
ROWS_A_TASK = 50_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Alternates two steps until nothing changes: each node's larger neighbours are hung on its smallest neighbour, then
    each node and its smaller neighbours are. Every step is a minimum by node, pre-aggregated before the shuffle, and a
    join on that node, whose hot keys adaptive execution can split; the number of rounds grows as the logarithm of the
    longest path. Self-loops count as nodes. Null ends are dropped.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = pairs.where(F.col("a") == F.col("b")).select(F.col("a").alias("node")).distinct()
    e = cut_lineage(pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _mark(e)
    for _ in range(rounds):
        tasks, before = 1 + seen[0] // ROWS_A_TASK, e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        low = e.join(least, "u").coalesce(tasks)
        e = low.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut_lineage(e.distinct().coalesce(tasks), "edges")
        drop(before)
        if (now := _mark(e)) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = stars.unionByName(roots)
    return found.unionByName(loops.join(found, "node", "left_anti").withColumn("component", F.col("node")))


def forest_roots(parents: DataFrame, node: str = "node", parent: str = "parent", rounds: int = 60) -> DataFrame:
    """(node, root) by pointer jumping: each round replaces every parent by the parent's parent.

    parents has one row a node; a null parent, or the node itself, marks a root. Chains of length n take log2(n) rounds,
    each an equi-join on the parent. A parent without a row of its own counts as a root.
    """
    table = up = cut_lineage(parents.select(F.col(node).alias("node"), F.coalesce(F.col(parent), F.col(node)).alias("root")), "parents")
    tasks = 1 + up.count() // ROWS_A_TASK
    for _ in range(rounds):
        jump = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut_lineage(up.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")).coalesce(tasks), "parents")
        done = new.where("moved").isEmpty()
        drop(table)
        table, up = new, new.select("node", "root")
        if done:
            return up
    raise RuntimeError(f"no fixed point after {rounds} rounds: the parents have a cycle")
