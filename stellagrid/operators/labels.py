"""Labels: handed down the parent forest, cut at boundaries, and reduced to connected parts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import cut_lineage
from .graph import connected_components, forest_roots
from .grid import Shape, by_block, voxel_index


#: Edge of the blocks in which chains of parents are followed in a task.
BLOCK = 32


def _ends(table: pa.Table, number: np.ndarray) -> pa.Table:
    """Rows with the place `goal` where their chain ends or, if `leaves`, first comes to another block."""
    idx, up = table.column("idx").to_numpy(), table.column("up").to_numpy()
    names, code = np.unique(np.concatenate((idx, up)), return_inverse=True)
    mine, theirs = (number * len(names) + c for c in (code[: len(idx)], code[len(idx) :]))
    order = np.argsort(mine)
    at = np.minimum(np.searchsorted(mine[order], theirs), len(idx) - 1)
    there = order[at]
    outside = mine[there] != theirs
    to = np.where(outside, np.arange(len(idx)), there)
    while (to[to] != to).any():
        to = to[to]
    kept = table.drop_columns([c for c in table.column_names if c == "up" or c.startswith("b_")])
    return kept.append_column("goal", pa.array(up[to])).append_column("leaves", pa.array(outside[to]))


def propagate(linked: DataFrame, centre: DataFrame) -> DataFrame:
    """linked with clump_id: each voxel has the label of the centre its chain of parents meets first, or null.

    Centres become roots. Voxels are dealt to blocks of BLOCK places an axis (by idx, if linked has no axes), and a task
    follows their chains to the end or out of the block. Places at which chains come into a block are few; those alone go
    through pointer jumping, in log2(most blocks of a chain) joins.
    """
    axes = [a for a in ("x", "y", "v") if a in linked.columns]
    place = {f"b_{a}": F.floor((F.col(a) - 1) / BLOCK) for a in axes} or {"b_idx": F.floor(F.col("idx") / BLOCK**2)}
    marked = linked.join(centre.select("tile", "idx", "clump_id"), ["tile", "idx"], "left")
    up = F.when(F.col("clump_id").isNull() & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("idx"))
    kinds = dict(linked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in linked.columns) + f", goal {kinds['idx']}, leaves boolean"
    followed = by_block(marked.select(*linked.columns, *(c.alias(n) for n, c in place.items()), up.alias("up")), ["tile", *place], _ends, schema)
    ways = cut_lineage(followed, "ways")
    entries = ways.where("leaves").select("tile", F.col("goal").alias("idx")).distinct()
    steps = ways.join(entries, ["tile", "idx"]).select(F.struct("tile", "idx").alias("node"), F.struct("tile", F.col("goal").alias("idx")).alias("parent"))
    roots = forest_roots(steps).select("node.tile", F.col("node.idx").alias("goal"), F.col("root.idx").alias("root"))
    named = centre.select("tile", F.col("idx").alias("root"), "clump_id")
    named = roots.join(named, ["tile", "root"]).drop("root").unionByName(named.withColumnRenamed("root", "goal")).distinct()
    return ways.join(named, ["tile", "goal"], "left").select(*linked.columns, "clump_id")


def cut_boundaries(labelled: DataFrame, gradmin: float = 0.01) -> DataFrame:
    """The voxels of each cluster with a steep way up, or denser than the mean of those; clusters without any go.

    grad is -1 where there is no denser neighbour. Labels are renumbered without gaps: a cluster stays if any voxel is
    steep. Spans and means are aggregates of one row a cluster, joined back to the voxels: no task sorts a cluster.
    """
    named = labelled.where(F.col("clump_id").isNotNull())
    span = named.groupBy("tile", "clump_id").agg((F.max("rho") - F.min("rho")).alias("span"))
    steep = F.coalesce("grad", F.lit(-1.0)) / F.when(F.col("span") == 0, 1).otherwise(F.col("span")) > gradmin
    means = named.join(span, ["tile", "clump_id"]).where(steep).groupBy("tile", "clump_id").agg(F.avg("rho").alias("mean"), F.max("span").alias("span"))
    means = cut_lineage(means.withColumn("new_id", F.row_number().over(W.partitionBy("tile").orderBy("clump_id"))), "means")
    kept = named.join(means, ["tile", "clump_id"]).where(steep | (F.col("rho") > F.col("mean")))
    return kept.drop("clump_id", "mean", "span").withColumnRenamed("new_id", "clump_id")


def renumber(labelled: DataFrame) -> DataFrame:
    """clump_id without gaps from 1, in the same order. Ranks are made of the distinct labels, not of the voxels."""
    new = labelled.select("tile", "clump_id").distinct().withColumn("new_id", F.row_number().over(W.partitionBy("tile").orderBy("clump_id")))
    return labelled.join(new, ["tile", "clump_id"]).drop("clump_id").withColumnRenamed("new_id", "clump_id")


#: Lines a block has along each axis but x.
LINES = 16


def runs(labelled: DataFrame, shape: Shape) -> DataFrame:
    """labelled with `run`: the least idx of the voxels of its clump that stand next to one another along x with it."""
    _, *others = shape
    line = W.partitionBy("tile", "clump_id", *others)
    island = F.col("x") - F.row_number().over(line.orderBy("x"))
    return labelled.withColumn("_island", island).withColumn("run", F.min("idx").over(W.partitionBy("tile", "clump_id", *others, "_island"))).drop("_island")


def _united(axes: list[str]):
    """The runs of a block, each with the least idx of the runs of the block that it is connected with."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        places = rows[axes].to_numpy(dtype=np.int64)
        lo, hi, clump = (rows[c].to_numpy(dtype=np.int64) for c in ("lo", "hi", "clump_id"))
        order = np.lexsort((lo, *places.T[::-1], clump))
        places, lo, hi, clump, idx = places[order], lo[order], hi[order], clump[order], rows["run"].to_numpy(dtype=np.int64)[order]
        lines, which = np.unique(np.column_stack((clump, places)), axis=0, return_inverse=True)
        which = which.ravel()
        starts = np.searchsorted(which, np.arange(len(lines) + 1))
        number = {tuple(line): k for k, line in enumerate(lines.tolist())}
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for step in [(1,)] if len(axes) == 1 else [(1, 0), (-1, 1), (0, 1), (1, 1)]:
            for k, line in enumerate(lines.tolist()):
                other = number.get((line[0], *(p + d for p, d in zip(line[1:], step, strict=True))))
                if other is None:
                    continue
                a, b = np.arange(starts[k], starts[k + 1]), slice(starts[other], starts[other + 1])
                first, last = np.searchsorted(hi[b], lo[a] - 1, side="left"), np.searchsorted(lo[b], hi[a] + 1, side="right")
                n = np.maximum(last - first, 0)
                left = np.repeat(a, n)
                ends.append((left, np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()) + starts[other]))
        root = np.arange(len(rows))
        if ends:
            a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
            while len(a):  # hang the greater root on the smaller one, and shorten the ways
                low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root = root[root]
                apart = root[a] != root[b]
                a, b = a[apart], b[apart]
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, root, idx)
        out = rows.iloc[order].copy()
        out["part"] = least[root]
        return out

    return run


def _touching(united: DataFrame, axes: list[str]) -> DataFrame:
    """(src, dst) of parts of neighbouring blocks with runs that touch. Only runs of lines at the edge of a block are looked at."""
    edge = reduce(lambda p, q: p | q, (((F.col(a) - 1) % LINES).isin(0, LINES - 1) for a in axes))
    node = F.struct("tile", F.col("part").alias("idx"))
    rim = cut_lineage(united.where(edge).select("tile", "clump_id", *axes, "lo", "hi", node.alias("node"), *(F.floor((F.col(a) - 1) / LINES).alias(f"b_{a}") for a in axes)), "rim")
    steps = [(1,)] if len(axes) == 1 else [(1, 0), (-1, 1), (0, 1), (1, 1)]
    other = F.explode(F.array(*(F.struct(*((F.col(a) + d).alias(a) for a, d in zip(axes, step, strict=True))) for step in steps)))
    looks = rim.withColumn("o", other).select("tile", "clump_id", *(F.col(f"o.{a}").alias(a) for a in axes), F.col("lo").alias("l"), F.col("hi").alias("h"), F.col("node").alias("src"), *(F.col(f"b_{a}").alias(f"c_{a}") for a in axes))
    crosses = reduce(lambda p, q: p | q, (F.col(f"b_{a}") != F.col(f"c_{a}") for a in axes))
    met = looks.join(rim, ["tile", "clump_id", *axes]).where(crosses & (F.col("l") <= F.col("hi") + 1) & (F.col("lo") <= F.col("h") + 1))
    return met.select("src", F.col("node").alias("dst")).distinct()


def parts(labelled: DataFrame, shape: Shape) -> DataFrame:
    """labelled with `part`: the least idx of the voxel's connected part of its clump, all neighbours touching. A voxel of
    no clump is a part of its own.

    Voxels next to one another along x are one run. Runs are dealt to blocks of LINES lines an axis and united there, in
    a task; parts of different blocks meet where runs at their edges touch, and those links alone go through the rounds
    of connected components.
    """
    _, *others = shape
    named = labelled.where(F.col("clump_id").isNotNull()).select("tile", *shape, "idx", "clump_id")
    marked = cut_lineage(runs(named, shape), "runs")
    lines = marked.groupBy("tile", "clump_id", *others, "run").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    blocks = [F.floor((F.col(a) - 1) / LINES).alias(f"_{a}") for a in others]
    kinds = dict(lines.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in lines.columns) + ", part long"
    united = cut_lineage(lines.groupBy("tile", *blocks).applyInPandas(_united(others), schema), "united")
    found = connected_components(_touching(united, others)).select("node.tile", F.col("node.idx").alias("part"), F.col("component.idx").alias("whole"))
    named = united.select("tile", "clump_id", "run", "part").join(found, ["tile", "part"], "left").select("tile", "clump_id", "run", F.coalesce("whole", "part").alias("part"))
    places = marked.select("tile", "clump_id", "idx", "run").join(named, ["tile", "clump_id", "run"]).select("tile", "idx", "part")
    return labelled.join(places, ["tile", "idx"], "left").withColumn("part", F.coalesce("part", "idx"))


def largest_part(labelled: DataFrame, shape: Shape) -> DataFrame:
    """The voxels of each clump's largest connected part; of equal ones, that with the least idx."""
    parted = parts(labelled, shape)
    sizes = parted.groupBy("tile", "clump_id", "part").agg(F.count("*").alias("n"))
    best = sizes.groupBy("tile", "clump_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "part"))["part"].alias("part"))
    return parted.join(best, ["tile", "clump_id", "part"], "left_semi")


def fill_holes(labelled: DataFrame, shape: Shape) -> DataFrame:
    """labelled (tile, clump_id, axes, idx) with the holes of each clump: voxels of its box that no path of faces, off
    the clump, leads from to outside the box.

    The box, one voxel wider, is the clump's own small grid; its empty voxels join along faces, and parts that do not
    reach the rim are holes.
    """
    axes = list(shape)
    clump = labelled.select("tile", "clump_id", *axes)
    box = clump.groupBy("tile", "clump_id").agg(*(F.min(a).alias(f"{a}_lo") for a in axes), *(F.max(a).alias(f"{a}_hi") for a in axes))
    cells = box
    for a in axes:
        cells = cells.withColumn(a, F.explode(F.sequence(F.col(f"{a}_lo") - 1, F.col(f"{a}_hi") + 1)))
    rim = F.lit(False)
    for a in axes:
        rim |= (F.col(a) < F.col(f"{a}_lo")) | (F.col(a) > F.col(f"{a}_hi"))
    free = cut_lineage(cells.withColumn("rim", rim).select("tile", "clump_id", *axes, "rim").join(clump, ["tile", "clump_id", *axes], "left_anti"), "free")
    node = F.struct("tile", "clump_id", *axes)
    edges = None
    for a in axes:
        step = free.select(node.alias("src"), "tile", "clump_id", *((F.col(b) + 1).alias(b) if b == a else F.col(b) for b in axes))
        side = step.join(free, ["tile", "clump_id", *axes], "left_semi").select("src", node.alias("dst"))
        edges = side if edges is None else edges.unionByName(side)
    part = connected_components(edges)
    free = free.select(node.alias("node"), "rim").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    outside = free.where("rim").select("component").distinct()
    holes = free.join(outside, "component", "left_anti").select("node.*")
    return labelled.select("tile", "clump_id", *axes, "idx").unionByName(holes.select("tile", "clump_id", *axes, voxel_index(shape).alias("idx")))


def area_and_span(part: DataFrame, shape: Shape) -> DataFrame:
    """Per clump the number of distinct (x, y) and the number of channels its box has (1 in two dimensions)."""
    span = (F.max("v") - F.min("v") + 1) if "v" in shape else F.lit(1)
    return part.groupBy("tile", "clump_id").agg(F.countDistinct("x", "y").alias("area"), span.cast("long").alias("span"))


def large_enough(labelled: DataFrame, shape: Shape, min_area: int = 25, min_span: int = 5) -> DataFrame:
    sizes = area_and_span(largest_part(labelled, shape), shape)
    enough = F.col("area") >= min_area
    if "v" in shape:
        enough &= F.col("span") >= min_span
    return labelled.join(sizes.where(enough), ["tile", "clump_id"], "left_semi")
