"""Tiles: cutting a field with halos, keeping what each tile owns, and putting tiles together."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import cut_lineage
from .graph import connected_components
from .grid import Shape


@dataclass(frozen=True)
class Tile:
    """A tile's cut (closed ranges of the field) and the part it owns (half-open: low < Cen <= high)."""

    name: str
    x: tuple[int, int]
    y: tuple[int, int]
    own_x: tuple[float, float]
    own_y: tuple[float, float]


def tiling(shape: Shape, step: int, halo: int) -> list[Tile]:
    """Tiles of step x step owned places, each cut with a halo around; together they own the field once."""
    tiles = []
    for ky, y in enumerate(range(0, shape["y"], step)):
        for kx, x in enumerate(range(0, shape["x"], step)):
            own_x = (float("-inf") if x == 0 else x + 0.5, float("inf") if x + step >= shape["x"] else x + step + 0.5)
            own_y = (float("-inf") if y == 0 else y + 0.5, float("inf") if y + step >= shape["y"] else y + step + 0.5)
            tiles.append(Tile(f"y{ky:03d}x{kx:03d}", (max(1, x + 1 - halo), min(shape["x"], x + step + halo)), (max(1, y + 1 - halo), min(shape["y"], y + step + halo)), own_x, own_y))
    return tiles


def tile_table(spark: SparkSession, tiles: list[Tile]) -> DataFrame:
    return spark.createDataFrame(
        [(t.name, *t.x, *t.y, *map(float, t.own_x), *map(float, t.own_y)) for t in tiles],
        "tile string, x_lo int, x_hi int, y_lo int, y_hi int, own_x_lo double, own_x_hi double, own_y_lo double, own_y_hi double",
    )


def split(voxels: DataFrame, shape: Shape, step: int, halo: int) -> DataFrame:
    """voxels of one field as voxels of tiles, those in halos once for each tile. Tiles follow from the coordinates, so
    nothing is joined: a place lies in the tiles of the steps that its halo reaches."""

    def reach(axis: str) -> Column:
        last = (shape[axis] - 1) // step
        low = F.greatest(F.floor((F.col(axis) - 1 - halo) / step), F.lit(0))
        high = F.least(F.floor((F.col(axis) - 1 + halo) / step), F.lit(last))
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    return voxels.withColumn("_ky", reach("y")).withColumn("_kx", reach("x")).withColumn("tile", F.format_string("y%03dx%03d", "_ky", "_kx")).drop("_kx", "_ky")


def owned(catalog: DataFrame, tiles: DataFrame) -> DataFrame:
    """The clumps whose centres their tile owns. tiles has a row a tile."""
    inside = (F.col("Cen1") > F.col("own_x_lo")) & (F.col("Cen1") <= F.col("own_x_hi")) & (F.col("Cen2") > F.col("own_y_lo")) & (F.col("Cen2") <= F.col("own_y_hi"))
    return catalog.join(tiles, "tile").where(inside).select(*catalog.columns)


def stitch(voxels: DataFrame, step: int) -> DataFrame:
    """Voxels of tiles (with field coordinates) as one field: each place from the tile that owns its step."""
    own = F.format_string("y%03dx%03d", F.floor((F.col("y") - 1) / step), F.floor((F.col("x") - 1) / step))
    return voxels.where(F.col("tile") == own).withColumn("tile", F.lit("t0"))


def merge_masks(labelled: DataFrame, kept: DataFrame) -> DataFrame:
    """Masks of tiles as one mask: the clumps in kept (tile, ID), renumbered without gaps over all tiles.

    Numbers come from the catalogue of clumps, never from voxels: a count a tile, added up, then a rank within the tile.
    """
    numbered = _numbers(kept).select("tile", F.col("ID").alias("clump_id"), "mosaic_id")
    return labelled.join(numbered, ["tile", "clump_id"]).drop("clump_id").withColumnRenamed("mosaic_id", "clump_id")


def _numbers(kept: DataFrame) -> DataFrame:
    """kept (tile, ID) with mosaic_id, without gaps over all tiles."""
    counts = kept.groupBy("tile").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("tile").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = counts.withColumn("before", before).select("tile", "before")
    return kept.join(start, "tile").select("tile", "ID", (F.col("before") + F.row_number().over(W.partitionBy("tile").orderBy("ID"))).alias("mosaic_id"))


def seam_labels(labelled: DataFrame, shared: int = 1) -> DataFrame:
    """(tile, clump_id, mosaic_id): one number for all labels that are the same clump, told by the voxels they share.

    labelled (tile, clump_id, idx) are masks of tiles with halos, idx the place in the field. Two labels of different
    tiles are one clump if at least `shared` places have both, and so on along chains of them. A place has a label a tile
    at most, so the pairs at a place are as few as the tiles that reach it. Numbers have no gaps; they follow the least
    (tile, label) of each clump, and are made of a count a tile and a rank within it.
    """
    label = F.struct("tile", "clump_id")
    names = labelled.select(label.alias("label")).distinct()
    met = labelled.select("idx", label.alias("label")).groupBy("idx").agg(F.sort_array(F.collect_set("label")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    links = met.select(F.inline(pairs)).groupBy("src", "dst").agg(F.count("*").alias("n")).where((F.col("n") >= shared) & (F.col("src.tile") != F.col("dst.tile")))
    found = connected_components(links).select(F.col("node").alias("label"), F.col("component").alias("root"))
    rooted = cut_lineage(names.join(found, "label", "left").select("label", F.coalesce("root", "label").alias("root")), "rooted")
    roots = rooted.select("root").distinct().select("root.tile", F.col("root.clump_id").alias("ID"))
    return rooted.join(_numbers(roots).select(F.struct("tile", F.col("ID").alias("clump_id")).alias("root"), "mosaic_id"), "root").select("label.tile", "label.clump_id", "mosaic_id")


def reconcile_masks(labelled: DataFrame, shared: int = 1) -> DataFrame:
    """(idx, mosaic_id) of the field: masks of tiles put together, a clump that lies across a seam being one.

    Where labels that are not one clump claim the same place (they share fewer than `shared` places), the least number
    has it.
    """
    named = labelled.select("tile", "clump_id", "idx").join(seam_labels(labelled, shared), ["tile", "clump_id"])
    return named.groupBy("idx").agg(F.min("mosaic_id").alias("mosaic_id"))


def stack(parts: list[DataFrame], column: str, step: float) -> DataFrame:
    """Parts one above the other: the k-th part's column grows by k * step."""
    moved = [p.withColumn(column, (F.col(column) + k * step).cast(dict(p.dtypes)[column])) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, moved)
