"""Cubes as tables of voxels: building, cropping, projecting.

A voxel table has one row a voxel: key columns (tile by default), 1-based integer axes x, y and, in three dimensions, v,
and an intensity. `shape` maps each axis to its length. Tables may be sparse; dense_grid fills them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wcs import Wcs, sky, velocity

Shape = dict[str, int]


def voxelize(df: DataFrame, axes: dict[str, Column], measure: Column, tile: Column | None = None) -> DataFrame:
    """Rows grouped to voxels: tile, the axes as int, and intensity = measure, an aggregate."""
    keys = [(F.lit("t0") if tile is None else tile).alias("tile"), *(c.cast("int").alias(a) for a, c in axes.items())]
    return df.groupBy(*keys).agg(measure.alias("intensity"))


def voxel_index(shape: Shape) -> Column:
    """0-based position in C order: x fastest, then y, then v."""
    index, step = F.lit(0).cast("long"), 1
    for axis, n in shape.items():
        index, step = index + (F.col(axis) - 1) * F.lit(step).cast("long"), step * n
    return index


def by_block(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """work on whole blocks, the rows of equal keys: df is dealt and sorted by keys, and work gets a table of some of the
    blocks in a row, with the number of each row's block, from 0. A task holds one batch, or one block if that is larger."""

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), dtype=bool)
        for k in keys:
            column = table.column(k).combine_chunks()
            a, b = column.slice(1), column.slice(0, len(table) - 1)
            differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
            new[1:] |= differ.to_numpy(zero_copy_only=False)
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([*rest, pa.Table.from_batches([batch])])
            new = starts(table)
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0
            rest = [table.slice(last)]
            if last:
                yield from work(table.slice(0, last).combine_chunks(), np.cumsum(new[:last])).to_batches()
        for table in rest:
            yield from work(table.combine_chunks(), np.zeros(len(table), dtype=np.int64)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def dense_grid(voxels: DataFrame, shape: Shape, tiles: DataFrame | None = None) -> DataFrame:
    """All voxels of each tile, missing, null and NaN intensities being 0, with their index. Voxels outside are dropped.

    What is shuffled is a row for each line of the first axis, and the voxels there are; both are dealt by line, and a
    line is filled where it arrives. So one tile of any size is spread over all tasks. tiles (tile) are the distinct tiles
    of voxels, where there is a shorter way to them than through the voxels.
    """
    first, *others = shape
    inside = reduce(lambda a, b: a & b, (F.col(axis).between(1, n) for axis, n in shape.items()))
    lines = reduce(lambda a, b: a * b, (shape[axis] for axis in others), 1)
    step, place = 1, []
    for axis in others:
        place.append((F.floor(F.col("line") / step) % shape[axis] + 1).cast("int").alias(axis))
        step *= shape[axis]
    tiles = voxels.select("tile").distinct() if tiles is None else tiles
    empty = tiles.select("tile", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line")).select("tile", *place)
    dealt = empty.unionByName(voxels.where(inside).select("tile", *shape, "intensity"), allowMissingColumns=True).repartition("tile", *others)
    cells = F.when(F.col(first).isNull(), F.sequence(F.lit(1), F.lit(shape[first]))).otherwise(F.array(F.col(first).cast("int")))
    filled = dealt.withColumn(first, F.explode(cells)).groupBy("tile", *shape).agg(F.max("intensity").alias("intensity"))
    value = F.coalesce(F.col("intensity"), F.lit(0))
    if dict(voxels.dtypes)["intensity"] in ("double", "float"):
        value = F.nanvl(value, F.lit(0.0))
    return filled.select("tile", *shape, voxel_index(shape).alias("idx"), value.alias("intensity"))


def nan_to_zero(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("intensity", F.coalesce(F.nanvl(F.col("intensity").cast("double"), F.lit(0.0)), F.lit(0.0)))


def subcube(voxels: DataFrame, shape: Shape, **ranges: tuple[int, int]) -> DataFrame:
    """The voxels within closed ranges of the axes; bounds outside the cube are moved to its edge."""
    keep = F.lit(True)
    for axis, (low, high) in ranges.items():
        keep &= F.col(axis).between(max(1, low), min(shape[axis], high))
    return voxels.where(keep)


def world_places(voxels: DataFrame, w: Wcs) -> DataFrame:
    """voxels with lon, lat (degrees) and, of a cube, vel (km/s) of their places."""
    lon, lat = sky(F.col("x"), F.col("y"), w)
    return voxels.withColumns({"lon": lon, "lat": lat, **({"vel": velocity(F.col("v"), w)} if "v" in voxels.columns else {})})


def world_subcube(voxels: DataFrame, w: Wcs, **ranges: tuple[float, float]) -> DataFrame:
    """The voxels whose places lie within closed ranges of lon, lat and vel. A bound beyond the cube is the cube's end."""
    placed = world_places(voxels, w)
    keep = reduce(lambda a, b: a & b, (F.col(name).between(low, high) for name, (low, high) in ranges.items()), F.lit(True))
    return placed.where(keep).select(*voxels.columns)


def world_ranges(voxels: DataFrame, w: Wcs, **ranges: tuple[float, float]) -> DataFrame:
    """One row a range: axis, low and high held within the cube's extremes, and whether either bound was moved."""
    placed = world_places(voxels, w)
    ends = placed.agg(*(f(n).alias(f"{n}_{f.__name__}") for n in ranges for f in (F.min, F.max)))
    rows = F.array(
        *(
            F.struct(
                F.lit(n).alias("axis"), F.greatest(F.lit(float(low)), F.col(f"{n}_min")).alias("low"), F.least(F.lit(float(high)), F.col(f"{n}_max")).alias("high"),
                ((F.col(f"{n}_min") > low) | (F.col(f"{n}_max") < high)).alias("moved"),
            )
            for n, (low, high) in ranges.items()
        )
    )
    return ends.select(F.inline(rows))


def projections(voxels: DataFrame, axes: tuple[str, ...] = ("x", "y", "v")) -> DataFrame:
    """Integrated maps onto all coordinate planes in one pass: plane, the axes (null where summed over), total."""
    planes = [(a, b) for k, a in enumerate(axes) for b in axes[k + 1 :]]
    sets = ", ".join(f"(tile, {a}, {b})" for a, b in planes)
    name = "CASE " + " ".join(f"WHEN {' AND '.join(f'grouping({c}) = {int(c not in p)}' for c in axes)} THEN '{p[0]}{p[1]}'" for p in planes) + " END"
    return voxels.sparkSession.sql(f"SELECT tile, {name} AS plane, {', '.join(axes)}, sum(intensity) AS total FROM {{voxels}} GROUP BY GROUPING SETS ({sets})", voxels=voxels)


def average_spectrum(voxels: DataFrame) -> DataFrame:
    """Per channel the mean over x of the means over y; NaN and null do not count."""
    value = F.when(~F.isnan(F.col("intensity").cast("double")), F.col("intensity"))
    return voxels.groupBy("tile", "v", "x").agg(F.avg(value).alias("m")).groupBy("tile", "v").agg(F.avg("m").alias("mean"))


def position_velocity(voxels: DataFrame, axis: str) -> DataFrame:
    """The mean over the other spatial axis for each channel and place along `axis` (x: l-v, y: b-v)."""
    value = F.when(~F.isnan(F.col("intensity").cast("double")), F.col("intensity"))
    return voxels.groupBy("tile", "v", axis).agg(F.avg(value).alias("mean"))


def bounding_boxes(labelled: DataFrame, shape: Shape, margin: int = 1) -> DataFrame:
    """Per clump the smallest box around it, widened by margin and held inside the cube: <axis>_lo and <axis>_hi."""
    return labelled.groupBy("tile", "clump_id").agg(
        *(F.greatest(F.min(a) - margin, F.lit(1)).alias(f"{a}_lo") for a in shape), *(F.least(F.max(a) + margin, F.lit(n)).alias(f"{a}_hi") for a, n in shape.items())
    )


def crop_boxes(voxels: DataFrame, boxes: DataFrame, shape: Shape) -> DataFrame:
    """The voxels in each clump's box, with its clump_id. The box side holds a row a clump and expands to (x, y) columns,
    so that the join is an equi-join on the column, with the channel range checked after it."""
    columns = boxes.withColumn("x", F.explode(F.sequence("x_lo", "x_hi"))).withColumn("y", F.explode(F.sequence("y_lo", "y_hi")))
    inside = F.col("v").between(F.col("v_lo"), F.col("v_hi")) if "v" in shape else F.lit(True)
    return voxels.join(columns, ["tile", "x", "y"]).where(inside).select("tile", "clump_id", *shape, "intensity")


def clump_spectra(voxels: DataFrame, labelled: DataFrame, shape: Shape) -> DataFrame:
    """Per clump and channel of its box the mean over the box, voxels outside the clump counting as zero."""
    inside = crop_boxes(voxels, bounding_boxes(labelled, shape), shape)
    mine = labelled.select("tile", "clump_id", *shape, F.lit(True).alias("mine"))
    return inside.join(mine, ["tile", "clump_id", *shape], "left").groupBy("tile", "clump_id", "v").agg(F.avg(F.when(F.col("mine"), F.col("intensity")).otherwise(0)).alias("mean"))


def peak_spectra(voxels: DataFrame, catalog: DataFrame, shape: Shape, v_len: int = 30) -> DataFrame:
    """Per clump (tile, ID, Peak1..3) the spectrum at its peak's place: clump_id, v and peak, missing voxels being 0.

    Channels reach v_len below and above the peak, without the last, and end before the cube's last one.
    """
    low, high = F.greatest(F.col("Peak3").cast("int") - v_len, F.lit(0)) + 1, F.least(F.col("Peak3").cast("int") + v_len, F.lit(shape["v"] - 1))
    wanted = catalog.where(low <= high).select("tile", F.col("ID").alias("clump_id"), F.col("Peak1").cast("int").alias("x"), F.col("Peak2").cast("int").alias("y"), F.explode(F.sequence(low, high)).alias("v"))
    return wanted.join(voxels.select("tile", *shape, "intensity"), ["tile", *shape], "left").select("tile", "clump_id", "v", F.coalesce("intensity", F.lit(0)).alias("peak"))


def sized_boxes(catalog: DataFrame, shape: Shape, times: float = 1.5) -> DataFrame:
    """Per clump the box of `times` sizes around its centre: Size1 along x, the mean of Size1 and Size2 along y and v."""
    mean = (F.col("Size1") + F.col("Size2")) / 2
    ends = {}
    for k, (axis, n) in enumerate(shape.items(), 1):
        reach = times * (F.col("Size1") if axis == "x" else mean)
        ends |= {f"{axis}_lo": F.greatest((F.col(f"Cen{k}") - 1 - reach).cast("int"), F.lit(0)) + 1, f"{axis}_hi": F.least((F.col(f"Cen{k}") + reach).cast("int"), F.lit(n))}
    return catalog.select("tile", F.col("ID").alias("clump_id"), *(e.alias(name) for name, e in ends.items()))


def world_axes(catalog: DataFrame, boxes: DataFrame, w: Wcs, per_degree: float = 120.0) -> DataFrame:
    """Per clump the world coordinates at which its box begins and ends, by steps of a pixel from its centre."""
    lon, lat = sky(F.col("Cen1"), F.col("Cen2"), w)
    steps = {"x": ("lon", lon, "Cen1", 1 / per_degree), "y": ("lat", lat, "Cen2", 1 / per_degree)}
    if "v_lo" in boxes.columns:
        steps["v"] = ("vel", velocity(F.col("Cen3"), w), "Cen3", w.resolution[2])
    joined = catalog.withColumnRenamed("ID", "clump_id").join(boxes, ["tile", "clump_id"])
    ends = [e for axis, (name, at, cen, step) in steps.items() for e in ((at - (F.col(cen) - F.col(f"{axis}_lo") + 1) * step).alias(f"{name}_lo"), (at + (F.col(f"{axis}_hi") - F.col(cen)) * step).alias(f"{name}_hi"))]
    return joined.select("tile", "clump_id", *ends)


def clump_points(voxels: DataFrame, labelled: DataFrame, shape: Shape) -> DataFrame:
    """One row a voxel of a clump: what a fit takes."""
    return voxels.join(labelled.select("tile", "clump_id", *shape), ["tile", *shape]).select("tile", "clump_id", *shape, "intensity")


def local_cube(points: DataFrame, shape: Shape) -> DataFrame:
    """Points of clumps moved so that each clump's least coordinate is 0."""
    least = points.groupBy("tile", "clump_id").agg(*(F.min(a).alias(f"{a}_lo") for a in shape))
    return points.join(least, ["tile", "clump_id"]).select("tile", "clump_id", *((F.col(a) - F.col(f"{a}_lo")).alias(a) for a in shape), "intensity")
