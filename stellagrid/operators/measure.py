"""Catalogues: measuring clumps, and filters and formats of catalogue rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import FWHM
from .grid import Shape
from .rank import median


#: States of clumps that a task keeps before it sends them on.
STATES = 20_000


def regions(labelled: DataFrame, shape: Shape, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row a clump: ID, Peak1.., Cen1.., Size1.., Peak, Sum, Volume, and what `extra` names. One aggregation with partial
    sums.

    extra has aggregates of further measures by name, over the columns of labelled (intensity, the axes and others);
    they are worked out in the same pass. For measures that no aggregate of Spark gives, see merged_regions().

    Moments are taken about a fixed place near each clump's own coordinates only through raw sums of small integers,
    so they cancel little. Of equal peaks the one with the least idx counts. A clump whose intensities sum to 0 has no
    centre: its Cen and Size are null.
    """
    i, axes = F.col("intensity"), list(shape)
    top = F.max(F.struct(i, (-F.col("idx")).alias("o"), *axes))
    sums = labelled.groupBy("tile", F.col("clump_id").alias("ID")).agg(
        F.count("*").alias("Volume"),
        F.sum(i).alias("Sum"),
        F.max(i).alias("Peak"),
        top.alias("top"),
        *(F.sum(i * F.col(a)).alias(f"s_{a}") for a in axes),
        *(F.sum(i * F.col(a) * F.col(a)).alias(f"q_{a}") for a in axes),
        *(c.alias(n) for n, c in (extra or {}).items()),
    )
    cen = {a: F.try_divide(F.col(f"s_{a}"), F.col("Sum")) for a in axes}
    spread = {a: F.try_divide(F.col(f"q_{a}"), F.col("Sum")) - cen[a] * cen[a] for a in axes}
    size = {a: F.when(spread[a].isNotNull(), FWHM * F.sqrt(F.greatest(spread[a], F.lit(0.0)))) for a in axes}
    return sums.select(
        "tile",
        "ID",
        *(F.col(f"top.{a}").alias(f"Peak{k}") for k, a in enumerate(axes, 1)),
        *(cen[a].alias(f"Cen{k}") for k, a in enumerate(axes, 1)),
        *(size[a].alias(f"Size{k}") for k, a in enumerate(axes, 1)),
        "Peak",
        "Sum",
        "Volume",
        *(extra or {}),
    )


def merged_regions(labelled: DataFrame, start: Callable[[pd.DataFrame], dict], merge: Callable[[dict, dict], dict], finish: Callable[[dict], dict], state: str, result: str) -> DataFrame:
    """(tile, ID) and the columns `result` of each clump: a measure in Python that is made of mergeable states.

    start() makes a state of some voxels of a clump, merge() one of two, finish() the result; a state's entries are the
    columns `state`. A task keeps a state a clump and sends it on when it has many or ends, so what meets of a clump is
    as many states as tasks and fillings, never its voxels. Order and grouping of merges are not defined.
    """
    names = [c.strip().split(" ")[0] for c in state.split(",")]
    tile, clump = (dict(labelled.dtypes)[c] for c in ("tile", "clump_id"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, dict] = {}

        def out() -> pd.DataFrame:
            made = pd.DataFrame([{"tile": t, "clump_id": c} | s for (t, c), s in held.items()], columns=["tile", "clump_id", *names])
            held.clear()
            return made

        for batch in batches:
            for who, voxels in batch.groupby(["tile", "clump_id"], sort=False):
                new = start(voxels)
                held[who] = merge(held[who], new) if who in held else new
            if len(held) > STATES:
                yield out()
        yield out()

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        states = group[names].to_dict("records")
        return pd.DataFrame([{"tile": group["tile"].iloc[0], "ID": group["clump_id"].iloc[0]} | finish(reduce(merge, states))])

    states = labelled.where(F.col("clump_id").isNotNull()).mapInPandas(partial, f"tile {tile}, clump_id {clump}, {state}")
    return states.groupBy("tile", "clump_id").applyInPandas(whole, f"tile {tile}, ID {clump}, {result}")


def orientation(labelled: DataFrame) -> DataFrame:
    """Per clump the angle, in degrees, of its footprint on the sky, each (x, y) counting once."""
    foot = labelled.select("tile", "clump_id", "x", "y").distinct()
    angle = F.degrees(0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("y") - F.var_pop("x")))
    return foot.groupBy("tile", "clump_id").agg(angle.alias("Angle"))


def touches_edge(shape: Shape) -> Column:
    """Peak at the first or last place of an axis, or the centre within two sigma of an end."""
    bad = F.lit(False)
    for k, n in enumerate(shape.values(), 1):
        reach = 2 * F.col(f"Size{k}") / FWHM
        bad |= F.col(f"Peak{k}").isin(1, n) | (F.col(f"Cen{k}") + reach > n) | (F.col(f"Cen{k}") - reach < 1)
    return bad


def in_core(shape: Shape, edges: tuple[tuple[float, float], ...]) -> Column:
    """The half-open local region: edge0 < Cen <= size - edge1 - 1 on each axis."""
    keep = F.lit(True)
    for k, (n, (low, high)) in enumerate(zip(shape.values(), edges, strict=False), 1):
        keep &= (F.col(f"Cen{k}") > low) & (F.col(f"Cen{k}") <= n - high - 1)
    return keep


#: Decimals of catalogue columns.
PIXEL_DECIMALS = {"Peak1": 0, "Peak2": 0, "Peak3": 0, "Cen1": 3, "Cen2": 3, "Cen3": 3, "Size1": 3, "Size2": 3, "Size3": 3, "Peak": 3, "Sum": 3, "Volume": 3, "Angle": 1}
FIT_WORLD_DECIMALS = {"Galactic_Longitude": 3, "Galactic_Latitude": 3, "Velocity": 2, "Size_major": 0, "Size_minor": 0, "Size_velocity": 2, "Theta": 0, "Peak": 1, "Flux": 1, "Flux_SNR": 1, "Peak_SNR": 1}


def rounded(catalog: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Half-even rounding of the columns named."""
    return catalog.withColumns({c: F.bround(c, d) for c, d in decimals.items() if c in catalog.columns})


def detect_counts(catalog: DataFrame, shape: Shape, edges: tuple[tuple[float, float], ...], tiles: DataFrame | None = None) -> DataFrame:
    """Clumps found, clear of the edge, and of those in the core. tiles (tile): the tiles that were searched, each of which
    has a row; without them a tile in which nothing is found has none."""
    clear = ~touches_edge(shape)
    counts = catalog.groupBy("tile").agg(F.count("*").alias("found"), F.count_if(clear).alias("clear"), F.count_if(clear & in_core(shape, edges)).alias("core"))
    return counts if tiles is None else tiles.select("tile").distinct().join(counts, "tile", "left").fillna(0, ["found", "clear", "core"])


def background_rms(spark_or_voxels, header: dict | None = None, key: str = "RMS", noise_map: DataFrame | None = None, given: float | None = None) -> float | None:
    """The noise: the header's value, else the median of the noise map (NaN and null as 0), else the given one."""
    if header and key in header:
        return float(header[key])
    if noise_map is not None:
        return median(noise_map, "intensity")
    return given


def off_mask_rms(voxels: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per tile the root mean square of the voxels outside all clumps."""
    return voxels.join(labelled.select("tile", "idx").distinct(), ["tile", "idx"], "left_anti").groupBy("tile").agg(F.sqrt(F.avg(F.col("intensity") * F.col("intensity"))).alias("rms"))
