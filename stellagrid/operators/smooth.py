"""Smoothing of dense cubes, axis by axis with window functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import Shape

#: The scales that adaptive density chooses among.
SCALES = tuple(round(0.3 + 0.05 * k, 2) for k in range(10))


def gaussian_kernel(sigma: float) -> list[float]:
    """Normalised weights at -r..r with r = int(4 sigma + 0.5)."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def box_kernel(size: int, sigma: float) -> list[float]:
    """Normalised Gaussian weights on `size` places."""
    w = [math.exp(-0.5 * ((k - size // 2) / sigma) ** 2) for k in range(size)]
    return [x / sum(w) for x in w]


def _along(axis: str, axes: list[str]) -> W:
    return W.partitionBy("tile", *(a for a in axes if a != axis)).orderBy(axis)


def _weighted(column: str, kernel: list, line, edge: str) -> Column:
    """The sum of kernel times column along a line; beyond its ends the nearest value ("clamp") or zero."""
    r, total = len(kernel) // 2, None
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    for k, w in enumerate(kernel, -r):
        if k == 0:
            term = F.col(column)
        else:
            there = F.lag(column, -k).over(line) if k < 0 else F.lead(column, k).over(line)
            beyond = F.lit(0) if edge == "zero" else (F.first(column) if k < 0 else F.last(column)).over(whole)
            term = F.coalesce(there, beyond)
        total = F.lit(w) * term if total is None else total + F.lit(w) * term
    return total


def smooth(grid: DataFrame, shape: Shape, kernels: dict[str, list], out: str = "rho", edge: str = "clamp") -> DataFrame:
    """grid, dense, with its intensity convolved by the kernels of each axis.

    One pass an axis: (2r + 1) terms rather than (2r + 1)^n. A pass sorts the lines of its axis, which are short and
    many, so it partitions evenly whatever the cube's content; nothing is exploded or joined.
    """
    grid = grid.withColumn(out, F.col("intensity"))
    for axis, kernel in kernels.items():
        grid = grid.withColumn(out, _weighted(out, kernel, _along(axis, list(shape)), edge))
    return grid


def binomial(grid: DataFrame, shape: Shape) -> DataFrame:
    """1-2-1 along each axis without division, so integer intensities give integer sums."""
    return smooth(grid, shape, {a: [1, 2, 1] for a in shape})


def adaptive_density(grid: DataFrame, shape: Shape, scales: tuple[float, ...] = SCALES) -> DataFrame:
    """Per voxel the smoothed value, over all scales, that is closest to their mean; the smallest scale on ties.

    The scales share each pass's sort.
    """
    names = [f"_g{k}" for k in range(len(scales))]
    grid = grid.withColumns({n: F.col("intensity").cast("double") for n in names})
    for axis in shape:
        line = _along(axis, list(shape))
        grid = grid.withColumns({n: _weighted(n, gaussian_kernel(s), line, "clamp") for n, s in zip(names, scales, strict=True)})
    grid = grid.withColumn("_all", F.array(*names)).withColumn("_mean", F.aggregate("_all", F.lit(0.0), lambda a, b: a + b) / len(scales))
    nearest = F.array_min(F.transform("_all", lambda g, k: F.struct(F.abs(g - F.col("_mean")).alias("off"), k.alias("k"), g.alias("g"))))
    return grid.withColumn("rho", nearest["g"].cast("float").cast("double")).drop(*names, "_all", "_mean")


def detail(grid: DataFrame, shape: Shape, size: int = 5, sigma: float = 1.0) -> DataFrame:
    """grid with `detail`: what a blur with zeros beyond the edge takes away."""
    blurred = smooth(grid, shape, {a: box_kernel(size, sigma) for a in shape}, "blurred", "zero")
    return blurred.withColumn("detail", F.col("intensity") - F.col("blurred"))


def differences_of_gaussians(grid: DataFrame, shape: Shape, levels: int = 15, sigma: float = 0.4, ratio: float = 1.05) -> DataFrame:
    """Long table of levels: tile, axes, level, difference of two neighbouring scales."""
    names = [f"_g{k}" for k in range(levels + 1)]
    grid = grid.withColumns({n: F.col("intensity").cast("double") for n in names})
    for axis in shape:
        line = _along(axis, list(shape))
        grid = grid.withColumns({n: _weighted(n, gaussian_kernel(sigma * ratio**k), line, "clamp") for k, n in enumerate(names)})
    each = F.array(*(F.struct(F.lit(k + 1).alias("level"), (F.col(names[k + 1]) - F.col(names[k])).alias("difference")) for k in range(levels)))
    return grid.select("tile", *shape, F.explode(each).alias("d")).select("tile", *shape, "d.level", "d.difference")
