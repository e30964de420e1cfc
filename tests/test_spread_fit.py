"""Fits by blocks against fits in one task."""

from functools import reduce

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellagrid.operators import fit, overlap, spread_fit
from stellagrid.params import FWHM, FitParams


def chain(spark, n, ndim, gap=6.5, seed=0, rows=1):
    """Points, catalogue and true centres of n clumps that stand in rows, each overlapping the next."""
    r = np.random.default_rng(seed)
    p = np.empty((n, 6 if ndim == 2 else 8))
    k = np.arange(n)
    p[:, 0], p[:, 1], p[:, 2] = r.uniform(3, 6, n), 9 + gap * (k // rows) + r.uniform(-0.4, 0.4, n), 9 + 5 * (k % rows) + r.uniform(-0.5, 0.5, n)
    p[:, 3], p[:, 4], p[:, 5] = r.uniform(2.0, 2.4, n), r.uniform(1.4, 1.8, n), r.uniform(0.2, 0.9, n)
    if ndim == 3:
        p[:, 6], p[:, 7] = 7 + r.uniform(-0.5, 0.5, n), r.uniform(1.5, 2.0, n)
    found = []
    for a in range(n):  # voxels around a clump that no other one is nearer to
        near = [np.arange(np.ceil(c - 7), np.floor(c + 7) + 1) for c in (p[a, 1], p[a, 2], *p[a, 6:7])]
        grid = np.stack([g.ravel() for g in np.meshgrid(*near, indexing="ij")], axis=1)
        grid = grid[(grid > 0).all(axis=1)]
        few = np.arange(max(a - 6 * rows, 0), min(a + 6 * rows + 1, n))
        d = (grid[:, :1] - p[few, 1]) ** 2 + (grid[:, 1:2] - p[few, 2]) ** 2
        mine = grid[few[d.argmin(axis=1)] == a]
        values = fit.model_and_slopes(p[few], mine)[0].sum(axis=0) + r.normal(0, 0.05, len(mine))
        found.append(pd.DataFrame(mine.astype("int32"), columns=["x", "y", "v"][:ndim]).assign(clump_id=a + 1, intensity=values))
    start = p * r.uniform(0.96, 1.04, p.shape)
    c = {"ID": k + 1, "Peak": start[:, 0], "Cen1": start[:, 1], "Cen2": start[:, 2], "Size1": start[:, 3] * FWHM, "Size2": start[:, 4] * FWHM}
    if ndim == 3:
        c |= {"Cen3": start[:, 6], "Size3": start[:, 7] * FWHM}
    return spark.createDataFrame(pd.concat(found)), spark.createDataFrame(pd.DataFrame(c)), p


def test_blocks_fit_what_a_task_fits(spark):
    points, catalog, p = chain(spark, 6, 2)
    groups = overlap.overlap_groups(catalog, 1.5)
    assert groups.select("component").distinct().count() == 1
    alone = fit.fit_clumps(points, catalog, groups).orderBy("ID").toPandas()
    blocks = spread_fit.spread_fit(points, catalog, groups).orderBy("ID").toPandas()
    assert list(alone.columns) == list(blocks.columns) and alone["Success"].all() and blocks["Success"].all()
    names = fit.NAMES[2]
    assert np.allclose(alone[names], blocks[names], atol=2e-3) and np.allclose(alone["Cost"], blocks["Cost"], atol=1e-5)
    assert np.abs(blocks[["x0", "y0"]].to_numpy() - p[:, 1:3]).max() < 0.1


def test_tiles_and_missing_values(spark):
    """Two tiles with the same IDs and components of their own; values that do not count; a clump without a place, one without voxels."""
    parts = [(name, *chain(spark, 2, 3, seed=seed)[:2]) for name, seed in (("a", 3), ("b", 4))]
    points, catalog = (reduce(DataFrame.unionByName, (df.withColumn("tile", F.lit(name)) for name, *two in parts for df in two[at : at + 1])) for at in (0, 1))
    bad = points.limit(3).withColumns({"x": F.col("x") + 100, "intensity": F.when(F.col("x") % 2 == 0, float("nan"))})
    more = catalog.where("ID = 1").withColumns({"ID": F.lit(7).cast("long"), "Cen1": F.when(F.col("tile") == "a", F.col("Cen1"))})
    groups = catalog.select("tile", "ID", F.lit(1).alias("component")).union(more.select("tile", "ID", F.lit(2)))
    catalog, points = catalog.unionByName(more), points.unionByName(bad)
    alone = spread_fit.fit_any(points, catalog, groups).orderBy("tile", "ID").toPandas()
    blocks = spread_fit.fit_any(points, catalog, groups, FitParams(task_mb=0.0)).orderBy("tile", "ID").toPandas()
    assert [*zip(blocks["tile"], blocks["ID"], blocks["component"], strict=True)] == [("a", 1, 1), ("a", 2, 1), ("b", 1, 1), ("b", 2, 1)] and list(alone.columns) == list(blocks.columns)
    names = fit.NAMES[3]
    assert np.allclose(alone[names], blocks[names], atol=2e-3) and np.allclose(alone["Cost"], blocks["Cost"], atol=1e-5)


def test_no_clumps(spark):
    points, catalog, _ = chain(spark, 2, 2)
    groups = catalog.select("ID", F.lit(1).alias("component"))
    assert spread_fit.spread_fit(points, catalog.limit(0), groups).count() == 0
    assert spread_fit.spread_fit(points.limit(0), catalog, groups).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6))
def test_sparse_step_solves_the_dense_equations(seed):
    r = np.random.default_rng(seed)
    n, k, damping = int(r.integers(1, 6)), 6, 10 ** r.uniform(-3, 1)
    jac = r.normal(size=(80, n * k))
    h, g = jac.T @ jac, r.normal(size=n * k)
    free = r.random(n * k) < 0.8
    block = h.reshape(n, k, n, k).transpose(0, 2, 1, 3)
    left, right = np.triu_indices(n, 1)
    got = spread_fit._solve(left, right, block[left, right], block[np.arange(n), np.arange(n)], g.reshape(n, k), free.reshape(n, k), damping).ravel()
    part = h[np.ix_(free, free)]
    want = np.zeros(n * k)
    want[free] = np.linalg.solve(part + damping * np.diag(np.diag(part)), -g[free])
    assert np.allclose(got, want, atol=1e-4 * max(np.abs(want).max(), 1e-9))
