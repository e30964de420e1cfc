"""Joint fits of Gaussians to the voxels of overlapping clumps, a group of clumps a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import bounds, initial_guess
from ..params import FitParams, tile_keys

#: Sigmas are held above this.
LEAST_SIGMA = 0.1
NAMES = {2: ["A", "x0", "y0", "s1", "s2", "theta"], 3: ["A", "x0", "y0", "s1", "s2", "theta", "v0", "s3"]}


def model_and_slopes(p: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value of each component (rows of p) at each place (rows of places), and its derivatives by the parameters."""
    a, x0, y0, s1, s2, t = (p[:, k, None] for k in range(6))
    dx, dy = places[:, 0] - x0, places[:, 1] - y0
    cos, sin = np.cos(t), np.sin(t)
    along, across = dx * cos - dy * sin, dx * sin + dy * cos
    q = along**2 / (2 * s1**2) + across**2 / (2 * s2**2)
    if p.shape[1] == 8:
        v0, s3 = p[:, 6, None], p[:, 7, None]
        dv = places[:, 2] - v0
        q = q + dv**2 / (2 * s3**2)
    e = np.exp(-q)
    m = a * e
    slopes = [
        e,
        m * (along * cos / s1**2 + across * sin / s2**2),
        m * (-along * sin / s1**2 + across * cos / s2**2),
        m * along**2 / s1**3,
        m * across**2 / s2**3,
        m * (along * across * (1 / s1**2 - 1 / s2**2)),
    ]
    if p.shape[1] == 8:
        slopes += [m * dv / s3**2, m * dv**2 / s3**3]
    return m, np.stack(slopes, axis=1)


def fit_group(start: np.ndarray, low: np.ndarray, high: np.ndarray, places: np.ndarray, values: np.ndarray, o: FitParams = FitParams()) -> tuple[np.ndarray, bool, float]:
    """Bounded least squares with a soft-L1 loss: the parameters (rows: components), success, and root mean square.

    Damped Gauss-Newton steps on the free parameters, held inside the bounds. Each step weighs the residuals by the
    slope of the loss at the last ones. The weight of a voxel is a power of the first model there.
    """
    sigmas = [k for k in (3, 4, 7) if k < start.shape[1]]
    start, low, high = start.copy(), low.copy(), high.copy()
    for table in (start, low, high):  # a clump of one voxel has no width; a model needs one
        table[:, sigmas] = np.maximum(table[:, sigmas], LEAST_SIGMA)
    p = np.clip(start, low, high)
    m, _ = model_and_slopes(p, places)
    first = m.sum(axis=0) ** o.weight_power
    weight = first / max(first.sum(), 1e-300)

    def cost(q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        m, s = model_and_slopes(q, places)
        r = (m.sum(axis=0) - values) * weight
        return float((r**2 / (1 + np.sqrt(1 + (r / o.soft_scale) ** 2))).sum()), r, s  # the loss, where 1 + r^2 is 1 as well

    now, r, s = cost(p)
    damping, done = 1e-3, False
    for _ in range(o.max_steps):
        jac = (s * weight).reshape(-1, s.shape[2]).T
        soft = 1 / np.sqrt(1 + (r / o.soft_scale) ** 2)
        g, h = jac.T @ (soft * r), (jac * soft[:, None]).T @ jac
        flat, lo, hi = p.ravel(), low.ravel(), high.ravel()
        free = ~(((flat <= lo) & (g > 0)) | ((flat >= hi) & (g < 0)))
        if not free.any():
            done = True
            break
        hf = h[np.ix_(free, free)]
        scale = np.maximum(np.diag(hf), 1e-300)
        moved = False
        while damping < 1e12:
            step = np.zeros_like(flat)
            step[free] = -np.linalg.lstsq(hf + damping * np.diag(scale), g[free], rcond=None)[0]
            q = np.clip(flat + step, lo, hi).reshape(p.shape)
            new, r2, s2 = cost(q)
            if new < now:
                gain, far = now - new, np.abs(q - p).max()
                p, now, r, s, moved, damping = q, new, r2, s2, True, max(damping / 10, 1e-12)
                break
            damping *= 10
        if not moved or gain <= 1e-10 * max(now, 1e-300) or far < 1e-9:
            done = True
            break
    m, _ = model_and_slopes(p, places)
    return p, done, float(np.sqrt(np.mean((m.sum(axis=0) - values) ** 2)))


def fit_clumps(points: DataFrame, catalog: DataFrame, groups: DataFrame, o: FitParams = FitParams()) -> DataFrame:
    """(component, ID, parameters, Success, Cost) of each clump of catalog, after tile if it has tiles.

    points are voxels (clump_id, axes, intensity), groups gives each ID its component; with tiles, all three have them,
    and a component is one of its tile. A component's voxels and start values meet in one task: a component is as large
    as a chain of overlapping clumps. Values that are null or NaN do not count.
    """
    ndim, keys = 3 if "Cen3" in catalog.columns else 2, tile_keys(catalog)
    names, axes = NAMES[ndim], ["x", "y", "v"][:ndim]
    b = bounds(initial_guess(catalog), o)
    numbers = [*names, *(f"{n}_lo" for n in names), *(f"{n}_hi" for n in names)]
    starts = b.join(groups, [*keys, "ID"]).select(*keys, "component", F.col("ID").cast("long").alias("ID"), F.array(*(F.col(n).cast("double") for n in numbers)).alias("start"), F.lit(None).cast("array<double>").alias("place"), F.lit(None).cast("double").alias("value"))
    value = F.col("intensity").cast("double")
    good = points.where(value.isNotNull() & ~F.isnan(value)).join(groups.withColumnRenamed("ID", "clump_id"), [*keys, "clump_id"])
    voxels = good.select(*keys, "component", F.lit(None).cast("long").alias("ID"), F.lit(None).cast("array<double>").alias("start"), F.array(*(F.col(a).cast("double") for a in axes)).alias("place"), value.alias("value"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        head, body = group[group["start"].notna()].sort_values("ID"), group[group["place"].notna()]
        columns = [*keys, "component", "ID", *names, "Success", "Cost"]
        if not len(head) or not len(body):
            return pd.DataFrame(columns=columns)
        table = np.array(head["start"].tolist())
        k = len(names)
        p, ok, rms = fit_group(table[:, :k], table[:, k : 2 * k], table[:, 2 * k :], np.array(body["place"].tolist()), body["value"].to_numpy(), o)
        out = pd.DataFrame(p, columns=names)
        return out.assign(**{c: head[c].to_numpy() for c in (*keys, "component", "ID")}, Success=ok, Cost=rms)[columns]

    kinds = dict(catalog.dtypes) | dict(groups.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "component")) + ", ID long, " + ", ".join(f"{n} double" for n in names) + ", Success boolean, Cost double"
    return starts.unionByName(voxels).groupBy(*keys, "component").applyInPandas(run, schema)
