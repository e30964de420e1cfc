"""Joint fits of groups of clumps that are too large for one task: normal equations from blocks of voxels, sparse steps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model import bounds, initial_guess
from ..params import FitParams, tile_keys
from ..tables import cut_lineage, drop
from .fit import LEAST_SIGMA, NAMES, fit_clumps, model_and_slopes

#: Edge of a block of voxels, by the number of axes: at most 256 or 512 voxels.
EDGE = {2: 16, 3: 8}
#: Sigmas beyond which a clump's model is left out; it is below 2e-8 of its peak there.
REACH = 6.0
#: Blocks of voxels a task evaluates at least.
BLOCKS_A_TASK = 500
#: Turns of conjugate gradients a step takes at most: what they leave is left to the next step, the cost falls all the same.
CG_TURNS = 200
#: A pair's part of the normal equations is left out of a block where it is smaller than this share of both clumps' own.
SMALL_PAIR = 1e-9
#: What the state of a component holds after the parameters of each of its clumps.
STATE = ["damping", "now", "steps", "total", "done", "rms", "base", "n"]


def _solve(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, own: np.ndarray, slope: np.ndarray, free: np.ndarray, damping: float) -> np.ndarray:
    """The damped Gauss-Newton step (rows: clumps) by conjugate gradients, each clump's own block as the preconditioner.

    own are the blocks of clumps with themselves, pairs those of clumps left with clumps right; parameters that are not
    free stay. The equations are scaled to a unit diagonal first.
    """
    diagonal = np.einsum("naa->na", own)
    free = free & (diagonal > 0)
    s = np.where(free, 1 / np.sqrt(np.where(free, diagonal, 1)), 0)
    own = own * s[:, :, None] * s[:, None, :]
    k = np.arange(own.shape[1])
    own[:, k, k] = np.where(free, 1 + damping, 1)
    pairs = pairs * s[left][:, :, None] * s[right][:, None, :]
    near = np.linalg.pinv(own, rcond=1e-13, hermitian=True)

    def times(x: np.ndarray) -> np.ndarray:
        y = np.einsum("nab,nb->na", own, x)
        np.add.at(y, left, np.einsum("nab,nb->na", pairs, x[right]))
        np.add.at(y, right, np.einsum("nab,na->nb", pairs, x[left]))
        return y

    x, r = np.zeros_like(slope), -slope * s
    z = np.einsum("nab,nb->na", near, r)
    d, rz, enough = z, (r * z).sum(), 1e-12 * (r * r).sum()
    for _ in range(CG_TURNS):
        hd = times(d)
        if rz <= 0 or (curve := (d * hd).sum()) <= 0:
            break
        x, r = x + rz / curve * d, r - rz / curve * hd
        if (r * r).sum() <= enough:
            break
        z = np.einsum("nab,nb->na", near, r)
        rz, before = (r * z).sum(), rz
        d = z + rz / before * d
    return x * s


def _step(rows: pd.DataFrame, k: int, o: FitParams) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """IDs, new state, and the parts of the normal equations that hold for it, of one component after a trial.

    A trial that costs less becomes the component's place; otherwise it goes back, and the damping grows. The next trial
    is a step from the place.
    """
    state = rows[rows["j"].isna() & rows["i"].notna()].sort_values("i")
    ids, table = state["i"].to_numpy("int64"), np.array(state["part"].tolist())
    p, q, lo, hi = (table[:, n * k : (n + 1) * k] for n in range(4))
    damping, now, steps, total, _, rms, base, n = table[0, 4 * k :]
    cost = rows[rows["i"].isna()]["part"]
    new, square = np.sum(cost.tolist(), axis=0) if len(cost) else (0.0, 0.0)  # a component whose models reach no voxel
    first, better, done = np.isinf(now), new < now, 0
    parts = rows[rows["j"].notna() & (rows["fresh"] == int(better))]
    if better:
        gain, far = now - new, np.abs(q - p).max()
        p, now, rms = q, new, np.sqrt(max(base + square, 0.0) / n)
        if not first:
            steps, damping = steps + 1, max(damping / 10, 1e-12)
            done = 1 if gain <= 1e-10 * max(now, 1e-300) or far < 1e-9 else 2 if steps >= o.max_steps else 0
    else:
        damping *= 10
        done = int(damping >= 1e12)
    if not done:
        left, right = (np.searchsorted(ids, parts[c].to_numpy("int64")) for c in ("i", "j"))
        alone = left == right
        own, slope = np.zeros((len(ids), k, k)), np.zeros((len(ids), k))
        if alone.any():
            mine = np.array(parts["part"][alone].tolist())
            own[left[alone]], slope[left[alone]] = mine[:, : k * k].reshape(-1, k, k), mine[:, k * k :]
        pairs = np.array([x[: k * k] for x in parts["part"][~alone]]).reshape(-1, k, k)
        free = ~(((p <= lo) & (slope > 0)) | ((p >= hi) & (slope < 0)))
        q = np.clip(p + _solve(left[~alone], right[~alone], pairs, own, slope, free, damping), lo, hi)
        done = int(np.abs(q - p).max() < 1e-9)
    common = np.tile([damping, now, steps, total, done, rms, base, n], (len(ids), 1))
    return ids, np.concatenate([p, q, lo, hi, common], axis=1), parts.iloc[:0] if done else parts


def _evaluate(batches: Iterator[pd.DataFrame], names: list[str], k: int, ndim: int, o: FitParams) -> Iterator[pd.DataFrame]:
    """Parts of the cost and of the normal equations of blocks of voxels, summed over a batch."""
    for batch in batches:
        sums: dict[tuple, np.ndarray] = {}

        def add(key: tuple, part: np.ndarray) -> None:
            sums[key] = sums[key] + part if key in sums else part  # noqa: B023

        for row in batch.itertuples(index=False):
            ids, p = np.asarray(row.ids), np.asarray(row.numbers).reshape(len(row.ids), k)
            values, weight = np.asarray(row.value), np.asarray(row.weight) / max(row.total, 1e-300)
            m, s = model_and_slopes(p, np.asarray(row.place).reshape(-1, ndim))
            off = m.sum(axis=0) - values
            r = off * weight
            root = np.sqrt(1 + (r / o.soft_scale) ** 2)
            jac = s * weight
            soft = jac / root
            head = tuple(getattr(row, c) for c in names)
            add((*head, None, None), np.array([(r**2 / (1 + root)).sum(), (off**2 - values**2).sum()]))
            own = np.einsum("ian,ibn->iab", soft, jac)
            slope = np.einsum("ian,n->ia", soft, r)
            size = np.einsum("iaa->ia", own).max(axis=1)
            for a in range(len(ids)):
                add((*head, ids[a], ids[a]), np.concatenate([own[a].ravel(), slope[a]]))
                for b in range(a + 1, len(ids)):
                    both = soft[a] @ jac[b].T
                    if np.abs(both).max() > SMALL_PAIR * np.sqrt(size[a] * size[b]):
                        add((*head, ids[a], ids[b]), both.ravel())
        out = pd.DataFrame([*sums], columns=[*names, "i", "j"])
        out["i"], out["j"] = out["i"].astype("Int64"), out["j"].astype("Int64")
        yield out.assign(part=list(sums.values()))


def _first_models(batches: Iterator[pd.DataFrame], k: int, ndim: int, o: FitParams) -> Iterator[pd.DataFrame]:
    for batch in batches:
        weight = []
        for ids, numbers, place, value in zip(batch["ids"], batch["numbers"], batch["place"], batch["value"], strict=True):
            if ids is None or not len(ids):
                weight.append(np.zeros(len(value)))
            else:
                m, _ = model_and_slopes(np.asarray(numbers).reshape(len(ids), k), np.asarray(place).reshape(-1, ndim))
                weight.append(m.sum(axis=0) ** o.weight_power)
        yield batch.drop(columns=["ids", "numbers", "total"]).assign(weight=weight)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def spread_fit(points: DataFrame, catalog: DataFrame, groups: DataFrame, o: FitParams = FitParams()) -> DataFrame:
    """The fits of fit_clumps(), with the same columns, for components of any number of voxels.

    Voxels are put into blocks; a clump's model is added up in the blocks within REACH sigmas of it. A round is one trial
    of all components: blocks give their parts of the cost, its slope and the second derivatives of a clump or of two
    clumps that share voxels; an aggregation sums them; a task a component takes a damped Gauss-Newton step by conjugate
    gradients, and a table cuts the round. So no task holds a component's voxels. What it holds of a component is 0.6 KB
    for each clump and each pair that shares voxels, twice: a chain of 5,000 clumps that meet two others takes 20 MB.
    A clump that shares voxels with many is met by its blocks, not by a key.

    Values that are null or not finite do not count. Clumps whose start values are null or NaN, and components without
    a voxel, have no row; an empty catalogue gives no rows.
    """
    ndim, keys = 3 if "Cen3" in catalog.columns else 2, tile_keys(catalog)
    names, axes = NAMES[ndim], ["x", "y", "v"][:ndim]
    k, edge, head = len(names), EDGE[ndim], [*keys, "component"]
    blocks = [f"b_{a}" for a in axes]
    block = lambda c: F.floor((c - 1) / edge).cast("int")

    value = F.col("intensity").cast("double")
    member = groups.select(*head, F.col("ID").cast("long").alias("clump_id"))
    placed = points.where(_finite(value)).join(member, [*keys, "clump_id"]).withColumns({b: block(F.col(a)) for a, b in zip(axes, blocks, strict=True)})
    cells = placed.groupBy(*head, *blocks).agg(F.collect_list(F.struct(F.array(*(F.col(a).cast("double") for a in axes)).alias("place"), value.alias("value"))).alias("all"))
    cells = cut_lineage(cells.select(*head, *blocks, F.flatten("all.place").alias("place"), F.col("all.value").alias("value")), "cells")

    guess = bounds(initial_guess(catalog), o)
    guess = guess.where(reduce(lambda a, b: a & b, (_finite(F.col(n).cast("double")) for n in names)))
    held = lambda n, c: F.greatest(c, F.lit(LEAST_SIGMA)) if n in ("s1", "s2", "s3") else c
    lo, hi = ([held(n, F.col(f"{n}_{end}").cast("double")) for n in names] for end in ("lo", "hi"))
    start = [F.least(F.greatest(held(n, F.col(n).cast("double")), low), high) for n, low, high in zip(names, lo, hi, strict=True)]
    member = member.withColumnRenamed("clump_id", "i")
    begun = guess.withColumn("i", F.col("ID").cast("long")).join(member, [*keys, "i"]).select(*head, "i", F.array(*start).alias("start"), F.array(*lo).alias("low"), F.array(*hi).alias("high"))

    def reached(numbers: Column, clumps: DataFrame) -> DataFrame:
        """clumps (head, i, total) with their numbers, gathered by the blocks they reach."""
        c = clumps.withColumn("numbers", numbers)
        of = {n: F.element_at("numbers", pos + 1) for pos, n in enumerate(names)}
        cos, sin = F.cos(of["theta"]), F.sin(of["theta"])
        wide = [F.hypot(of["s1"] * cos, of["s2"] * sin), F.hypot(of["s1"] * sin, of["s2"] * cos), *([of["s3"]] if ndim == 3 else [])]
        for b, at, w in zip(blocks, ("x0", "y0", "v0"), wide, strict=False):
            c = c.withColumn(b, F.explode(F.sequence(block(of[at] - REACH * w), block(of[at] + REACH * w))))
        met = c.groupBy(*head, *blocks).agg(F.sort_array(F.collect_list(F.struct("i", "numbers"))).alias("all"), F.first("total").alias("total"))
        return met.select(*head, *blocks, "total", F.col("all.i").alias("ids"), F.flatten("all.numbers").alias("numbers"))

    kinds = dict(cells.dtypes)
    schema = lambda *rest: ", ".join([*(f"{c} {kinds[c]}" for c in head), *rest])
    ready = cells.join(reached(F.col("start"), begun.withColumn("total", F.lit(None).cast("double"))), [*head, *blocks], "left").repartition(1 + cells.count() // BLOCKS_A_TASK, *head, *blocks)
    cell_schema = schema(*(f"{b} int" for b in blocks), "place array<double>", "value array<double>", "weight array<double>")
    weighed = cut_lineage(ready.mapInPandas(lambda it: _first_models(it, k, ndim, o), cell_schema), "weighed")
    total = lambda c, f: F.sum(F.aggregate(c, F.lit(0.0), f))
    whole = weighed.groupBy(*head).agg(total("weight", lambda s, x: s + x).alias("total"), total("value", lambda s, x: s + x * x).alias("base"), F.sum(F.size("value")).cast("double").alias("n"))
    common = {"damping": F.lit(1e-3), "now": F.lit(float("inf")), "steps": F.lit(0.0), "done": F.lit(0.0), "rms": F.sqrt(F.col("base") / F.col("n"))}
    state = begun.join(whole, head).select(*head, "i", F.lit(None).cast("long").alias("j"), F.concat("start", "start", "low", "high", F.array(*(common.get(c, F.col(c)) for c in STATE))).alias("part"), F.lit(0).alias("fresh"))
    drop(cells)
    table = cut_lineage(state, "state")

    entry = lambda c: F.element_at("part", 4 * k + 1 + STATE.index(c))
    is_state = F.col("i").isNotNull() & F.col("j").isNull()
    whole_part = F.array(*(F.sum(F.get("part", F.lit(n))) for n in range(k * k + k)))
    step_schema = schema("i long", "j long", "part array<double>", "fresh int")
    part_schema = schema("i long", "j long", "part array<double>")

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        ids, numbers, parts = _step(rows, k, o)
        new = pd.DataFrame({"i": pd.array(ids, "Int64"), "j": pd.array([None] * len(ids), "Int64"), "part": list(numbers)})
        old = pd.DataFrame({"i": parts["i"].astype("Int64"), "j": parts["j"].astype("Int64"), "part": parts["part"]})
        out = pd.concat([new, old], ignore_index=True)
        return out.assign(fresh=0, **{c: rows[c].iloc[0] for c in head})[[*head, "i", "j", "part", "fresh"]]

    finished = []
    while True:
        active = table.where(is_state & (entry("done") == 0))
        ended, left = table.where(is_state).agg(F.count_if(entry("done") > 0), F.count_if(entry("done") == 0)).first()
        if ended:
            finished.append(cut_lineage(table.where(is_state & (entry("done") > 0)), "fitted"))
        if not left:
            break
        going = table.join(active.select(*head).distinct(), head, "left_semi") if ended else table
        trial = reached(F.slice("part", k + 1, k), active.withColumn("total", entry("total")))
        tried = weighed.join(trial, [*head, *blocks]).mapInPandas(lambda it: _evaluate(it, head, k, ndim, o), part_schema)
        summed = tried.groupBy(*head, "i", "j").agg(whole_part.alias("part")).withColumns({"part": F.filter("part", lambda x: x.isNotNull()), "fresh": F.lit(1)})
        before, table = table, cut_lineage(going.unionByName(summed).groupBy(*head).applyInPandas(step, step_schema), "state")
        drop(before)
    fits = reduce(DataFrame.unionByName, finished or [table.limit(0)])
    return fits.select(*head, F.col("i").alias("ID"), *(F.element_at("part", n + 1).alias(c) for n, c in enumerate(names)), (entry("done") == 1).alias("Success"), entry("rms").alias("Cost"))


def fit_any(points: DataFrame, catalog: DataFrame, groups: DataFrame, o: FitParams = FitParams()) -> DataFrame:
    """fit_clumps() for components whose slopes fit in o.task_mb, spread_fit() for larger ones.

    Both lower the same cost from the same start; they agree within the solver's tolerance, not bit by bit.
    """
    keys = tile_keys(catalog)
    head, k = [*keys, "component"], 8 if "Cen3" in catalog.columns else 6
    points = cut_lineage(points, "points")
    voxels = points.join(groups.withColumnRenamed("ID", "clump_id"), [*keys, "clump_id"]).groupBy(*head).agg(F.count("*").alias("voxels"))
    clumps = groups.groupBy(*head).agg(F.count("*").alias("clumps"))
    large = cut_lineage(clumps.join(voxels, head).where(F.col("voxels") * F.col("clumps") * (8 * k) > o.task_mb * 2.0**20).select(*head), "large")
    if large.isEmpty():
        return fit_clumps(points, catalog, groups, o)
    small = fit_clumps(points, catalog, groups.join(large, head, "left_anti"), o)
    return small.unionByName(spread_fit(points, catalog, groups.join(large, head, "left_semi"), o))
