"""Simulated cubes and samples: placing clumps, rendering them, and statistics of their sizes and fluxes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import cut_lineage
from .grid import Shape, voxel_index
from .rank import ranked

COMPONENT = "tile string, ID int, A double, x0 double, y0 double, v0 double, s1 double, s2 double, s3 double, angle double, theta double"


def overlapping(ax: Column, ay: Column, asig: Column, bx: Column, by: Column, bsig: Column, av=None, asv=None, bv=None, bsv=None) -> Column:
    """Whether two clumps are too near to be told apart: strictly within their summed reaches on every axis."""
    near = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) < asig + bsig
    return near if av is None else near & (F.abs(av - bv) < asv + bsv)


#: Clumps that a task of separable_from() gets of each side, about.
CLUMPS_A_TASK = 10_000


def _apart(candidates: DataFrame, placed: DataFrame, cell: float, tasks: int) -> DataFrame:
    """The candidates that overlap none of placed: an anti-join on cells as wide as the greatest reach, dealt by cells."""
    own = candidates.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)}).repartition(tasks, "tile", "cx", "cy")
    step = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    there = placed.select(*(F.col(c).alias(f"p_{c}") for c in ("tile", "x", "y", "v", "s", "sv")), F.explode(F.transform(step, lambda k: F.floor(F.col("x") / cell) + k)).alias("p_cx"))
    there = there.withColumn("p_cy", F.explode(F.transform(step, lambda k: F.floor(F.col("p_y") / cell) + k))).repartition(tasks, "p_tile", "p_cx", "p_cy")
    c = F.col
    bad = (c("tile") == c("p_tile")) & (c("cx") == c("p_cx")) & (c("cy") == c("p_cy")) & overlapping(c("x"), c("y"), c("s"), c("p_x"), c("p_y"), c("p_s"), c("v"), c("sv"), c("p_v"), c("p_sv"))
    return own.join(there.hint("merge"), bad, "left_anti").drop("cx", "cy")


def separable_from(candidates: DataFrame, placed: DataFrame) -> DataFrame:
    """The candidates (tile, ID, x, y, v, s, sv) that overlap no placed clump of their tile.

    Where clumps are dense, one placed clump of each of a grid of small boxes already overlaps almost all candidates: they
    are looked at first, and all placed clumps only for the candidates that are left.
    """
    ends = lambda t: t.select("s", "sv")
    longest, deepest, n = ends(candidates).unionByName(ends(placed)).agg(F.max("s"), F.max(F.abs("sv")), F.count("*")).first()
    cell, deep = 2 * (longest or 1.0) + 1e-9, 2 * (deepest or 1.0) + 1e-9
    tasks = 1 + n // CLUMPS_A_TASK
    boxes = [F.floor(F.col(a) / (w / 4)).alias(f"b_{a}") for a, w in (("x", cell), ("y", cell), ("v", deep))]
    few = placed.groupBy("tile", *boxes).agg(F.max(F.struct("s", "sv", "x", "y", "v")).alias("p")).select("tile", "p.*")
    left = cut_lineage(_apart(candidates, few, cell, tasks), "left")
    return _apart(left, placed, cell, tasks)


#: Tiles whose clumps a task places, and voxels of dense cubes that it makes: their rows say little of the work in them.
TILES_A_TASK, VOXELS_A_TASK = 50, 2_000_000


def place_clumps(tiles: DataFrame, shape: Shape, number: int, seed: int = 0, tries: int = 2000) -> DataFrame:
    """Clumps of each tile of tiles (tile), drawn until `number` are placed apart from one another (see COMPONENT).

    Rejection is sequential, so a tile is one group; it holds its few clumps, not its voxels. After `tries` rejections
    in a row the tile starts afresh with another seed.
    """
    nx, ny, nv = shape["x"], shape["y"], shape.get("v", 0)

    def place(group: pd.DataFrame) -> pd.DataFrame:
        tile = group["tile"].iloc[0]
        for attempt in range(20):
            rng = np.random.default_rng([seed, attempt, *tile.encode()])
            rows: list[tuple] = []
            failed = 0
            while len(rows) < number and failed < tries:
                a, x, y = rng.uniform(0.46, 3), rng.uniform(5, nx - 5), rng.uniform(5, ny - 5)
                v = rng.uniform(5, nv - 5) if nv else 0.0
                s1, s2 = sorted(rng.uniform(2, 4, 2), reverse=True)
                s3, angle = rng.uniform(1, 7), rng.uniform(0, 180)
                reach = math.hypot(s1, s2)
                if any(math.hypot(x - r[3], y - r[4]) < reach + math.hypot(r[6], r[7]) and (not nv or abs(v - r[5]) < s3 + r[8]) for r in rows):
                    failed += 1
                    continue
                failed = 0
                rows.append((tile, len(rows) + 1, a, x, y, v, s1, s2, s3, angle, math.radians((90 + angle) % 180)))
            if len(rows) == number:
                return pd.DataFrame(rows, columns=[c.split()[0] for c in COMPONENT.split(", ")])
        raise ValueError(f"{number} clumps do not fit into tile {tile}")

    names = cut_lineage(tiles.select("tile").distinct(), "tiles")
    return names.repartition(1 + names.count() // TILES_A_TASK, "tile").groupBy("tile").applyInPandas(place, COMPONENT)


#: Edge of the blocks of voxels in which models are summed.
BLOCK = 64


def _boxes(components: DataFrame, shape: Shape, reach: float) -> DataFrame:
    """A row for each component and block of BLOCK places an axis that its box of `reach` sigmas meets: tile, b_<axis>, the
    box's ends <axis>_lo and <axis>_hi, and what the model needs."""
    c = F.col
    wide = F.ceil(F.greatest("s1", "s2") * reach)
    half = {"x": wide, "y": wide, "v": F.ceil(c("s3") * reach) if "v" in shape else None}
    c2, n2, both = F.cos("theta") * F.cos("theta"), F.sin("theta") * F.sin("theta"), F.sin(2 * c("theta"))
    ends = {f"{a}_lo": F.greatest(F.floor(f"{a}0") - half[a], F.lit(1)).cast("int") for a in shape} | {f"{a}_hi": F.least(F.ceil(f"{a}0") + half[a], F.lit(n)).cast("int") for a, n in shape.items()}
    known = components.where((c("x0") + wide >= 1) & (c("x0") - wide <= shape["x"])).select(
        "tile", c("A").cast("double"), *(c(f"{a}0").cast("double") for a in shape),
        (c2 / (2 * c("s1") * c("s1")) + n2 / (2 * c("s2") * c("s2"))).alias("xx"),
        (n2 / (2 * c("s1") * c("s1")) + c2 / (2 * c("s2") * c("s2"))).alias("yy"),
        (both / (2 * c("s2") * c("s2")) - both / (2 * c("s1") * c("s1"))).alias("xy"),
        *([(2 * c("s3") * c("s3")).alias("vv")] if "v" in shape else []),
        *(e.alias(n) for n, e in ends.items()),
    )
    for a in shape:
        known = known.where(c(f"{a}_lo") <= c(f"{a}_hi")).withColumn(f"b_{a}", F.explode(F.sequence(F.floor((c(f"{a}_lo") - 1) / BLOCK).cast("int"), F.floor((c(f"{a}_hi") - 1) / BLOCK).cast("int"))))
    return known


def _summed(boxes: DataFrame, shape: Shape, threshold: float, dense: bool) -> DataFrame:
    """(tile, axes, intensity): the models of boxes, sorted by tile and block within their partitions, summed in a block at
    a time; a block that lies in several partitions gives rows of each. dense: also the voxels that no model reaches."""
    axes, others = list(shape), [a for a in shape if a != "x"]
    cube = "v" in shape

    def planes(who: tuple, total: np.ndarray, hit: np.ndarray) -> Iterator[dict]:
        """A row for each place along y: what the others begin at, and the voxels as positions from there."""
        origin = {a: b * BLOCK + 1 for a, b in zip(axes, who[1:], strict=True)}
        for p in range(len(total)):
            if len(at := np.flatnonzero(hit[p])):
                yield {"tile": who[0], **origin, "y": origin["y"] + p, "w": total.shape[-1], "at": at.astype(np.int32), "ms": total[p].ravel()[at]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ready = None, []
        for batch in batches:
            columns = [batch[n].tolist() for n in ("tile", *(f"b_{a}" for a in axes))]
            numbers = {n: batch[n].to_numpy() for n in batch.columns if n != "tile" and not n.startswith("b_")}
            for k, who in enumerate(zip(*columns, strict=True)):
                if held is None or held[0] != who:
                    if held is not None:
                        ready.extend(planes(held[0], *held[2:]))
                    if len(ready) > 200:
                        yield pd.DataFrame(ready)
                        ready = []
                    block = dict(zip(axes, who[1:], strict=True))
                    size = [min(BLOCK, shape[a] - block[a] * BLOCK) for a in (*others, "x")]
                    held = (who, block, np.zeros(size), np.full(size, dense))
                block, total, hit = held[1:]
                if numbers["A"][k] != numbers["A"][k]:  # no component, but a block to be filled
                    continue
                first = {a: max(int(numbers[f"{a}_lo"][k]) - block[a] * BLOCK - 1, 0) for a in axes}
                last = {a: min(int(numbers[f"{a}_hi"][k]) - block[a] * BLOCK, total.shape[(*others, "x").index(a)]) for a in axes}
                d = {a: np.arange(first[a], last[a]) + (block[a] * BLOCK + 1 - numbers[f"{a}0"][k]) for a in axes}
                dx, dy = d["x"][None, :], d["y"][:, None]
                m = numbers["A"][k] * np.exp(-(dx * dx * numbers["xx"][k] + dy * dy * numbers["yy"][k] + dx * dy * numbers["xy"][k]))
                if cube:
                    m = m[:, None, :] * np.exp(-d["v"] * d["v"] / numbers["vv"][k])[None, :, None]
                box = tuple(slice(first[a], last[a]) for a in (*others, "x"))
                if m.min() > threshold:
                    total[box] += m
                    hit[box] = True
                else:
                    total[box] += np.where(m > threshold, m, 0.0)
                    hit[box] |= m > threshold
        if held is not None:
            ready.extend(planes(held[0], *held[2:]))
        if ready:
            yield pd.DataFrame(ready)

    kind = dict(boxes.dtypes)["tile"]
    made = boxes.mapInPandas(run, f"tile {kind}, {', '.join(f'{a} int' for a in axes)}, w int, at array<int>, ms array<double>")
    moved = {"x": F.col("x") + F.col("at") % F.col("w")} | ({"v": F.col("v") + F.floor(F.col("at") / F.col("w")).cast("int")} if cube else {})
    return made.select("tile", *axes, "w", F.inline(F.arrays_zip("at", "ms"))).select("tile", *(moved.get(a, F.col(a)).alias(a) for a in axes), F.col("ms").alias("intensity"))


def render(components: DataFrame, shape: Shape, reach: float = 4.0, threshold: float = 0.0) -> DataFrame:
    """(tile, axes, intensity): the sum of all components' models, each over `reach` sigmas around its centre.

    What is shuffled are components and sums, never a component's voxels: components are dealt evenly, in the order of
    their blocks, and a task sums those of a block in an array; what tasks have of the same block is added at last.
    Components with missing values add nothing.
    """
    blocks = ["tile", *(f"b_{a}" for a in shape)]
    boxes = _boxes(components, shape, reach).where(~F.isnan("A"))
    dealt = boxes.repartitionByRange(*blocks, F.xxhash64(*boxes.columns)).sortWithinPartitions(*blocks)
    return _summed(dealt, shape, threshold, False).groupBy("tile", *shape).agg(F.sum("intensity").alias("intensity"))


def model_sums(components: DataFrame, shape: Shape, least: float = 0.01) -> DataFrame:
    """Per component the sum of its model over the cube, and the number of voxels where it exceeds `least`."""
    named = components.withColumns({"_of": F.struct("tile", "ID"), "tile": F.to_json(F.struct("tile", "ID"))})
    each = render(named, shape).groupBy("tile").agg(F.sum("intensity").alias("Sum"), F.count_if(F.col("intensity") > least).alias("Volume"))
    return named.select("tile", "_of").distinct().join(each, "tile").select("_of.tile", "_of.ID", "Sum", "Volume")


def simulate_cubes(tiles: DataFrame, shape: Shape, number: int, noise: float = 0.23, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(voxels with index, components): dense cubes of placed clumps with Gaussian noise.

    The noise of a voxel depends on its tile and index alone, so a recomputed task makes the same cube.
    """
    components = cut_lineage(place_clumps(tiles, shape, number, seed), "components")
    blocks = ["tile", *(f"b_{a}" for a in shape)]
    empty = tiles.select("tile").distinct().withColumn("A", F.lit(float("nan")))
    for a, n in shape.items():
        empty = empty.withColumn(f"b_{a}", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // BLOCK))))
    # Each block is whole in its partition, as a tile has few clumps: its sums need no further shuffle.
    tasks = 1 + components.count() // max(number, 1) * math.prod(shape.values()) // VOXELS_A_TASK
    boxes = _boxes(components, shape, 4.0).unionByName(empty, allowMissingColumns=True).repartition(tasks, *blocks).sortWithinPartitions(*blocks)
    unit = [(F.pmod(F.xxhash64("tile", voxel_index(shape), F.lit(seed + k)), F.lit((1 << 52) - 1)) + 1) / float(1 << 52) for k in (1, 2)]
    normal = F.sqrt(-2 * F.log(unit[0])) * F.cos(2 * math.pi * unit[1])
    voxels = _summed(boxes, shape, 0.0, True).select("tile", *shape, voxel_index(shape).alias("idx"), (F.col("intensity") + noise * normal).alias("intensity"))
    return voxels, components


def inject(voxels: DataFrame, components: DataFrame, shape: Shape) -> DataFrame:
    """A real cube with the components' models added, without noise."""
    return voxels.select("tile", *shape, "intensity").unionByName(render(components, shape)).groupBy("tile", *shape).agg(F.sum("intensity").alias("intensity"))


def shuffled(key: str, seed: int) -> Column:
    """A random order that belongs to the rows: it is the same in another partitioning, or when a task runs again."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def random_rows(df: DataFrame, n: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """n rows, random but the same for the same seed; key (the first column) tells rows apart. Fewer rows are all taken."""
    key = key or df.columns[0]
    return df.orderBy(shuffled(key, seed), key).limit(n)


def core_sample(spark, number: int, sigma: float, scale: float, seed: int = 0) -> DataFrame:
    """Synthetic clumps: log-normal peaks, uniform sizes and angles, and their sums in closed form."""
    s = spark.range(1, number + 1).select(
        F.col("id").alias("ID"), (scale * F.exp(sigma * F.randn(seed))).alias("Peak"), (2 + 2 * F.rand(seed + 1)).alias("Size1"), (2 + 2 * F.rand(seed + 2)).alias("Size2"),
        (1 + 6 * F.rand(seed + 3)).alias("Size3"), (180 * F.rand(seed + 4)).alias("theta"),
    )
    return s.withColumn("Sum", F.col("Peak") * F.col("Size1") * F.col("Size2") * F.col("Size3") * (2 * math.pi) ** 1.5)


def lognormal_fit(df: DataFrame, column: str) -> DataFrame:
    """Maximum likelihood of a log-normal distribution at 0: sigma and scale."""
    x = F.log(F.when(F.col(column) > 0, F.col(column)))
    return df.agg(F.stddev_pop(x).alias("sigma"), F.exp(F.avg(x)).alias("scale"), F.count(x).alias("n"))


def lognormal_density(x: Column, sigma: float, scale: float) -> Column:
    z = F.log(x / scale) / sigma
    return F.exp(-z * z / 2) / (x * sigma * math.sqrt(2 * math.pi))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) of equal bins between least and greatest value, the last one closed; empty bins have no row."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).where(F.lit(False))
    place = F.lit(0) if hi == lo else F.least(F.floor((F.col(column) - F.lit(float(lo))) / F.lit(float(hi) - float(lo)) * bins), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation, ties sharing their mean rank. Meant for tables of bins: its ranks are global."""
    ranked = df
    for c in (a, b):
        order = W.orderBy(c)
        ranked = ranked.withColumn(f"_r_{c}", F.rank().over(order) + (F.count("*").over(W.partitionBy(c)) - 1) / 2)
    return ranked.agg(F.corr(f"_r_{a}", f"_r_{b}").alias("rho"))


def stratified_quota(pool: DataFrame, wanted: DataFrame, column: str, interval: float, n: int) -> DataFrame:
    """(stratum, share, quota, available): how many rows of each stratum of `column` a sample of n like `wanted` takes."""
    stratum = F.floor(F.col(column) / interval).alias("stratum")
    total = wanted.agg(F.count("*")).first()[0] or 1
    share = wanted.groupBy(stratum).agg(F.count("*").alias("c")).select("stratum", (F.col("c") / total).alias("share"))
    there = pool.groupBy(stratum).agg(F.count("*").alias("available"))
    return share.join(there, "stratum").select("stratum", "share", F.ceil(F.col("share") * n).cast("long").alias("quota"), "available")


def stratified_resample(pool: DataFrame, wanted: DataFrame, column: str, interval: float, n: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """A sample of pool with the strata of wanted; rows of a short stratum repeat, empty strata are left out.

    Within a stratum rows are ranked in the random order of their keys (the first column), which tell rows apart; no task
    ranks a whole stratum.
    """
    key = key or pool.columns[0]
    quota = stratified_quota(pool, wanted, column, interval, n)
    times = F.ceil(F.col("quota") / F.col("available")).cast("int")
    strata = pool.withColumn("stratum", F.floor(F.col(column) / interval)).join(F.broadcast(quota.select("stratum", "quota", "available")), "stratum").withColumn("_order", shuffled(key, seed))
    each = ranked(strata, ["stratum"], [F.col("_order"), F.col(key)], "_rank").withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    return each.where((F.col("_copy") - 1) * F.col("available") + F.col("_rank") <= F.col("quota")).select(*pool.columns)
