"""Density peaks: neighbours on the lattice, the nearest denser neighbour, and cluster centres."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import cut_lineage
from .grid import Shape, by_block
from .rank import ranked


#: Edge of the blocks in which neighbours meet.
BLOCK = 32


def neighbour_pairs(left: DataFrame, right: DataFrame, shape: Shape, r: int | dict[str, int], carry: tuple[str, ...] = ("rho",)) -> DataFrame:
    """Every voxel of left with every voxel of right in the box of half-width r (one for all axes, or each axis its own).

    Voxels are dealt to blocks of BLOCK places an axis, those of right also to the neighbouring blocks that their box
    reaches: that halo is all that is copied before the shuffle. Probes to the places around a voxel are made after it,
    and find what stands there within their block. Columns of right have the prefix n_; d2 is the squared distance.
    """
    axes = list(shape)
    reach = {a: r if isinstance(r, int) else r[a] for a in axes}
    around = [o for o in product(*(range(-reach[a], reach[a] + 1) for a in axes)) if any(o)]
    step = lambda o: F.struct(*(F.lit(d).alias(a) for a, d in zip(axes, o, strict=True)))
    block = lambda a, d: F.greatest(F.floor((F.col(a) - 1 + d) / BLOCK), F.lit(0)).cast("int")
    own = left.select("tile", *axes, *(block(a, 0).alias(f"b_{a}") for a in axes), F.struct("idx", *carry).alias("probe"))
    there = right.select("tile", *axes, F.struct("idx", *carry).alias("there"))
    for a in axes:
        there = there.withColumn(f"b_{a}", F.explode(F.sequence(block(a, -reach[a]), block(a, reach[a]))))
    blocks = ["tile", *(f"b_{a}" for a in axes)]
    both = own.unionByName(there, allowMissingColumns=True).repartition(*blocks)
    steps = F.when(F.col("probe").isNotNull(), F.array(*map(step, around))).otherwise(F.array(step([0] * len(axes))))
    d2 = sum(F.col(f"o.{a}") * F.col(f"o.{a}") for a in axes)
    placed = both.select(*blocks, *axes, "probe", "there", F.explode(steps).alias("o")).select(
        *blocks, *axes, "probe", "there", *((F.col(a) + F.col(f"o.{a}")).alias(f"n_{a}") for a in axes), d2.alias("d2")
    )
    found = placed.withColumn("there", F.max("there").over(W.partitionBy(*blocks, *(f"n_{a}" for a in axes)))).where(F.col("probe").isNotNull() & F.col("there").isNotNull())
    return found.select(
        "tile", *axes, "probe.idx", *(f"probe.{c}" for c in carry), *(f"n_{a}" for a in axes), "d2", F.col("there.idx").alias("n_idx"), *(F.col(f"there.{c}").alias(f"n_{c}") for c in carry)
    )


def _best(pairs: DataFrame, shape: Shape) -> DataFrame:
    """(tile, idx, parent, d2, grad) of the nearest of each voxel's partners in pairs."""
    key = F.struct(F.col("d2"), *((-F.col(f"n_{a}")).alias(f"k_{a}") for a in shape))
    best = F.min(F.struct(key.alias("key"), F.col("n_idx"), F.col("n_rho")))
    grad = (F.col("b.n_rho") - F.col("rho")) / F.sqrt(F.col("b.key.d2"))
    return pairs.groupBy("tile", "idx", "rho").agg(best.alias("b")).select("tile", "idx", F.col("b.n_idx").alias("parent"), F.col("b.key.d2").alias("d2"), grad.alias("grad"))


def _denser(axes: list[str], reach: int):
    """Rows of blocks to their own voxels, with the nearest denser voxel of each; itself, at the distance 0, without one."""
    steps = sorted((o for o in product(range(-reach, reach + 1), repeat=len(axes)) if any(o)), key=lambda o: (sum(d * d for d in o), [-d for d in o]))
    side = BLOCK + 2 * reach

    def work(table: pa.Table, number: np.ndarray) -> pa.Table:
        place = number.astype(np.int64)
        for a in axes:
            place = place * side + table.column(a).to_numpy() - table.column(f"b_{a}").to_numpy() * BLOCK - 1 + reach
        idx, known = table.column("idx").to_numpy(), ~table.column("rho").is_null().to_numpy()
        level = np.full(len(table), -1)  # equal numbers for equal densities; nulls neither look nor are found
        level[known] = np.unique(table.column("rho").drop_null().to_numpy(), return_inverse=True)[1]
        order = np.lexsort((idx, level, place))
        order = order[known[order]]
        places = place[order]
        own = np.flatnonzero(table.column("own").to_numpy())
        found, d2 = own.copy(), np.zeros(len(own), dtype=np.int32)
        left = np.flatnonzero(known[own])
        for o in steps:
            if not len(left):
                break
            me, shift = own[left], 0
            for d in o:
                shift = shift * side + d
            at = np.searchsorted(places, place[me] + shift, side="right") - 1
            there = order[np.maximum(at, 0)]
            hit = (at >= 0) & (place[there] == place[me] + shift) & ((level[there] > level[me]) | ((level[there] == level[me]) & (idx[there] < idx[me])))
            found[left[hit]], d2[left[hit]] = there[hit], sum(d * d for d in o)
            left = left[~hit]
        mine = table.drop_columns(["own", *(f"b_{a}" for a in axes)]).take(pa.array(own))
        partner = table.select(["idx", "rho"]).take(pa.array(found))
        return mine.append_column("parent", partner.column("idx")).append_column("d2", pa.array(d2)).append_column("n_rho", partner.column("rho"))

    return work


def nearest_higher(bright: DataFrame, shape: Shape, reach: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """bright (tile, axes, idx, rho and the columns of carry) with parent, d2 and grad of each voxel's nearest denser
    neighbour; null without one.

    Denser is a total order: greater rho, then smaller idx. Nearest: least distance, then the last place in (x, y, v)
    order, among the voxels at most `reach` places away along every axis. Voxels are dealt to blocks of BLOCK places an
    axis and to those that their halo of `reach` places lies in: one shuffle, after which a task has all that its voxels
    can find, and looks at the places around them by distance until each has met a denser one. No pair becomes a row.
    """
    axes = list(shape)
    block = lambda a, d: F.floor((F.col(a) - 1 + d) / BLOCK).cast("int")
    rows = bright.select("tile", "idx", *axes, "rho", *carry)
    near, own = rows, F.lit(True)
    for a in axes:
        near = near.withColumn(f"b_{a}", F.explode(F.sequence(block(a, -reach), block(a, reach))))
        own &= block(a, 0) == F.col(f"b_{a}")
    blocks = [f"b_{a}" for a in axes]
    dealt = near.withColumn("own", own)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns) + f", parent {kinds['idx']}, d2 int, n_rho {kinds['rho']}"
    looked = by_block(dealt, ["tile", *blocks], _denser(axes, reach), schema)
    denser = F.col("d2") > 0
    grad = F.when(denser, (F.col("n_rho") - F.col("rho")) / F.sqrt("d2"))
    return looked.select(*rows.columns, F.when(denser, F.col("parent")).alias("parent"), F.when(denser, F.col("d2")).alias("d2"), grad.alias("grad"))


#: Edge of the smallest blocks of a pyramid, and how many blocks of a level a block of the next one has along an axis.
LEAF, FAN = 8, 4


def _levels(shape: Shape) -> int:
    """The level at which one block holds the cube."""
    top = 0
    while LEAF * FAN**top < max(shape.values()):
        top += 1
    return top


def _block(a: str, level: int) -> Column:
    return F.floor((F.col(a) - 1) / (LEAF * FAN**level)).cast("int")


def pyramid(bright: DataFrame, shape: Shape) -> DataFrame:
    """(tile, level, b_x, b_y, ..., top): the densest voxel of every block of every level that has any. One aggregation."""
    top = F.max(F.struct("rho", (-F.col("idx")).alias("order"), *shape)).alias("top")
    leaves = bright.groupBy("tile", *(_block(a, 0).alias(f"b_{a}") for a in shape)).agg(top)
    up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_levels(shape)))))
    wide = F.pow(F.lit(FAN), F.col("level"))
    return up.groupBy("tile", "level", *(F.floor(F.col(f"b_{a}") / wide).cast("int").alias(f"b_{a}") for a in shape)).agg(F.max("top").alias("top"))


def farther_higher(peaks: DataFrame, bright: DataFrame, shape: Shape) -> DataFrame:
    """(tile, idx, parent, d2, grad): the nearest denser voxel of each of peaks, however far it is; none for a tile's densest.

    A pyramid of the densest voxels of blocks is searched from its top. A block stays for a peak if its densest voxel is
    denser than the peak and the block lies no farther than the nearest of the densest voxels that the peak has met on
    this level; its own blocks are looked at next. So near blocks come before far ones and whole regions without a denser
    voxel are left out at once. Voxels of the smallest blocks that stay are compared at last, with ties as in
    nearest_higher(). Every level is a join on (tile, block) and an aggregation by peak.
    """
    axes = list(shape)
    blocks = [f"b_{a}" for a in axes]
    levels = cut_lineage(pyramid(bright, shape), "pyramid")
    found = peaks.select("tile", *axes, "idx", "rho").withColumns({b: F.lit(0) for b in blocks})
    denser = (F.col("top.rho") > F.col("rho")) | ((F.col("top.rho") == F.col("rho")) & (-F.col("top.order") < F.col("idx")))
    square = lambda terms: sum((t * t for t in terms[1:]), terms[0] * terms[0])
    for level in range(_levels(shape), -1, -1):
        side = LEAF * FAN**level
        here = levels.where(F.col("level") == level).select("tile", *blocks, "top", *(F.floor(F.col(b) / FAN).cast("int").alias(f"up_{b}") for b in blocks))
        above = found.select("tile", *axes, "idx", "rho", *(F.col(b).alias(f"up_{b}") for b in blocks))
        near = square([F.greatest(F.col(b) * side + 1 - F.col(a), F.col(a) - (F.col(b) + 1) * side, F.lit(0)).cast("long") for a, b in zip(axes, blocks, strict=True)])
        there = square([(F.col(f"top.{a}") - F.col(a)).cast("long") for a in axes])
        met = above.join(here, ["tile", *(f"up_{b}" for b in blocks)]).where(denser).withColumns({"near": near, "there": there})
        least = F.min("there").over(W.partitionBy("tile", "idx"))
        found = cut_lineage(met.withColumn("least", least).where(F.col("near") <= F.col("least")).select("tile", *axes, "idx", "rho", *blocks), "found")
    voxels = bright.select("tile", *(_block(a, 0).alias(f"b_{a}") for a in axes), *(F.col(a).alias(f"n_{a}") for a in axes), F.col("idx").alias("n_idx"), F.col("rho").alias("n_rho"))
    higher = (F.col("n_rho") > F.col("rho")) | ((F.col("n_rho") == F.col("rho")) & (F.col("n_idx") < F.col("idx")))
    d2 = square([(F.col(f"n_{a}") - F.col(a)).cast("long") for a in axes])
    return _best(found.join(voxels, ["tile", *blocks]).where(higher).withColumn("d2", d2), shape)


def nearest_higher_anywhere(bright: DataFrame, shape: Shape, reach: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """As nearest_higher(), but voxels without a denser one in the box look on through the whole tile. Only the densest
    voxel of a tile has no parent."""
    linked = cut_lineage(nearest_higher(bright, shape, reach, carry), "linked")
    alone = linked.where(F.col("parent").isNull()).drop("parent", "d2", "grad")
    far = farther_higher(alone, bright, shape)
    rest = alone.join(far, ["tile", "idx"], "left").select(*linked.columns)
    return linked.where(F.col("parent").isNotNull()).unionByName(rest)


def density_rank(bright: DataFrame) -> DataFrame:
    """bright with each voxel's rank in its tile, the densest first."""
    return ranked(bright, ["tile"], [F.desc("rho"), F.col("idx")], "rank")


def decision_graph(linked: DataFrame, delta_min: int = 4) -> DataFrame:
    """tile, idx, rho, delta and parent of every voxel: the distance of its denser neighbour, to choose centres by.

    A voxel without one is its own parent, farther than delta_min and than all others of its tile.
    """
    widest = linked.groupBy("tile").agg(F.sqrt(F.max("d2")).alias("widest"))
    alone = F.greatest(F.coalesce("widest", F.lit(0.0)), F.lit(delta_min + 0.001))
    return linked.join(widest, "tile").select("tile", "idx", "rho", F.coalesce(F.sqrt("d2"), alone).alias("delta"), F.coalesce("parent", "idx").alias("parent"))


def centres(linked: DataFrame, rho_min, delta_min: int = 4) -> DataFrame:
    """(tile, idx, clump_id) of the voxels over rho_min whose denser neighbour is over delta_min away or missing."""
    far = F.col("parent").isNull() | (F.col("d2") > delta_min * delta_min)
    return linked.where((F.col("rho") > rho_min) & far).select("tile", "idx", F.row_number().over(W.partitionBy("tile").orderBy("idx")).alias("clump_id"))
