"""Which clumps overlap, and the groups that overlaps form."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import FWHM, tile_keys
from ..tables import cut_lineage
from .graph import connected_components


def touches(d_centre: Column, s1: Column, s2: Column, mult: float = 1.0) -> Column:
    """Whether two clumps touch along one direction, clumps just in contact counting as touching."""
    return ~((s1 + s2) * mult < d_centre)


#: Clumps that a task of a join on cells gets of each side, about.
CLUMPS_A_TASK = 4_000


class _Cells:
    """A catalogue's clumps (keys, id, x, y, s and, in a cube, v, sv) with a class of size, and the cells in which they meet.

    Each class is twice as wide as the one before, its sky cells as wide as the greatest reach of two of its clumps. A
    clump stands in one cell of its own class and looks into those around its place in the cells of its own and every
    greater class, so that the theta join is an equi-join on cells and a clump as wide as the field does not make one
    cell of it. Cells of velocity are as wide as the greatest reach of all.
    """

    def __init__(self, catalog: DataFrame, mult: float):
        self.cube, self.keys, self.mult = "Cen3" in catalog.columns, tile_keys(catalog), mult
        s = catalog.select(
            *self.keys, F.col("ID").alias("id"), F.col("Cen1").alias("x"), F.col("Cen2").alias("y"),
            (F.sqrt(F.col("Size1") * F.col("Size1") + F.col("Size2") * F.col("Size2")) / FWHM).alias("s"),
            *([F.col("Cen3").alias("v"), (F.col("Size3") / FWHM).alias("sv")] if self.cube else []),
        )
        s = s.where((F.col("s") >= 0) & ~F.isnan("s") & (~F.isnan("sv") if self.cube else F.lit(True)))
        self.clumps = s.withColumn("class", F.ceil(F.log2(F.greatest("s", F.lit(1e-6)))).cast("int"))
        sizes = self.clumps.groupBy("class").agg(F.count("*"), F.max("s"), F.max("sv") if self.cube else F.lit(0.0)).collect()  # powers of two between the sizes
        # A hair wider than the reach, against rounding.
        wide = lambda top: 2 * mult * max(top or 0.0, 1e-6) * (1 + 1e-9)
        self.widths = {r[0]: wide(r[2]) for r in sizes}
        self.deep = wide(max((r[3] or 0.0 for r in sizes), default=0.0))
        self.rows = sum(r[1] for r in sizes)

    @property
    def axes(self) -> list[str]:
        return ["cx", "cy", "cv"] if self.cube else ["cx", "cy"]

    def _places(self, s: DataFrame, parts: int = 1) -> DataFrame:
        """s, with a column grid, in its cell of that class, or in one of `parts` parts of it along each axis."""
        wide = F.element_at(F.create_map(*(F.lit(k) for c, w in self.widths.items() for k in (c, w / parts))), F.col("grid")) if self.widths else F.lit(1.0)
        there = {"cx": F.floor(F.col("x") / wide), "cy": F.floor(F.col("y") / wide)} | ({"cv": F.floor(F.col("v") / (self.deep / parts))} if self.cube else {})
        return s.withColumns(there)

    def boxes(self, s: DataFrame, parts: int) -> DataFrame:
        """s in the parts of cells of its own classes."""
        return self._places(s.withColumn("grid", F.col("class")), parts)

    def _touch(self) -> Column:
        dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
        touch = (F.col("a.s") + F.col("b.s")) * self.mult > F.sqrt(dx * dx + dy * dy)
        return touch & ((F.col("a.sv") + F.col("b.sv")) * self.mult > F.abs(F.col("a.v") - F.col("b.v"))) if self.cube else touch

    def _met(self, looking: DataFrame, standing: DataFrame, steps, apart: Column) -> DataFrame:
        """The pairs a of looking, b of standing that touch, with the columns of a and b. steps: which cells around a clump
        looks into. Both sides are dealt by cells, none is sent to all tasks: crowds make few small rows, but much work."""
        classes = F.array(*map(F.lit, sorted(self.widths) or [0]))
        looks = self._places(looking.withColumn("grid", F.explode(F.filter(classes, lambda g: g >= F.col("class")))))
        looks = looks.withColumn("step", F.explode(steps)).withColumns({c: F.col(c) + F.col(f"step.{c}") for c in self.axes})
        stands = self.boxes(standing, 1)
        by = [*self.keys, "grid", *self.axes]
        tasks = 1 + self.rows // CLUMPS_A_TASK
        a, b = looks.repartition(tasks, *by).alias("a"), stands.repartition(tasks, *by).alias("b").hint("merge")
        same = reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in by))
        return a.join(b, same & apart & self._touch())

    def _around(self, keep=lambda o: True) -> list:
        return [F.struct(*(F.lit(d).cast("long").alias(c) for c, d in zip(self.axes, o, strict=True)), F.lit(any(o)).alias("off")) for o in product((-1, 0, 1), repeat=len(self.axes)) if keep(o)]

    def pairs(self) -> DataFrame:
        """(keys, src, dst), src < dst, of all clumps that touch. Of two neighbouring cells of a class one looks into the other."""
        ahead = F.array(*self._around(lambda o: o >= (0,) * len(o)))
        steps = F.when(F.col("grid") == F.col("class"), ahead).otherwise(F.array(*self._around()))
        once = (F.col("a.class") < F.col("b.class")) | (F.col("a.step.off") & (F.col("a.id") != F.col("b.id"))) | (F.col("a.id") < F.col("b.id"))
        met = self._met(self.clumps, self.clumps, steps, once)
        return met.select(*(F.col(f"a.{c}") for c in self.keys), F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst"))

    def links(self, some: DataFrame, others: DataFrame, carry: list[str] = ()) -> DataFrame:
        """(keys, a, b) of the clumps of some, and of others, that touch; columns `carry` of both as a_<name>, b_<name>."""
        steps, apart = F.array(*self._around()), F.col("a.id") != F.col("b.id")
        keys = [F.col(f"a.{c}") for c in self.keys]
        ends = lambda p, q: (*keys, *(F.col(f"{e}.{c}").alias(f"{n}{s}") for n, e in (("a", p), ("b", q)) for c, s in (("id", ""), *((k, f"_{k}") for k in carry))))
        up = self._met(some, others, steps, apart).select(*ends("a", "b"))
        down = self._met(others, some, steps, apart & (F.col("a.class") < F.col("b.class"))).select(*ends("b", "a"))
        return up.unionByName(down)


def overlap_pairs(catalog: DataFrame, mult: float = 0.8) -> DataFrame:
    """(src, dst), src < dst, of clumps nearer on the sky than mult times their summed sigma lengths, and in velocity
    nearer than mult times their summed velocity sigmas. A catalogue with tiles gives (tile, src, dst): clumps of
    different tiles do not meet. Clumps whose place or size is null or NaN overlap nothing."""
    return _Cells(catalog, mult).pairs()


def overlap_groups(catalog: DataFrame, mult: float = 0.8) -> DataFrame:
    """(ID, component), after tile if the catalogue has tiles: the least ID that chains of overlaps within a tile lead to,
    the clump's own if it overlaps none.

    Not all pairs are made, for in a crowd they grow as the square of the clumps. One clump of each of a grid of boxes,
    for each class of size, is its marker. Markers that touch are grouped, and every clump joins the group of one marker that it touches. What is
    then missing are links between groups, and one end of each lies outside its tile's largest group: the clumps
    outside, few where clumps are dense, look for all that they touch, and groups so linked are united.
    """
    keys = tile_keys(catalog)
    cells = _Cells(catalog, mult)
    clumps = cells.clumps = cut_lineage(cells.clumps.where(F.col("id").isNotNull()), "clumps")
    if not cells.rows:
        return catalog.select(*keys, "ID", F.col("ID").alias("component"))
    node = lambda c: F.struct(*keys, F.col(c).alias("ID"))
    boxes = cells.boxes(clumps, 2)
    top = F.max(F.struct("s", *(c for c in clumps.columns if c not in ("s", *keys)))).alias("m")
    markers = cut_lineage(boxes.groupBy(*keys, "grid", *cells.axes).agg(top).select(*keys, "m.*").select(*clumps.columns), "markers")
    marked = markers.select(*keys, F.col("id").alias("a"), F.lit(True).alias("marker"))
    met = cells.links(clumps, markers)
    first = cut_lineage(met.groupBy(*keys, "a").agg(F.min("b").alias("b")), "first")
    among = cells.links(markers, markers).where(F.col("a") < F.col("b"))
    found = connected_components(among.select(node("a").alias("src"), node("b").alias("dst")))
    group = found.select("node.*", F.col("component.ID").alias("group")).withColumnRenamed("ID", "b")
    # A marker is in its own group, another clump in that of the marker it touches.
    own = marked.withColumn("m", F.col("a")).unionByName(first.join(marked, [*keys, "a"], "left_anti").select(*keys, "a", F.col("b").alias("m"), F.lit(False).alias("marker")))
    named = own.join(group.withColumnRenamed("b", "m"), [*keys, "m"], "left").select(*keys, F.col("a").alias("id"), F.coalesce("group", "m").alias("group"))
    grouped = cut_lineage(clumps.join(named.hint("merge"), [*keys, "id"], "left").withColumn("group", F.coalesce("group", "id")), "grouped")
    sizes = grouped.groupBy(*keys, "group").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    largest = sizes.groupBy(*keys).agg(F.max(F.struct("n", "group"))["group"].alias("largest"))
    rest = grouped.join(largest, keys) if keys else grouped.crossJoin(largest)
    rest = cut_lineage(rest.where(F.col("group") != F.col("largest")).drop("largest"), "rest")
    bridges = cells.links(rest, grouped, ["group"]).where(F.col("a_group") != F.col("b_group")).select(*keys, "a_group", "b_group").distinct()
    united = connected_components(bridges.select(node("a_group").alias("src"), node("b_group").alias("dst"))).select("node.*", F.col("component.ID").alias("whole")).withColumnRenamed("ID", "group")
    whole = sizes.join(united, [*keys, "group"], "left").withColumn("whole", F.coalesce("whole", "group"))
    names = whole.join(whole.groupBy(*keys, "whole").agg(F.min("least").alias("component")), [*keys, "whole"]).select(*keys, "group", "component")
    named = grouped.select(*keys, "id", "group").join(names, [*keys, "group"]).select(*keys, F.col("id").alias("ID"), "component")
    return catalog.select(*keys, "ID").join(named.hint("merge"), [*keys, "ID"], "left").select(*keys, "ID", F.coalesce("component", "ID").alias("component"))
