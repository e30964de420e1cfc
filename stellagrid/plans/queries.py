"""The registered queries of source extraction, over cubes and catalogues derived from the given tables.

A cube counts the rows of lineitem by quantity, month (or discount and quarter); catalogues are arithmetic on keys.
Doubles are rounded at the end, counts are long, so that another engine's results can be compared by value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model, wcs
from ..operators import density, grid, labels, match, measure, mosaic, overlap, simulate, smooth
from ..params import DetectParams, MatchParams
from ..tables import cut_lineage
from . import detect

SHAPE2 = {"x": 50, "y": 83}
SHAPE3 = {"x": 50, "y": 11, "v": 28}
EDGES = ((3, 3), (3, 3), (2, 2))
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(*names: str) -> list[Column]:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def longs(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# Cubes and catalogues.


def cube2(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    return grid.voxelize(table(spark, sf_dir, "lineitem"), {"x": F.col("l_quantity"), "y": month}, F.count("*"))


def cube3(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate")
    return grid.voxelize(table(spark, sf_dir, "lineitem"), {"x": F.col("l_quantity"), "y": F.round(F.col("l_discount") * 100) + 1, "v": quarter}, F.count("*"))


def grid2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.dense_grid(cube2(spark, sf_dir), SHAPE2)


def grid3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.dense_grid(cube3(spark, sf_dir), SHAPE3)


def rho2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smooth.binomial(grid2(spark, sf_dir), SHAPE2)


def levels(rho: DataFrame) -> tuple[float, float]:
    """Mean, and mean plus one standard deviation, from exact integer sums."""
    n, s, q = rho.agg(F.count("*"), F.sum("rho"), F.sum(F.col("rho") * F.col("rho"))).first()
    if not n:
        return 0.0, 0.0
    mean = s / n
    return mean, mean + math.sqrt(q / n - mean * mean)


def supplier_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-dimensional cube of each block of 25 suppliers, smoothed: as many tiles as the tables have blocks.

    Tiles are numbers, which are shuffled and sorted with less work than names; block_name() names them.
    """
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    block = F.floor(F.col("l_suppkey") / 25)
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_suppkey").isNotNull())
    cubes = grid.voxelize(rows, {"x": F.col("l_quantity"), "y": month}, F.count("*"), block)
    return smooth.binomial(grid.dense_grid(cubes, SHAPE2, rows.select(block.alias("tile")).distinct()), SHAPE2)


def block_name() -> Column:
    return F.format_string("s%05d", F.col("tile")).alias("tile")


class Found:
    """The steps of detection on two-dimensional cubes, each made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, cubes=rho2):
        self.rho = cut_lineage(cubes(spark, sf_dir), "rho")
        self.noise, self.rho_min = levels(self.rho)
        self.bright = self.rho.where(F.col("rho") > self.noise)

    def linked(self) -> DataFrame:
        return cut_lineage(density.nearest_higher(self.bright, SHAPE2, 4, ("intensity",)), "linked")

    def labelled(self) -> DataFrame:
        linked = self.linked()
        return cut_lineage(labels.propagate(linked, density.centres(linked, self.rho_min, 4)), "labels")

    def clusters(self) -> DataFrame:
        return cut_lineage(labels.cut_boundaries(self.labelled(), 0.01), "clusters")

    def catalog(self) -> DataFrame:
        return measure.regions(self.clusters(), SHAPE2)


def catalog3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel catalogue from the keys of part."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("ID"),
        *((1 + (k * a % m) / 100.0).alias(f"Peak{i}") for i, (a, m) in enumerate(((7927, 11801), (104723, 11801), (1299721, 6801)), 1)),
        *((1 + (k * a % m) / 100.0).alias(f"Cen{i}") for i, (a, m) in enumerate(((7919, 11801), (104729, 11801), (1299709, 6801)), 1)),
        (4 + k % 5 + 0.5).alias("Size1"),
        (3 + k % 4 + 0.25).alias("Size2"),
        (5 + k % 6 + 0.125).alias("Size3"),
        (2 + k % 9 + (k % 16) / 16.0).alias("Peak"),
        (100 + k % 1000 + (k % 32) / 32.0).alias("Sum"),
        (30 + k % 400).alias("Volume"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("ID"), *((1 + (k * a % m) / 100.0).alias(f"Cen{i}") for i, (a, m) in enumerate(((7919, 11801), (104729, 11801), (1299709, 6801)), 1)),
        (3 + k % 4 + 0.5).alias("Size1"), (3 + k % 3 + 0.5).alias("Size2"), (3 + k % 5 + 0.5).alias("Size3"),
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections near the true places of the suppliers' keys; every ninth is far from all of them."""
    k = F.col("s_suppkey")
    far = F.when(k % 9 == 4, F.lit(500.0)).otherwise(F.lit(0.0))
    return table(spark, sf_dir, "supplier").select(
        k.alias("ID"), *((1 + (k * a % m) / 100.0 + (k * b % 15 - 7) / 10.0 + far).alias(f"Cen{i}") for i, (a, m, b) in enumerate(((7919, 11801, 7), (104729, 11801, 11), (1299709, 6801, 13)), 1))
    )


# Sources, grids and projections.


@query
def detect_2d(spark, sf_dir):
    """The flagship: the whole detection on the two-dimensional cube."""
    c = Found(spark, sf_dir).catalog()
    return c.select(*longs("ID", "Peak1", "Peak2"), *r6("Cen1", "Cen2", "Size1", "Size2"), *longs("Peak", "Sum", "Volume"))


@query
def detect_suppliers(spark, sf_dir):
    """The whole detection on the cubes of all blocks of suppliers at once."""
    c = Found(spark, sf_dir, supplier_cubes).catalog()
    return c.select(block_name(), *longs("ID", "Peak1", "Peak2"), *r6("Cen1", "Cen2", "Size1", "Size2"), *longs("Peak", "Sum", "Volume"))


@query
def voxelize_2d(spark, sf_dir):
    return cube2(spark, sf_dir).select(*longs("x", "y", "intensity"))


@query
def voxelize_3d(spark, sf_dir):
    return cube3(spark, sf_dir).select(*longs("x", "y", "v", "intensity"))


@query
def voxelize_events(spark, sf_dir):
    e = grid.voxelize(table(spark, sf_dir, "events"), {"x": F.col("user_id") % 50 + 1, "y": F.dayofmonth("ts")}, F.count("*"))
    return e.select(*longs("x", "y", "intensity"))


@query
def dense_grid(spark, sf_dir):
    return grid3(spark, sf_dir).select(*longs("x", "y", "v", "idx", "intensity"))


@query
def subcube_filter(spark, sf_dir):
    return grid.subcube(cube3(spark, sf_dir), SHAPE3, x=(-5, 20), v=(10, 99)).select(*longs("x", "y", "v", "intensity"))


@query
def nan_to_zero(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("intensity"))
    return grid.nan_to_zero(e).select("event_id", *r6("intensity"))


@query
def projection_maps(spark, sf_dir):
    return grid.projections(cube3(spark, sf_dir)).select("plane", *longs("x", "y", "v", "total"))


@query
def average_spectrum(spark, sf_dir):
    return grid.average_spectrum(grid3(spark, sf_dir)).select(*longs("v"), *r6("mean"))


@query
def lv_diagram(spark, sf_dir):
    return grid.position_velocity(grid3(spark, sf_dir), "x").select(*longs("v", "x"), *r6("mean"))


@query
def bv_diagram(spark, sf_dir):
    return grid.position_velocity(grid3(spark, sf_dir), "y").select(*longs("v", "y"), *r6("mean"))


@query
def bbox_crop(spark, sf_dir):
    f = Found(spark, sf_dir)
    boxes = grid.bounding_boxes(f.clusters(), SHAPE2)
    return grid.crop_boxes(f.rho, boxes, SHAPE2).groupBy("clump_id").agg(F.count("*").alias("voxels"), F.sum("intensity").alias("total")).select(*longs("clump_id", "voxels", "total"))


# Smoothing.


@query
def smooth_binomial(spark, sf_dir):
    return rho2(spark, sf_dir).select(*longs("x", "y", "rho"))


@query
def smooth_binomial_3d(spark, sf_dir):
    return smooth.binomial(grid3(spark, sf_dir), SHAPE3).select(*longs("x", "y", "v", "rho"))


@query
def smooth_gaussian(spark, sf_dir):
    k = smooth.gaussian_kernel(0.8)
    return smooth.smooth(grid2(spark, sf_dir), SHAPE2, {"x": k, "y": k}).select(*longs("x", "y"), *r6("rho"))


@query
def adaptive_density(spark, sf_dir):
    return smooth.adaptive_density(grid2(spark, sf_dir), SHAPE2).select(*longs("x", "y"), F.round("rho", 3).alias("rho"))


@query
def detail_residual(spark, sf_dir):
    return smooth.detail(grid2(spark, sf_dir), SHAPE2).select(*longs("x", "y"), *r6("blurred", "detail"))


@query
def difference_of_gaussians(spark, sf_dir):
    d = smooth.differences_of_gaussians(grid2(spark, sf_dir), SHAPE2)
    return d.select(*longs("x", "y", "level"), *r6("difference"))


@query
def background_rms_median(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("value").alias("intensity"))
    rms = measure.background_rms(None, noise_map=e)
    return spark.createDataFrame([(None if rms is None else round(rms, 6),)], "rms double")


@query
def offmask_rms(spark, sf_dir):
    f = Found(spark, sf_dir)
    return measure.off_mask_rms(f.rho, f.clusters()).select(*r6("rms"))


# Density peaks and labels.


@query
def noise_cut(spark, sf_dir):
    return Found(spark, sf_dir).bright.select(*longs("idx", "rho"))


@query
def neighbour_join(spark, sf_dir):
    b = Found(spark, sf_dir).bright
    return density.neighbour_pairs(b, b, SHAPE2, 1).groupBy("idx").agg(F.count("*").alias("n"), F.sum("n_rho").alias("total"), F.sum("d2").alias("d2")).select(*longs("idx", "n", "total", "d2"))


@query
def nearest_higher(spark, sf_dir):
    return Found(spark, sf_dir).linked().select(*longs("idx", "rho", "parent", "d2"), *r6("grad"))


@query
def density_rank(spark, sf_dir):
    return density.density_rank(Found(spark, sf_dir).bright).select(*longs("idx", "rank"))


@query
def cluster_centres(spark, sf_dir):
    f = Found(spark, sf_dir)
    return density.centres(f.linked(), f.rho_min, 4).select(*longs("idx", "clump_id"))


@query
def label_propagation(spark, sf_dir):
    return Found(spark, sf_dir).labelled().select(*longs("idx", "clump_id"))


@query
def gradient_boundary(spark, sf_dir):
    return Found(spark, sf_dir).clusters().select(*longs("idx", "clump_id"))


@query
def largest_component(spark, sf_dir):
    return labels.largest_part(Found(spark, sf_dir).clusters(), SHAPE2).select(*longs("idx", "clump_id", "part"))


@query
def area_span_filter(spark, sf_dir):
    return labels.large_enough(Found(spark, sf_dir).clusters(), SHAPE2, 15).groupBy("clump_id").agg(F.count("*").alias("n")).select(*longs("clump_id", "n"))


@query
def mask_relabel(spark, sf_dir):
    c = Found(spark, sf_dir).clusters().where(F.col("clump_id") % 3 != 1)
    return labels.renumber(c).select(*longs("idx", "clump_id"))


@query
def clump_points(spark, sf_dir):
    f = Found(spark, sf_dir)
    c = f.clusters()
    return grid.local_cube(grid.clump_points(f.rho, c, SHAPE2), SHAPE2).select(*longs("clump_id", "x", "y", "intensity"))


# Measures and catalogues.


@query
def peak_position(spark, sf_dir):
    return Found(spark, sf_dir).catalog().select(*longs("ID", "Peak1", "Peak2", "Peak"))


@query
def orientation(spark, sf_dir):
    # Where variances are equal the angle hangs on the last bit: such footprints are left to the operator's tests.
    c = Found(spark, sf_dir).clusters()
    spread = c.select("clump_id", "x", "y").distinct().groupBy("clump_id").agg(F.abs(F.var_pop("y") - F.var_pop("x")).alias("s"), F.abs(F.covar_pop("x", "y")).alias("c"))
    clear = spread.where((F.col("s") > 1e-6) & (F.col("c") > 1e-6)).select("clump_id")
    return measure.orientation(c).join(clear, "clump_id").select(*longs("clump_id"), *r6("Angle"))


@query
def touch_edge_filter(spark, sf_dir):
    return Found(spark, sf_dir).catalog().where(~measure.touches_edge(SHAPE2)).select(*longs("ID"))


@query
def local_region(spark, sf_dir):
    return Found(spark, sf_dir).catalog().where(measure.in_core(SHAPE2, EDGES)).select(*longs("ID"))


@query
def detect_counts(spark, sf_dir):
    tiles = spark.range(1).select(F.lit("t0").alias("tile"))
    return measure.detect_counts(Found(spark, sf_dir).catalog(), SHAPE2, EDGES, tiles).select(*longs("found", "clear", "core"))


@query
def round_catalog(spark, sf_dir):
    return measure.rounded(catalog3(spark, sf_dir), measure.PIXEL_DECIMALS).select(*longs("ID"), "Peak", "Sum", "Size3")


@query
def tile_ownership(spark, sf_dir):
    tiles = mosaic.tile_table(spark, mosaic.tiling({"x": 120, "y": 120}, 40, 10))
    c = catalog3(spark, sf_dir).withColumn("tile", F.format_string("y%03dx%03d", F.floor(F.col("ID") % 3), F.floor((F.col("ID") / 3).cast("long") % 3)))
    return mosaic.owned(c, tiles).select(*longs("ID"), "tile")


@query
def mosaic_stitch(spark, sf_dir):
    parts = mosaic.split(cube2(spark, sf_dir).drop("tile"), SHAPE2, 20, 5)
    return mosaic.stitch(parts, 20).select(*longs("x", "y", "intensity"))


@query
def tile_split(spark, sf_dir):
    return mosaic.split(cube2(spark, sf_dir).drop("tile"), SHAPE2, 20, 5).groupBy("tile").agg(F.count("*").alias("n"), F.sum("intensity").alias("total"))


@query
def tile_union(spark, sf_dir):
    c = catalog3(spark, sf_dir)
    return c.where(F.col("Cen1") <= 60).unionByName(c.where(F.col("Cen1") > 60)).groupBy((F.col("Cen1") > 60).alias("east")).agg(F.count("*").alias("n"), F.sum("Volume").alias("volume"))


@query
def row_setdiff(spark, sf_dir):
    a, b = cube2(spark, sf_dir).select("x", "y"), grid.voxelize(table(spark, sf_dir, "events"), {"x": F.col("user_id") % 50, "y": F.dayofmonth("ts")}, F.count("*")).select("x", "y")
    return a.exceptAll(b).select(*longs("x", "y"))


# World coordinates.


@query
def pix2world(spark, sf_dir):
    w = wcs.to_world(catalog3(spark, sf_dir).withColumn("k", F.col("ID")), wcs.Wcs())
    return w.select(*longs("k"), *r6("Peak1", "Peak2", "Peak3", "Cen1", "Cen2", "Cen3", "Size1", "Size2", "Size3"))


@query
def world2pix(spark, sf_dir):
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(k.alias("ID"), (15.5 + (k % 2001) / 1000.0).alias("lon"), ((k * 7 % 1501) / 1000.0).alias("lat"), (15.0 + (k % 401) / 10.0).alias("vel"))
    x, y = wcs.pixel(F.col("lon"), F.col("lat"), wcs.Wcs())
    return c.select(*longs("ID"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(wcs.channel(F.col("vel"), wcs.Wcs()), 6).alias("v"))


@query
def clump_id_format(spark, sf_dir):
    k = F.col("p_partkey")
    lon, lat, vel = (k * 37 % 36000) / 100.0, (k % 401 - 200) / 100.0, (k * 3 % 2001 - 1000) / 10.0
    return table(spark, sf_dir, "part").select(*longs("p_partkey"), wcs.clump_name(lon, lat, vel).alias("name"))


# Overlaps, models and fits.


@query
def overlap_pairs(spark, sf_dir):
    return overlap.overlap_pairs(catalog3(spark, sf_dir), 0.8).select(*longs("src", "dst"))


@query
def overlap_components(spark, sf_dir):
    return overlap.overlap_groups(catalog3(spark, sf_dir), 0.8).select(*longs("ID", "component"))


@query
def fit_initial_guess(spark, sf_dir):
    return model.initial_guess(catalog3(spark, sf_dir)).select(*longs("ID"), *r6("A", "x0", "y0", "s1", "s2", "theta", "v0", "s3"))


@query
def fit_bounds(spark, sf_dir):
    b = model.bounds(model.initial_guess(catalog3(spark, sf_dir)))
    return b.select(*longs("ID"), *r6("A_lo", "A_hi", "x0_lo", "x0_hi", "s1_lo", "s1_hi", "theta_lo", "theta_hi", "v0_lo", "s3_hi"))


@query
def gaussian_model(spark, sf_dir):
    g = model.initial_guess(catalog3(spark, sf_dir)).withColumn("theta", (F.col("ID") % 7) / 10.0)
    c = F.col
    value = model.gaussian(c("x0") + 1.5, c("y0") - 0.5, c("v0") + 1, *(c(n) for n in ("A", "x0", "y0", "s1", "s2", "theta", "v0", "s3")))
    return g.select(*longs("ID"), F.round(value, 6).alias("m"))


def _fits(spark, sf_dir) -> DataFrame:
    return model.initial_guess(catalog3(spark, sf_dir)).withColumns({"theta": (F.col("ID") % 50) / 10.0, "s1": F.lit(0.7) + (F.col("ID") % 3) / 4.0, "s2": F.lit(0.8) + (F.col("ID") % 5) / 4.0, "s3": F.lit(0.9) + (F.col("ID") % 2) / 4.0})


@query
def fit_flux_closed_form(spark, sf_dir):
    return _fits(spark, sf_dir).select(*longs("ID"), F.round(model.flux(*(F.col(c) for c in ("A", "s1", "s2", "s3"))), 6).alias("flux"))


@query
def fit_major_minor(spark, sf_dir):
    return model.fit_catalog(_fits(spark, sf_dir), 0.5).select(*longs("ID"), *r6("Size1", "Size2", "Theta", "Sum", "Flux_SNR", "Peak_SNR"))


@query
def fit_world_catalog(spark, sf_dir):
    c = catalog3(spark, sf_dir).withColumn("Theta", F.lit(10.0)).withColumn("k", F.col("ID"))
    w = wcs.fit_to_world(c.withColumn("Cost", F.col("k").cast("double")), wcs.Wcs())
    return w.select(F.col("Cost").cast("long").alias("k"), *r6("Galactic_Longitude", "Galactic_Latitude", "Velocity", "Size_major", "Size_minor", "Size_velocity", "Flux"))


@query
def multi_gauss_fit(spark, sf_dir):
    """Joint fits of overlapping clumps of the three-dimensional cube."""
    g = grid3(spark, sf_dir).withColumn("intensity", F.col("intensity").cast("double"))
    mean, sd = g.agg(F.avg("intensity"), F.stddev_pop("intensity")).first()
    p = DetectParams(rms=sd, noise_times=mean / sd, rms_times=(mean + 0.3 * sd) / sd, min_area=4, min_span=2, sigma=0.8, remove_edge=False)
    _, fitted = detect.detect_and_fit(g, SHAPE3, p)
    return fitted.drop("tile")


@query
def detect_fit_tiled(spark, sf_dir):
    """Detection and joint fits tile by tile on the three-dimensional cube."""
    g = grid3(spark, sf_dir).withColumn("intensity", F.col("intensity").cast("double"))
    mean, sd = g.agg(F.avg("intensity"), F.stddev_pop("intensity")).first()
    p = DetectParams(rms=sd, noise_times=mean / sd, rms_times=(mean + 0.3 * sd) / sd, min_area=4, min_span=2, sigma=0.8, remove_edge=False)
    return detect.detect_fit_tiled(g, SHAPE3, p, 25, 12)[1]


@query
def overlap_tiles(spark, sf_dir):
    """Groups of overlapping clumps in each of four tiles whose IDs are the same numbers, with a few clumps as wide as a tile."""
    k = F.col("ID")
    c = catalog3(spark, sf_dir).withColumns({"tile": F.concat(F.lit("t"), k % 4), "ID": F.floor(k / 4), "Size1": F.col("Size1") * F.when(k % 97 == 5, 20).otherwise(1)})
    return overlap.overlap_groups(c, 0.4).select("tile", *longs("ID", "component"))


@query
def fit_cost(spark, sf_dir):
    g = model.initial_guess(catalog3(spark, sf_dir))
    c = F.col
    value = model.gaussian(c("x0") + 1, c("y0"), c("v0"), *(c(n) for n in ("A", "x0", "y0", "s1", "s2", "theta", "v0", "s3")))
    return g.select((c("ID") % 10).alias("k"), (value - c("A")).alias("r")).groupBy("k").agg(F.round(F.sqrt(F.avg(c("r") * c("r"))), 6).alias("cost"))


# Matching.


def _matched(spark, sf_dir) -> match.MatchResult:
    return match.match_catalogs(truth(spark, sf_dir), found(spark, sf_dir), MatchParams())


@query
def match_pairs(spark, sf_dir):
    return _matched(spark, sf_dir).match.select(*longs("s_ID", "f_ID"), *r6("distance"))


@query
def match_miss(spark, sf_dir):
    return _matched(spark, sf_dir).miss.select(*longs("s_ID"))


@query
def match_false(spark, sf_dir):
    return _matched(spark, sf_dir).false.select(*longs("f_ID"))


@query
def match_metrics(spark, sf_dir):
    return _matched(spark, sf_dir).scores.select(*longs("matched", "n_truth", "n_found"), *r6("precision", "recall", "f1"))


# Simulation and statistics.


@query
def separability(spark, sf_dir):
    c = catalog3(spark, sf_dir).select(F.lit("t0").alias("tile"), "ID", F.col("Cen1").alias("x"), F.col("Cen2").alias("y"), F.col("Cen3").alias("v"), (F.col("Size1") / 4).alias("s"), (F.col("Size3") / 4).alias("sv"))
    return simulate.separable_from(c.where(F.col("ID") % 2 == 1), c.where(F.col("ID") % 2 == 0)).select(*longs("ID"))


@query
def render_model(spark, sf_dir):
    c = model.initial_guess(catalog3(spark, sf_dir)).withColumn("tile", F.concat(F.lit("t"), F.col("ID") % 4))
    return simulate.render(c, {"x": 120, "y": 120, "v": 70}).groupBy("tile", "v").agg(F.round(F.sum("intensity"), 4).alias("total"), F.count("*").alias("n")).select("tile", *longs("v", "n"), "total")


@query
def lognormal_fit(spark, sf_dir):
    return simulate.lognormal_fit(table(spark, sf_dir, "lineitem"), "l_extendedprice").select(*r6("sigma", "scale"), *longs("n"))


@query
def histogram(spark, sf_dir):
    return simulate.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 25).select(*longs("bin", "n"))


@query
def rank_correlation(spark, sf_dir):
    h = simulate.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 25)
    low, high = table(spark, sf_dir, "lineitem").agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    fit = simulate.lognormal_fit(table(spark, sf_dir, "lineitem"), "l_extendedprice").first()
    middle = float(low) + (F.col("bin") + 0.5) * (float(high) - float(low)) / 25
    return simulate.spearman(h.withColumns({"a": F.col("n").cast("double"), "b": simulate.lognormal_density(middle, fit["sigma"], fit["scale"])}), "a", "b").select(*r6("rho"))


def _prices(spark, sf_dir) -> DataFrame:
    """Another distribution of prices: that of line items, scaled to orders."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * 4).alias("o_totalprice"))


@query
def stratified_quota(spark, sf_dir):
    q = simulate.stratified_quota(table(spark, sf_dir, "orders"), _prices(spark, sf_dir), "o_totalprice", 20000.0, 1000)
    return q.select(*longs("stratum", "quota", "available"), *r6("share"))


@query
def stratified_resample(spark, sf_dir):
    return simulate.stratified_resample(table(spark, sf_dir, "orders"), _prices(spark, sf_dir), "o_totalprice", 20000.0, 1000).select(*longs("o_orderkey"), *r6("o_totalprice"))


@query
def random_sample(spark, sf_dir):
    return simulate.random_rows(table(spark, sf_dir, "orders"), 100).select(*longs("o_orderkey"))


@query
def clump_spectrum(spark, sf_dir):
    g = grid3(spark, sf_dir)
    lab = g.where(F.col("intensity") > 3).withColumn("clump_id", (F.floor((F.col("x") - 1) / 10) + 1).cast("int"))
    return grid.clump_spectra(g, lab, SHAPE3).select(*longs("clump_id", "v"), *r6("mean"))


@query
def simulate_cube(spark, sf_dir):
    """A cube of placed clumps for each block of ten suppliers, its components read back by detection-free sums."""
    tiles = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.floor(F.col("s_suppkey") / 10)).alias("tile")).distinct()
    shape = {"x": 40, "y": 40, "v": 24}
    voxels, components = simulate.simulate_cubes(tiles, shape, 4)
    totals = voxels.groupBy("tile").agg(F.sum("intensity").alias("total"), F.max("intensity").alias("top"))
    return totals.join(components.groupBy("tile").agg(F.count("*").alias("clumps")), "tile")


@query
def detect_3d(spark, sf_dir):
    """Detection with adaptive density on the three-dimensional cube."""
    g = grid3(spark, sf_dir).withColumn("intensity", F.col("intensity").cast("double"))
    mean, sd = g.agg(F.avg("intensity"), F.stddev_pop("intensity")).first()
    p = DetectParams(rms=sd, noise_times=mean / sd, rms_times=(mean + 0.5 * sd) / sd, min_area=4, min_span=2, remove_edge=False)
    return detect.detect(g, SHAPE3, p).catalog.drop("tile")


@query
def detect_tiled(spark, sf_dir):
    """Detection tile by tile on the two-dimensional cube, in world coordinates."""
    g = grid2(spark, sf_dir).withColumn("intensity", F.col("intensity").cast("double"))
    mean, sd = g.agg(F.avg("intensity"), F.stddev_pop("intensity")).first()
    p = DetectParams(rms=sd, noise_times=mean / sd, rms_times=(mean + 0.5 * sd) / sd, min_area=9, sigma=0.8, remove_edge=False)
    return detect.detect_tiled(g, SHAPE2, p, 25, 12, wcs.Wcs()).drop("tile")


@query
def multiscale_detect(spark, sf_dir):
    """Clumps of what a blur takes away, fitted jointly."""
    g = grid2(spark, sf_dir).withColumn("intensity", F.col("intensity").cast("double"))
    mean, sd = g.agg(F.avg("intensity"), F.stddev_pop("intensity")).first()
    p = DetectParams(rms=sd, noise_times=mean / sd, rms_times=(mean + 0.5 * sd) / sd, min_area=9, sigma=0.8, remove_edge=False)
    fine = DetectParams(rms=1.0, noise_times=0.3, rms_times=0.8, min_area=4, sigma=0.6, remove_edge=False)
    _, small, fits = detect.detect_multiscale(g, SHAPE2, p, fine)
    return small.catalog.select("ID", "Peak1", "Peak2", "Volume") if fits is None else fits.drop("tile")


# World ranges, spectra at peaks, boxes by size, and what else works on them.

#: A header whose reference pixel lies in the cube, south of the equator.
SOUTH = wcs.Wcs(crval=(30.0, -1.25, 12000.0), crpix=(20.0, 6.0, 4.0))
RANGES = {"lon": (29.904, 30.096), "lat": (-9.0, -1.24), "vel": (12.1, 99.0)}


@query
def world_range_filter(spark, sf_dir):
    return grid.world_subcube(cube3(spark, sf_dir), SOUTH, **RANGES).select(*longs("x", "y", "v", "intensity"))


@query
def world_range_clamp(spark, sf_dir):
    return grid.world_ranges(cube3(spark, sf_dir), SOUTH, **RANGES).select("axis", *r6("low", "high"), "moved")


@query
def pix2world_south(spark, sf_dir):
    """Places of a southern header, and the way back."""
    c = catalog3(spark, sf_dir).select("ID", "Cen1", "Cen2")
    lon, lat = wcs.sky(F.col("Cen1"), F.col("Cen2"), SOUTH)
    placed = c.select("ID", lon.alias("lon"), lat.alias("lat"))
    x, y = wcs.pixel(F.col("lon"), F.col("lat"), SOUTH)
    return placed.select(*longs("ID"), *r6("lon", "lat"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query
def peak_spectrum(spark, sf_dir):
    k = F.col("p_partkey")
    peaks = table(spark, sf_dir, "part").select(F.lit("t0").alias("tile"), k.alias("ID"), (1 + k * 7 % 50).alias("Peak1"), (1 + k * 3 % 11).alias("Peak2"), (1 + k * 5 % 28).alias("Peak3"))
    return grid.peak_spectra(grid3(spark, sf_dir), peaks, SHAPE3, 6).select(*longs("clump_id", "v", "peak"))


def _world_fits(spark, sf_dir) -> DataFrame:
    c = catalog3(spark, sf_dir).withColumns({"Theta": (F.col("ID") % 180).cast("double"), "Flux_SNR": F.col("ID") / 7.0, "Peak_SNR": F.col("ID") / 11.0, "Cost": F.col("ID").cast("double")})
    return wcs.fit_to_world(c, wcs.Wcs())


@query
def fit_world2pix(spark, sf_dir):
    p = wcs.fit_to_pixel(_world_fits(spark, sf_dir), wcs.Wcs())
    return p.select(F.col("Cost").cast("long").alias("k"), *r6("Cen1", "Cen2", "Cen3", "Size1", "Size2", "Size3", "Theta", "Peak", "Sum", "Flux_SNR"))


@query
def fit_world_rounded(spark, sf_dir):
    # The world places are irrational; a thousandth is far coarser than what engines differ by.
    r = measure.rounded(_world_fits(spark, sf_dir), measure.FIT_WORLD_DECIMALS)
    return r.select(F.col("Cost").cast("long").alias("k"), *r6("Galactic_Longitude", "Galactic_Latitude", "Size_major", "Size_minor", "Theta", "Peak"))


@query
def sized_boxes(spark, sf_dir):
    c = catalog3(spark, sf_dir).withColumn("tile", F.lit("t0"))
    return grid.sized_boxes(c, {"x": 120, "y": 120, "v": 70}).select(*longs("clump_id", "x_lo", "x_hi", "y_lo", "y_hi", "v_lo", "v_hi"))


@query
def world_axes(spark, sf_dir):
    c = catalog3(spark, sf_dir).withColumn("tile", F.lit("t0"))
    a = grid.world_axes(c, grid.sized_boxes(c, {"x": 120, "y": 120, "v": 70}), wcs.Wcs())
    return a.select(*longs("clump_id"), *r6("lon_lo", "lon_hi", "lat_lo", "lat_hi", "vel_lo", "vel_hi"))


@query
def neighbour_box(spark, sf_dir):
    """Neighbours in a box that is wider in x and y than in v."""
    c = cube3(spark, sf_dir).withColumn("idx", grid.voxel_index(SHAPE3)).where(F.col("intensity") > 4)
    near = density.neighbour_pairs(c, c, SHAPE3, {"x": 2, "y": 2, "v": 1}, ("intensity",))
    return near.groupBy("idx").agg(F.count("*").alias("n"), F.sum("n_intensity").alias("total"), F.sum("d2").alias("d2")).select(*longs("idx", "n", "total", "d2"))


@query
def fill_holes(spark, sf_dir):
    """The holes of bright places in ten stripes of the cube."""
    c = cube2(spark, sf_dir).withColumn("idx", grid.voxel_index(SHAPE2))
    stripes = c.where(F.col("intensity") > 12).withColumn("clump_id", F.floor((F.col("y") - 1) / 10))
    return labels.fill_holes(stripes, SHAPE2).select(*longs("clump_id", "idx"))


@query
def mosaic_masks(spark, sf_dir):
    """Bright places of tiles as one mask, numbered over all tiles."""
    parts = mosaic.split(cube2(spark, sf_dir).drop("tile"), SHAPE2, 20, 0).withColumn("idx", grid.voxel_index(SHAPE2))
    lab = parts.where(F.col("intensity") > 12).withColumn("clump_id", F.col("x") % 3 + 1)
    kept = lab.where(F.col("clump_id") != 2).select("tile", F.col("clump_id").alias("ID")).distinct()
    return mosaic.merge_masks(lab, kept).select(*longs("idx", "clump_id"))


@query
def decision_graph(spark, sf_dir):
    return density.decision_graph(Found(spark, sf_dir).linked(), 4).select(*longs("idx", "rho", "parent"), *r6("delta"))


@query
def fit_in_bounds(spark, sf_dir):
    """Which of the fits lie within the bounds of their start values."""
    b = model.bounds(model.initial_guess(catalog3(spark, sf_dir)))
    moved = b.withColumns({"x0": F.col("x0") + (F.col("ID") % 5 - 2), "s1": F.col("s1") * (F.col("ID") % 3 + 0.25)})
    return moved.select(*longs("ID"), model.in_bounds(moved).alias("inside"))


@query
def catalog_names(spark, sf_dir):
    """The pixel catalogue with the names its clumps have in the world catalogue, joined by ID."""
    c = catalog3(spark, sf_dir)
    w = wcs.to_world(c, wcs.Wcs(), keep_id=True).select(F.col("PixelID").alias("ID"), F.col("Cen1").alias("lon"), F.length("ID").alias("letters"))
    return c.join(w, "ID").select(*longs("ID", "letters"), *r6("Cen1", "lon"))


@query
def pix2world_fixed(spark, sf_dir):
    """World coordinates with the usual resolution, whatever the header says."""
    w = wcs.to_world_fixed(catalog3(spark, sf_dir).withColumn("k", F.col("ID")), wcs.Wcs(resolution=(7.0, 7.0, 7.0)))
    return w.select(*longs("k"), *r6("Cen1", "Cen3", "Size1", "Size3"))


@query
def mosaic_rows(spark, sf_dir):
    """The cubes of the two halves of the months, and both above each other."""
    c = cube2(spark, sf_dir).select("x", "y", "intensity")
    low, high = c.where(F.col("y") <= 41), c.where(F.col("y") > 41).withColumn("y", F.col("y") - 41)
    return mosaic.stack([low, high], "y", 41).select(*longs("x", "y", "intensity"))


@query
def detect_log(spark, sf_dir):
    """The log of a detection: its parameters and counts, without the date."""
    f = Found(spark, sf_dir)
    p = DetectParams(rms=2.0)
    return detect.detect_log(p, SHAPE2, detect.Detection(f.clusters(), f.catalog(), f.rho)).select("shape", "rms", "delta_min", "sigma", *longs("clumps"))


# Denser voxels anywhere, parts by runs, and masks across seams.


@query
def nearest_higher_anywhere(spark, sf_dir):
    """The nearest denser voxel of every bright one, however far."""
    b = Found(spark, sf_dir).bright
    return density.nearest_higher_anywhere(b, SHAPE2, 4).select(*longs("idx", "rho", "parent", "d2"), *r6("grad"))


@query
def decision_graph_anywhere(spark, sf_dir):
    """Distances to choose centres by, exact for all voxels but a tile's densest."""
    linked = density.nearest_higher_anywhere(Found(spark, sf_dir, supplier_cubes).bright, SHAPE2, 4)
    return density.decision_graph(linked, 4).select(block_name(), *longs("idx", "rho", "parent"), *r6("delta"))


@query
def connected_parts(spark, sf_dir):
    """Connected parts of the well-filled cells of every block of suppliers, even and odd counts apart."""
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    block = F.format_string("s%05d", F.floor(F.col("l_suppkey") / 25))
    cubes = grid.voxelize(table(spark, sf_dir, "lineitem"), {"x": F.col("l_quantity"), "y": month}, F.count("*"), block).withColumn("idx", grid.voxel_index(SHAPE2))
    lab = cubes.where(F.col("intensity") > 5).withColumn("clump_id", F.col("intensity") % 2)
    return labels.parts(lab, SHAPE2).select("tile", *longs("idx", "clump_id", "part"))


@query
def reconcile_masks(spark, sf_dir):
    """Connected parts found in overlapping tiles as one mask of the field."""
    f = Found(spark, sf_dir)
    cells = f.rho.where(F.col("rho") > f.rho_min).select("x", "y", "idx").withColumn("clump_id", F.lit(1))
    found = labels.parts(mosaic.split(cells, SHAPE2, 20, 5), SHAPE2)
    return mosaic.reconcile_masks(found.select("tile", "idx", F.col("part").alias("clump_id"))).select(*longs("idx", "mosaic_id"))


@query
def region_extras(spark, sf_dir):
    """Clumps with further measures of the same pass: squares, the faintest voxel, voxels well above the noise."""
    f = Found(spark, sf_dir)
    i = F.col("intensity")
    c = measure.regions(f.clusters(), SHAPE2, {"Squares": F.sum(i * i), "Least": F.min(i), "Bright": F.count_if(F.col("rho") > f.rho_min)})
    return c.select(*longs("ID", "Volume", "Squares", "Least", "Bright"), *r6("Cen1"))


@query
def match_lattice(spark, sf_dir):
    """Suppliers' places on a line against customers' places between them: chains of equal distances."""
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(k.alias("ID"), (2.0 * k).alias("Cen1"), F.lit(1.0).alias("Cen2"), F.lit(9.0).alias("Size1"), F.lit(9.0).alias("Size2"))
    c = F.col("c_custkey")
    f = table(spark, sf_dir, "customer").select(c.alias("ID"), (2.0 * c + 1).alias("Cen1"), F.lit(1.0).alias("Cen2"))
    return match.match_catalogs(t, f, MatchParams()).match.select(*longs("s_ID", "f_ID"), *r6("distance"))
