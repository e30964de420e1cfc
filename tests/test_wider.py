"""Sources, sinks and operators beyond the detection itself."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stellagrid import params, tables
from stellagrid.functions import wcs
from stellagrid.operators import density, grid, match, measure, rank, simulate
from stellagrid.params import MatchParams
from stellagrid.sources import catalog, fits


def test_a_clump_that_sums_to_nothing(spark):
    df = spark.createDataFrame([("t", 1, x, 1, x - 1, float(i)) for x, i in ((1, 2), (2, -2))] + [("t", 2, 3, 1, 2, 1.0)], "tile string, clump_id int, x int, y int, idx long, intensity double")
    got = {r["ID"]: r for r in measure.regions(df, {"x": 5, "y": 5}).collect()}
    assert got[1]["Cen1"] is None and got[1]["Size1"] is None and got[1]["Sum"] == 0 and got[1]["Volume"] == 2 and got[1]["Peak1"] == 1
    assert got[2]["Cen1"] == 3


def test_ranks_over_many_ranges(spark):
    r = random.Random(1)
    rows = [(g, r.randrange(50), k) for k in range(3000) for g in ["big" if r.random() < 0.8 else r.choice("abc")]]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(7)
    got = {x["id"]: x["rank"] for x in rank.ranked(df, ["g"], [F.desc("v"), F.col("id")]).collect()}
    for g in {x[0] for x in rows}:
        want = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        assert [got[x[2]] for x in want] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 9, [-1e308, 1e308, 0.0, 1e-320, 2e-320], [None, float("nan"), 4.0, -2.0, 7.5]])
def test_exact_median(spark, values):
    want = statistics.median([0.0 if v is None or math.isnan(v) else v for v in values])
    assert rank.median(spark.createDataFrame([(v,) for v in values], "intensity double"), "intensity") == pytest.approx(want)


def test_exact_median_of_many(spark):
    r = random.Random(3)
    values = [r.gauss(0, 1) ** 3 for _ in range(4001)] + [1e6] * 5
    df = spark.createDataFrame([(v,) for v in values], "intensity double").repartition(5)
    assert measure.background_rms(None, noise_map=df) == statistics.median(values)
    assert rank.median(df.limit(0), "intensity") is None


def test_neighbours_across_blocks(spark):
    """Every pair in the box, over the edges of blocks and of the cube."""
    r = random.Random(5)
    cells = sorted({(r.randint(1, 80), r.randint(1, 70), r.randint(1, 40)) for _ in range(2500)})
    shape = {"x": 80, "y": 70, "v": 40}
    df = spark.createDataFrame([("t", x, y, v, ((v - 1) * 70 + y - 1) * 80 + x - 1, 1.0) for x, y, v in cells], "tile string, x int, y int, v int, idx long, rho double")
    got = sorted((p["x"], p["y"], p["v"], p["n_x"], p["n_y"], p["n_v"], p["d2"]) for p in density.neighbour_pairs(df, df, shape, {"x": 3, "y": 1, "v": 2}).collect())
    near = lambda a, b: a != b and abs(a[0] - b[0]) <= 3 and abs(a[1] - b[1]) <= 1 and abs(a[2] - b[2]) <= 2
    assert got == sorted((*a, *b, sum((p - q) ** 2 for p, q in zip(a, b, strict=True))) for a in cells for b in cells if near(a, b))
    plan = density.neighbour_pairs(df, df, shape, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # voxels and halo move, probes do not


def test_dense_grid_moves_lines_only(spark):
    df = spark.createDataFrame([("t", 2, 1, 5.0), ("t", 9, 1, 7.0), ("u", 3, 2, None)], "tile string, x int, y int, intensity double")
    got = grid.dense_grid(df, {"x": 3, "y": 2})
    assert sorted((r["tile"], r["idx"], r["intensity"]) for r in got.collect()) == sorted((t, k, 5.0 if (t, k) == ("t", 1) else 0.0) for t in "tu" for k in range(6))


@pytest.mark.parametrize("latitude", [-70.0, -1.0, 0.0, 42.0])
def test_round_trips_on_both_hemispheres(spark, latitude):
    w = wcs.Wcs(crval=(200.0, latitude, 0.0), crpix=(10.0, 10.0, 1.0))
    df = spark.range(60).select((F.col("id") % 9 * 2.5).alias("p"), (F.col("id") % 7 * 3.0).alias("q"))
    lon, lat = wcs.sky(F.col("p"), F.col("q"), w)
    x, y = wcs.pixel(F.col("lon"), F.col("lat"), w)
    for r in df.select("p", "q", lon.alias("lon"), lat.alias("lat")).withColumns({"x": x, "y": y}).collect():
        assert (r["x"], r["y"]) == pytest.approx((r["p"], r["q"]), abs=1e-9)
    at = spark.range(1).select(*wcs.sky(F.lit(10.0), F.lit(10.0), w)).first()
    north = spark.range(1).select(wcs.sky(F.lit(10.0), F.lit(12.0), w)[1]).first()[0]
    assert tuple(at) == pytest.approx((200.0, latitude)) and north > latitude


def test_fits_through_the_file_systems(spark, tmp_path):
    shape = {"x": 40, "y": 30, "v": 9}
    a = np.random.default_rng(2).normal(size=(9, 30, 40))
    voxels = spark.createDataFrame([(k, float(v)) for k, v in enumerate(a.ravel()) if k % 5 and not 2400 <= k < 4800], "idx long, intensity double").repartition(4)
    path = str(tmp_path / "cube.fits")
    fits.write_fits(voxels, shape, path, {"OBJECT": "x", **{f"H{k}": k for k in range(60)}})  # a header of several blocks
    header, back = fits.read_fits(spark, "file://" + path)
    want = np.where((np.arange(a.size) % 5 == 0) | ((np.arange(a.size) >= 2400) & (np.arange(a.size) < 4800)), 0.0, a.ravel())
    rows = back.orderBy("idx").collect()
    assert header["H59"] == 59 and np.allclose([r["intensity"] for r in rows], want)
    assert all(r["idx"] == ((r["v"] - 1) * 30 + r["y"] - 1) * 40 + r["x"] - 1 for r in rows)
    mask = spark.createDataFrame([(3, 1), (70, 2)], "idx long, clump_id int")
    fits.write_mask(mask, {"x": 10, "y": 8}, str(tmp_path / "mask.fits"))
    _, read = fits.read_fits(spark, str(tmp_path / "mask.fits"))
    assert [(r["idx"], r["intensity"]) for r in read.where("intensity > 0").orderBy("idx").collect()] == [(3, 1.0), (70, 2.0)]


def test_sinks_can_be_read_back(spark, tmp_path):
    t = spark.createDataFrame([(1, 10.0, 10.0, 3.0, 3.0), (2, 50.0, 50.0, 3.0, 3.0)], "ID long, Cen1 double, Cen2 double, Size1 double, Size2 double")
    f = spark.createDataFrame([(7, 10.5, 10.0), (8, 90.0, 90.0)], "ID long, Cen1 double, Cen2 double")
    catalog.write_matches(match.match_catalogs(t, f, MatchParams()), str(tmp_path), "000")
    ids = lambda name, c: [int(float(r[c])) for r in catalog.read_catalog(spark, str(tmp_path / f"{name}_000")).collect()]
    assert ids("Match", "s_ID") == [1] and ids("Match", "f_ID") == [7] and ids("Miss", "s_ID") == [2] and ids("False", "f_ID") == [8]
    fitted = spark.createDataFrame([(k % 2, 9 - k, k / 3) for k in range(6)], "component int, ID int, A double")
    catalog.write_fit_groups(fitted, str(tmp_path / "fits"))
    assert [r["ID"] for r in catalog.collect_fit_groups(spark, str(tmp_path / "fits")).collect()] == [4, 5, 6, 7, 8, 9]
    world = spark.createDataFrame([("n", 17.23456, 0.98765, 12.3456, 120.5, 91.4, 1.2345, 33.5, 2.25, 10.04)], "ID string, Galactic_Longitude double, Galactic_Latitude double, Velocity double, Size_major double, Size_minor double, Size_velocity double, Theta double, Peak double, Flux double")
    catalog.write_fit_world(world, str(tmp_path / "world"))
    got = catalog.read_catalog(spark, str(tmp_path / "world")).first()
    assert got[1:] == (17.235, 0.988, 12.35, 120.0, 91.0, 1.23, 34.0, 2.2, 10.0)
    catalog.write_spaced(t, str(tmp_path / "spaced"))
    assert catalog.read_catalog(spark, str(tmp_path / "spaced")).count() == 2
    catalog.write_fixed_width(t, str(tmp_path / "fixed"))
    assert all(len(r[0]) == 5 * 14 for r in spark.read.text(str(tmp_path / "fixed")).collect())
    (tmp_path / "log.txt").write_text("date: 1\nfile: /data/a.fits\n")
    assert catalog.log_value(spark, str(tmp_path / "log.txt")) == "/data/a.fits"


def test_samples_belong_to_their_rows(spark):
    df = spark.range(500)
    one = {r[0] for r in simulate.random_rows(df.repartition(3), 40, seed=1).collect()}
    assert len(one) == 40 and one == {r[0] for r in simulate.random_rows(df.repartition(9, "id"), 40, seed=1).collect()}
    assert one != {r[0] for r in simulate.random_rows(df, 40, seed=2).collect()}


def test_cut_tables_can_be_dropped(spark):
    t = tables.cut_lineage(spark.range(5), "five")
    assert t.count() == 5
    tables.drop(t, spark.range(1))
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(t.cut_path).count()
    assert Row(id=1) in tables.cut_lineage(spark.range(3)).collect()


def test_configuration(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# detection\nrms: 0.5\ndelta_min: 6  # voxels\nsigma: 0.8\nremove_edge: false\nid_prefix: 'XY'\ndata_name: /a/b.fits\n")
    config = params.read_config(spark, str(tmp_path / "c.yaml"))
    p = params.from_config(params.DetectParams, config)
    assert (p.rms, p.delta_min, p.sigma, p.remove_edge, p.id_prefix, p.min_area) == (0.5, 6, 0.8, False, "XY", 25) and config["data_name"] == "/a/b.fits"
    with pytest.raises(Exception):  # noqa: B017
        params.read_config(spark, str(tmp_path / "none.yaml"))


def test_subcubes_are_written_with_their_header(spark, tmp_path):
    shape = {"x": 6, "y": 5, "v": 4}
    voxels = spark.range(120).select(F.lit("t").alias("tile"), (F.col("id") % 6 + 1).alias("x"), (F.floor(F.col("id") / 6) % 5 + 1).alias("y"), (F.floor(F.col("id") / 30) + 1).alias("v"), F.col("id").cast("double").alias("intensity"))
    small = fits.write_subcube(voxels, shape, str(tmp_path / "s.fits"), {"CRPIX1": 3.0, "CRPIX2": 3.0}, x=(2, 99), v=(-4, 2))
    header, back = fits.read_fits(spark, str(tmp_path / "s.fits"))
    assert small == {"x": 5, "y": 5, "v": 2} and (header["CRPIX1"], header["CRPIX2"]) == (2.0, 3.0)
    assert {(r["x"], r["y"], r["v"]): r["intensity"] for r in back.collect()} == {(r["x"] - 1, r["y"], r["v"]): r["intensity"] for r in voxels.where("x >= 2 and v <= 2").collect()}


def test_folders_by_name_and_local_catalogues(spark, tmp_path):
    c = spark.createDataFrame([(1, 2.0, 5.0), (2, 5.0, 5.0)], "ID long, Cen1 double, Cen2 double")
    catalog.write_local_catalog(c, str(tmp_path / "loc"), {"x": 10, "y": 10}, ((3, 3), (3, 3)))
    assert [r["ID"] for r in catalog.read_catalog(spark, str(tmp_path / "loc")).collect()] == [2]
    for k, name in enumerate(("fit_001.csv", "fit_002.csv", "other.txt")):
        (tmp_path / name).write_text(f"ID,A\n{k},1.5\n")
    assert sorted(r["ID"] for r in catalog.read_catalog(spark, str(tmp_path), names="fit_*.csv").collect()) == [0, 1]


def test_peak_spectra_end_with_the_cube(spark):
    cube = spark.createDataFrame([("t", 2, 3, v, float(v)) for v in range(1, 9) if v != 4], "tile string, x int, y int, v int, intensity double")
    peaks = spark.createDataFrame([("t", 1, 2, 3, 2), ("t", 2, 2, 3, 7)], "tile string, ID int, Peak1 int, Peak2 int, Peak3 int")
    got = sorted((r["clump_id"], r["v"], r["peak"]) for r in grid.peak_spectra(cube, peaks, {"x": 4, "y": 4, "v": 8}, 3).collect())
    assert got == [(1, v, 0.0 if v == 4 else float(v)) for v in range(1, 6)] + [(2, v, float(v)) for v in range(5, 8)]


def test_sized_boxes_hold_within_the_cube(spark):
    c = spark.createDataFrame([("t", 1, 2.0, 10.0, 4.0, 2.0)], "tile string, ID int, Cen1 double, Cen2 double, Size1 double, Size2 double")
    box = grid.sized_boxes(c, {"x": 20, "y": 12}).first()
    assert (box["x_lo"], box["x_hi"], box["y_lo"], box["y_hi"]) == (1, 8, 5, 12)
    ends = grid.world_axes(c, grid.sized_boxes(c, {"x": 20, "y": 12}), wcs.Wcs()).first()
    assert ends["lon_hi"] - ends["lon_lo"] == pytest.approx(8 / 120) and ends["lat_hi"] - ends["lat_lo"] == pytest.approx(8 / 120)
