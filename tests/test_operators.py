"""Operators against direct NumPy or Python versions, published catalogues' formulas, and each other."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stellagrid.functions import model, wcs
from stellagrid.operators import density, fit, graph, grid, labels, match, measure, mosaic, overlap, simulate, smooth
from stellagrid.params import FWHM, DetectParams, MatchParams
from stellagrid.plans import detect
from stellagrid.sources import catalog as catalogs
from stellagrid.sources import fits


def cube_of(spark, a: np.ndarray):
    """A dense voxel table of an array in C order, and its shape."""
    axes = ["x", "y", "v"][: a.ndim]
    shape = dict(zip(axes, a.shape[::-1], strict=True))
    rows = [("t0", *(int(k) + 1 for k in reversed(i)), float(v)) for i, v in np.ndenumerate(a)]
    table = spark.createDataFrame(rows, "tile string, " + ", ".join(f"{x} int" for x in axes) + ", intensity double")
    return grid.dense_grid(table, shape), shape


def array_of(df, column, shape):
    out = np.full(math.prod(shape.values()), np.nan)
    for i, v in df.select("idx", column).collect():
        out[i] = np.nan if v is None else v
    return out.reshape(tuple(shape.values())[::-1])


def blurred(a, kernel, mode):
    r = len(kernel) // 2
    for axis in range(a.ndim):
        pad = [(r, r) if k == axis else (0, 0) for k in range(a.ndim)]
        p = np.pad(a, pad, mode="edge" if mode == "clamp" else "constant")
        a = sum(w * np.take(p, range(k, k + a.shape[axis]), axis=axis) for k, w in enumerate(kernel))
    return a


@pytest.fixture(scope="module")
def noisy():
    return np.random.default_rng(3).gamma(1.0, 2.0, (7, 9, 8))


def test_dense_grid_fills_and_cleans(spark):
    rows = [("a", 1, 1, 2.0), ("a", 2, 2, float("nan")), ("b", 3, 1, None)]
    df = grid.dense_grid(spark.createDataFrame(rows, "tile string, x int, y int, intensity double"), {"x": 3, "y": 2}).collect()
    assert len(df) == 12 and sum(r["intensity"] for r in df) == 2.0
    assert all(r["idx"] == (r["y"] - 1) * 3 + r["x"] - 1 for r in df)


@pytest.mark.parametrize("edge", ["clamp", "zero"])
def test_smoothing(spark, noisy, edge):
    cube, shape = cube_of(spark, noisy)
    k = smooth.gaussian_kernel(0.7)
    got = array_of(smooth.smooth(cube, shape, {a: k for a in shape}, edge=edge), "rho", shape)
    assert np.allclose(got, blurred(noisy, k, edge))


def test_adaptive_density(spark, noisy):
    cube, shape = cube_of(spark, noisy[:3])
    stack = np.stack([blurred(noisy[:3], smooth.gaussian_kernel(s), "clamp") for s in smooth.SCALES])
    pick = np.abs(stack - stack.mean(axis=0)).argmin(axis=0)
    want = np.take_along_axis(stack, pick[None], axis=0)[0]
    assert np.allclose(array_of(smooth.adaptive_density(cube, shape), "rho", shape), want, rtol=1e-5)


def linked_by_hand(rho, noise, reach):
    places = [i for i in np.ndindex(rho.shape) if rho[i] > noise]
    flat = {i: np.ravel_multi_index(i, rho.shape) for i in places}
    out = {}
    for i in places:
        best = None
        for r in (1, reach):
            for j in places:
                gap = [abs(a - b) for a, b in zip(i, j, strict=True)]
                if i != j and max(gap) <= r and (rho[j] > rho[i] or (rho[j] == rho[i] and flat[j] < flat[i])):
                    key = (sum(g * g for g in gap), tuple(-x for x in reversed(j)))
                    best = min(best or (key, j), (key, j))
            if best:
                break
        out[flat[i]] = (flat[best[1]], best[0][0]) if best else (None, None)
    return out


def test_nearest_higher_and_labels(spark):
    a = np.random.default_rng(5).integers(0, 12, (5, 6, 7)).astype(float)
    cube, shape = cube_of(spark, a)
    bright = cube.withColumn("rho", F.col("intensity")).where("rho > 4")
    got = density.nearest_higher(bright, shape, 3)
    want = linked_by_hand(a, 4, 3)
    assert {r["idx"]: (r["parent"], r["d2"]) for r in got.collect()} == want
    centre = density.centres(got, 8, 2)
    named = {r["idx"]: r["clump_id"] for r in labels.propagate(got, centre).collect()}
    ids = {r["idx"]: r["clump_id"] for r in centre.collect()}
    assert sorted(ids) == [i for i in sorted(want) if a.flat[i] > 8 and (want[i][0] is None or want[i][1] > 4)]
    for i in want:
        j = i
        while j not in ids and want[j][0] is not None:
            j = want[j][0]
        assert named[i] == ids.get(j)


def test_largest_part(spark):
    a = np.array([[1, 1, 0, 1, 1, 1], [0, 0, 0, 0, 0, 0], [2, 0, 2, 2, 0, 2]], dtype=float)
    cube, shape = cube_of(spark, a)
    lab = cube.where("intensity > 0").withColumn("clump_id", F.col("intensity").cast("int"))
    assert sorted(r["idx"] for r in labels.largest_part(lab, shape).collect()) == [3, 4, 5, 14, 15]


def test_boundaries_and_renumbering(spark):
    rows = [("t", k, float(r), g, c) for k, (r, g, c) in enumerate([(10, None, 1), (8, 0.5, 1), (2, 0.001, 1), (9.5, 0.0, 1), (5, None, 2), (4, 0.0, 2), (7, None, 3), (6, 1.0, 3)])]
    df = spark.createDataFrame(rows, "tile string, idx long, rho double, grad double, clump_id int")
    assert sorted((r["idx"], r["clump_id"]) for r in labels.cut_boundaries(df).collect()) == [(0, 1), (1, 1), (3, 1), (6, 2), (7, 2)]


def test_regions_and_orientation(spark, noisy):
    cube, shape = cube_of(spark, noisy)
    lab = cube.where("intensity > 2").withColumn("clump_id", (F.col("x") > 4).cast("int") + 1)
    got = {r["ID"]: r for r in measure.regions(lab, shape).collect()}
    angle = {r["clump_id"]: r["Angle"] for r in measure.orientation(lab).collect()}
    v, y, x = np.nonzero(noisy > 2)
    i = noisy[noisy > 2]
    for c in (1, 2):
        m = (x + 1 > 4) + 1 == c
        r = got[c]
        assert r["Volume"] == m.sum() and r["Sum"] == pytest.approx(i[m].sum()) and r["Peak"] == i[m].max()
        for k, axis in enumerate((x, y, v), 1):
            cen = (i[m] * (axis[m] + 1)).sum() / i[m].sum()
            assert r[f"Cen{k}"] == pytest.approx(cen)
            assert r[f"Size{k}"] == pytest.approx(FWHM * math.sqrt((i[m] * (axis[m] + 1 - cen) ** 2).sum() / i[m].sum()))
        foot = np.array(sorted(set(zip(x[m], y[m], strict=True))), dtype=float)
        fx, fy = foot.T - foot.mean(axis=0)[:, None]
        assert angle[c] == pytest.approx(math.degrees(0.5 * math.atan2(2 * (fx * fy).mean(), (fy**2).mean() - (fx**2).mean())))


def test_components_and_roots(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)] + [(7, 7), (500, 500), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {n: c for n, c in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in up}
    parents = spark.createDataFrame([(k, k - 1 if k % 17 else None) for k in range(100)], "node long, parent long")
    assert {n: p for n, p in graph.forest_roots(parents).collect()} == {k: k - k % 17 for k in range(100)}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_world_coordinates_round_trip(spark):
    rows = [(k, float(k * 3 % 181), float(k * 7 % 91), float(k), *(5.0,) * 3, float(k * 3 % 181), float(k * 7 % 91), float(k)) for k in range(60)]
    c = spark.createDataFrame(rows, "ID long, Cen1 double, Cen2 double, Cen3 double, Size1 double, Size2 double, Size3 double, Peak1 double, Peak2 double, Peak3 double")
    back = {r["Peak3"]: r for r in wcs.to_pixel(wcs.to_world(c, wcs.Wcs()), wcs.Wcs()).collect()}
    for r in rows:
        b = min(back.values(), key=lambda b: abs(b["Cen3"] - r[3]))
        assert (b["Cen1"], b["Cen2"], b["Cen3"], b["Size3"]) == pytest.approx((r[1], r[2], r[3], 5.0), abs=1e-7)


def test_world_coordinates_of_the_reference_pixel(spark):
    c = spark.createDataFrame([(181.0, 91.0, 1.0, -0.004, 0.0)], "a double, b double, c double, d double, e double")
    lon, lat = wcs.sky(F.col("a"), F.col("b"), wcs.Wcs())
    name = wcs.clump_name(lon, F.col("d"), F.col("e"))
    got = c.select(lon, lat, wcs.velocity(F.col("c"), wcs.Wcs()), name).first()
    assert tuple(got)[:3] == pytest.approx((16.75, 0.75, 15.93988032)) and got[3] == "MWISP016.750-00.004+00.000"


def greedy_by_hand(t, f, tolerance=2.0, stop=True):
    pairs = sorted((sum((a - b) ** 2 for a, b in zip(x[1:4], y[1:4], strict=True)), x[0], y[0], all(abs(a - b) <= min(tolerance, s / FWHM) for a, b, s in zip(x[1:4], y[1:4], x[4:], strict=True))) for x in t for y in f)
    used, out = (set(), set()), []
    for d, i, j, ok in pairs:
        if i in used[0] or j in used[1]:
            continue
        if not ok:
            if stop:
                break
            continue
        used[0].add(i)
        used[1].add(j)
        out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("stop", [True, False])
def test_greedy_matching(spark, stop):
    r = random.Random(4)
    t = [(k, *(float(r.randint(0, 12)) for _ in range(3)), *(r.uniform(3, 8) for _ in range(3))) for k in range(60)]
    f = [(k, *(float(r.randint(0, 12)) for _ in range(3))) for k in range(50)] + [(99, float("nan"), 1.0, 1.0)]
    truth = spark.createDataFrame(t, "ID long, Cen1 double, Cen2 double, Cen3 double, Size1 double, Size2 double, Size3 double")
    found = spark.createDataFrame(f, "ID long, Cen1 double, Cen2 double, Cen3 double")
    out = match.match_catalogs(truth, found, MatchParams(stop_on_first_reject=stop))
    want = greedy_by_hand(t, f[:-1], stop=stop)
    assert sorted((r["s_ID"], r["f_ID"]) for r in out.match.collect()) == want
    s = out.scores.first()
    assert (s["matched"], s["n_truth"], s["n_found"]) == (len(want), 60, 50)
    assert out.miss.count() == 60 - len(want) and out.false.count() == 50 - len(want)


@pytest.mark.parametrize("stop", [True, False])
def test_greedy_matching_of_chains(spark, stop):
    # equal distances, ordered by (d2, i, j): each round finds one pair that is mutually closest
    chain = [(i, j, 1.0, not (stop and i == 1100)) for i in range(1200) for j in (i - 1, i) if j >= 0]
    pairs = spark.createDataFrame(chain, "i long, j long, d2 double, accept boolean")
    used, want = set(), []
    for i, j, _, accept in chain:
        if ("i", i) in used or ("j", j) in used:
            continue
        if stop and not accept:
            break
        used |= {("i", i), ("j", j)}
        want.append((i, j))
    assert sorted((r["i"], r["j"]) for r in match.greedy_pairs(pairs, stop).collect()) == want


def test_matching_nothing(spark):
    truth = spark.createDataFrame([(1, 1.0, 1.0, 5.0, 5.0)], "ID long, Cen1 double, Cen2 double, Size1 double, Size2 double")
    found = spark.createDataFrame([(1, 90.0, 1.0)], "ID long, Cen1 double, Cen2 double")
    out = match.match_catalogs(truth, found)
    assert (out.match.count(), out.miss.count(), out.false.count(), out.scores.first()["f1"]) == (0, 1, 1, 0.0)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 3]))
def test_fit_recovers_parameters(seed, ndim):
    r = np.random.default_rng(seed)
    side = np.arange(1, 14.0)
    places = np.stack([g.ravel() for g in np.meshgrid(*[side] * ndim, indexing="ij")], axis=1)
    p = np.array([[r.uniform(2, 5), 7 + r.uniform(-1, 1), 7 + r.uniform(-1, 1), r.uniform(2.2, 2.8), r.uniform(1.2, 1.6), r.uniform(0.3, 1.2), 7.2, 1.7][: 6 if ndim == 2 else 8]])
    values = fit.model_and_slopes(p, places)[0].sum(axis=0)
    start = p * r.uniform(0.93, 1.07, p.shape)
    got, _, rms = fit.fit_group(start, start - 2, start + 2, places, values)
    assert rms < 0.02 and np.allclose(got[:, :3], p[:, :3], atol=0.1)


def test_slopes_are_the_models(spark):
    r = np.random.default_rng(0)
    p, places = r.uniform(1, 3, (2, 8)), r.uniform(0, 4, (5, 3))
    _, slopes = fit.model_and_slopes(p, places)
    for k in range(8):
        q = p.copy()
        q[:, k] += 1e-6
        near = (fit.model_and_slopes(q, places)[0] - fit.model_and_slopes(p, places)[0]) / 1e-6
        assert np.allclose(slopes[:, k], near, atol=1e-4)


def test_multiscale_fits_groups_apart(spark):
    y, x = np.mgrid[1:41, 1:41]
    a = sum(9 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 4.5) for cx, cy in ((10, 10), (30, 29)))
    cube, shape = cube_of(spark, a + 0.01 * np.sin(7 * x + 3 * y))
    p = DetectParams(rms=1.0, noise_times=0.5, rms_times=1.0, min_area=4, sigma=0.6, remove_edge=False)
    _, small, fitted = detect.detect_multiscale(cube, shape, p, p)
    rows = fitted.collect()
    assert len(rows) == small.catalog.count() >= 2 and len({r["component"] for r in rows}) == len(rows)
    assert all(min(math.hypot(r["x0"] - cx, r["y0"] - cy) for r in rows) < 0.5 for cx, cy in ((10, 10), (30, 29)))


def test_simulate_detect_match(spark):
    shape = {"x": 40, "y": 40, "v": 30}
    places = [(10, 10, 9), (29, 11, 21), (12, 28, 10), (29, 29, 20)]
    components = spark.createDataFrame([("a", k, 1.5 + 0.3 * k, *map(float, p), 2.2, 1.6, 2.0, 30.0, 0.4 * k) for k, p in enumerate(places, 1)], simulate.COMPONENT)
    empty = spark.createDataFrame([("a", 1, 1, 1, 0.0)], "tile string, x int, y int, v int, intensity double")
    noise = grid.dense_grid(empty, shape).withColumn("intensity", 0.05 * F.randn(3))
    voxels = graph.cut_lineage(grid.dense_grid(simulate.inject(graph.cut_lineage(noise), components, shape), shape))
    found = detect.detect(voxels, shape, DetectParams(rms=0.05, rms_times=5, noise_times=2, sigma=0.8, remove_edge=False))
    truth = components.select("ID", F.col("x0").alias("Cen1"), F.col("y0").alias("Cen2"), F.col("v0").alias("Cen3"), *((F.col(f"s{k}") * FWHM).alias(f"Size{k}") for k in (1, 2, 3)))
    scores = match.match_catalogs(truth, found.catalog.drop("tile"), MatchParams()).scores.first()
    assert scores["f1"] == 1.0
    assert found.mask.groupBy("clump_id").count().count() == found.catalog.count()
    groups = overlap.overlap_groups(found.catalog)
    fitted = model.fit_catalog(fit.fit_clumps(grid.clump_points(voxels, found.mask, shape), found.catalog, groups), 0.05).collect()
    for k, p in enumerate(places, 1):
        near = min(fitted, key=lambda r: math.dist((r["Cen1"], r["Cen2"], r["Cen3"]), p))
        assert (near["Cen1"], near["Cen2"], near["Cen3"]) == pytest.approx(p, abs=0.2) and near["Peak"] == pytest.approx(1.5 + 0.3 * k, rel=0.1)
    assert len(fitted) == found.catalog.count() and all(0 <= r["Theta"] <= 180 and r["Size1"] >= r["Size2"] for r in fitted)


def test_tiles_give_what_the_field_gives(spark):
    a = np.random.default_rng(9).gamma(1.0, 1.0, (24, 40))
    cube, shape = cube_of(spark, a)
    p = DetectParams(rms=0.5, noise_times=2, rms_times=2.5, min_area=4, sigma=0.8, remove_edge=False)
    whole = detect.detect(cube, shape, p).catalog.select("Peak1", "Peak2", "Volume", "Sum").collect()
    tiled = detect.detect_tiled(cube, shape, p, 20, 20).select("Peak1", "Peak2", "Volume", "Sum").collect()
    key = lambda r: (r["Peak1"], r["Peak2"], r["Volume"], round(r["Sum"], 6))
    assert sorted(map(key, tiled)) == sorted(map(key, whole)) and whole


def test_tiles_own_the_field_once(spark):
    tiles = mosaic.tile_table(spark, mosaic.tiling({"x": 50, "y": 30}, 20, 5))
    c = spark.createDataFrame([(k, float(k % 50) + 0.5, float(k % 31) + 0.5) for k in range(200)], "ID long, Cen1 double, Cen2 double")
    named = c.crossJoin(tiles.select("tile"))
    assert mosaic.owned(named, tiles).groupBy("ID").count().where("count <> 1").count() == 0
    assert mosaic.owned(named, tiles).count() == 200


def test_masks_merge_without_gaps(spark):
    lab = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 3, 5), ("b", 4, 7)], "tile string, idx long, clump_id int")
    kept = spark.createDataFrame([("a", 9), ("b", 5), ("b", 7)], "tile string, ID int")
    assert sorted((r["idx"], r["clump_id"]) for r in mosaic.merge_masks(lab, kept).collect()) == [(2, 1), (3, 2), (4, 3)]


def test_resample_meets_its_quota(spark):
    pool = spark.range(1000).select(F.col("id"), (F.col("id") % 90).cast("double").alias("v"))
    wanted = spark.range(100).select((F.col("id") % 30).cast("double").alias("v"))
    quota = {r["stratum"]: r["quota"] for r in simulate.stratified_quota(pool, wanted, "v", 10.0, 2000).collect()}
    got = simulate.stratified_resample(pool, wanted, "v", 10.0, 2000).groupBy(F.floor(F.col("v") / 10).alias("s")).count().collect()
    assert {r["s"]: r["count"] for r in got} == quota


def test_fits_round_trip(spark, tmp_path, noisy):
    cube, shape = cube_of(spark, noisy)
    path = str(tmp_path / "cube.fits")
    fits.write_fits(cube, shape, path, {"OBJECT": "it's", "RMS": 0.25, "OK": True})
    spark.dataSource.register(fits.FitsSource)
    back = spark.read.format("fits").option("planes", 2).load(path)
    assert np.allclose(array_of(back, "intensity", shape), noisy) and back.rdd.getNumPartitions() == 4
    header = dict(spark.read.format("fits").option("what", "header").load(path).collect())
    assert header["OBJECT"] == "it's" and float(header["RMS"]) == 0.25 and header["NAXIS3"] == "7"
    part = spark.read.format("fits").option("v_range", "3:99").option("x_range", "0:2").load(path)
    assert part.count() == 5 * 9 * 2
    assert measure.background_rms(None, fits.read_header(path)[0]) == 0.25


@pytest.mark.parametrize("delimiter", ["\t", ",", " "])
def test_catalog_delimiters(spark, tmp_path, delimiter):
    path = tmp_path / "c.txt"
    path.write_text(delimiter.join(["PIDENT", "cen1", "peak"]) + "\n" + "\n".join(delimiter.join(map(str, x)) for x in [(1, 2.5, 3.0), (2, -1.0, 4.25)]) + "\n")
    got = catalogs.normalise_names(catalogs.read_catalog(spark, str(path))).select("ID", "Cen1", "Peak").collect()
    assert [tuple(map(float, r)) for r in got] == [(1, 2.5, 3.0), (2, -1.0, 4.25)]


def test_arriving_tiles(spark, tmp_path):
    from stellagrid.streaming.tiles import detect_arriving

    a = np.zeros((12, 12))
    a[4:8, 4:8] = 5
    a[5, 5] = 9
    cube, shape = cube_of(spark, a)
    cube.drop("idx").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cube.drop("idx").schema).parquet(str(tmp_path / "in"))
    q = detect_arriving(stream, shape, DetectParams(rms=0.5, sigma=0.5, min_area=4, remove_edge=False), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_simulated_cubes_are_the_same_again(spark):
    tiles = spark.createDataFrame([("a",), ("b",)], "tile string")
    shape = {"x": 30, "y": 30, "v": 16}
    first, again = (sorted(map(tuple, simulate.simulate_cubes(tiles, shape, 3, seed=5)[0].where("idx % 97 = 0").collect())) for _ in range(2))
    assert first == again and len(first) == 2 * -(-30 * 30 * 16 // 97)


def test_holes_are_filled(spark):
    a = np.ones((5, 6))
    a[1, 1] = a[1, 2] = a[3, 4] = a[0, 5] = a[4, 0] = 0  # two holes, two dents
    cube, shape = cube_of(spark, a)
    lab = cube.where("intensity > 0").withColumn("clump_id", F.lit(1))
    got = {r["idx"] for r in labels.fill_holes(lab, shape).collect()}
    assert got == set(range(30)) - {5, 24}


def test_coordinates_from_a_header():
    w = wcs.Wcs.from_header({"NAXIS": 3, "CRVAL1": 10.0, "CDELT1": -0.01, "CDELT3": 200.0})
    assert w.crval[0] == 10.0 and w.crval[1] == 0.75 and w.resolution == pytest.approx((36.0, 30.0, 0.2))
