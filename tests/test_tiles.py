"""Tiles, seams, parts by runs, and denser voxels anywhere, against direct versions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellagrid.operators import density, labels, mosaic, overlap
from stellagrid.params import DetectParams
from stellagrid.plans import detect

from .test_operators import cube_of


def test_overlaps_stay_within_tiles(spark):
    """Clumps 1 and 2 lie apart in tile a and touch in tile b."""
    rows = [("a", 1, 5.0, 5.0), ("a", 2, 50.0, 5.0), ("b", 1, 5.0, 5.0), ("b", 2, 6.0, 5.0)]
    c = spark.createDataFrame([(t, i, x, y, 4.0, 4.0) for t, i, x, y in rows], "tile string, ID int, Cen1 double, Cen2 double, Size1 double, Size2 double")
    assert [tuple(r) for r in overlap.overlap_pairs(c).collect()] == [("b", 1, 2)]
    assert sorted(tuple(r) for r in overlap.overlap_groups(c).collect()) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 1)]


def test_overlaps_of_very_different_sizes(spark):
    r = random.Random(3)
    rows = [(k, r.uniform(1, 300), r.uniform(1, 300), *(2 * [r.choice([0.0, 0.5, 3.0, 3.0, 9.0, 400.0 if k % 40 == 0 else 1.0])])) for k in range(400)]
    rows += [(1000, None, 3.0, 2.0, 2.0), (1001, 4.0, 3.0, None, 2.0), (1002, 4.0, 3.0, float("nan"), 2.0)]
    c = spark.createDataFrame(rows, "ID long, Cen1 double, Cen2 double, Size1 double, Size2 double")
    s = {k: (x, y, math.hypot(a, b) / 2.3548) for k, x, y, a, b in rows[:400]}
    want = sorted((i, j) for i in s for j in s if i < j and (s[i][2] + s[j][2]) * 0.8 > math.dist(s[i][:2], s[j][:2]))
    assert sorted(tuple(p) for p in overlap.overlap_pairs(c).collect()) == want and len(want) > 400


def blobs(spark):
    y, x = np.mgrid[1:61, 1:91]
    centres = [(12, 12, 2.2), (44, 20, 2.0), (47.5, 20, 2.4), (46, 45, 2.6), (75, 40, 2.1), (15, 48, 2.3), (78.5, 42, 2.0)]
    return cube_of(spark, sum(9 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * s * s)) for cx, cy, s in centres) + 0.02 * np.sin(3 * x + 5 * y))


def test_tiles_fit_what_the_field_fits(spark):
    """Clumps that overlap across a seam (x = 45) are fitted together, by the tile that owns each, as in the whole field."""
    cube, shape = blobs(spark)
    p = DetectParams(rms=1.0, noise_times=0.5, rms_times=2.0, min_area=9, sigma=0.6, remove_edge=False)
    found, whole = detect.detect_and_fit(cube, shape, p)
    own, fitted = detect.detect_fit_tiled(cube, shape, p, 45, 20)
    key = lambda r: (round(r["Cen1"], 3), round(r["Cen2"], 3))
    a, b = (sorted(df.collect(), key=key) for df in (whole, fitted))
    assert len(a) == len(b) == own.count() == found.catalog.count() >= 5 and len({r["tile"] for r in b}) > 2
    for p1, p2 in zip(a, b, strict=True):
        for c in ("Cen1", "Cen2", "Size1", "Size2", "Peak", "Sum", "Flux_SNR", "Cost"):
            assert p1[c] == pytest.approx(p2[c], rel=1e-4, abs=1e-4), c


def test_fits_of_two_tiles_do_not_mix(spark):
    cube, shape = blobs(spark)
    p = DetectParams(rms=1.0, noise_times=0.5, rms_times=2.0, min_area=9, sigma=0.6, remove_edge=False)
    one = {tuple(round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items() if k != "tile") for r in detect.detect_and_fit(cube, shape, p)[1].collect()}
    turned = cube.select(F.lit("other").alias("tile"), (91 - F.col("x")).alias("x"), "y", (F.col("idx") + 91 - 2 * F.col("x")).alias("idx"), "intensity")
    both = detect.detect_and_fit(cube.unionByName(turned), shape, p)[1].collect()
    again = {tuple(round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items() if k != "tile") for r in both if r["tile"] != "other"}
    assert again == one and len(both) == 2 * len(one)


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_denser_anywhere(spark, seed):
    r = np.random.default_rng(seed)
    shape = {"x": 70, "y": 40, "v": 37}
    rows = []
    for tile in "ab":
        cells = {(int(x), int(y), int(v)) for x, y, v in zip(*(r.integers(1, n + 1, 220) for n in shape.values()), strict=True)}
        rows += [(tile, x, y, v, ((v - 1) * 40 + y - 1) * 70 + x - 1, float(r.integers(1, 60))) for x, y, v in sorted(cells)]
    df = spark.createDataFrame(rows, "tile string, x int, y int, v int, idx long, rho double")
    got = {(p["tile"], p["idx"]): (p["parent"], p["d2"], p["grad"]) for p in density.farther_higher(df, df, shape).collect()}
    for tile in "ab":
        mine = [q for q in rows if q[0] == tile]
        for _, x, y, v, idx, rho in mine:
            up = [(((x - q[1]) ** 2 + (y - q[2]) ** 2 + (v - q[3]) ** 2), -q[1], -q[2], -q[3], q[4], q[5]) for q in mine if q[5] > rho or (q[5] == rho and q[4] < idx)]
            if not up:
                assert (tile, idx) not in got
                continue
            d2, *_, parent, prho = min(up)
            assert got[tile, idx] == (parent, d2, pytest.approx((prho - rho) / math.sqrt(d2)))
    linked = density.nearest_higher_anywhere(df, shape, 4)
    assert linked.count() == len(rows) and linked.where("parent IS NULL").count() == 2
    graph = density.decision_graph(linked, 4).groupBy("tile").agg(F.max("delta").alias("m"), F.count("*").alias("n")).collect()
    assert all(g["m"] >= 4.001 for g in graph)


def test_detection_with_parents_anywhere(spark):
    cube, shape = blobs(spark)
    p = DetectParams(rms=1.0, noise_times=0.5, rms_times=2.0, min_area=9, sigma=0.6, remove_edge=False, anywhere=True)
    assert detect.detect(cube, shape, p).catalog.count() >= 5


def parts_by_hand(cells):
    """cells: (tile, clump, place) -> the least place, by the order of idx, of its part."""
    out, left = {}, set(cells)
    while left:
        start = min(left, key=lambda c: (c[0], c[1], c[2][::-1]))
        seen, todo = {start}, [start]
        left.discard(start)
        while todo:
            tile, clump, place = todo.pop()
            for step in np.ndindex(*[3] * len(place)):
                n = (tile, clump, tuple(a + d - 1 for a, d in zip(place, step, strict=True)))
                if n in left:
                    left.discard(n)
                    seen.add(n)
                    todo.append(n)
        least = min(seen, key=lambda c: c[2][::-1])
        out |= {c: least[2] for c in seen}
    return out


@pytest.mark.parametrize(("shape", "share"), [({"x": 60, "y": 50}, 0.45), ({"x": 40, "y": 36, "v": 35}, 0.12)])
def test_parts_against_flood_fill(spark, shape, share):
    r = random.Random(8)
    index = lambda p: sum((c - 1) * math.prod(list(shape.values())[:k]) for k, c in enumerate(p))
    cells = {(t, r.randint(1, 2), tuple(a + 1 for a in p)) for t in "ab" for p in np.ndindex(*shape.values()) if r.random() < share}
    cells = {(t, p): (t, c, p) for t, c, p in cells}.values()
    df = spark.createDataFrame([(t, c, *p, index(p)) for t, c, p in cells], "tile string, clump_id int, " + ", ".join(f"{a} int" for a in shape) + ", idx long")
    want = {(t, index(p)): index(least) for (t, c, p), least in parts_by_hand(cells).items()}
    assert {(q["tile"], q["idx"]): q["part"] for q in labels.parts(df, shape).collect()} == want


def test_a_snake_is_one_part_of_few_edges(spark, monkeypatch):
    """A line that winds through all blocks: edges are between blocks alone, a few for each run."""
    shape = {"x": 50, "y": 199}
    rows = [(x, y) for y in range(1, 200, 2) for x in range(1, 51)] + [(50 if k % 2 == 0 else 1, 2 * k + 2) for k in range(99)]
    df = spark.createDataFrame([("t", 1, x, y, (y - 1) * 50 + x - 1) for x, y in rows], "tile string, clump_id int, x int, y int, idx long")
    edges = []
    real = labels.connected_components
    monkeypatch.setattr(labels, "connected_components", lambda e: (edges.append(e.count()), real(e))[1])
    assert [r["part"] for r in labels.parts(df, shape).select("part").distinct().collect()] == [0]
    assert edges[0] == 199 // labels.LINES < 199


def test_a_voxel_of_no_clump_is_a_part(spark):
    df = spark.createDataFrame([("t", None, 1, 1, 0), ("t", 1, 2, 1, 1)], "tile string, clump_id int, x int, y int, idx long")
    assert sorted((r["idx"], r["part"]) for r in labels.parts(df, {"x": 3, "y": 2}).collect()) == [(0, 0), (1, 1)]
    assert labels.parts(df.limit(0), {"x": 3, "y": 2}).count() == 0


def test_a_clump_across_seams_gets_one_number(spark):
    """Three tiles in a row: 7 of a is 1 of b and, further on, 4 of c; the others stay apart; 9 and 2 share one place only."""
    masks = {("a", 7): range(0, 20), ("b", 1): range(15, 40), ("c", 4): range(36, 50), ("a", 9): range(100, 110), ("b", 2): range(109, 120), ("c", 1): range(200, 203)}
    df = spark.createDataFrame([(t, c, i) for (t, c), places in masks.items() for i in places], "tile string, clump_id int, idx long")
    got = {(r["tile"], r["clump_id"]): r["mosaic_id"] for r in mosaic.seam_labels(df, 3).collect()}
    assert got == {("a", 7): 1, ("b", 1): 1, ("c", 4): 1, ("a", 9): 2, ("b", 2): 3, ("c", 1): 4}
    assert mosaic.seam_labels(df).where("clump_id IN (9, 2)").select("mosaic_id").distinct().count() == 1
    by = defaultdict(list)
    for r in mosaic.reconcile_masks(df, 3).collect():
        by[r["mosaic_id"]].append(r["idx"])
    assert {k: (min(v), max(v), len(v)) for k, v in by.items()} == {1: (0, 49, 50), 2: (100, 109, 10), 3: (110, 119, 10), 4: (200, 202, 3)}
    assert mosaic.reconcile_masks(df.limit(0)).count() == 0
