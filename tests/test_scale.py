"""Tables of many clumps: models in blocks, links in crowds, and counts of nothing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stellagrid.functions import model
from stellagrid.operators import density, graph, grid, labels, measure, overlap, simulate
from stellagrid.params import FWHM
from stellagrid.plans import queries


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_models_are_summed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simulate, "BLOCK", 7)
    shape = {"x": 20, "y": 17, "v": 9}
    rows = [("a", 1, 1.5, 6.3, 5.2, 4.4, 1.6, 1.1, 0.9, 0.0, 0.7), ("a", 2, 0.5, 8.0, 7.0, 5.0, 1.2, 1.3, 1.0, 0.0, 0.0), ("b", 1, 2.0, 19.5, 2.0, 8.8, 0.8, 0.9, 0.7, 0.0, 0.2), ("b", 2, 2.0, 9.0, 60.0, 4.0, 0.8, 0.9, 0.7, 0.0, 0.0)]
    made = simulate.render(spark.createDataFrame(rows, simulate.COMPONENT), shape)
    want: dict = {}
    for t, _, a, x0, y0, v0, s1, s2, s3, _, th in rows:
        w, h = math.ceil(4 * max(s1, s2)), math.ceil(4 * s3)
        for x in range(max(math.floor(x0) - w, 1), min(math.ceil(x0) + w, 20) + 1):
            for y in range(max(math.floor(y0) - w, 1), min(math.ceil(y0) + w, 17) + 1):
                for v in range(max(math.floor(v0) - h, 1), min(math.ceil(v0) + h, 9) + 1):
                    dx, dy, dv = x - x0, y - y0, v - v0
                    q = dx * dx * (math.cos(th) ** 2 / (2 * s1 * s1) + math.sin(th) ** 2 / (2 * s2 * s2)) + dy * dy * (math.sin(th) ** 2 / (2 * s1 * s1) + math.cos(th) ** 2 / (2 * s2 * s2))
                    q += dx * dy * math.sin(2 * th) * (1 / (2 * s2 * s2) - 1 / (2 * s1 * s1)) + dv * dv / (2 * s3 * s3)
                    want[t, x, y, v] = want.get((t, x, y, v), 0) + a * math.exp(-q)
    got = {tuple(r)[:4]: r["intensity"] for r in made.select("tile", "x", "y", "v", "intensity").collect()}
    assert got.keys() == want.keys()  # the clump beyond the cube's end has no voxel
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_simulated_cubes_join_no_voxels(spark, monkeypatch):
    monkeypatch.setattr(simulate, "BLOCK", 16)
    shape = {"x": 30, "y": 24, "v": 20}
    tiles = spark.createDataFrame([("p",), ("q",)], "tile string")
    voxels, components = simulate.simulate_cubes(tiles, shape, 2, noise=0.0)
    assert "Join" not in _plan(voxels)
    model = simulate.render(components, shape).withColumnRenamed("intensity", "model")
    both = voxels.join(model, ["tile", "x", "y", "v"], "full").select(F.count("*"), F.count_distinct("tile", "idx"), F.max(F.abs(F.col("intensity") - F.coalesce("model", F.lit(0.0)))), F.count("intensity"))
    n, places, off, full = both.first()
    assert n == places == full == 2 * 30 * 24 * 20 and off < 1e-12


def _crowd(spark, n: int):
    """Two crowds in a tile, a chain between, a clump as wide as the field in another tile, and clumps that overlap nothing."""
    rows = [("a", k, (k * 7 % 31) / 10.0, (k * 11 % 29) / 10.0, 2.0 + k % 2, 2.0, 5.0 + k % 3 / 10, 2.0) for k in range(1, n)]
    rows += [("a", n + k, 60 + (k * 7 % 31) / 10.0, (k * 11 % 29) / 10.0, 2.0 + k % 2, 2.0, 5.0, 2.0) for k in range(1, n)]
    rows += [("a", 3 * n + k, 4.0 + 1.5 * k, 1.0, 2.0, 2.0, 5.0, 2.0) for k in range(40)]
    rows += [("b", 1, 50.0, 50.0, 300.0, 300.0, 5.0, 300.0), ("b", 2, 0.0, 0.0, 1.0, 1.0, 9.0, 1.0), ("b", 3, 500.0, 0.0, 1.0, 1.0, 9.0, 1.0), ("b", 4, 0.0, 0.0, 1.0, 1.0, 9.0, float("nan"))]
    return spark.createDataFrame(rows, "tile string, ID long, Cen1 double, Cen2 double, Size1 double, Size2 double, Cen3 double, Size3 double")


def test_pairs_of_a_crowd_are_not_broadcast(spark):
    c = _crowd(spark, 30)
    pairs = overlap.overlap_pairs(c)
    assert "Broadcast" not in _plan(pairs)
    rows = [r.asDict() for r in c.collect()]
    near = lambda a, b: ((a["s"] + b["s"]) * 0.8 > math.hypot(a["Cen1"] - b["Cen1"], a["Cen2"] - b["Cen2"])) and (a["Size3"] + b["Size3"]) / FWHM * 0.8 > abs(a["Cen3"] - b["Cen3"])
    for r in rows:
        r["s"] = math.hypot(r["Size1"], r["Size2"]) / FWHM
    want = sorted((a["tile"], a["ID"], b["ID"]) for a in rows for b in rows if a["tile"] == b["tile"] and a["ID"] < b["ID"] and near(a, b))
    assert sorted(map(tuple, pairs.collect())) == want  # a clump with a NaN size overlaps nothing


def test_groups_of_a_crowd_make_few_links(spark, monkeypatch):
    n, seen = 200, []
    real = graph.connected_components
    monkeypatch.setattr(overlap, "connected_components", lambda e, *a, **k: seen.append(e.count()) or real(e, *a, **k))
    got = {(r["tile"], r["ID"]): r["component"] for r in overlap.overlap_groups(_crowd(spark, n)).collect()}
    assert {c for (t, _), c in got.items() if t == "a"} == {1}
    assert [got["b", k] for k in (1, 2, 3, 4)] == [1, 1, 3, 4]
    assert sum(seen) < n * n / 4  # the crowds have about n * n pairs


def test_a_tile_without_clumps_counts_nothing(spark):
    catalog = spark.createDataFrame([("a", 1, 9, 9, 9.0, 9.0, 1.0, 1.0)], "tile string, ID int, Peak1 int, Peak2 int, Cen1 double, Cen2 double, Size1 double, Size2 double")
    tiles = spark.createDataFrame([("a",), ("b",)], "tile string")
    got = measure.detect_counts(catalog, {"x": 50, "y": 83}, ((3, 3), (3, 3)), tiles)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1, 1), ("b", 0, 0, 0)]


def test_counts_of_a_cube_without_clumps(spark, small, tmp_path):
    spark.read.parquet(f"{small}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in queries.detect_counts(spark, str(tmp_path)).collect()] == [(0, 0, 0)]


def test_volumes_without_rows_for_points(spark, monkeypatch):
    monkeypatch.setattr(model, "POINTS", 40)
    rows = [(k, 2.0 + k, 5.1, 6.2, 0.7 + k / 4, 0.8 + k / 3, k / 5, 4.3, 0.9) for k in range(6)] + [(9, None, 5.0, 6.0, 1.0, 1.0, 0.0, 4.0, 1.0), (10, 2.0, 5.0, 6.0, 1.0, 1.0, 0.0, 4.0, None)]
    fits = spark.createDataFrame(rows, "ID int, A double, x0 double, y0 double, s1 double, s2 double, theta double, v0 double, s3 double")
    made = model.model_volume(fits, 0.5)
    assert "Generate" not in _plan(made)
    want = {9: 0, 10: 0}
    for k, a, _, _, s1, s2, t, _, s3 in rows[:6]:
        grid = [(x - 3 * s1, y - 3 * s2, v - 3 * s3) for x in range(math.ceil(6 * s1)) for y in range(math.ceil(6 * s2)) for v in range(math.ceil(6 * s3))]
        q = [x * x * (math.cos(t) ** 2 / (2 * s1 * s1) + math.sin(t) ** 2 / (2 * s2 * s2)) + y * y * (math.sin(t) ** 2 / (2 * s1 * s1) + math.cos(t) ** 2 / (2 * s2 * s2)) + x * y * math.sin(2 * t) * (1 / (2 * s2 * s2) - 1 / (2 * s1 * s1)) + v * v / (2 * s3 * s3) for x, y, v in grid]
        want[k] = sum(a * math.exp(-p) >= 0.5 for p in q)
    assert {r["ID"]: r["Volume"] for r in made.collect()} == want


def test_separable_without_broadcast(spark):
    c = spark.range(1, 900).select(F.lit("t").alias("tile"), F.col("id").alias("ID"), (F.col("id") * 37 % 301 / 10).alias("x"), (F.col("id") * 53 % 307 / 10).alias("y"), (F.col("id") * 71 % 311 / 10).alias("v"), (0.9 + F.col("id") % 3 / 4).alias("s"), (0.9 + F.col("id") % 2 / 2).alias("sv"))
    rows = c.collect()
    free = {r["ID"] for r in rows if r["ID"] % 2 and not any(math.hypot(r["x"] - p["x"], r["y"] - p["y"]) < r["s"] + p["s"] and abs(r["v"] - p["v"]) < r["sv"] + p["sv"] for p in rows if p["ID"] % 2 == 0)}
    got = simulate.separable_from(c.where("ID % 2 = 1"), c.where("ID % 2 = 0"))
    assert "Broadcast" not in _plan(got)
    assert {r["ID"] for r in got.collect()} == free and 0 < len(free) < 400


def _field(spark, n: int):
    """Two tiles, by number, of plateaus, gaps and one long slope over many blocks; and a voxel without a density."""
    rows = [(7, x, y, (y - 1) * n + x - 1, x * y % 11) for x in range(1, n + 1) for y in range(1, n + 1) if x * y % 5 != 3]
    rows += [(8, x, 1, x - 1, x) for x in range(1, n + 1)] + [(8, 1, 3, 2 * n, None)]
    return rows, spark.createDataFrame(rows, "tile long, x int, y int, idx long, rho long"), {"x": n, "y": n}


def test_denser_voxels_are_found_without_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 6)
    rows, df, shape = _field(spark, 20)
    linked = density.nearest_higher(df.withColumn("extra", F.col("idx") * 3), shape, 3, ("extra",))
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan  # a probe a place made both, and a sort of nine rows a voxel
    got = {(r["tile"], r["idx"]): r for r in linked.collect()}
    assert len(got) == len(rows) and all(r["extra"] == 3 * r["idx"] for r in got.values())
    for t, x, y, idx, rho in rows:
        near = [((x - a) ** 2 + (y - b) ** 2, -a, -b, k, r) for s, a, b, k, r in rows if rho is not None and r is not None and s == t and max(abs(x - a), abs(y - b)) <= 3 and (r > rho or (r == rho and k < idx))]
        r, best = got[t, idx], min(near, default=None)
        assert (r["parent"], r["d2"]) == ((best[3], best[0]) if best else (None, None))
        assert r["grad"] == (pytest.approx((best[4] - rho) / math.sqrt(best[0])) if best else None)


def test_chains_are_followed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 6)
    monkeypatch.setattr(labels, "BLOCK", 6)
    seen = []
    whole = labels.forest_roots
    monkeypatch.setattr(labels, "forest_roots", lambda parents: whole(seen.append(parents.count()) or parents))
    rows, df, shape = _field(spark, 20)
    linked = density.nearest_higher(df, shape, 3).cache()
    centre = density.centres(linked, 3, 2).cache()
    up = {(r["tile"], r["idx"]): r["parent"] for r in linked.collect()}
    ids = {(r["tile"], r["idx"]): r["clump_id"] for r in centre.collect()}
    want = {}
    for t, k in up:
        at = k
        while (t, at) not in ids and up[t, at] is not None:
            at = up[t, at]
        want[t, k] = ids.get((t, at))
    for given in (linked, linked.drop("x", "y")):  # by places, and by idx
        got = labels.propagate(given, centre)
        assert got.columns == [*given.columns, "clump_id"]
        assert {(r["tile"], r["idx"]): r["clump_id"] for r in got.collect()} == want
    assert max(seen) < len(rows) / 2  # every voxel went through every round


def test_blocks_are_whole_in_batches_of_any_size(spark):
    rows = [(None if k < 5 else f"t{k % 3}", k % 4, k) for k in range(60)]
    df = spark.createDataFrame(rows, "tile string, b long, k long")

    def count(table, number):
        sizes = np.bincount(number)
        return table.append_column("n", pa.array(sizes[number]))

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (1, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = grid.by_block(df, ["tile", "b"], count, "tile string, b long, k long, n long").collect()
            assert sorted(r["k"] for r in got) == list(range(60))
            assert all(r["n"] == sum(q[:2] == (r["tile"], r["b"]) for q in rows) for r in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_supplier_cubes_have_numbers_for_tiles(spark, tmp_path):
    rows = [(k, 1.0 + k % 7, f"199{5 + k % 3}-0{1 + k % 9}-11") for k in range(1, 80)] + [(None, 3.0, "1995-01-01"), (99, None, "1995-01-01"), (2_500_000, 50.0, "1995-01-01")]
    items = spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_shipdate string").withColumn("l_shipdate", F.to_date("l_shipdate"))
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    rho = queries.supplier_cubes(spark, str(tmp_path))
    assert dict(rho.dtypes)["tile"] == "bigint"
    sums = {r["tile"]: (r["n"], r["s"]) for r in rho.groupBy("tile").agg(F.count("*").alias("n"), F.sum("intensity").alias("s")).collect()}
    # a row without a supplier has no tile, one without a quantity makes its tile but no voxel of it
    assert sums == {0: (4150, 24), 1: (4150, 25), 2: (4150, 25), 3: (4150, 5), 100_000: (4150, 1)}
    found = queries.QUERIES["decision_graph_anywhere"](spark, str(tmp_path))
    assert {r["tile"] for r in found.select("tile").distinct().collect()} == {"s00000", "s00001", "s00002", "s00003", "s100000"}
    assert found.where("idx = parent").groupBy("tile").count().where("count <> 1").count() == 0
