"""FITS scans that read what a filter needs, parallel sinks, binary tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan, StringContains

from stellagrid.functions.wcs import Wcs
from stellagrid.operators import grid
from stellagrid.sources import fits


@pytest.fixture(scope="module")
def cube(spark, tmp_path_factory):
    shape = {"x": 30, "y": 20, "v": 50}
    a = np.random.default_rng(2).normal(size=(50, 20, 30))
    path = str(tmp_path_factory.mktemp("cubes") / "cube.fits")
    fits.write_fits(spark.createDataFrame([(k, float(v)) for k, v in enumerate(a.ravel())], "idx long, intensity double").repartition(5), shape, path, {"CRVAL3": 12000.0, "CDELT3": 200.0, "CRPIX3": 4.0})
    return path, a, shape


def reader(path, **options):
    return fits.PushingFitsReader({"path": path, **options}, None)


def test_filters_become_byte_ranges(cube):
    path, _, shape = cube
    whole = sum(p.bytes_read for p in reader(path).partitions())
    assert whole == 8 * math.prod(shape.values())
    r = reader(path)
    rest = list(r.pushFilters([IsNotNull(("v",)), GreaterThanOrEqual(("v",), 11), LessThan(("v",), 16), EqualTo(("y",), 7), StringContains(("tile",), "a"), EqualTo(("intensity",), 1)]))
    assert [type(f).__name__ for f in rest] == ["StringContains", "EqualTo"]
    assert sum(p.bytes_read for p in r.partitions()) == 8 * 5 * 30  # five planes, a row of each
    r = reader(path)
    some = In(("v",), (3, 9))
    assert list(r.pushFilters([some])) == [some] and sum(p.bytes_read for p in r.partitions()) == whole * 7 // 50
    r = reader(path)
    assert not list(r.pushFilters([GreaterThanOrEqual(("v",), 99)])) and sum(p.bytes_read for p in r.partitions()) == 0


def test_scan_gives_what_the_filter_says(spark, cube):
    path, a, _ = cube
    df = fits.scan_fits(spark, path).where("v >= 11 AND v < 16 AND y IN (3, 7) AND x > 4 AND intensity > 0")
    want = sorted((x, y, v, a[v - 1, y - 1, x - 1]) for v in range(11, 16) for y in (3, 7) for x in range(5, 31) if a[v - 1, y - 1, x - 1] > 0)
    assert sorted((r["x"], r["y"], r["v"], r["intensity"]) for r in df.collect()) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "intensity" in plan and df.rdd.getNumPartitions() == 1  # five planes are one partition of 16
    assert fits.scan_fits(spark, path).where("v > 400").count() == 0


def test_a_world_range_reads_its_planes(spark, cube):
    path, _, _ = cube
    w = Wcs.from_header(fits.read_header(path)[0])
    whole = grid.world_subcube(fits.read_fits(spark, path)[1], w, vel=(13.05, 14.0))
    got = fits.scan_world(spark, path, vel=(13.05, 14.0))
    pick = lambda df: sorted((r["idx"], r["intensity"]) for r in df.collect())
    assert pick(got) == pick(whole) and 0 < got.count() < 10 * 600
    assert got.rdd.getNumPartitions() == 1 < fits.scan_fits(spark, path).rdd.getNumPartitions()  # seven planes or so of fifty


def test_sink_writes_in_tasks_and_again(spark, tmp_path, monkeypatch):
    """Runs of few samples, many tasks, and a second writing over the first."""
    monkeypatch.setattr(fits, "CHUNK", 64)
    shape = {"x": 13, "y": 11, "v": 5}
    path = str(tmp_path / "s.fits")
    rows = [(k, float(k)) for k in range(0, 13 * 11 * 5, 2)] + [(10**6, 5.0), (-1, 4.0), (1, None)]
    df = spark.createDataFrame(rows, "idx long, intensity double").repartition(6)
    for _ in range(2):
        fits.write_fits(df, shape, path)
    back = {r["idx"]: r["intensity"] for r in fits.scan_fits(spark, path).collect()}
    assert back == {k: float(k) if k % 2 == 0 else 0.0 for k in range(13 * 11 * 5)}
    assert (tmp_path / "s.fits").stat().st_size % 2880 == 0


def test_binary_table_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fits, "CHUNK_BYTES", 1000)
    r = random.Random(1)
    rows = [(k, r.choice([None, "é", "", "name of a clump", "x"]), r.choice([None, -5, 7]), r.choice([None, 2.5, -1e300]), r.random() < 0.5, [k / 2, -1.0, float(k)], [k, 2 * k]) for k in range(500)]
    schema = "id long, name string, n int, value double, ok boolean, place array<double>, pair array<int>"
    df = spark.createDataFrame(rows, schema).repartition(7)
    path = str(tmp_path / "t.fits")
    fits.write_table(df, path, ["id"])
    back = fits.read_table(spark, path)
    assert [f.dataType for f in back.schema] == [f.dataType for f in df.schema]
    got = sorted(map(tuple, back.collect()))
    plain = lambda t: (t[0], t[1] or "", t[2], None if t[3] is None else t[3], t[4], list(t[5]), list(t[6]))
    nan = lambda t: (*t[:3], None if t[3] is None or math.isnan(t[3]) else t[3], *t[4:])
    assert [nan(plain(t)) for t in got] == [plain(t) for t in rows]
    assert fits.read_table(spark, path, columns=["pair", "name"]).columns == ["pair", "name"]
    many = spark.read.format("fits").options(what="table", rows="100").load(path)
    assert many.rdd.getNumPartitions() == 5 and many.count() == 500
    empty = str(tmp_path / "e.fits")
    fits.write_table(df.limit(0), empty, ["id"])
    assert fits.read_table(spark, empty).count() == 0
    with pytest.raises(ValueError, match="different lengths"):
        fits.write_table(df.withColumn("place", F.slice("place", 1, F.when(F.col("id") > 3, 2).otherwise(1))), path, ["id"])
    with pytest.raises(ValueError, match="1PD"):
        fits._columns({"TFIELDS": 1, "TFORM1": "1PD(20)", "TTYPE1": "heap", "NAXIS1": 8})
