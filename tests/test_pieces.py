"""Tiles that arrive in pieces."""

import time

import numpy as np
from pyspark.sql import functions as F

from stellagrid.params import DetectParams
from stellagrid.plans import detect
from stellagrid.streaming.tiles import detect_pieces

from .test_operators import cube_of

P = DetectParams(rms=0.5, sigma=0.5, min_area=4, remove_edge=False)


def two_tiles(spark):
    a = np.zeros((12, 12))
    a[4:8, 4:8] = 5
    a[5, 5] = 9
    cube, shape = cube_of(spark, a)
    other = cube.withColumns({"tile": F.lit("u"), "intensity": F.col("intensity") * 2})
    return cube.unionByName(other), shape


def rows(df):
    return sorted((r["tile"], r["ID"], r["Peak1"], r["Peak2"], round(r["Cen1"], 9), round(r["Sum"], 6), r["Volume"]) for r in df.collect())


def until(query, done, seconds=150):
    """Waits until done() gives something, and stops the query."""
    end, got = time.time() + seconds, None
    while not got and time.time() < end and query.isActive:
        time.sleep(1)
        got = done()
    if query.exception():
        raise query.exception()
    return got


def test_pieces_over_three_batches(spark, tmp_path):
    """The pieces of two tiles, two voxels twice, give what whole tiles give; a tile goes on once, when it is whole."""
    cube, shape = two_tiles(spark)
    want = detect.detect(cube, shape, P).catalog
    source, out = str(tmp_path / "in"), tmp_path / "out"
    again = cube.where("tile = 'u' AND idx = 70").withColumn("intensity", F.lit(-99.0))
    pieces = [cube.where("idx % 3 = 0").unionByName(again), cube.where("idx % 3 = 1 AND tile = 'u' OR idx % 3 != 0 AND tile != 'u'"), cube.where("tile = 'u' AND idx % 3 = 2").unionByName(cube.where("idx = 70"))]
    pieces[0].drop("idx").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(cube.drop("idx").schema).parquet(source)
    query = detect_pieces(stream, shape, P, str(out), str(tmp_path / "check"), every="1 second")
    found = lambda: spark.read.parquet(str(out)).collect() if list(out.glob("batch=*/_SUCCESS")) else []
    try:
        until(query, lambda: query.lastProgress and query.lastProgress["batchId"] >= 1)
        assert not found()
        pieces[1].drop("idx").coalesce(1).write.mode("append").parquet(source)
        first = until(query, found)
        assert {r["tile"] for r in first} == {cube.first()["tile"]}
        pieces[2].drop("idx").coalesce(1).write.mode("append").parquet(source)
        assert until(query, lambda: len({r["tile"] for r in found()}) == 2)
    finally:
        query.stop()
    got = spark.read.parquet(str(out))
    assert rows(got) == rows(want) and got.where("NOT complete").count() == 0


def test_a_tile_that_stays_unfinished(spark, tmp_path):
    cube, shape = two_tiles(spark)
    source, out = str(tmp_path / "in"), tmp_path / "out"
    cube.where("tile = 'u' AND idx < 130").drop("idx").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(cube.drop("idx").schema).parquet(source)
    query = detect_pieces(stream, shape, P, str(out), str(tmp_path / "check"), patience=1.0, every="1 second")
    try:
        found = until(query, lambda: spark.read.parquet(str(out)).collect() if list(out.glob("batch=*/_SUCCESS")) else [])
    finally:
        query.stop()
    assert [(r["tile"], r["complete"]) for r in found] == [("u", False)]
