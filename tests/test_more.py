"""Long chains of ties, measures of one's own, densities that are kept."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellagrid.operators import match, measure
from stellagrid.params import DetectParams
from stellagrid.plans import detect

from .test_operators import cube_of


def greedy(pairs):
    used, out = set(), []
    for d, i, j in sorted((d, i, j) for i, j, d in pairs):
        if ("i", i) not in used and ("j", j) not in used:
            used |= {("i", i), ("j", j)}
            out.append((i, j))
    return sorted(out)


def test_a_hundred_thousand_equidistant_rows(spark):
    """One chain of ties through all rows: no task gets it whole, and few rounds decide it."""
    n = 100_000
    pairs = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(F.col("id") - 1, F.col("id"))).alias("j")).where("j >= 0").select("i", "j", F.lit(1.0).alias("d2"), F.lit(True).alias("accept"))
    got = match.greedy_pairs(pairs.repartition(4), rounds=1)
    assert got.count() == n and got.where("i != j").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_and_crossings(spark, seed):
    """Paths with falling and equal distances, and denser graphs, by the parity of chains alone."""
    r = random.Random(seed)
    pairs = {(i, i + d): (float(300 - i) if seed == 1 else float(r.randint(0, 3))) for i in range(300) for d in ((0, 1) if seed < 3 else (0, 1, 2, 5))}
    rows = [(i, j, d) for (i, j), d in pairs.items()]
    df = spark.createDataFrame([(*x, True) for x in rows], "i long, j long, d2 double, accept boolean")
    assert sorted((x["i"], x["j"]) for x in match.greedy_pairs(df, rounds=0).collect()) == greedy(rows)


def test_measures_of_ones_own(spark, monkeypatch):
    r = random.Random(2)
    rows = [(t, c, r.randint(1, 9), r.randint(1, 9), k, float(r.randint(1, 50))) for k, (t, c) in enumerate((t, c) for t in "ab" for c in range(1, 40) for _ in range(r.randint(1, 30)))]
    df = spark.createDataFrame(rows, "tile string, clump_id int, x int, y int, idx long, intensity double").repartition(6)
    shape = {"x": 9, "y": 9}
    got = measure.regions(df, shape, {"Mean": F.avg("intensity"), "Odd": F.count_if(F.col("x") % 2 == 1)})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_avg" in plan
    by = {}
    for t, c, x, y, k, i in rows:
        by.setdefault((t, c), []).append((x, i))
    assert {(g["tile"], g["ID"]): (g["Mean"], g["Odd"]) for g in got.collect()} == {k: (pytest.approx(np.mean([i for _, i in v])), sum(x % 2 for x, _ in v)) for k, v in by.items()}

    # The three brightest voxels of each clump, as states that merge; a task that sends its states on after every batch.
    monkeypatch.setattr(measure, "STATES", 3)
    top = lambda values: sorted(values, reverse=True)[:3]
    made = measure.merged_regions(df, lambda v: {"top": top(v["intensity"].tolist()), "n": len(v)}, lambda a, b: {"top": top([*a["top"], *b["top"]]), "n": a["n"] + b["n"]}, lambda s: {"third": min(s["top"]), "n": s["n"]}, "top array<double>, n long", "third double, n long")
    assert {(g["tile"], g["ID"]): (g["third"], g["n"]) for g in made.collect()} == {k: (min(top([i for _, i in v])), len(v)) for k, v in by.items()}


def test_a_density_is_made_once(spark, tmp_path, monkeypatch):
    a = np.zeros((30, 30))
    a[10:20, 10:20] = 5
    a[14, 14] = 9
    cube, shape = cube_of(spark, a)
    p = DetectParams(rms=0.5, sigma=0.5, min_area=4, remove_edge=False)
    folder = str(tmp_path / "densities")
    first = detect.detect(cube, shape, p, folder, {"RMS": 0.5}).catalog.collect()
    smoothed = detect.smoothed
    calls = []
    monkeypatch.setattr(detect, "smoothed", lambda *x: (calls.append(1), smoothed(*x))[1])
    again = detect.detect(cube.repartition(3), shape, p, folder, {"RMS": 0.5}).catalog.collect()
    assert again == first and not calls  # the order of rows does not count
    assert not detect.kept_density(cube, shape, DetectParams(sigma=0.6), folder, {"RMS": 0.5})[1] and len(calls) == 1
    assert not detect.kept_density(cube, shape, p, folder, {"RMS": 0.4})[1]
    changed = cube.withColumn("intensity", F.when(F.col("idx") == 3, 1e-9).otherwise(F.col("intensity")))
    assert not detect.kept_density(changed, shape, p, folder, {"RMS": 0.5})[1] and len(calls) == 3
    # A table that was not finished is made again.
    key = detect.fingerprint(cube, shape, p, {"RMS": 0.5})
    (tmp_path / "densities" / f"density-{key}" / "_SUCCESS").unlink()
    table, known = detect.kept_density(cube, shape, p, folder, {"RMS": 0.5})
    assert not known and len(calls) == 4 and table.count() == 900 and detect.kept_density(cube, shape, p, folder, {"RMS": 0.5})[1]
