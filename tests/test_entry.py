"""The registry, with and without the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(3).count() == 3


def test_the_rest_works_alone(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/stellagrid", tmp_path / "stellagrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'detect_2d' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


@pytest.mark.parametrize("name", ["voxelize_2d", "projection_maps", "smooth_binomial", "pix2world", "overlap_components", "match_pairs", "histogram", "fit_major_minor"])
def test_against_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("part", "customer", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, small)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    plain = lambda row: tuple(round(float(v), 5) + 0.0 if isinstance(v, int | float) else v for v in row)
    assert sorted((plain(r) for r in df.collect()), key=repr) == sorted((plain([r[k] for k in at]) for r in cur.fetchall()), key=repr)
