"""Vector codes against Lloyd's method in plain Python."""

import hashlib
import math
import random
from collections import defaultdict

import pytest

from stellagrid.llm import codebooks, queries


def brute(rows, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    ids = sorted({i for i, _, _ in kept if i is not None})[:16] + ([None] if len({i for i, _, _ in kept if i is not None}) < 16 and any(i is None for i, _, _ in kept) else [])
    n = len(kept[0][1])
    ends = [p * n // 8 for p in range(9)]
    books = [[min(v for i, v, _ in kept if i == k)[ends[p] : ends[p + 1]] for k in ids] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    choose = lambda p, v: min(range(len(ids)), key=lambda e: (far(v[ends[p] : ends[p + 1]], books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(8):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[choose(p, v)].append(v[ends[p] : ends[p + 1]])
            new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else books[p][e] for e in range(len(ids))])
        books = new
    out, by = [], defaultdict(int)
    for i, v, lab in kept:
        code = [choose(p, v) for p in range(8)]
        error = sum(far(v[ends[p] : ends[p + 1]], books[p][e]) for p, e in enumerate(code))
        by[lab] += error
        out.append((i, "".join(f"{e:02x}" for e in code), error, lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[lab], sha) for i, c, e, lab in out), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, pos int, row string, entry string"


def vectors(n, width, seed=2):
    r = random.Random(seed)
    near = [[r.choice([-0.5, 0.25, 0.1]) for _ in range(width)] for _ in range(5)]
    return [(r.randrange(n), [c + (0 if r.random() < 0.3 else round(r.gauss(0, 0.2) * 64) / 64) for c in r.choice(near)], r.choice([1, 2, 2, 2, None])) for _ in range(n)]


@pytest.mark.parametrize(("n", "width", "owner"), [(300, 24, 40), (9, 16, 100), (60, 11, 7), (40, 3, 1000)])
def test_against_brute_force(spark, monkeypatch, n, width, owner):
    monkeypatch.setattr(codebooks.fit, "__defaults__", (6, owner))
    rows = vectors(n, width)
    rows += [rows[0], rows[0], (None, rows[1][1], None), (-5, None, 1), (-4, [None] + rows[0][1][1:], 1), (-3, [float("nan")] * width, None), (-2, [float("-inf")] + rows[0][1][1:], 3)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    assert rows_of(codebooks.encode_vectors(df)) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert codebooks.encode_vectors(empty).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 8, 1, 1, "", ""), (2, [2.0] * 8, 1, 1, "", ""), (3, [1.0], 1, 1, "", ""), (4, [], None, 1, "", ""), (5, [3e38] * 8, 1, 1, "", "")], SCHEMA)
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codebooks.encode_vectors(odd).orderBy("vec_id").collect()] == [(1, "00" * 8, 0, 0), (2, "01" * 8, 0, 0)]
    assert [r["code"] for r in codebooks.encode_vectors(odd.where("vec_id = 4")).collect()] == ["00" * 8]


def test_only_movers_are_shuffled(spark, monkeypatch):
    """What a round sends to other owners is what changed its entry."""
    moved = []
    real = codebooks.cut

    def watched(df, name="cut", by=()):
        out = real(df, name, by=by) if by else real(df, name)
        if name == "arrived":
            moved.append(out.count())
        return out

    monkeypatch.setattr(codebooks, "cut", watched)
    rows = vectors(400, 16)
    codebooks.encode_vectors(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)).count()
    assert moved and max(moved) < 8 * 400 / 2


def test_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    df = queries.QUERIES["op12_codebooks"](spark, small)
    sql = con.execute("SELECT " + ", ".join(df.columns) + f" FROM ({queries.SQL['op12_codebooks']})").fetchall()
    assert rows_of(df) == sorted(map(tuple, sql), key=repr) and sql
