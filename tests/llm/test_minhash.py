"""MinHash components against all pairs of sets."""

import random
import re

import numpy as np
import pytest

from stellagrid.llm import jaccard, minhash, queries

from .test_operators import docs, empty, low, rows_of, texts  # noqa: F401


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), 1 << 62), i)
    return sorted(((i, len(sets[a]), None if i is None else least[find(a)], i is None or i == least[find(a)]) for a, (i, _) in enumerate(rows)), key=repr)


NAMES = ["doc_id", "n_shingles", "component_id", "kept"]


def test_against_all_pairs(docs, empty):  # noqa: F811
    got = rows_of(minhash.near_duplicates(docs), *NAMES)
    assert got == brute(texts()) and len({r[2] for r in got}) < len(got) - 10
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("tile", "partners"), [(2048, 2000), (5, 3)])
def test_chains_of_borderline_copies(spark, tile, partners):
    r = random.Random(12)
    rows, base = [], []
    for k in range(160):  # each a change away from the one before: links form chains
        if k % 20 == 0:
            base = [f"w{r.randint(0, 10**6)}" for _ in range(90)]
        base[r.randrange(90)] = f"c{k}"
        if k % 7 == 0:
            base[r.randrange(90)] = f"d{k}"
        rows.append((k, " ".join(base)))
    rows += [(1000 + k, " ".join(f"v{j}" if j != k else "x" for j in range(40))) for k in range(40)]  # a star, and pairs on either side of 0.85
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(minhash.minhash_components(df, tile, partners), *NAMES[:3]) == [r[:3] for r in brute(rows)]


def test_equal_lanes_estimate_similarity():
    r = np.random.default_rng(4)
    errors = []
    for share in (0.0, 0.3, 0.6, 0.85, 1.0):
        for _ in range(40):
            both, x, y = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (max(1, int(400 * share)), 400 - int(400 * share), 400 - int(400 * share)))
            a, b = np.unique(np.concatenate((both, x))), np.unique(np.concatenate((both, y)))
            similar = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(minhash.estimate(minhash.equal_lanes(minhash.packed(minhash.minima(a)), minhash.packed(minhash.minima(b)))) - similar)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_bands_and_lanes_find_links():
    """Pairs of similarity 0.85 share a band and have LEAST equal lanes."""
    r = np.random.default_rng(6)
    for n in (12, 40, 400):
        for _ in range(150):
            both = r.integers(0, 1 << 63, n, dtype=np.uint64)
            more = int(n * 15 / 85)
            a, b = np.unique(np.concatenate((both, r.integers(0, 1 << 63, more // 2, dtype=np.uint64)))), np.unique(np.concatenate((both, r.integers(0, 1 << 63, more - more // 2, dtype=np.uint64))))
            la, lb = minhash.minima(a), minhash.minima(b)
            assert (minhash.bands(la) == minhash.bands(lb)).any()
            assert minhash.equal_lanes(minhash.packed(la), minhash.packed(lb)) >= minhash.LEAST


def test_links_are_exact():
    words = [f"w{k}" for k in range(102)]
    a = jaccard.shingle_set(" ".join(words), 3)
    assert len(a) == 100 and minhash.linked(a[:85], a) and not minhash.linked(a[:84], a)


def test_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    df = queries.QUERIES["op11_minhash"](spark, small)
    sql = con.execute("SELECT " + ", ".join(df.columns) + f" FROM ({queries.SQL['op11_minhash']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(sql) and sql
