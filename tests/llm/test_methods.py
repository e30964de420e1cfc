"""What each method promises beyond its result: joins that count once, filters that reject, wrappers that decide."""

import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellagrid.llm import decontaminate, html, jaccard, licenses, shards, token_counts, urls

from .test_operators import WORD, brute_components, brute_hits, brute_licenses, docs, empty, library, rows_of, texts  # noqa: F401


# 2


def test_shards_of_many_small_groups(spark):
    """50,000 groups, a hot one and a large one: dealt to tasks, the balance is that of placing one by one."""
    r = np.random.default_rng(3)
    lengths = np.minimum(4000, 5 + r.pareto(1.3, 50_000) * 60).astype(int)
    rows = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "doc_id long, n int").repartition(6)
    word = F.when(F.col("doc_id") % 3 == 0, F.lit("ab ")).otherwise(F.lit("longer word "))
    docs = rows.withColumn("w", word).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.expr("left(repeat(w, n), n)")).alias("text"))
    docs = docs.unionByName(spark.range(10**6, 10**6 + 9000).select(F.col("id").alias("doc_id"), F.lit("a copy of one text").alias("text"))).unionByName(spark.createDataFrame([(-1, "z " * 30_000)], "doc_id long, text string"))
    got = shards.shard(docs, in_task=5000)
    by = shards.balance(got).collect()
    assert len(by) == shards.SHARDS
    for b in by:
        assert abs(b["size"] - 1) < 0.002 and abs(b["tokens"] - 1) < 0.002 and abs(b["n"] - 1) < 0.002, b
    one = shards.balance(shards.shard(docs, single=1 << 40)).collect()  # all at the driver, one after the other
    worst = lambda bs, c: max(abs(b[c] - 1) for b in bs)
    assert all(worst(by, c) < worst(one, c) + 0.002 for c in ("size", "tokens", "n"))
    slots = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()
    assert all(s["n"] == s["d"] == s["hi"] + 1 and s["lo"] == 0 for s in slots) and sum(s["n"] for s in slots) == 59_001


def test_shards_balance_bytes_tokens_and_rows(spark, small):
    """Small inputs are packed group by group; a small bound of single groups, as on large inputs, bundles the tail."""
    d = spark.read.parquet(f"{small}/../sf0.01/documents.parquet").select("doc_id", "text")
    for single, size, tokens in ((shards.SINGLE, 0.02, 0.05), (200, 0.02, 0.05)):
        by = shards.balance(shards.shard(d, single=single)).collect()
        assert len(by) == shards.SHARDS
        assert max(r["size"] for r in by) - min(r["size"] for r in by) < size
        assert max(r["tokens"] for r in by) - min(r["tokens"] for r in by) < tokens
        assert max(r["n"] for r in by) - min(r["n"] for r in by) < 0.05
    t = spark.createDataFrame([(1, None), (2, "a\tb\nc  d"), (3, " ")], "doc_id long, text string")
    assert rows_of(shards.shard(t), "doc_id", "tokens") == [(1, 0), (2, 4), (3, 0)]


# 3

LINES = {
    "Released under the ISC License.": "isc",
    "Licensed under CC BY 4.0.": "cc-by",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "This work is licensed under the GNU Affero General Public License, version 3.": "agpl,gpl",  # gpl by its phrase
    "This work is licensed under the GNU Lesser General Public License, version 3.": "gpl,lgpl",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "The weather is licensed to change under the public.": "",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "isc",
    "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
    "nd is a word.\nLicensed under CC BY-NC 4.0. nd": "cc-by-nc",
}


def wrapped(text, width):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line += (" " if line else "") + w
    return "\n".join([*out, line])


def test_license_labels(spark):
    mit = next(t for label, t, _, _ in reversed(licenses.TEMPLATES) if label == "mit" and "merge" in t)
    long = "far " * 50_000  # a very long line, with the words of a notice far from one another
    cases = [*LINES.items(), (wrapped(mit, 40), "mit"), (wrapped(mit, 11), "mit"), (long + "Released " + long + "under the MIT " + long + "license " + long, ""), (long + mit + " " + long, "mit")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for k, (text, labels) in enumerate(cases):
        assert got[k]["labels"] == labels, text[:80]
        found, score = brute_licenses(text)
        assert found <= set(labels.split(",")) and got[k]["score"] == pytest.approx(score)


def test_license_filters_reject_and_lose_nothing(spark):
    """Length and positional filters leave fewer pairs than share a prefix word, and every pair that matches."""
    r = random.Random(11)
    known = licenses.prepare(licenses.TEMPLATES, 0.8)
    rows = [(k, " ".join(r.sample(t.words, r.randint(1, len(t.words))))) for k in range(300) for t in [r.choice(known)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = sorted({w for t in known for w in (*t.words, *t.must, *t.never)})
    order = {w: k for k, w in enumerate(words)}
    sides, vocabulary, prefix = licenses._sides(spark, known, order)
    texts = docs.select(F.col("doc_id").alias("t1"), F.lit(0).alias("t2"), "text")
    blocks = licenses.blocks(texts, vocabulary, prefix).where("tile = 0")
    shared = blocks.select("t1", "reach", F.explode("ranks").alias("rank")).join(sides, ["reach", "rank"]).select("t1", "template").distinct()
    left = licenses.candidates(blocks, sides).select("t1", "template").distinct()
    want = {(k, t.number) for k, text in rows for t in known if len(set(text.split()) & set(t.words)) >= t.need}
    got = {tuple(x) for x in left.collect()}
    assert want <= got and len(got) < shared.count()
    # The positional filter alone rejects some that are long enough.
    enough = {(k, t.number) for k, text in rows for t in known if len({w for w in text.split() if w in order}) >= t.need}
    assert {tuple(x) for x in shared.collect()} & enough > got & enough


# 4


def test_windows_in_arrays():
    """Random words of a small alphabet, so that blocks repeat, windows touch, and items of every length occur."""
    r = random.Random(2)
    word = lambda: r.choice("ab cd ef g".split())
    prose = lambda n: " ".join(word() for _ in range(n))
    for _ in range(60):
        bench = [(k, prose(r.randint(1, 14))) for k in range(4)]
        texts = [prose(r.randint(0, 200)) for _ in range(5)] + [None, "", " ".join([prose(3), bench[0][1], prose(20), bench[0][1]])]
        found = decontaminate.search(decontaminate.tables(bench, 10), texts)
        got = [(k, n, sum(b - a for a, b in spans), {str(bench[i][0]) for i in items}) for k, (n, spans, items) in enumerate(found)]
        assert got == brute_hits(list(enumerate(texts)), bench)


def test_pieces_of_a_long_text_lose_no_window(monkeypatch):
    from stellagrid.llm import common

    monkeypatch.setattr(common, "PIECE", 50)
    text = " ".join(f"w{k}" for k in range(300))
    bench = [(k, " ".join(f"w{k + j}" for j in range(10))) for k in range(0, 290, 7)]
    found = decontaminate.search(decontaminate.tables(bench, 10), [text])
    assert [(0, found[0][0], sum(b - a for a, b in found[0][1]), {str(bench[i][0]) for i in found[0][2]})] == brute_hits([(0, text)], bench)


# 6


def test_inner_branches_merge(spark):
    """/en and /fr have alike shares: a branch below one of them that has no label of its own goes by both."""
    rules = [("block", "x.net", "/en/a/1"), ("block", "x.net", "/fr/a/1"), ("allow", "x.net", "/it/a/1")]
    rows = [(k, f"http://x.net/{lang}/a/1{k}") for lang in ("en", "fr", "it") for k in range(40)] + [(900, "http://x.net/en/b/c"), (901, "http://x.net/it/b/c")]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).where("page_id >= 900").collect()}
    assert got[900]["verdict"] == "block" and got[901]["verdict"] == "allow"
    alone = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame([r for r in rows if "/fr/" not in r[1]], "page_id long, url string"), rules).where("page_id >= 900").collect()}
    assert got[900]["impurity"] > alone[900]["impurity"]  # twice the evidence, as /fr is pooled with /en


# 8


@pytest.mark.parametrize("tile", [2, 5, 512])
def test_tiles_by_size_band_lose_no_link(spark, tile):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([12, 30, 60]))]
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((k, " ".join(w[: r.randint(len(w) - 8, len(w))])))
            k += 1
    got = rows_of(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows) and len({c for _, _, c in got}) < len(got)


# 9

OPAQUE = {"<nav>": '<div class="k1">', "</nav>": "</div>", '<div class="ad">': '<div class="k2">', "<article>": '<div class="k3">', "</article>": "</div>", "<footer>": '<div class="k4">', "</footer>": "</div>"}


def without_marks(source, names):
    for tag, other in OPAQUE.items():
        source = source.replace(tag, other if names else re.sub(" class=.*(?=>)", "", other))
    return source


@pytest.mark.parametrize("names", [True, False])
def test_the_wrapper_decides_without_marks(spark, small, monkeypatch, names):
    """No article, nav or footer, and no telling class names: what the aligned pages of a host vary in must do."""
    pages = spark.read.parquet(f"{small}/../sf0.01/pages.parquet")
    right = {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()}
    bare = spark.createDataFrame([(r["page_id"], r["url"], without_marks(r["html"], names)) for r in pages.collect()], "page_id long, url string, html string")
    host = lambda u: u.split("/")[2].lower()
    per = Counter(host(r["url"]) for r in bare.collect())
    got = [r for r in html.extract_pages(bare).collect() if per[host(r["url"])] >= 3]
    wrong = [r["page_id"] for r in got if r["text"] != right[r["page_id"]]]
    assert len(got) > 100 and not wrong
    monkeypatch.setattr(html, "main_part", lambda page, chosen: html.marked_main(page))  # as without any wrapper
    sources = {r["page_id"]: r["html"] for r in bare.collect()}
    assert all(html.extract(sources[r["page_id"]]) != right[r["page_id"]] for r in got)


def test_the_wrapper_chooses_where_marks_exist(spark, small):
    """On hosts of the test tables with several pages the chosen part is the article: the wrapper found it by itself."""
    pages = spark.read.parquet(f"{small}/../sf0.01/pages.parquet")
    rows = pages.select("page_id", F.col("html"), F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)).alias("host"), F.lit("").alias("layout"), F.xxhash64("html").alias("mark"))
    wrappers = {r["host"]: r["wrapper"] for r in html.induce_wrappers(rows)[0].collect()}
    chosen = Counter()
    for r in rows.collect():
        if wrapper := wrappers.get(r["host"]):
            page = html.parse(r["html"])
            t = html.Template(json.loads(wrapper))
            pairs = html.aligned(html.Shape([page]), t) or []
            chosen[tuple(n.tag for a, b in pairs if b.main for n in a.nodes)] += 1
    assert set(chosen) == {("article",)} and chosen[("article",)] > 150


def test_teasers_are_not_the_main_part(spark):
    rows = [(k, f"http://t.org/{k}", f"<body><div class=z><article>Teaser {k}</article></div><div class=q><h2>Head {k}</h2><p>{'Long text of the page ' * 5}{k}</p></div></body>") for k in range(5)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith(f"Head {r['page_id']} Long text") and "Teaser" not in r["text"] for r in got)


# 10


@pytest.mark.parametrize("common", [0, 5, 300])
def test_token_counts_through_the_shuffled_join(docs, library, common):  # noqa: F811
    got = rows_of(token_counts.count_tokens(docs, WORD, common=common), "doc_id", "n_bytes", "n_tokens")
    assert got == sorted(((i, len((t or "").encode()), len(library[1].encode(t or "", add_special_tokens=False).ids)) for i, t in texts()), key=repr)


def test_each_distinct_pretoken_is_counted_once(docs, library):  # noqa: F811
    table = token_counts.count_pretokens(token_counts.distinct_pretokens(docs), WORD).collect()
    want = Counter(w for _, t in texts() for words in token_counts.pretokens(t) for w in words)
    assert len({r["h"] for r in table}) == len(table) == len(want)
    assert sum(r["n"] for r in table) == sum(want.values())
    assert sum(r["tokens"] for r in table) == sum(len(library[1].encode(w.decode(), add_special_tokens=False).ids) for w in want)


def test_least_common_bounds_the_broadcast(spark):
    t = spark.range(1, 1000).select(F.col("id").alias("n"))
    for common in (0, 1, 10, 500, 5000):
        least = token_counts.least_common(t, common)
        assert t.where(F.col("n") >= least).count() <= common
    assert token_counts.least_common(t, 5000) == 1
