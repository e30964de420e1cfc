"""The pipeline against the brute-force versions of its stages, in order."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from stellagrid.llm import quality  # noqa: E402

from .test_operators import BYTE, brute_components, brute_hits, brute_lines, brute_scores  # noqa: E402


def test_pipeline(spark, small):
    d, labels, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
    trusted = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}

    def enough(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        return len(w) >= 50 and 100 * len(again) <= 50 * len(w)

    rows = [r for r, score in zip(rows, brute_scores(rows, trusted), strict=True) if enough(r[1]) and score >= quality.THRESHOLD]
    rows = [(i, k) for i, _, _, k in brute_lines(rows)]
    first = {i for i, _, c in brute_components(rows) if i == c}
    rows = [r for r in rows if r[0] in first]
    hits = brute_hits(rows, [(r[0], r[1]) for r in bench.collect()])
    rows = [r for r, (_, _, hit, _) in zip(rows, hits, strict=True) if not hit]
    library = Tokenizer.from_file(BYTE)
    want = []
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_stages_keep_the_columns(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").withColumn("row_hash", F.lit("odd")).withColumn("kept", F.lit(1.5))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, small).dtypes == d.dtypes
        assert stage(spark, d.limit(0), small).count() == 0
