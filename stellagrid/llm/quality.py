"""Quality rules: base counts of each text, and a hashed n-gram likelihood ratio of trusted against raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, small_batches

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: N-grams of so many bytes, hashed to so many buckets; the count that draws each bucket's ratio towards 1.
GRAM, BUCKETS, PRIOR = 4, 1 << 16, 1.0
#: The trusted multinomial is fitted on so many trusted documents at most, those whose ids have the smallest hashes.
TRUSTED = 20_000
#: A document is kept if its mean log ratio is at least this.
THRESHOLD = -0.7


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen and line.strip(SPACES):
                dup += 1
            seen.add(line)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        hit = bytearray(len(words))
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                hit[i : i + 3] = hit[j : j + 3] = b"\1\1\1"
        repeat = sum(hit)
    return len(words), chars, symbols, dup, repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def gram_buckets(text: str | bytes | None) -> np.ndarray:
    """The bucket of each n-gram of bytes of the text."""
    b = np.frombuffer(text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = b[:n].copy()
    for k in range(1, GRAM):
        h = (h << np.uint32(8)) | b[k : k + n]
    h *= np.uint32(2654435761)
    return (h >> np.uint32(16)).astype(np.int64) % BUCKETS


def stretches(text: str | None, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a text in stretches that overlap by GRAM - 1, so that every n-gram stands in exactly one."""
    b = text.encode("utf-8", "surrogatepass") if text else b""
    for at in range(0, len(b), step):
        yield b[at : at + step + GRAM - 1]


def mean_ratio(text: str | None, ratio: np.ndarray) -> float:
    """The mean over all n-grams of the text, a stretch of it at a time."""
    total, n = 0.0, 0
    for stretch in stretches(text):
        g = gram_buckets(stretch)
        total, n = total + float(ratio[g].sum()), n + len(g)
    return total / n if n else 0.0


def trusted_ids(labels: DataFrame, at_most: int) -> DataFrame:
    """Ids of documents labelled good and not toxic: all, or the at_most whose hashes are smallest."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)


def fit_ratio(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> np.ndarray:
    """log P(bucket | trusted) - log P(bucket | raw), smoothed; raw counts cover every document.

    A bucket's trusted count is held against the one that the raw share lets expect, both raised by PRIOR: what is rare
    in a small trusted sample says little, what is common in raw text and missing in trusted text says much.

    Each task adds up its own texts and sends one row a bucket, so the shuffle has tasks x BUCKETS small rows and the
    driver gets BUCKETS sums, whatever the corpus. The broadcast side has at most `trusted` ids.
    """
    small_batches(docs.sparkSession)
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted_ids(labels, trusted).withColumn("good", F.lit(True))), "doc_id", "left")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, good, any_row = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), False
        for batch in batches:
            for text, g in zip(batch["text"], batch["good"], strict=True):
                for stretch in stretches(text):
                    counts = np.bincount(gram_buckets(stretch), minlength=BUCKETS) if len(stretch) > 3000 else None
                    if counts is None:
                        buckets = gram_buckets(stretch)
                        np.add.at(raw, buckets, 1)
                        if g is True:
                            np.add.at(good, buckets, 1)
                    else:
                        raw += counts
                        if g is True:
                            good += counts
                any_row = True
        if any_row:
            used = np.flatnonzero(raw)
            yield pd.DataFrame({"bucket": used.astype(np.int32), "raw": raw[used], "good": good[used]})

    sums = marked.select("text", "good").mapInPandas(tally, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, g in sums.collect():  # BUCKETS rows at most
        raw[b], good[b] = r, g
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + PRIOR) / (raw * (good.sum() / raw.sum()) + PRIOR))


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """The base counts of each row of docs (doc_id, text), and whether it is kept (see RESULT).

    kept is false if base_failed, else true if the mean log ratio of the text's hashed n-grams is at least threshold.
    Null or empty text has no words and fails. Without any trusted document the ratio is 0 throughout, and the base
    rules alone decide. Repeated rows each count and each get their row. Long texts are taken in stretches that lose no
    n-gram. A score equal to the threshold keeps the document. An empty table gives no rows.
    Other columns are left aside.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(fit_ratio(docs, labels, trusted))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([base_counts(t) for t in batch["text"]], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            out["doc_id"] = batch["doc_id"].array
            out["base_failed"] = [base_failed(n, r) for n, r in zip(out["n_words"], out["n_repeat_words"], strict=True)]
            out["score"] = [mean_ratio(t, ratio.value) for t in batch["text"]]
            out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
            yield out

    return docs.select("doc_id", "text").mapInPandas(score, RESULT)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    ratio = docs.sparkSession.sparkContext.broadcast(fit_ratio(docs, labels, trusted))

    def passes(text: str | None) -> bool:
        n_words, *_, n_repeat_words = base_counts(text)
        return not base_failed(n_words, n_repeat_words) and mean_ratio(text, ratio.value) >= threshold

    return filter_texts(docs, lambda texts: [passes(t) for t in texts])
