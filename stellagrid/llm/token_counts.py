"""Token counts without token ids: each distinct pre-token is counted once, and joined to the documents' frequencies."""

from __future__ import annotations

import hashlib
import os
from collections import Counter as Tally
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, small_batches, word_hashes

LIMIT = 2048
#: So many distinct pre-tokens does a task hold before it sends their counts on.
HELD = 300_000
#: The counts of so many of the commonest pre-tokens, of 12 bytes each, are broadcast at most; others meet theirs in a
#: shuffle.
COMMON = 2_000_000
#: A first cut into what the library would find in a pre-token, all special cases being the library's own.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Counts the tokens of pre-tokens under a vocabulary that drops white space and lower-cases.

    No token crosses white space there, so what stands between white space is a pre-token. Its count is the sum over
    runs of letters, of signs, and single digits, each of which goes to the library once a batch. Pre-tokens that may
    hold a special string, or characters that normalising may change, go to the library whole.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def _library(self, strings: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def count(self, pretokens: list[bytes]) -> list[int]:
        strings = [b.decode() for b in pretokens]
        # Of the letters in the first two Latin blocks, none is changed by composing, and each has one lower case.
        parts = [None if "<|" in s or not s.isascii() and max(s) > "ɏ" else _PARTS.findall(s.lower()) for s in strings]
        distinct = list({p for x in parts if x for p in x} | {s for s, x in zip(strings, parts, strict=True) if x is None})
        known = dict(zip(distinct, self._library(distinct), strict=True))
        return [known[s] if x is None else sum(map(known.__getitem__, x)) for s, x in zip(strings, parts, strict=True)]


def counter(source: str) -> Counter:
    """One counter a vocabulary in each Python process."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(source)
    return _COUNTERS[key]


def pretokens(text: str | None) -> Iterator[list[bytes]]:
    """The pre-tokens of a text, piece by piece, A-Z lower-cased but where a special string may stand."""
    for piece in pieces(text.encode()) if text else ():
        yield (piece if b"<|" in piece else piece.lower()).split()


def distinct_pretokens(docs: DataFrame) -> DataFrame:
    """(word, n): each distinct pre-token of docs (text), and how often it stands in all of them.

    Tasks send partial counts of their distinct pre-tokens, which are added up by word.
    """

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Tally = Tally()
        for batch in batches:
            for text in batch["text"]:
                for words in pretokens(text):
                    seen.update(words)
                    if len(seen) > HELD:
                        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                        seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return docs.select("text").mapInPandas(tally, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_pretokens(words: DataFrame, vocabulary: str) -> DataFrame:
    """(h, tokens, n) of words (word, n): each pre-token's hash and number of tokens. Every row is counted once."""
    with open(vocabulary, encoding="utf-8") as f:
        source = words.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(source.value)
        for batch in batches:
            words = list(batch["word"])
            yield pd.DataFrame({"h": word_hashes(words).view(np.int64), "tokens": c.count(words), "n": batch["n"]})

    return words.mapInPandas(count, "h long, tokens int, n long")


def least_common(counted: DataFrame, common: int) -> int:
    """The least frequency from which on no more than `common` pre-tokens are left; from a histogram of 64 rows at most."""
    power = F.floor(F.log2("n")).cast("int")
    left = common
    for p, rows in sorted(counted.groupBy(power.alias("p")).count().collect(), reverse=True):
        if (left := left - rows) < 0:
            return 1 << (p + 1)
    return 1


def frequencies(docs: DataFrame, table: DataFrame, least: int) -> DataFrame:
    """row, doc_id, n_bytes, tokens and rest of each row of docs: its pre-tokens' frequencies joined to table (h, tokens).

    Pre-tokens found at least `least` times in all texts are joined within the task, in the broadcast table of these,
    sorted by hash. The others stay in rest, an array of (h, f).
    """
    hot = table.where(F.col("n") >= least).select("h", "tokens").toArrow()  # COMMON rows at most
    h, tokens = hot["h"].to_numpy().view(np.uint64), hot["tokens"].to_numpy().astype(np.uint32)
    order = np.argsort(h)
    shared = docs.sparkSession.sparkContext.broadcast((h[order], tokens[order]))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, tokens = shared.value
        for batch in batches:
            sums, rests, counts, sizes = [], [], [], []
            for text in batch["text"]:
                found = [word_hashes(words) for words in pretokens(text)]
                own, f = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                hit = known[at] == own if len(known) else np.zeros(len(own), dtype=bool)
                sums.append(int((f[hit] * tokens[at[hit]]).sum()))
                rests.append(own[~hit].view(np.int64))
                counts.append(f[~hit])
                sizes.append(len(text.encode()) if text else 0)
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "n_bytes": sizes, "tokens": sums, "rest": rests, "f": counts})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInPandas(join, "row long, doc_id long, n_bytes long, tokens long, rest array<long>, f array<long>")


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs (doc_id, text).

    vocabulary is the path, on the driver, of a lower-casing, white-space-dropping vocabulary in the tokenizers
    library's JSON form; its text goes to the tasks.

    1. Distinct pre-tokens of all texts, with how often they occur.
    2. The number of tokens of each, counted once, as a table by the pre-token's 64-bit hash.
    3. Each document's pre-token frequencies, joined to that table: in a broadcast of its `common` commonest rows at
       most, and in a shuffled join for the pre-tokens that are not there; what comes to it is summed by document.

    The shuffled join has no hot key, since common pre-tokens never reach it. No ids are made. Counts are exact but for
    equal 64-bit hashes of different pre-tokens. Long texts are taken in pieces, cut at white space.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows each get their row; an empty table gives none. Ties of
    frequency stay on the same side of the broadcast's bound.
    """
    small_batches(docs.sparkSession)
    table = cut(count_pretokens(distinct_pretokens(docs), vocabulary), "pretokens")
    least = least_common(table, common)
    first = cut(frequencies(docs, table, least), "frequencies")
    rare = first.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "f")).alias("x")).select("row", F.col("x.rest").alias("h"), F.col("x.f").alias("f"))
    other = table.where(F.col("n") < least).select("h", F.col("tokens").alias("each"))
    more = rare.join(other, "h").groupBy("row").agg(F.sum(F.col("f") * F.col("each")).alias("more"))
    n_tokens = F.col("tokens") + F.coalesce("more", F.lit(0))
    return first.select("row", "doc_id", "n_bytes", "tokens").join(more, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
