"""Benchmark decontamination: Wu-Manber search for every window of the test items in every document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, hash128, pieces, small_batches, text_or_empty

WINDOW = 10
#: At most so many MB of test text are searched for at once; more is searched for block by block. The tables of a block
#: are built once in each Python process, and take about 12 times its size while they are (measured: 390 MB for 32 MB).
BLOCK_MB = 16
#: So many words of documents are searched at once.
_AT_ONCE = 200_000
_TABLES: dict[tuple, list[WuManber]] = {}

#: Word characters are 0-9, a-z and all beyond ASCII; A-Z become a-z, and every other byte a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _hashes(first: list[bytes], second: list[bytes] | None) -> np.ndarray:
    """Hashes of blocks of one or two words; they hold within this process."""
    return np.fromiter(map(hash, first if second is None else zip(first, second, strict=False)), dtype=np.int64).view(np.uint64)


class WuManber:
    """Multi-pattern search over words, for the windows of one length of items (number, words).

    A block is two adjacent words, or the one of windows of one word. The shift table says how far a search may jump
    when a text has that block where a window would end; a block that no window holds allows `far` words. Windows stand
    in buckets by the hashes of their last and first blocks. All tables are sorted arrays: a window takes about 40
    bytes, whatever its words are.
    """

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], length: int):
        self.length, self.width = length, min(2, length)
        self.far = length - self.width + 1
        texts, blocks, shifts, keys, starts, owners, at = [], [], [], [], [], [], 0
        for number, words in items:
            own = self._blocks(words)
            windows = len(words) - length + 1
            blocks.append(own)
            shifts.append(np.maximum(0, length - self.width - np.arange(len(own))).astype(np.uint8))
            keys.append(self._keys(own[:windows], own[length - self.width :]))
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            starts.append((at + np.concatenate(([0], ends[:-1])))[:windows].astype(np.uint32))
            owners.append(np.full(windows, number, dtype=np.int32))
            texts.append(b" ".join(words) + b" ")
            at += int(ends[-1])
        self.text = b"".join(texts)
        del texts
        every, shift = np.concatenate(blocks), np.concatenate(shifts)
        order = np.lexsort((shift, every))
        every, shift = every[order], shift[order]
        first = np.concatenate(([True], every[1:] != every[:-1]))
        self.blocks, self.shift = every[first], shift[first]
        del every, shift, blocks, shifts, order, first
        keys, starts, owners = np.concatenate(keys), np.concatenate(starts), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.owners = keys[order], starts[order], owners[order]

    def _blocks(self, words: list[bytes]) -> np.ndarray:
        return _hashes(words, words[1:] if self.width == 2 else None)

    @staticmethod
    def _keys(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (first * _MIX) ^ last

    def find(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, set[int]]]:
        """(text, start, items) of each occurrence in texts, which are lists of words.

        Blocks are looked up at every far-th place. Where one is in no window, no window ends before the next such
        place; elsewhere the shift says which of the ends up to there are possible.
        """
        length, width, far = self.length, self.width, self.far
        looked = [_hashes(t[length - width :: far], t[length - 1 :: far] if width == 2 else None) if len(t) >= length else np.zeros(0, np.uint64) for t in texts]
        which = np.repeat(np.arange(len(texts)), [len(x) for x in looked])
        place = length + far * np.concatenate([np.arange(len(x)) for x in looked]) if looked else np.zeros(0, np.int64)
        block = np.concatenate(looked) if looked else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(self.blocks, block), len(self.blocks) - 1)
        hit = self.blocks[at] == block
        which, place, shift = which[hit], place[hit], self.shift[at[hit]].astype(np.int64)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.maximum(0, np.minimum(far - shift, sizes[which] - place - shift + 1))
        which, end = np.repeat(which, ends), np.repeat(place + shift, ends) + np.arange(ends.sum()) - np.repeat(np.cumsum(ends) - ends, ends)
        pairs = [(texts[i], e) for i, e in zip(which.tolist(), end.tolist(), strict=True)]
        first = _hashes([t[e - length] for t, e in pairs], [t[e - length + 1] for t, e in pairs] if width == 2 else None)
        last = _hashes([t[e - width] for t, e in pairs], [t[e - 1] for t, e in pairs] if width == 2 else None)
        key = self._keys(first, last)
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        for k in np.flatnonzero(low < high).tolist():
            t, e = pairs[k]
            said = b" ".join(t[e - length : e]) + b" "
            items = {int(self.owners[j]) for j in range(low[k], high[k]) if self.text.startswith(said, int(self.starts[j]))}
            if items:
                yield int(which[k]), e - length, items


def tables(items: list[tuple], window: int) -> list[WuManber]:
    """A searcher for each length of the windows of items (id, text); items are numbered as they come."""
    by_length: dict[int, list[int]] = {}
    for number, (_, text) in enumerate(items):
        if n := len(words_of(text)):
            by_length.setdefault(min(window, n), []).append(number)
    return [WuManber(((k, words_of(items[k][1])) for k in own), length) for length, own in sorted(by_length.items())]


def known_tables(key: tuple, items: list[tuple], window: int) -> list[WuManber]:
    """tables(), built once for a key in each Python process, which holds those of one key."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = tables(items, window)
    return _TABLES[key]


def merge(spans: list) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def stretches(text: str | None, window: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(place of the first word, words, new words) of pieces of a text, each with the last window - 1 words before it."""
    at, carry = 0, []
    for piece in pieces(text.encode("utf-8", "surrogatepass").translate(_FOLD)) if text else ():
        new = piece.split()
        words = carry + new
        yield at - len(carry), words, len(new)
        at += len(new)
        carry = words[max(0, len(words) - window + 1) :]


def search(searchers: list[WuManber], texts: list[str | None], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """For each text its number of words, the merged [start, end) stretches of hit words, and the numbers of items."""
    counts, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    held: list[tuple[int, int, list[bytes]]] = []

    def flush() -> None:
        for s in searchers:
            for k, start, found in s.find([words for _, _, words in held]):
                i, at, _ = held[k]
                spans[i].append((at + start, at + start + s.length))
                items[i] |= found
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        for at, words, new in stretches(text, window):
            counts[i] += new
            held.append((i, at, words))
            size += len(words)
            if size > _AT_ONCE:
                flush()
                size = 0
    flush()
    return [(n, merge(s), found) for n, s, found in zip(counts, spans, items, strict=True)]


def summary(n_words: int, spans: list, items: list[str]) -> tuple:
    names = sorted(set(items))
    n_hit = sum(b - a for a, b in spans)
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Block:
    """Some of the items, on their way to the tasks: ids, texts and a key for the tables made of them."""

    def __init__(self, items: DataFrame, window: int):
        rows = [tuple(r) for r in items.orderBy("item", "text").collect()]  # block_mb of text at most
        self.window = window
        self.key = (window, hashlib.sha256(repr(rows).encode("utf-8", "surrogatepass")).hexdigest())
        self.rows = items.sparkSession.sparkContext.broadcast(rows)

    def search(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        rows = self.rows.value
        found = search(known_tables(self.key, rows, self.window), texts, self.window)
        return [(n, spans, [rows[i][0] for i in items]) for n, spans, items in found]


def _blocks(benchmark: DataFrame, window: int, block_mb: float) -> Iterator[Block]:
    """The items in blocks of about block_mb of text each, by a hash of the item."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -int(-size // (block_mb * 1_000_000)))
    for k in range(n):
        yield Block(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k), window)


def _scan_blocks(keyed: DataFrame, blocks: list[Block]) -> DataFrame:
    """(t1, t2, spans, items) of the texts of keyed (t1, t2, text) in which an item of any block is found."""
    parts = None
    for block in blocks:

        def part(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(t1, t2, [list(s) for s in spans], items) for t1, t2, (_, spans, items) in zip(batch["t1"], batch["t2"], block.search(list(batch["text"])), strict=True) if spans]
                yield pd.DataFrame(rows, columns=["t1", "t2", "spans", "items"])

        found = keyed.select("t1", "t2", "text").mapInPandas(part, "t1 long, t2 long, spans array<array<int>>, items array<string>")
        found = found.dropDuplicates(["t1", "t2"])  # equal texts find the same
        parts = found if parts is None else parts.unionByName(found)
    # A row a text and block; its spans and items are bounded by its own length and the benchmark's.
    return parts.groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_mb: float = BLOCK_MB) -> DataFrame:
    """For each row of docs (doc_id, text): its words, those inside test windows, and the items found (see RESULT).

    The size of the benchmark is checked first. Up to block_mb of test text go to the executors at once, and one scan
    without any shuffle answers all; a larger benchmark is searched for in blocks of that size, each in a scan of its
    own, and the stretches found are merged by row.

    Null or empty texts have no words and no hits. Items without words or without an id find nothing; rows of one
    item_id are one item. An item of fewer than `window` words is a single window. Windows that several items have
    count for each of them. Repeated rows of docs each get a row. Long texts are searched in pieces that overlap by a
    window. An empty table gives no rows, an empty benchmark no hits. Other columns are left aside.
    """
    small_batches(docs.sparkSession)
    blocks = list(_blocks(benchmark, window, block_mb))
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    if len(blocks) == 1:
        block = blocks[0]

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([summary(*x) for x in block.search(list(batch["text"]))], columns=columns).assign(doc_id=batch["doc_id"].array)

        return docs.select("doc_id", "text").mapInPandas(whole, RESULT)

    keyed = docs.select("doc_id", "text", *(h.alias(f"t{i}") for i, h in enumerate(hash128(text_or_empty()), 1)))
    parts = _scan_blocks(keyed, blocks)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans, items in zip(batch["text"], batch["spans"], batch["items"], strict=True):
                n_words = sum(new for _, _, new in stretches(text, window))
                out.append(summary(n_words, merge([tuple(s) for s in spans]) if spans is not None else [], list(items) if items is not None else []))
            yield pd.DataFrame(out, columns=columns).assign(doc_id=batch["doc_id"].array)

    return keyed.join(parts, ["t1", "t2"], "left").select("doc_id", "text", "spans", "items").mapInPandas(gather, RESULT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_mb: float = BLOCK_MB) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of any item occurs."""
    for block in _blocks(benchmark, window, block_mb):  # each a scan that drops rows; none is shuffled
        docs = filter_texts(docs, lambda texts, block=block: [not spans for _, spans, _ in block.search(texts)])
    return docs
