"""MinHash near-duplicates: few low bits of many minima, candidates from bands, links confirmed on full shingle sets.

The minima of a set under MINIMA hash functions agree with those of another one at a share that is their Jaccard
similarity. Bands of ROWS minima bring together sets that agree in one of them; of each minimum LOW bits are kept, packed
into whole numbers, whose equal lanes are counted by bit operations. Two sets of similarity 0.85 miss each other in all
bands with a chance of 7e-9, and fall below LEAST equal lanes with one of less than 1e-9. All else is exact, but for equal
64-bit hashes of different shingles or sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import cut, drop, small_side, text_or_empty
from .jaccard import BITS, PARTNERS, _index_pairs, _node, _runs, _tiles, confirm, least_ids, shingle_set, signature

WORDS, SIMILAR = 3, 85
BANDS, ROWS, LOW = 32, 5, 2
MINIMA = BANDS * ROWS
LANES = 64 // LOW
PACKED = MINIMA // LANES
#: Entries of a bucket that meet in one tile at most.
TILE = 2048
#: Buckets of over LARGE entries first try only the closest partner of each component.
LARGE = 32


def _chance(matches: int, n: int, p: float) -> float:
    return math.comb(n, matches) * p**matches * (1 - p) ** (n - matches)


def least_equal(similar: float = SIMILAR / 100, miss: float = 1e-9) -> int:
    """The least number of equal lanes that sets of this similarity have, but for a chance of `miss`.

    Lanes of different minima are equal by chance once in 2 ** LOW: of a similarity s, s + (1 - s) / 2 ** LOW are equal.
    """
    p, below, m = similar + (1 - similar) / 2**LOW, 0.0, 0
    while below + _chance(m, MINIMA, p) < miss:
        below += _chance(m, MINIMA, p)
        m += 1
    return m


LEAST = least_equal()


def estimate(equal):
    """The similarity that a number of equal lanes speaks for, less what is equal by chance."""
    return (equal / MINIMA - 2.0**-LOW) / (1 - 2.0**-LOW)


_rng = np.random.default_rng(0x5EED)
_MULTIPLY = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_WEIGH = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """The minima of a set of hashes, not empty."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(low, (s[i : i + 4096, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest bits of the minima, LANES to a number."""
    lanes = (low & np.uint64((1 << LOW) - 1)).reshape(PACKED, LANES)
    return np.bitwise_or.reduce(lanes << (np.arange(LANES, dtype=np.uint64) * np.uint64(LOW)), axis=1)


def bands(low: np.ndarray) -> np.ndarray:
    """A hash of each band's minima."""
    h = (low.reshape(BANDS, ROWS) * _WEIGH).sum(axis=1, dtype=np.uint64) + _BAND
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_EVEN = 0x5555555555555555


def equal_lanes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of equal lanes of rows of packed numbers."""
    d = x ^ y
    return MINIMA - np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(_EVEN)).sum(axis=-1, dtype=np.int64)


SIG = [f"s{k}" for k in range(PACKED)]
SIGNED = "doc_id long, row_hash long, n_shingles long, node long, " + ", ".join(f"{c} long" for c in SIG) + ", bits binary, bands array<long>"


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t, WORDS) for t in batch["text"]]
        lows = [minima(s) if len(s) else None for s in sets]
        none = np.zeros(PACKED, np.int64)
        sigs = np.stack([none if m is None else packed(m).view(np.int64) for m in lows]) if lows else np.zeros((0, PACKED), np.int64)
        out = {"doc_id": batch["doc_id"], "row_hash": batch["row_hash"], "n_shingles": [len(s) for s in sets], "node": [_node(s) for s in sets]}
        yield pd.DataFrame(out | {c: sigs[:, k] for k, c in enumerate(SIG)} | {"bits": [signature(s, BITS) for s in sets], "bands": [None if m is None else bands(m).view(np.int64) for m in lows]})


def _similar(na: Column | str, nb: Column | str) -> Column:
    """Whether sets of so many shingles can link."""
    return 100 * F.least(na, nb) >= SIMILAR * F.greatest(na, nb)


def _likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sizes allow a link and whose signatures have LEAST equal lanes."""
    side = lambda x: small_side(marks.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), *(F.col(c).alias(f"{x}{c}") for c in SIG)), F.lit(24 + 8 * PACKED))
    apart = lambda c: F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))
    unequal = sum((F.bit_count((apart(c).bitwiseOR(F.shiftrightunsigned(apart(c), 1))).bitwiseAND(F.lit(_EVEN))) for c in SIG[1:]), F.bit_count((apart(SIG[0]).bitwiseOR(F.shiftrightunsigned(apart(SIG[0]), 1))).bitwiseAND(F.lit(_EVEN))))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_similar("na", "nb") & (MINIMA - unequal >= LEAST)).select("a", "b")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted distinct arrays, neither empty, link."""
    if 100 * min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return (100 + SIMILAR) * int((both[1:] == both[:-1]).sum()) >= SIMILAR * (len(x) + len(y))


def _close(best: bool):
    """Pairs of a tile that differ in label, can link by size, have LEAST equal lanes, and bitmaps of all their shingles that
    differ in no more bits than elements of a link may; if `best`, the closest of each label.

    The bitmaps lose no link. They leave out most pairs whose similarity is below that of a link by less than the lanes
    can tell, of which a large group of near copies has as many as it has pairs. Without `best`, a pair comes from the
    first of the buckets that it shares: there are no other bounds, so it meets in all of them.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _ in _runs(batches, ["h", "lo", "c", "d"], 1 << 30):
            h, lo, c, d, own = (rows[x].to_numpy() for x in ("h", "lo", "c", "d", "own"))
            n, node, label = (rows[x].to_numpy().astype(np.int64) for x in ("n", "node", "label"))
            sig = np.stack([rows[x].to_numpy().astype(np.int64) for x in SIG], axis=1).view(np.uint64)
            bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint64).reshape(len(rows), BITS // 64)
            keys = None if best else np.array(rows["bands"].tolist(), dtype=np.int64)
            edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1]))))
            tile = np.repeat(np.arange(len(edge)), np.diff(np.concatenate((edge, [len(h)]))))
            end = np.searchsorted(tile, tile, side="right")
            total = np.concatenate(([0], np.cumsum(end - np.arange(len(h)) - 1)))
            at, found = 0, []
            while at < len(h):  # about 100 000 pairs at a time
                to = max(at + 1, int(np.searchsorted(total, total[at] + 100_000, side="right")) - 1)
                x, y = _index_pairs(at, to, end)
                at = to
                ok = (label[x] != label[y]) & ((c[x] == d[x]) | (own[x] != own[y])) & (100 * np.minimum(n[x], n[y]) >= SIMILAR * np.maximum(n[x], n[y]))
                x, y = x[ok], y[ok]
                equal = equal_lanes(sig[x], sig[y])
                ok = equal >= LEAST
                x, y, equal = x[ok], y[ok], equal[ok]
                common = (n[x] + n[y] - np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)) // 2
                ok = (100 + SIMILAR) * common >= SIMILAR * (n[x] + n[y])
                if not best:
                    first = (keys[x] == keys[y]).argmax(axis=1)
                    ok &= keys[x, first] == h[x]
                found.append((x[ok], y[ok], equal[ok]))
            x, y, equal = (np.concatenate(z) for z in zip(*found, strict=True))
            if best and len(x):
                who, which = np.concatenate((label[x], label[y])), np.concatenate((np.arange(len(x)), np.arange(len(x))))
                order = np.lexsort((-equal[which], who, tile[x[which]]))
                where, who = tile[x[which]][order], who[order]
                keep = np.unique(which[order][np.concatenate(([True], (who[1:] != who[:-1]) | (where[1:] != where[:-1])))])
                x, y = x[keep], y[keep]
            if len(x):
                yield pd.DataFrame({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])}).drop_duplicates()

    return pairs


def minhash_components(docs: DataFrame, tile: int = TILE, partners: int = PARTNERS) -> DataFrame:
    """doc_id, row_hash, n_shingles and component_id of each row of docs (doc_id, text); row_hash is its text's.

    1. Each text becomes a set of hashed shingles, a node, with a packed signature and a hash of every band. Equal sets are
       one node, so copies cost one row each.
    2. The least node of a bucket is its pivot. Every node is compared with the pivot it shares most bands with, if
       their signatures allow it, and the links joined to components. So a group of near copies costs a text a member.
    3. Buckets that still hold several components are cut into tiles by size band. First every component of a large
       bucket is compared with the closest other one by equal lanes, at last every pair of sets of different components
       that the signatures allow. So no link is lost that could join two components.

    Null or empty text, or text without words, has no shingles and its own doc_id as component. Rows without doc_id have a
    null component and link with nothing. Repeated rows of a doc_id get equal results if their texts are equal. An empty
    table gives none. Very long texts are hashed in stretches; their sets are held by one task at a time. Ties between
    partners that are equally close go to either. Other columns are left aside.
    """
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("row_hash"), "text")
    signed = cut(rows.mapInPandas(_sign, SIGNED), "signed")
    used = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    entries = used.select(F.explode("bands").alias("h"), "node", F.col("n_shingles").alias("n"))
    pivots = cut(entries.groupBy("h").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where(F.col("pivot") < F.col("last")).select("h", "pivot"), "pivots")
    active = cut(entries.join(small_side(pivots, F.lit(16)), "h").distinct(), "active")
    nodes = small_side(cut(active.select("node").distinct(), "nodes"), F.lit(8))
    marks = cut(used.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "row_hash")).alias("first"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in (*SIG, "bits", "bands"))), "marks")
    places = marks.select("node", "first.doc_id", "first.row_hash")

    shared = active.where(F.col("pivot") != F.col("node")).groupBy("node", "pivot").agg(F.count("*").alias("k"))
    pairs = cut(shared.groupBy("node").agg(F.max(F.struct("k", "pivot"))["pivot"].alias("a")).select("a", F.col("node").alias("b")), "pairs")
    tried = cut(_likely(pairs, marks), "pairs")
    found = connected_components(confirm(tried, rows, places, WORDS, linked, partners), "a", "b")
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for best in (True, False):
        named = active.join(found, "node", "left").select("h", F.lit(0).alias("pos"), "n", "node", F.coalesce("component", "node").alias("label"))
        tiles = _tiles(named, tile, LARGE if best else 1).join(marks.select("node", *SIG, "bits", *([] if best else ["bands"])), "node")
        close = tiles.repartition("h", "lo", "c", "d").sortWithinPartitions("h", "lo", "c", "d").mapInPandas(_close(best), "a long, b long").distinct()
        new = cut(close.join(tried, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            continue
        tried = tried.unionByName(new)
        links = confirm(new, rows, places, WORDS, linked, partners)
        if not links.isEmpty():
            found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), "a", "b")
    out = least_ids(signed.select("doc_id", "row_hash", "n_shingles", "node"), found)
    drop(active)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs: the first of a component and rows without id are kept."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return minhash_components(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
