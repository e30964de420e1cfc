"""N-gram Jaccard join: documents whose word-shingle sets are alike, and the groups that such links form.

All that follows is exact, but for equal 64-bit hashes of different shingles or different shingle sets. Two sets of a
and b shingles link if they share at least t = ceil(4 (a + b) / 9), which is a Jaccard similarity of 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import cut, drop, run_hashes, small_batches, small_side, text_or_empty

WORDS = 5
#: Similarity 80 / 100; the formulas below have it worked in.
SIMILAR = 80
#: Bits of a signature for each shingle, and of all signatures when tiles are compared; buckets of the frequency
#: sketch; entries of a bucket that meet in one tile at most.
BITS_EACH, BITS, SKETCH, TILE = 8, 1024, 1 << 16, 2048
#: Partners of one set that a task compares with it at most.
PARTNERS = 2000
#: Rounds in which only best partners are tried, in buckets of over LARGE entries, before all pairs are.
ROUNDS, LARGE = 1, 32
#: A sketch bucket with so many shingles above the mean is dealt to several tasks.
SALT_AT = 50_000
_STRETCH = 1 << 19

def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the runs of k words; of all words if there are fewer; nothing without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(text) <= _STRETCH:
        return np.unique(run_hashes(b" ".join(words), k))
    step = _STRETCH // 8
    return np.unique(np.concatenate([run_hashes(b" ".join(words[i : i + step + k - 1]), k) for i in range(0, max(1, len(words) - k + 1), step)]))


def needed(a, b):
    """The least number of common shingles with which sets of a and b link."""
    return -(-4 * (a + b) // 9)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted distinct arrays, neither empty, link."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= needed(len(x), len(y))


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(s: np.ndarray, width: int | None = None) -> bytes:
    """A bitmap of a set's hashes, BITS_EACH times as wide as the set is large, to a power of two, BITS at least."""
    if width is None:
        width = BITS
        while width < min(1 << 17, BITS_EACH * len(s)):
            width *= 2
    bits = np.zeros(width, dtype=np.uint8)
    bits[(s >> np.uint64(40)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def differing_bits(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the wider one folded to the other's width: no more than elements that differ."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    w, v = 8 * len(x), 8 * len(y)
    while w > v:
        w //= 2
        a = (a >> w) | (a & ((1 << w) - 1))
    while v > w:
        v //= 2
        b = (b >> v) | (b & ((1 << v) - 1))
    return (a ^ b).bit_count()


SIGNED = "doc_id long, row_hash long, n_shingles long, node long, bucket int, n long"


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document, then one for each used bucket of the task's frequency sketch."""
    seen = np.zeros(SKETCH, dtype=np.int64)
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "row_hash": batch["row_hash"],
                "n_shingles": [len(s) for s in sets],
                "node": [_node(s) for s in sets],
                "bucket": None,
                "n": None,
            }
        )
        if sets:
            seen += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    used = np.flatnonzero(seen)
    if len(used):
        yield pd.DataFrame({"doc_id": None, "row_hash": None, "n_shingles": None, "node": None, "bucket": used, "n": seen[used]})


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        yield pd.DataFrame({"node": batch["node"], "n": [*map(len, sets)], "sig": [*map(signature, sets)], "bits": [signature(s, BITS) for s in sets]})


ENTRY = "h long, salt int, pos int, n int, node long"


def _entries(counts: np.ndarray, salt_at: int):
    """Each set's rarest shingles, so many that two sets that link share one of them.

    The order is that of the sketched frequency, then of the hash. Any fixed order finds every link; this one leaves
    what many documents share to the end. A set that the task has sent already is not sent again.
    """
    mean = counts.sum() / max(1, len(counts))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[int] = set()
        for batch in batches:
            parts: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if doc_id is None or doc_id != doc_id:
                    continue
                s = shingle_set(text)
                if not len(s) or (node := _node(s)) in sent:
                    continue
                if len(sent) < 200_000:
                    sent.add(node)
                n = len(s)
                m = n - (4 * n + 4) // 5 + 1
                order = np.argsort((counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (s >> np.uint64(32)), kind="stable")[:m]
                parts.append((s[order], np.arange(m, dtype=np.int32), np.full(m, n, np.int32), np.full(m, node, np.int64)))
            if parts:
                h, pos, n, node = (np.concatenate(x) for x in zip(*parts, strict=True))
                excess = np.maximum(0, counts[(h & np.uint64(SKETCH - 1)).astype(np.int64)] - mean)
                salts = 1 + (excess // salt_at).astype(np.int64)
                yield pd.DataFrame({"h": h.view(np.int64), "salt": (np.abs(node) % salts).astype(np.int32), "pos": pos, "n": n, "node": node})

    return emit


def _gathered(batches: Iterator[pd.DataFrame], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Batches of short rows, put together to about so many."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _runs(batches: Iterator[pd.DataFrame], keys: list[str], at_most: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Rows sorted by keys in pieces of whole runs of equal keys, and whether the last run goes on in the next piece.

    Only a run of over at_most rows is divided.
    """
    rest = None
    for batch in _gathered(batches):
        if not len(batch):
            continue
        if rest is not None and len(rest):
            batch = pd.concat([rest, batch], ignore_index=True)
        same = np.ones(len(batch), dtype=bool)
        for k in keys:
            same &= (batch[k] == batch[k].iloc[-1]).to_numpy()
        whole = len(batch) - int(same.sum())
        if not whole and len(batch) > at_most:
            yield batch, True
            rest = batch.iloc[:0]
        else:
            if whole:
                yield batch.iloc[:whole], False
            rest = batch.iloc[whole:]
    if rest is not None and len(rest):
        yield rest, False


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries in whose bucket several sets meet, each with the pivot of its size band (or of the next lower band)."""
    divided = None
    for rows, goes_on in _runs(batches, ["h", "salt"], 100_000):
        h, salt, n, node = (rows[c].to_numpy() for c in ("h", "salt", "n", "node"))
        run = np.concatenate(([0], np.cumsum((h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))))
        band = np.floor(np.log(n) / np.log(1.25)).astype(np.int64)
        order = np.lexsort((node, band, run))
        h, salt, n, node, run, band, pos = h[order], salt[order], n[order], node[order], run[order], band[order], rows["pos"].to_numpy()[order]
        # Salted buckets and the parts of a divided run meet later, so a lone entry there may have partners.
        whole = rows["salted"].to_numpy()[order] | ((h == divided) if divided is not None else False) | goes_on
        divided = h[-1] if goes_on or (divided is not None and h[-1] == divided) else None
        fresh = np.concatenate(([True], (run[1:] != run[:-1]) | (node[1:] != node[:-1])))
        h, n, node, run, band, pos, whole = (x[fresh] for x in (h, n, node, run, band, pos, whole))
        keep = whole | _has_partner(run, n, pos)
        if not keep.any():
            continue
        h, n, node, run, band, pos = (x[keep] for x in (h, n, node, run, band, pos))
        heads = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (band[1:] != band[:-1]))))
        lengths = np.diff(np.concatenate((heads, [len(run)])))
        pivot = np.repeat(node[heads], lengths)
        near = np.concatenate(([False], (run[heads][1:] == run[heads][:-1]) & (band[heads][1:] == band[heads][:-1] + 1)))
        pivot[heads[near]] = node[heads[np.flatnonzero(near) - 1]]
        yield pd.DataFrame({"h": h, "pos": pos, "n": n, "node": node, "pivot": pivot})


def _has_partner(run: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which entries have another in their run that size and position allow; all of a run of over 64 entries do."""
    sizes = np.bincount(run)
    keep = sizes[run] > 64
    small = np.flatnonzero((sizes[run] > 1) & ~keep)
    if len(small):
        r, a, i = run[small], n[small].astype(np.int64), pos[small].astype(np.int64)
        end = np.searchsorted(r, r, side="right")
        x, y = _index_pairs(0, len(r), end)
        ok = _allowed(a[x], a[y], i[x], i[y])
        keep[small[x[ok]]] = True
        keep[small[y[ok]]] = True
    return keep


def _index_pairs(low: int, high: int, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (x, y) with low <= x < high and x < y < end[x]."""
    x = np.arange(low, high)
    partners = end[low:high] - x - 1
    first = np.cumsum(partners) - partners
    left = np.repeat(x, partners)
    return left, left + 1 + np.arange(len(left)) - np.repeat(first, partners)


def _allowed(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of a and b shingles whose first common one stands at places i and j can link."""
    return (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (1 + np.minimum(a - i - 1, b - j - 1) >= needed(a, b))


def _best(best: bool):
    """Pairs of a tile that differ in label and pass the bounds of size, position and bit count.

    With `best`, for each label only the pair with the most room to the bound.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _ in _runs(batches, ["h", "lo", "c", "d"], 1 << 30):
            h, lo, c, d, own = (rows[x].to_numpy() for x in ("h", "lo", "c", "d", "own"))
            n, pos, node, label = (rows[x].to_numpy().astype(np.int64) for x in ("n", "pos", "node", "label"))
            bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint64).reshape(len(rows), BITS // 64)
            edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1]))))
            tile = np.repeat(np.arange(len(edge)), np.diff(np.concatenate((edge, [len(h)]))))
            end = np.searchsorted(tile, tile, side="right")
            total = np.concatenate(([0], np.cumsum(end - np.arange(len(h)) - 1)))
            at, found = 0, []
            while at < len(h):  # about 100 000 pairs at a time
                to = max(at + 1, int(np.searchsorted(total, total[at] + 100_000, side="right")) - 1)
                x, y = _index_pairs(at, to, end)
                at = to
                ok = (label[x] != label[y]) & ((c[x] == d[x]) | (own[x] != own[y])) & _allowed(n[x], n[y], pos[x], pos[y])
                x, y = x[ok], y[ok]
                room = (n[x] + n[y] - np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)) // 2 - needed(n[x], n[y])
                ok = room >= 0
                found.append((x[ok], y[ok], room[ok]))
            x, y, room = (np.concatenate(z) for z in zip(*found, strict=True))
            if best and len(x):
                who, which = np.concatenate((label[x], label[y])), np.concatenate((np.arange(len(x)), np.arange(len(x))))
                order = np.lexsort((-room[which], who, tile[x[which]]))
                where, who = tile[x[which]][order], who[order]
                first = np.concatenate(([True], (who[1:] != who[:-1]) | (where[1:] != where[:-1])))
                keep = np.unique(which[order][first])
                x, y = x[keep], y[keep]
            if len(x):
                yield pd.DataFrame({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])}).drop_duplicates()

    return pairs


def _bounded(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that the bit counts of their signatures allow to link.

    Only the signatures of the pairs' own nodes go through a shuffle.
    """
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    signed = signed.join(small_side(nodes, F.lit(0)), "node", "left_semi")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            t = needed(batch["na"], batch["nb"])
            bits = np.fromiter(map(differing_bits, batch["sa"], batch["sb"]), dtype=np.int64, count=len(batch))
            yield batch.loc[(batch["na"] + batch["nb"] - bits) // 2 >= t, ["a", "b"]]

    left = signed.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = signed.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = pairs.join(left, "a").join(right, "b").where(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))
    return sized.mapInPandas(check, "a long, b long")


def _compare(words: int, link: Callable):
    """Sorted by leader, each leader's text before those of its partners: one set is held besides a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead, s = None, None
        for batch in batches:
            ok = []
            for a, kind, text in zip(batch["a"], batch["kind"], batch["text"], strict=True):
                if kind == 0:
                    if a != lead:
                        lead, s = a, shingle_set(text, words)
                    ok.append(False)
                else:
                    ok.append(link(s, shingle_set(text, words)))
            yield batch.loc[ok, ["a", "b"]]

    return run


def confirm(pairs: DataFrame, rows: DataFrame, places: DataFrame, words: int = WORDS, link: Callable = linked, partners: int = PARTNERS) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets link, by sorted-array intersection.

    places (node, doc_id, row_hash) says where each node's text stands. A leader's text is sent once for every `partners`
    of its partners, a partner's text once a pair. They meet sorted, the leader first, so that a task holds one set
    besides a batch, whatever number of partners a leader has.
    """
    leaders = small_side(cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / partners).cast("int").alias("salts")), "leaders"), F.lit(16))
    dealt = pairs.join(leaders, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "b", F.col("b").alias("node"))
    heads = leaders.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"), F.col("a").alias("node"))
    sent = cut(dealt.unionByName(heads).join(places, "node").drop("node"), "sent")
    texts = rows.join(small_side(sent, F.lit(48)), ["doc_id", "row_hash"]).select("a", "salt", "kind", "b", "text")
    return cut(texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind").mapInPandas(_compare(words, link), "a long, b long").distinct(), "links")


def _tiles(named: DataFrame, tile: int, least: int) -> DataFrame:
    """named (h, pos, n, node, label) dealt to cells (lo, c, d) in which entries of a bucket h meet, with own.

    Linked sets lie in the same size band or in neighbouring ones. An entry stays only if its bucket has at least
    `least` entries there and one of another label. A bucket of up to `tile` of them is one cell. In a larger one each
    band is dealt by hash to pieces of about that size, and a cell is two pieces of a band (c <= d), or a piece of a
    band and one of the next (d < 0): no cell has bands that are out of reach of one another. Two entries of a cell are
    compared if it is a single piece, or if they differ in own.
    """
    named = named.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int"))
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    per = named.groupBy("h", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k"))
    count = lambda d: F.ceil(F.coalesce(F.sum(F.when(F.col("o") == d, F.col("k"))), F.lit(0)) / tile).cast("int")
    reach = (
        per.select("h", near.alias("o"), "band", "lo", "hi", "k")
        .withColumn("band", F.col("band") + F.col("o"))
        .groupBy("h", "band")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("k").alias("near"), count(0).alias("same"), count(-1).alias("above"), count(1).alias("below"))
        .where((F.col("lo") < F.col("hi")) & (F.col("near") > least) & (F.col("same") > 0))
        .withColumn("size", F.sum("near").over(W.partitionBy("h")))
    )
    wanted = small_side(cut(reach.select("h", "band", "size", "same", "above", "below"), "bands"), F.lit(16))
    own = F.pmod(F.xxhash64("node"), F.col("same")).cast("int")
    none = F.expr("CAST(array() AS array<struct<lo:int,c:int,d:int,own:int>>)")

    def cell(lo, c, d, who):
        return F.struct(lo.cast("int").alias("lo"), c.cast("int").alias("c"), d.cast("int").alias("d"), who.cast("int").alias("own"))

    def upto(k: str) -> Column:
        return F.sequence(F.lit(0), F.col(k) - 1)

    banded = F.concat(
        F.transform(upto("same"), lambda q: cell(F.col("band"), F.least("mine", q), F.greatest("mine", q), F.col("mine"))),
        F.when(F.col("above") > 0, F.transform(upto("above"), lambda q: cell(F.col("band"), F.col("mine"), -1 - q, F.lit(-1)))).otherwise(none),
        F.when(F.col("below") > 0, F.transform(upto("below"), lambda q: cell(F.col("band") - 1, q, -1 - F.col("mine"), F.lit(-2)))).otherwise(none),
    )
    cells = F.when(F.col("size") <= tile, F.array(cell(F.lit(-1), F.lit(0), F.lit(0), F.lit(0)))).otherwise(banded)
    return named.join(wanted, ["h", "band"]).withColumn("mine", own).select("h", "pos", "n", "node", "label", F.inline(cells))


def least_ids(sets: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, row_hash, n_shingles and component_id of every row of sets. found (node, component) has the nodes with links."""
    labelled = sets.join(found, "node", "left").select("doc_id", "row_hash", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "node")).alias("label"))
    # A task sends a label once; labels of a single document need no join.
    least = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    least = small_side(cut(least.where(F.col("size") > 1).select("label", "least"), "least"), F.lit(0))
    return labelled.join(least, "label", "left").select("doc_id", "row_hash", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, tile: int = TILE, salt_at: int = SALT_AT) -> DataFrame:
    """doc_id, row_hash, n_shingles and component_id of each row of docs (doc_id, text); row_hash is its text's.

    1. Each text becomes a set of hashed shingles, a node. Equal sets are one node, so copies cost one row each.
    2. Sets send their rarest shingles to buckets, which have a pivot for each size band. Every set is paired with the
       pivot that it shares most buckets with; pairs that their bitmaps allow are verified, and the links joined to
       components. So a group of near copies costs a text a member, not a pair of members.
    3. Buckets that still hold several components within reach of one another are cut into tiles by size band. For a few
       rounds every component there is verified with the closest other one by bit count. At last every pair of sets of
       different components must fail the bounds of size, position or bit count, or is verified. So no link is lost
       that could join two components.

    Null or empty text has no shingles and its own doc_id as component. Rows without doc_id have a null component and
    link with nothing. Repeated rows of a doc_id get equal results if their texts are equal. An empty table gives none.
    Long texts are hashed in stretches; their sets are held by one task at a time. Ties between partners that are equally
    close go to either, as every pair is tried at last.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("row_hash"), "text")
    signed = cut(rows.mapInPandas(_sign, SIGNED), "signed")
    sets = signed.where(F.col("bucket").isNull())
    counts = np.zeros(SKETCH, dtype=np.int64)
    for bucket, n in signed.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("n")).collect():  # SKETCH rows at most
        counts[bucket] = n
    scaled = np.minimum(counts, (1 << 31) - 1) if counts.max() < 1 << 31 else (counts / (counts.max() / ((1 << 31) - 1))).astype(np.int64)

    entries = rows.select("doc_id", "text").mapInPandas(_entries(scaled, salt_at), ENTRY)
    hot = [int(b) for b in np.flatnonzero(scaled - scaled.sum() / SKETCH >= salt_at)]  # of SKETCH at most
    salted = F.col("h").bitwiseAND(SKETCH - 1).isin(hot) if hot else F.lit(False)
    active = cut(
        entries.repartition("h", "salt").sortWithinPartitions("h", "salt").withColumn("salted", salted).mapInPandas(_buckets, "h long, pos int, n int, node long, pivot long"),
        "active",
    )

    ids = sets.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    places = cut(ids.groupBy("node").agg(F.min(F.struct("doc_id", "row_hash")).alias("first")).join(active.select("node").distinct(), "node", "left_semi").select("node", "first.doc_id", "first.row_hash"), "places")
    found = rows.join(small_side(places, F.lit(0)), ["doc_id", "row_hash"]).select("node", "text")
    bitmaps = cut(found.mapInPandas(_signatures, "node long, n int, sig binary, bits binary").dropDuplicates(["node"]), "bitmaps")

    shared = active.where(F.col("pivot") != F.col("node")).groupBy("node", "pivot").agg(F.count("*").alias("k"))
    pairs = cut(shared.groupBy("node").agg(F.max(F.struct("k", "pivot"))["pivot"].alias("a")).select("a", F.col("node").alias("b")), "pairs")
    tried = cut(_bounded(pairs, bitmaps), "pairs")
    first = connected_components(confirm(tried, rows, places), "a", "b")
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for turn in range(ROUNDS + 1):
        named = active.join(first, "node", "left").select("h", "pos", "n", "node", F.coalesce("component", "node").alias("label"))
        tiles = _tiles(named, tile, LARGE if turn < ROUNDS else 1).join(bitmaps.select("node", "bits"), "node")
        close = tiles.repartition("h", "lo", "c", "d").sortWithinPartitions("h", "lo", "c", "d").mapInPandas(_best(turn < ROUNDS), "a long, b long").distinct()
        new = cut(_bounded(cut(close.join(tried, ["a", "b"], "left_anti"), "pairs"), bitmaps), "pairs")
        if new.isEmpty():
            continue
        tried = tried.unionByName(new)
        links = confirm(new, rows, places)
        if not links.isEmpty():
            first = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), "a", "b")

    drop(active, bitmaps)
    return least_ids(sets, first)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component. Rows without doc_id stay.

    Repeated rows of one doc_id and text are one document, and stay together.
    """
    later = jaccard_components(docs).where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("later_id"), F.col("row_hash").alias("later_hash"))
    later = small_side(cut(later.distinct(), "later"), F.lit(16))
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.join(later, (docs["doc_id"] == later["later_id"]) & (F.xxhash64(text) == later["later_hash"]), "left_anti")
