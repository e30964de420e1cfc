"""Vector code compression: product codes of integer vectors, by Lloyd's method over parts that stay where they are."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, small_side

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts that one owner holds at most, should all vectors choose the same entry: more vectors make more salts.
ROWS_AN_OWNER = 250_000
#: Differences worked out at once in a task.
AT_ONCE = 1 << 22

Books = list[np.ndarray]


def cuts(n: int) -> list[int]:
    """Where the parts of vectors of n components begin and end: equal, or as near to it as n allows."""
    return [p * n // PARTS for p in range(PARTS + 1)]


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (of equally near ones the lowest) and the squared distance, in whole numbers."""
    entry, far = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
    step = max(1, AT_ONCE // max(1, book.size))
    for i in range(0, len(parts), step):
        d = ((parts[i : i + step, None, :].astype(np.int64) - book[None, :, :]) ** 2).sum(axis=2)
        entry[i : i + step] = d.argmin(axis=1)
        far[i : i + step] = d.min(axis=1)
    return entry, far


def whole(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label and ints (components in 4096ths, rounded down) of the vectors that are kept."""
    x = F.col("embedding")
    # The squared distance of two vectors of n such components fits 63 bits.
    limit = F.lit(2.0**63) / F.greatest(F.size(x), F.lit(1))
    small = lambda v: F.coalesce(F.abs(v.cast("double")) * (2 * SCALE) < F.sqrt(limit) - 2, F.lit(False))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("int"))
    return vectors.where(x.isNotNull() & F.forall(x, small)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size(x).alias("width"), ints.alias("ints"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]) if m.shape[1] else np.zeros(len(m) + 1), pa.int32()), pa.array(m.ravel(), pa.int32()))


HOME = "row long, pos int, entry int, part array<int>"


def _divide(n: int, books: Books) -> Callable:
    """Vectors to parts, each with its nearest entry."""
    ends = cuts(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("ints"), n)
            for p in range(PARTS):
                part = m[:, ends[p] : ends[p + 1]]
                entry, _ = nearest(part, books[p])
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(m), p, np.int32)), pa.array(entry), _lists(part)], ["row", "pos", "entry", "part"])

    return run


def _by_position(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, places in the batch, parts) of each position that a batch has."""
    ends, pos = cuts(n), batch.column("pos").to_numpy()
    for p in np.unique(pos):
        at = np.flatnonzero(pos == p)
        yield int(p), at, _matrix(batch.column("part").take(pa.array(at)), ends[p + 1] - ends[p])


def _owned(n: int) -> Callable:
    """The count and the sum of each owner's members."""
    schema = pa.schema([("pos", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            entry, salt = batch.column("entry").to_numpy(), batch.column("salt").to_numpy()
            for p, at, parts in _by_position(batch, n):
                owners, which = np.unique(np.stack((entry[at], salt[at])), axis=1, return_inverse=True)
                sums = np.zeros((owners.shape[1], parts.shape[1]), np.int64)
                np.add.at(sums, which.ravel(), parts)
                for (e, s), k, total in zip(owners.T, np.bincount(which.ravel()), sums, strict=True):
                    mine = held.setdefault((p, int(e), int(s)), [0, 0])
                    mine[0], mine[1] = mine[0] + int(k), mine[1] + total
        yield pa.RecordBatch.from_pylist([{"pos": p, "entry": e, "salt": s, "n": k, "sums": total.tolist()} for (p, e, s), (k, total) in held.items()], schema=schema)

    return run


def _choose(n: int, books: Books) -> Callable:
    """Members with the entry that is nearest now, and whether they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column("entry").to_numpy()
            entry = np.zeros(batch.num_rows, np.int32)
            for p, at, parts in _by_position(batch, n):
                entry[at] = nearest(parts, books[p])[0]
            columns = [batch.column("row"), batch.column("pos"), pa.array(entry), batch.column("part"), batch.column("salt"), pa.array(entry != before)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "pos", "entry", "part", "salt", "moved"])

    return run


def _measure(n: int, books: Books) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, at, parts in _by_position(batch, n):
                entry[at], far[at] = nearest(parts, books[p])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("pos"), pa.array(entry), pa.array(far)], ["row", "pos", "entry", "far"])

    return run


def _starts(kept: DataFrame, n: int) -> Books:
    """The parts of the smallest vec_ids' vectors: 16 rows come to the driver. Of several vectors of one id the least counts."""
    ids = [r[0] for r in kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(ENTRIES).collect()]
    known = F.col("vec_id").isin([i for i in ids if i is not None])
    rows = kept.where((known | F.col("vec_id").isNull()) if None in ids else known).groupBy("vec_id").agg(F.min("ints").alias("ints")).collect()
    place = {i: k for k, i in enumerate(ids)}
    m = np.array([r["ints"] for r in sorted(rows, key=lambda r: place[r["vec_id"]])], dtype=np.int64).reshape(len(rows), n)
    ends = cuts(n)
    return [m[:, ends[p] : ends[p + 1]].copy() for p in range(PARTS)]


def _updated(books: Books, members: DataFrame, n: int) -> Books:
    """Every entry replaced by its members' mean, rounded down. 16 entries of n components come to the driver."""
    owners = members.mapInArrow(_owned(n), "pos int, entry int, salt int, n long, sums array<long>")
    rows = owners.select("pos", "entry", "n", F.posexplode("sums").alias("k", "total")).groupBy("pos", "entry", "k").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    new = [b.copy() for b in books]
    for r in rows.collect():
        new[r["pos"]][r["entry"], r["k"]] = int(r["total"]) // int(r["n"])
    return new


def fit(kept: DataFrame, rounds: int = ROUNDS, rows_an_owner: int = ROWS_AN_OWNER) -> tuple[Books, DataFrame]:
    """The codebooks of the vectors that whole() gives, all of one width, and (row, pos, entry, far) of every part.

    A part lives with the owner of (position, entry, salt): a partition of the table of members. In a round the owners sum
    the members they hold, which gives the new codebooks, and look for each member's nearest entry. Members that keep
    theirs are written where they are read; only those that change it are shuffled to their new owners. A round without
    any change of the codebooks ends the work, as all later ones would be the same.
    """
    n, count = (kept.agg(F.max("width"), F.count("*")).first()[k] for k in (0, 1))
    if not count:
        return [np.zeros((0, 0), np.int64)] * PARTS, kept.select("row", F.lit(0).alias("pos"), F.lit(0).alias("entry"), F.lit(0).cast("long").alias("far"))
    books = _starts(kept, n)
    salt = F.pmod(F.xxhash64("row"), F.lit(-(-count // rows_an_owner))).cast("int").alias("salt")
    home = ["pos", "entry", "salt"]
    first = kept.select("row", "ints").mapInArrow(_divide(n, books), HOME).select("*", salt)
    tables = [cut(first.repartition(*home), "members")]
    members = tables[0]
    for turn in range(rounds):
        before, books = books, _updated(books, members, n)
        if turn == rounds - 1 or all((a == b).all() for a, b in zip(before, books, strict=True)):
            break
        chosen = cut(members.mapInArrow(_choose(n, books), HOME + ", salt int, moved boolean"), "members", by=("moved",))
        drop(*tables)
        arrived = cut(chosen.where("moved").drop("moved").repartition(*home), "arrived")
        tables = [chosen, arrived]
        members = chosen.where("NOT moved").drop("moved").unionByName(arrived)
    ends = cut(members.mapInArrow(_measure(n, books), "row long, pos int, entry int, far long"), "codes")
    drop(*tables)
    return books, ends


def fingerprint(books: Books) -> str:
    """The hash of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row of vectors (vec_id, embedding, label) that is kept.

    Rows are dropped whose vector is null, has a null or non-finite component, or components so large that squared
    distances do not fit a long (46,000 and more with 64 components). Of vectors of different length those of the commonest
    (of equally common ones the greatest) length stay, as others have no place in the codebooks. Parts are equal, or as
    near to it as the length allows. Fewer than 16 different vec_ids give so many entries; null vec_ids come last, and of
    repeated ones the least vector counts. Repeated rows each get their result. Labels are compared with nulls equal; a
    sum over a label that does not fit a long is null. An empty table gives no rows. Other columns are left aside.
    """
    all_kept = cut(whole(vectors), "vectors")
    common = all_kept.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    kept = all_kept.where(F.col("width") == (common["width"] if common else 0))
    books, ends = fit(kept, rounds)
    digit = lambda p: F.lower(F.lpad(F.hex(F.max(F.when(F.col("pos") == p, F.col("entry"))).cast("long")), 2, "0"))
    codes = ends.groupBy("row").agg(F.concat(*(digit(p) for p in range(PARTS))).alias("code"), F.sum("far").alias("error"))
    out = cut(kept.select("row", "vec_id", "label").join(codes, "row").drop("row"), "coded")
    sums = small_side(cut(out.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "labels"), F.lit(16))
    joined = out.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
