"""Sharding: vector bin packing of groups of equal texts, balancing bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, hash128, small_side, text_or_empty

SHARDS = 16
#: Groups with more than 1 / SINGLE of any total are packed first, one after the other; of the others as many as IN_TASK
#: a task. A group with over 1 / WHOLE of a shard's share is dealt into pieces of 1 / PIECES of a shard's share each.
SINGLE, IN_TASK, WHOLE, PIECES = 32_768, 20_000, 4, 64
#: How much bytes, tokens and rows weigh in the dot product: the law is about bytes, tokens and rows follow closely.
WEIGHTS = (10.0, 1.0, 1.0)
SIZES = ["size", "tokens", "n"]
#: Groups larger than the mean are placed largest first, the others in the order of their hash: if small ones of one kind
#: came last, they could level what they have much of only by upsetting the rest.
ABOVE = 1.0


def place(vectors: np.ndarray, residual: np.ndarray, weights: tuple = WEIGHTS, above: float = 0.0) -> np.ndarray:
    """The shard of each row of vectors, each where its dot product with the residual capacity is highest.

    Vectors and residual (a row a shard) are in the same units; residual is what is left afterwards. Rows whose weighted
    sum is over `above` times the mean come first, largest first; the others follow as they stand.
    """
    w = np.asarray(weights, dtype=float)
    out = np.zeros(len(vectors), dtype=np.int64)
    size = (vectors * w).sum(axis=1)
    large = size > above * (size.mean() if len(size) else 0)
    for i in np.concatenate((np.flatnonzero(large)[np.argsort(-size[large], kind="stable")], np.flatnonzero(~large))):
        s = int(np.argmax(residual @ (w * vectors[i])))
        out[i] = s
        residual[s] -= vectors[i]
    return out


def pack(vectors: np.ndarray, shards: int = SHARDS, weights: tuple = WEIGHTS) -> np.ndarray:
    """As place(), into empty shards that hold all vectors in equal shares."""
    total = np.maximum(vectors.sum(axis=0), 1)
    return place(vectors / total * shards, np.ones((shards, vectors.shape[1])), weights)


def _packed_in_task(left: np.ndarray):
    """Packs the groups of one deal into its part of the capacity that is left, which is what its groups need."""
    shards = len(left)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h1", "h2"])
        v = rows[SIZES].to_numpy(dtype=float)
        v = v / np.maximum(v.sum(axis=0), 1) * shards
        mean = left.mean(axis=0)
        residual = np.where(mean > 0, left / np.where(mean > 0, mean, 1), 1.0)
        turn = int(rows["deal"].iloc[0]) % shards  # so that the first of equal shards is another one in every deal
        order = np.roll(np.arange(shards), turn)
        return rows[["h1", "h2", "deal"]].assign(shard=order[place(v, residual[order].copy(), above=ABOVE)].astype(np.int32))

    return run


def shard(docs: DataFrame, shards: int = SHARDS, single: int = SINGLE, in_task: int = IN_TASK) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of each row of docs (doc_id, text). The law is `bytes`.

    Tokens are estimated as words between white space. Every group of equal texts is placed by the same rule: where
    the dot product of its bytes, tokens and rows with the residual capacity is highest. Groups with more
    than 1 / `single` of a total, 3 * single at most, are placed one after the other at the driver. The capacity that they
    leave is divided among deals of about `in_task` groups by hash, each in proportion to what its groups need, and a
    task places the groups of a deal. So no group is summed with others before it has its shard, and the work is shared
    by as many tasks as there are groups for. A group with over a quarter of a shard's share of bytes, tokens or rows
    cannot stay whole without upsetting the law: it is dealt by doc_id into pieces of a 64th of such a share, which are
    placed as groups. Slots are counted within deals and pieces, whose places follow one another in their shard; no task
    sorts a whole shard.

    Null text has no bytes and no tokens. Rows with equal doc_id and text share a place in any order, and each get
    their slot. Null doc_ids come first. Groups larger than the mean are placed largest first, the others in the order of their hash; of shards with
    equal dot products the first is taken, in deals counted from another shard each. A long text is one group as any
    other. An empty table gives no rows. Other columns are left aside.
    """
    spark = docs.sparkSession
    t = text_or_empty()
    h1, h2 = hash128(t)
    size = F.octet_length(t).cast("long") + 1
    tokens = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")
    rows = cut(docs.select("doc_id", size.alias("size"), tokens.alias("tokens"), F.crc32(t).alias("text_crc32"), h1.alias("h1"), h2.alias("h2")), "sizes")
    sums = (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    groups = cut(rows.groupBy("h1", "h2").agg(*sums), "groups")
    *total, count = groups.agg(*(F.sum(c) for c in SIZES), F.count("*")).first()
    total = np.array([max(1, x or 0) for x in total], dtype=float)
    large = F.greatest(*(F.col(c) / n for c, n in zip(SIZES, total.tolist(), strict=True))) > 1 / single

    chosen = groups.where(large).orderBy("h1", "h2").toPandas()  # 3 * single rows at most
    v = chosen[SIZES].to_numpy(dtype=float) / total * shards
    share = v.max(axis=1) if len(v) else np.zeros(0)
    pieces = np.where((share > 1 / WHOLE) & (chosen["n"] > 1), np.ceil(share * PIECES), 1).astype(np.int64)
    chosen["pieces"], chosen["first"] = pieces.astype(np.int32), (np.cumsum(pieces) - pieces).astype(np.int32)
    known = F.broadcast(spark.createDataFrame(chosen[["h1", "h2", "first", "pieces"]], "h1 long, h2 long, first int, pieces int"))
    heavy = rows.join(known, ["h1", "h2"]).withColumn("piece", (F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("int"))
    units = heavy.groupBy("piece").agg(*sums).orderBy("piece").toPandas()  # a row for each of these groups and pieces
    residual = np.ones((shards, len(SIZES)))
    units["shard"] = place(units[SIZES].to_numpy(dtype=float) / total * shards, residual, above=ABOVE).astype(np.int32)

    deals = max(1, -(-(count - len(chosen)) // in_task))
    dealt = groups.where(~large).withColumn("deal", F.pmod("h1", F.lit(deals)).cast("int"))
    tail = dealt.groupBy("deal").applyInPandas(_packed_in_task(residual), "h1 long, h2 long, deal int, shard int")
    found = F.broadcast(spark.createDataFrame(units[["piece", "shard"]], "piece int, shard int"))
    heavy = heavy.join(found, "piece").withColumn("deal", -1 - F.col("piece"))
    columns = ["doc_id", "size", "tokens", "text_crc32", "h1", "deal", "shard"]
    placed = cut(heavy.select(*columns).unionByName(rows.join(known, ["h1", "h2"], "left_anti").join(tail, ["h1", "h2"]).select(*columns)), "placed")

    counts = placed.groupBy("shard", "deal").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("shard").orderBy("deal").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = small_side(cut(counts.select("shard", "deal", before.alias("first_slot")), "firsts"), F.lit(16))
    within = F.row_number().over(W.partitionBy("shard", "deal").orderBy("doc_id", "h1"))
    return placed.withColumn("within", within).join(firsts, ["shard", "deal"]).select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first_slot") + F.col("within") - 1).alias("slot"))


def balance(sharded: DataFrame, shards: int = SHARDS) -> DataFrame:
    """shard, size, tokens and n (rows) of each shard, as shares of the mean shard."""
    by = sharded.groupBy("shard").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    totals = by.agg(F.sum("size"), F.sum("tokens"), F.sum("n")).first()
    return by.select("shard", *((F.col(c) * shards / (t or 1)).alias(c) for c, t in zip(("size", "tokens", "n"), totals, strict=True)))
