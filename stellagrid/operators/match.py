"""One-to-one matching of a found catalogue with a true one: Match, Miss, False and scores."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import FWHM, MatchParams
from ..tables import cut_lineage, drop


@dataclass
class MatchResult:
    match: DataFrame
    miss: DataFrame
    false: DataFrame
    scores: DataFrame


def _complete(catalog: DataFrame) -> DataFrame:
    """Rows without null or NaN, by an id that stays with the row."""
    bad = [F.isnan(c) for c, t in catalog.dtypes if t in ("double", "float")]
    for b in bad:
        catalog = catalog.where(~b)
    return catalog.dropna()


def candidate_pairs(truth: DataFrame, found: DataFrame, p: MatchParams) -> DataFrame:
    """(i, j, d2, accept): pairs within the distance that acceptance allows at most, joined over cells of that width."""
    axes = [k for k in (1, 2, 3) if f"Cen{k}" in truth.columns]
    reach = p.tolerance * len(axes) ** 0.5
    cell = reach + 1e-9
    t = truth.select(F.col("ID").alias("i"), *(F.col(f"Cen{k}").alias(f"t{k}") for k in axes), *(F.col(f"Size{k}").alias(f"w{k}") for k in axes))
    f = found.select(F.col("ID").alias("j"), *(F.col(f"Cen{k}").alias(f"f{k}") for k in axes), *(F.floor(F.col(f"Cen{k}") / cell).alias(f"c{k}") for k in axes))
    around = F.array(*(F.struct(*(F.lit(o).alias(f"o{k}") for k, o in zip(axes, step, strict=True))) for step in product((-1, 0, 1), repeat=len(axes))))
    t = t.withColumn("o", F.explode(around)).withColumns({f"c{k}": F.floor(F.col(f"t{k}") / cell) + F.col(f"o.o{k}") for k in axes})
    gap = {k: F.col(f"t{k}") - F.col(f"f{k}") for k in axes}
    d2 = sum((gap[k] * gap[k] for k in axes[1:]), gap[axes[0]] * gap[axes[0]])
    accept = F.lit(True)
    for k in axes:
        size = F.col(f"w{k}") if p.size_is_sigma else F.col(f"w{k}") / FWHM
        accept &= F.abs(gap[k]) <= F.least(F.lit(p.tolerance), size)
    return t.join(f, [f"c{k}" for k in axes]).select("i", "j", d2.alias("d2"), accept.alias("accept")).where(F.col("d2") <= reach * reach)


#: Rounds that take mutually closest pairs only; what is left then are chains.
ROUNDS = 8


def _chained(left: DataFrame) -> DataFrame:
    """(i, j, d2, accept) of the pairs that the greedy rule takes for certain, whatever else it does.

    A pair with no closer one at either of its rows is taken. One with a single closer pair is taken exactly if that one
    is not, and so on along the chain of closer pairs, until a pair that is taken or one with several closer ones, of
    which nothing is known yet. Chains are shortened by pointer jumping that keeps the parity of what it skips, so that
    a chain of any length takes as many steps as the logarithm of its length.
    """
    key, pair = F.struct("d2", "i", "j"), F.struct("i", "j")
    by_i, by_j = W.partitionBy("i").orderBy("d2", "j"), W.partitionBy("j").orderBy("d2", "i")
    seen = left.withColumns({"ri": F.row_number().over(by_i), "rj": F.row_number().over(by_j), "pj": F.lag("j").over(by_i), "pi": F.lag("i").over(by_j)})
    closer = F.when(F.col("ri") == 2, F.struct("i", F.col("pj").alias("j"))).otherwise(F.struct(F.col("pi").alias("i"), "j"))
    single = F.col("ri") + F.col("rj") == 3
    up = F.when(single, closer).otherwise(pair)
    ways = cut_lineage(seen.select(pair.alias("node"), up.alias("up"), single.alias("odd"), (F.col("ri") + F.col("rj") == 2).alias("sure"), key.alias("key"), "accept"), "ways")
    # Of the pair that up points to: where that one points, and whether it is taken for certain.
    jump = ways.select("node", "up", "odd")
    while True:
        above = jump.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("odd").alias("more"))
        new = cut_lineage(jump.join(above, "up").select("node", F.col("next").alias("up"), (F.col("odd") != F.col("more")).alias("odd"), (F.col("next") != F.col("up")).alias("moved")), "ways")
        drop(jump)
        done = new.where("moved").isEmpty()
        jump = new
        if done:
            break
    sure = ways.where("sure").select(F.col("node").alias("up"))
    taken = jump.join(sure, "up", "left_semi").where(~F.col("odd")).select("node")
    return ways.join(taken, "node", "left_semi").select("node.i", "node.j", "key.d2", "accept")


def greedy_pairs(pairs: DataFrame, stop_on_first_reject: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """(i, j, d2) that the greedy rule takes: again and again the closest pair of rows not used yet.

    A pair that is the closest for both its rows is one the rule takes, whatever it does elsewhere, so each round takes
    all of these at once. Where distances are equal or fall along a chain, a round takes one pair of the chain; so after
    some rounds all that chains decide is taken too (see _chained). No round brings more than the pairs of one row
    together. With stop_on_first_reject what lies beyond the closest rejected pair does not count; without, rejected
    pairs are passed over and use nothing up.
    """
    left = cut_lineage(pairs if stop_on_first_reject else pairs.where("accept"), "pairs")
    taken, turn = None, 0
    while True:
        if turn < rounds:
            key = F.struct("d2", "i", "j")
            best = left.withColumns({"bi": F.min(key).over(W.partitionBy("i")), "bj": F.min(key).over(W.partitionBy("j"))})
            now = best.where((F.col("bi") == key) & (F.col("bj") == key)).select("i", "j", "d2", "accept")
        else:
            now = _chained(left)
        now, turn = cut_lineage(now, "taken"), turn + 1
        if now.isEmpty():
            break
        taken = now if taken is None else taken.unionByName(now)
        before, left = left, cut_lineage(left.join(now.select("i"), "i", "left_anti").join(now.select("j"), "j", "left_anti"), "pairs")
        drop(before)
    if taken is None:
        return pairs.select("i", "j", "d2").where(F.lit(False))
    if stop_on_first_reject:
        stop = taken.where(~F.col("accept")).agg(F.min(F.struct("d2", "i", "j"))).first()[0]
        if stop is not None:
            taken = taken.where(F.struct("d2", "i", "j") < F.struct(F.lit(stop[0]).alias("d2"), F.lit(stop[1]).alias("i"), F.lit(stop[2]).alias("j")))
    return taken.select("i", "j", "d2")


def match_catalogs(truth: DataFrame, found: DataFrame, p: MatchParams = MatchParams()) -> MatchResult:
    """Match with columns s_* and f_*, Miss (truth without a partner), False (found without one), and scores.

    ID is unique in each catalogue. Rows with a null or NaN count nowhere.
    """
    truth, found = _complete(truth), _complete(found)
    pairs = cut_lineage(greedy_pairs(candidate_pairs(truth, found, p), p.stop_on_first_reject), "matched")
    s, f = truth.toDF(*(f"s_{c}" for c in truth.columns)), found.toDF(*(f"f_{c}" for c in found.columns))
    match = s.join(pairs, s["s_ID"] == pairs["i"]).join(f, F.col("j") == f["f_ID"]).select(*s.columns, *f.columns, F.sqrt("d2").alias("distance"))
    miss = s.join(pairs, s["s_ID"] == pairs["i"], "left_anti")
    false = f.join(pairs, f["f_ID"] == pairs["j"], "left_anti")
    n = pairs.agg(F.count("*").alias("matched")).select("matched", F.lit(None).alias("k"))
    counts = n.select("matched").withColumns({"n_truth": truth.agg(F.count("*")).scalar(), "n_found": found.agg(F.count("*")).scalar()})
    precision = F.when(F.col("n_found") > 0, F.col("matched") / F.col("n_found")).otherwise(0.0)
    recall = F.when(F.col("n_truth") > 0, F.col("matched") / F.col("n_truth")).otherwise(0.0)
    scores = counts.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", F.when(F.col("matched") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    )
    return MatchResult(match, miss, false, scores)
