"""Ranks and medians of groups that no task holds whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import cut_lineage

#: Bins of a histogram that narrows a median down.
BINS = 1024


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with `name`, from 1: each row's place in its group, in a total order.

    Rows are dealt to tasks by ranges of (group, order); a row's rank is its place in its range and the number of its
    group's rows in earlier ranges. A group of any size is spread over as many tasks as it fills.
    """
    dealt = cut_lineage(df.repartitionByRange(*(F.col(g) for g in group), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*group, "_part", earlier.alias("_before"))
    place = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order))
    return dealt.withColumn("_place", place).join(offsets, [*group, "_part"]).withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before")


def value_at(values: DataFrame, column: str, k: int, low: float, high: float) -> float:
    """The k-th smallest value (from 0) of a column of doubles between low and high, without NaN or null.

    Each pass counts the values of the current range in BINS bins, and goes on in the bin that has the k-th.
    """
    v = F.col(column)
    while low < high:
        width = high / BINS - low / BINS
        place = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else (v > F.lit(low)).cast("long")
        bins = values.where(v.between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("bin")
        for _, n, least, most in bins.collect():  # BINS rows at most
            if k < n:
                low, high = least, most
                break
            k -= n
    return low


def median(values: DataFrame, column: str) -> float | None:
    """The exact median; NaN and null count as 0. None for an empty table."""
    v = values.select(F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("v"))
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    return (value_at(v, "v", (n - 1) // 2, low, high) + value_at(v, "v", n // 2, low, high)) / 2
