"""Ranks and running sums over large groups without one task per group.

A bucket is a coarse, order-keeping version of the sort key. Totals per bucket
are accumulated first (few rows per group); rows are then ranked inside their
bucket only. A group with a third of all rows spreads over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a 32-bit hash that a bucket leaves out: 4096 buckets.
HASH_SHIFT = 20


def hash_bucket(h: Column) -> Column:
    return F.shiftright(h, HASH_SHIFT)


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[str | Column], weight: Column | None = None) -> DataFrame:
    """``df`` with r, the rank (or running sum of ``weight``) within ``keys``, and n, the group's total."""
    w = F.lit(1) if weight is None else weight
    d = df.withColumn("__b", bucket).withColumn("__w", w)
    totals = d.groupBy(*keys, "__b").agg(F.sum("__w").alias("__t"))
    by = W.partitionBy(*keys)
    upto = F.sum("__t").over(by.orderBy("__b"))
    totals = totals.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__b").alias("__tb"), (upto - F.col("__t")).alias("__ahead"), F.sum("__t").over(by).alias("n"))
    on = F.col("__b").eqNullSafe(F.col("__tb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return d.join(totals, on).withColumn("r", F.col("__ahead") + F.sum("__w").over(within)).select(*df.columns, "r", "n")


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: interpolated quantiles by name, of values that are not negative.

    Distinct values are counted and ranked in buckets, so neither rows nor
    values meet in one task; nulls do not count.
    """
    by = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    r = ranked(by, [], F.floor(F.log1p(F.col("v").cast("double")) * 64), ["v"], F.col("c"))
    out = []
    for name, q in shares.items():
        place = F.lit(q) * (F.col("n") - 1)
        low = F.floor(place)
        at = lambda k: F.min(F.when(F.col("r") > k, F.col("v"))).cast("double")
        first, second = at(low), at(F.least(low + 1, F.col("n") - 1))
        out.append((first + F.max(place - low) * (second - first)).alias(name))
    return r.agg(*out)
