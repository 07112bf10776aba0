"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more rows than this, and with more than one in HOT_SHARE of all rows, are hot: HOT_SHARE keys at most.
HOT_ROWS, HOT_SHARE = 100_000, 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """``left`` joined with ``right`` (one row a key), where ``right[count]`` is the number of rows that ``left`` has for the key.

    Rows of hot keys stay where they are and meet a broadcast of the at most
    HOT_SHARE rows of ``right`` that they need; all others are shuffled by key.
    Both tables should be written ones, as they are read twice.
    """
    if right.where(F.col(count) > HOT_ROWS).isEmpty():
        return left.join(right, key)
    total = right.agg(F.sum(count)).first()[0]
    least = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(right.where(F.col(count) > least))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(count) <= least), key)
    return cold.unionByName(left.join(hot, key))
