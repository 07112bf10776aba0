"""Arithmetic on ARRAY<DOUBLE> columns with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def cosine(x: Column, y: Column) -> Column:
    """0 where a vector has no length."""
    n = norm(x) * norm(y)
    return F.when(n > 0, dot(x, y) / n).otherwise(F.lit(0.0))


def scaled(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def argmax(x: Column) -> Column:
    """Index of the first largest element, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def padded(x: Column, width: int) -> Column:
    """``x`` with zeros up to ``width``."""
    return F.concat(x, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(x)))


def in_block(x: Column, before: Column | int, after: Column | int) -> Column:
    """``x`` with zeros before and after: the block of one node type in a shared feature space."""
    side = lambda n: F.array_repeat(F.lit(0.0), n if isinstance(n, Column) else F.lit(n))
    return F.concat(side(before), x, side(after))
