"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end, without loops."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
    return _oriented(both.where("v > u").join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), "m")
    tied = edges.join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(tied.union(least.select(F.col("at").alias("u"), F.col("m").alias("v"))))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; ``edges`` has columns u, v.

    Alternates large-star and small-star steps, which are joins and minima
    only: no neighbour list is gathered, and a hub's rows can be split. Each
    round is written to the shared folder, so lineage stays one round long.
    Edges with a null end are ignored. The component is the smallest node.
    """
    edges = written(_oriented(edges.where("u is not null and v is not null")), "edges")
    seen = None
    for _ in range(rounds):
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return nodes.union(roots)
        seen = mark
        edges = written(_small_star(_large_star(edges)), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
