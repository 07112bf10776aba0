"""Hubs by h-index from sketches alone: no pair of peers is ever listed.

A node's h-index is at least h if h of its peers have degree h or more. A
sketch that starts only from nodes with an estimated degree of at least h
counts just those peers. With growing h the starting nodes become fewer and
every count falls, so a node either reaches h or reaches nothing above h.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.metapath import GraphSchema, MetaPath, peers_of, stored
from ..plans.scratch import written
from . import hubs as H
from .sketch import LEVELS, levelled_counts


def restricted_counts(schema: GraphSchema, path: MetaPath, start: DataFrame, scores: DataFrame, pivots: list[int], k: int, candidates: DataFrame | None = None) -> DataFrame:
    """(pivot, node, count): peers with a score of at least ``pivot``, estimated for ``candidates`` (node) or all.

    A node that reaches a pivot reaches all lower ones, so the pivots' sketches
    are nested and move as one: with n nodes at the lowest and m at the highest
    pivot it has k (1 + log(n / m)) slots or so, however many pivots there are.
    LEVELS pivots share a plan. Nodes without such a peer are absent.
    """
    known, out = start.join(scores.select("node", "score"), "node"), None
    pivots = sorted(set(pivots))
    schema = stored(schema, path)
    for at in range(0, len(pivots), LEVELS):
        tried = pivots[at : at + LEVELS]
        ladder = F.array(*(F.lit(p) for p in tried))
        level = F.size(F.filter(ladder, lambda p: p <= F.col("score")))
        begin = known.select("node", "h", level.alias("level")).where("level > 0")
        counts = levelled_counts(schema, path, begin, len(tried), k, candidates)
        counts = counts.select(F.get(ladder, F.col("level") - 1).cast("long").alias("pivot"), "node", "count")
        out = counts if out is None else out.union(counts)
    return scores.sparkSession.createDataFrame([], "pivot long, node long, count double") if out is None else out


def h_hubs(schema: GraphSchema, path: MetaPath, start: DataFrame, scores: DataFrame, share: float, k: int, pivots: int = 15) -> DataFrame:
    """(node, cut): the nodes whose estimated h-index is at least ``cut``, the largest value that floor(share n) + 1 nodes reach.

    ``scores`` (node, score): estimated degrees, a written table. Each round
    tries ``pivots`` values between what is known to be reached and what is
    known not to be, keeps as candidates the nodes that reach the largest
    value that enough nodes reach, and stops when the two meet: at most
    log(largest score) / log(pivots + 1) rounds. Only the few numbers of nodes
    per pivot come to the driver. Nodes that tie at the cut are all in.
    """
    schema = stored(schema, path)
    cut = H.threshold(scores, share).first()
    room, lo, hi = int(share * (cut["n"] or 0)) + 1, 0, int(cut["cut"] or 0)
    candidates = scores.select("node")
    while lo < hi:
        tried = sorted({lo + -(-(hi - lo) * i // (pivots + 1)) for i in range(1, pivots + 1)})
        reached = restricted_counts(schema, path, start, scores, tried, k, candidates).where(F.col("count") >= F.col("pivot"))
        reached = written(reached.select("pivot", "node"), "reached")
        enough = {r["pivot"] for r in reached.groupBy("pivot").count().collect() if r["count"] >= room}
        best = max(enough, default=lo)
        hi = min([p - 1 for p in tried if p > best], default=hi)
        if best > lo:
            candidates = reached.where(F.col("pivot") == best).select("node")
            lo = best
    return candidates.select("node", F.lit(lo).cast("long").alias("cut"))


def own_h(schema: GraphSchema, path: MetaPath, layer: int, scores: DataFrame, queries: DataFrame) -> DataFrame:
    """(node, h): h-index of the query nodes over the scores of their exact peers; only their peers are listed."""
    peers = peers_of(schema, path, layer, queries).withColumnsRenamed({"node": "src", "peer": "dst"})
    return H.h_index(peers, scores.select("node", F.col("score").alias("value"))).select("node", "h")


def personal_h(schema: GraphSchema, path: MetaPath, start: DataFrame, scores: DataFrame, queries: DataFrame, share: float, k: int) -> DataFrame:
    """(node, h, is_hub) for the query nodes: with h from its exact peers, at most floor(share n) nodes (itself included) have as many peers with a score of h or more as it has."""
    own = written(own_h(schema, path, len(path.steps) // 2, scores, queries), "own-h")
    pivots = [r["h"] for r in own.select("h").distinct().collect() if r["h"] is not None]
    counts = written(restricted_counts(schema, path, start, scores, pivots, k), "counts")
    mine = own.join(counts, (own["h"] == counts["pivot"]) & (own["node"] == counts["node"]), "left").select(own["node"].alias("q"), "h", F.coalesce("count", F.lit(0.0)).alias("own"))
    above = counts.join(F.broadcast(mine), F.col("pivot") == F.col("h")).where((F.col("node") != F.col("q")) & (F.col("count") >= F.col("own")))
    above = above.groupBy(F.col("q").alias("node")).agg(F.count(F.lit(1)).alias("others"))
    n = F.broadcast(scores.agg(F.count(F.lit(1)).alias("n")))
    judged = mine.withColumnRenamed("q", "node").join(above, "node", "left").crossJoin(n)
    return judged.select("node", "h", (F.coalesce("others", F.lit(0)) + 1 <= F.floor(F.lit(share) * F.col("n"))).alias("is_hub"))


def clearly_not_h_hub(exact: Column, h: Column, clique: Column, beta: float, limit: Column) -> Column:
    """Early stop by h-index: as by degree, or a clique of at least the node's h-index and the hubs' number rules it out."""
    return H.clearly_not_hub(exact, clique, beta, limit) | ((clique >= h) & (clique >= F.floor(limit)))


def personal_h_stopped(schema: GraphSchema, path: MetaPath, start: DataFrame, scores: DataFrame, own: DataFrame, clique: DataFrame, queries: DataFrame, share: float, k: int, beta: float) -> DataFrame:
    """(node, stopped, is_hub) by h-index for the query nodes; ``own`` (node, exact) holds their degrees, ``clique`` one row, size.

    Sketches start only for the queries that the clique does not decide.
    """
    n = F.broadcast(scores.agg(F.count(F.lit(1)).alias("n")))
    judged = own.join(own_h(schema, path, len(path.steps) // 2, scores, queries), "node").crossJoin(F.broadcast(clique)).crossJoin(n)
    stop = clearly_not_h_hub(F.col("exact"), F.col("h"), F.col("size"), beta, F.lit(share) * F.col("n"))
    judged = written(judged.select("node", F.coalesce(stop, F.lit(False)).alias("stopped")), "own")
    rest = personal_h(schema, path, start, scores, judged.where("not stopped"), share, k)
    return judged.where("stopped").withColumn("is_hub", F.lit(False)).unionByName(rest.select("node", F.lit(False).alias("stopped"), "is_hub"))
