"""Hub queries: centralities, thresholds, top shares, and their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.metapath import MET, peer_ranks
from ..plans.scratch import written
from .edges import degree
from .ranking import ranked


def h_index(edges: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(node, h): largest h with at least h neighbours of value h or more.

    ``values`` (node, value) defaults to degrees; estimates work alike. Values
    are counted per node before the window runs, so a hub contributes one row
    per distinct value below its degree instead of one per neighbour.
    """
    values = degree(edges).withColumnRenamed("degree", "value") if values is None else values
    v = values.select(F.col("node").alias("dst"), F.col("value"))
    per = edges.join(v, "dst").groupBy("src", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("src").orderBy(F.col("value").desc()))
    per = per.withColumn("upto", upto)
    return per.groupBy(F.col("src").alias("node")).agg(F.max(F.least("upto", F.floor(F.col("value")).cast("bigint"))).alias("h"))


def mirrored_h_index(half: DataFrame, degrees: DataFrame, met: int = MET) -> DataFrame:
    """(node, h): ``h_index`` of the graph of ``metapath.mirrored``, of which no pair is written or shuffled.

    ``degrees`` (node, degree) of that graph, a written table. Nodes are
    numbered in falling order of degree; peers travel as these numbers. The
    i-th peer in that order has a degree of i or more if its number is at most
    that of all nodes with such a degree. No node's h exceeds the largest i
    that i nodes reach, whose square is at most the number of edges; so many
    numbers are broadcast.
    """
    by = _upto(degrees, "degree").select(F.col("degree").alias("value"), "r")
    most = by.agg(F.max(F.least("value", "r"))).first()[0] or 0
    i = degrees.sparkSession.range(1, most + 1).withColumnRenamed("id", "i")
    steps = by.select("r", F.least("value", F.lit(most)).cast("bigint").alias("i")).groupBy("i").agg(F.max("r").alias("r"))
    # Nodes of degree i or more, for every i up to ``most``.
    upto = i.join(steps, "i", "left").select("i", F.coalesce(F.max("r").over(W.orderBy(F.col("i").desc())), F.lit(0)).alias("r"))
    upto = upto.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("upto"))
    ranks = written(ranked(degrees, [], -F.floor(F.log1p(F.col("degree").cast("double")) * 64), [F.col("degree").desc(), "node"]).select("node", F.col("r").alias("rank")), "ranks")
    peers = peer_ranks(half, ranks, most, met=met).crossJoin(F.broadcast(upto))
    return peers.select("node", F.size(F.filter("ranks", lambda r, k: r <= F.get("upto", k))).cast("bigint").alias("h"))


def _upto(scores: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value, c, r, n): how often each value occurs, how many scores are at least as high, and how many there are.

    Scores are counted by value, and values are ranked in buckets, so that
    estimates, which hardly repeat, do not meet in one task.
    """
    by = scores.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    bucket = -F.floor(F.log1p(F.greatest(F.col(value).cast("double"), F.lit(0.0))) * 64)
    return ranked(by, list(keys), bucket, [F.col(value).desc()], F.col("c"))


def threshold(scores: DataFrame, share: float, value: str = "score") -> DataFrame:
    """One row (n, cut): the value at index floor(share n) of the scores in falling order."""
    by = _upto(scores, value).where(F.col("r") > F.floor(F.lit(share) * F.col("n")))
    return by.agg(F.max("n").alias("n"), F.max(value).alias("cut"))


def hubs(scores: DataFrame, share: float, strict: bool, value: str = "score") -> DataFrame:
    """(node, score) at (or, strict, above) the threshold."""
    cut = F.broadcast(threshold(scores, share, value))
    kept = scores.crossJoin(cut)
    return kept.where(F.col(value) > F.col("cut") if strict else F.col(value) >= F.col("cut")).select("node", value)


def top_share(scores: DataFrame, share: float, value: str = "score") -> DataFrame:
    """(node, score) of the floor(share n) + 1 largest scores; ties by node.

    Nodes above the cut value are taken without sorting; only those that tie at
    the cut are ranked.
    """
    cut = F.broadcast(threshold(scores, share, value).withColumnRenamed("n", "total"))
    s = scores.crossJoin(cut).where(F.col(value) >= F.col("cut"))
    above = s.where(F.col(value) > F.col("cut"))
    room = F.broadcast(above.agg(F.count(F.lit(1)).alias("above")))
    ties = s.where(F.col(value) == F.col("cut")).crossJoin(room)
    ties = ranked(ties, [], F.floor(F.col("node") / 4096), ["node"]).where(F.col("r") <= F.floor(F.lit(share) * F.col("total")) + 1 - F.col("above"))
    return above.select("node", value).union(ties.select("node", value))


def _f1_of(counts: DataFrame) -> DataFrame:
    """(precision, recall, f1) of np proposed nodes, tp of them inclusive hubs, and ns strict hubs, ts of them proposed."""
    precision = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0)
    recall = F.when(F.col("ts") > 0, F.col("ts") / F.col("ns")).otherwise(1.0)
    c = counts.select(precision.alias("precision"), recall.alias("recall"))
    both = F.col("precision") + F.col("recall")
    return c.select("*", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"))


def f1(proposed: DataFrame, inclusive: DataFrame, strict: DataFrame) -> DataFrame:
    """One row: precision against the inclusive set, recall against the strict set, F1.

    Ties at the threshold cost nothing: a tied node is no false positive, and
    missing it is no miss. Recall is 1 if no strict hub is proposed.
    """
    p = proposed.select("node").withColumn("p", F.lit(1))
    i = inclusive.select("node").withColumn("i", F.lit(1))
    s = strict.select("node").withColumn("s", F.lit(1))
    c = p.join(i, "node", "full").join(s, "node", "full").agg(
        F.count("p").alias("np"), F.count("s").alias("ns"),
        F.count(F.when(F.col("p").isNotNull() & F.col("i").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("p").isNotNull() & F.col("s").isNotNull(), 1)).alias("ts"),
    )
    return _f1_of(c)


def f1_at(proposed: DataFrame, scores: DataFrame, share: float, value: str = "score") -> DataFrame:
    """``f1`` against the hubs of ``scores`` (one row a node): one ranking and one join give the inclusive and the strict set."""
    cut = F.broadcast(threshold(scores, share, value).select("cut"))
    truth = scores.crossJoin(cut).where(F.col(value) >= F.col("cut")).select("node", (F.col(value) > F.col("cut")).alias("strict"))
    n = lambda c: F.count(F.when(c, 1))
    p, strict = F.col("p").isNotNull(), F.col("strict")
    c = proposed.select("node", F.lit(1).alias("p")).join(truth, "node", "full")
    return _f1_of(c.agg(n(p).alias("np"), n(strict).alias("ns"), n(p & strict.isNotNull()).alias("tp"), n(p & strict).alias("ts")))


def epsilon(proposed: DataFrame, scores: DataFrame, share: float, value: str = "score") -> DataFrame:
    """One row: the largest relative distance from the threshold among misclassified nodes."""
    cut = F.broadcast(threshold(scores, share, value))
    s = scores.crossJoin(cut).join(proposed.select(F.col("node"), F.lit(True).alias("proposed")), "node", "left")
    wrong = (F.col("proposed").isNotNull() & (F.col(value) < F.col("cut"))) | (F.col("proposed").isNull() & (F.col(value) > F.col("cut")))
    off = F.abs(F.col(value) - F.col("cut")) / F.col("cut")
    return s.agg(F.coalesce(F.max(F.when(wrong & (F.col("cut") >= 1), off)), F.lit(0.0)).alias("epsilon"))


def rank_of(scores: DataFrame, queries: DataFrame, value: str = "score") -> DataFrame:
    """(node, score, above, at_least, n) for the query nodes: how many scores are higher, and how many at least as high.

    One ranking of distinct values answers any number of queries.
    """
    by = _upto(scores, value).select(value, (F.col("r") - F.col("c")).alias("above"), F.col("r").alias("at_least"), "n")
    return scores.join(queries.select("node"), "node", "left_semi").join(by, value).select("node", value, "above", "at_least", "n")


def personal(scores: DataFrame, queries: DataFrame, share: float, value: str = "score") -> DataFrame:
    """(node, is_hub): the node's rank, 1 + higher scores, is within floor(share n)."""
    r = rank_of(scores, queries, value)
    return r.select("node", (F.col("above") + 1 <= F.floor(F.lit(share) * F.col("n"))).alias("is_hub"))


def accuracy(answers: DataFrame, inclusive: DataFrame, strict: DataFrame) -> DataFrame:
    """One row: a yes is right within the inclusive set, a no outside the strict set."""
    a = answers.join(inclusive.select("node", F.lit(1).alias("i")), "node", "left").join(strict.select("node", F.lit(1).alias("s")), "node", "left")
    right = F.when(F.col("is_hub"), F.col("i").isNotNull()).otherwise(F.col("s").isNull())
    return a.agg(F.avg(right.cast("double")).alias("accuracy"))


def clearly_not_hub(score: Column, clique: Column, beta: float, limit: Column) -> Column:
    """Early stop of a personal query: the largest clique alone holds more than ``limit`` nodes that score higher.

    All peers of one middle node are peers of each other, so each of them has
    at least the clique's size as its degree. ``beta`` is the margin for the
    clique's size being an estimate.
    """
    return (clique >= score * (1 + beta)) & (clique > limit * (1 + beta))


def personal_stopped(scores: DataFrame, own: DataFrame, clique: DataFrame, share: float, beta: float, value: str = "score") -> DataFrame:
    """(node, exact, stopped, is_hub) for ``own`` (node, exact, a score of the query node that costs little), by ``clique`` (one row, size) where it suffices.

    Only queries that the clique does not decide are ranked.
    """
    n = F.broadcast(scores.agg(F.count(F.lit(1)).alias("n")))
    judged = own.crossJoin(F.broadcast(clique)).crossJoin(n)
    stop = clearly_not_hub(F.col("exact"), F.col("size"), beta, F.lit(share) * F.col("n"))
    judged = judged.select("node", "exact", F.coalesce(stop, F.lit(False)).alias("stopped"))
    rest = personal(scores, judged.where("not stopped"), share, value)
    decided = judged.where("stopped").withColumn("is_hub", F.lit(False))
    return decided.unionByName(judged.where("not stopped").join(rest, "node"))


def personal_pruned(scores: DataFrame, own: DataFrame, clique: DataFrame, share: float, beta: float, value: str = "score") -> DataFrame:
    """(node, is_hub), as ``personal_stopped``."""
    return personal_stopped(scores, own, clique, share, beta, value).select("node", "is_hub")


def thresholds(scores: DataFrame, share: float, keys: tuple[str, ...], value: str = "score") -> DataFrame:
    """(keys, n, cut): ``threshold`` for every group of ``keys``."""
    by = _upto(scores, value, keys).where(F.col("r") > F.floor(F.lit(share) * F.col("n")))
    return by.groupBy(*keys).agg(F.max("n").alias("n"), F.max(value).alias("cut"))


def quality_by(estimates: DataFrame, exact: DataFrame, share: float, keys: tuple[str, ...], exact_keys: tuple[str, ...]) -> DataFrame:
    """(keys, precision, recall, f1, epsilon) of the top shares of ``estimates`` (keys, node, score) against ``exact`` (exact_keys, node, score).

    As ``top_share``, ``f1`` and ``epsilon``, for all groups at once: the plan
    does not grow with their number. ``exact_keys`` are among ``keys``; both
    tables are read several times, so they should be written ones.
    """
    cuts = thresholds(estimates, share, keys).withColumnRenamed("n", "total")
    e = estimates.join(cuts, list(keys)).where(F.col("score") >= F.col("cut"))
    above = e.where(F.col("score") > F.col("cut"))
    room = above.groupBy(*keys).agg(F.count(F.lit(1)).alias("above"))
    ties = e.where(F.col("score") == F.col("cut")).join(room, list(keys), "left").fillna(0, ["above"])
    ties = ranked(ties, list(keys), F.floor(F.col("node") / 4096), ["node"]).where(F.col("r") <= F.floor(F.lit(share) * F.col("total")) + 1 - F.col("above"))
    top = above.select(*keys, "node").union(ties.select(*keys, "node")).withColumn("p", F.lit(1))
    truth = exact.join(thresholds(exact, share, exact_keys).drop("n"), list(exact_keys)).select(*exact_keys, "node", F.col("score").alias("x"), "cut")
    groups = cuts.select(*keys)
    all_ = truth.join(F.broadcast(groups), list(exact_keys)).join(top, [*keys, "node"], "left")
    x, cut, p = F.col("x"), F.col("cut"), F.col("p").isNotNull()
    wrong = (p & (x < cut)) | (~p & (x > cut))
    n = lambda c: F.count(F.when(c, 1))
    c = all_.groupBy(*keys).agg(n(p).alias("np"), n(p & (x >= cut)).alias("tp"), n(x > cut).alias("ns"), n(p & (x > cut)).alias("ts"), F.coalesce(F.max(F.when(wrong & (cut >= 1), F.abs(x - cut) / cut)), F.lit(0.0)).alias("epsilon"))
    c = c.select(*keys, F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0).alias("precision"), F.when(F.col("ts") > 0, F.col("ts") / F.col("ns")).otherwise(1.0).alias("recall"), "epsilon")
    both = F.col("precision") + F.col("recall")
    return c.select("*", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"))
