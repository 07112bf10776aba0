"""Fidelity, classification, ranking and statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ranking import quantiles

# --- representations: (id, x, y), both ARRAY<DOUBLE> -----------------------------


def cosine_fidelity(pairs: DataFrame) -> DataFrame:
    c = V.cosine(F.col("x"), F.col("y"))
    return pairs.select(c.alias("c")).agg(F.avg("c").alias("mean"), F.stddev_samp("c").alias("std"))


def relative_l2(pairs: DataFrame) -> DataFrame:
    """(id, rel): |x - y| / |x|, 0 where x has no length."""
    n = V.norm(F.col("x"))
    return pairs.select("id", F.when(n > 0, V.norm(V.minus(F.col("x"), F.col("y"))) / n).otherwise(F.lit(0.0)).alias("rel"))


def frobenius(pairs: DataFrame) -> DataFrame:
    d = V.minus(F.col("x"), F.col("y"))
    s = pairs.select(V.dot(d, d).alias("d"), V.dot(F.col("x"), F.col("x")).alias("x"))
    return s.agg((F.sqrt(F.sum("d")) / F.sqrt(F.sum("x"))).alias("error"))


def gram(pairs: DataFrame) -> DataFrame:
    """(kind, i, j, value): sums of products xx, xy, yy and plain sums x, y (j = 0), and n.

    Each task multiplies its own block of rows; d * d numbers per task are added up.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("x", "y"))
            parts = {"xx": x.T @ x, "xy": x.T @ y, "yy": y.T @ y, "x": x.sum(0)[:, None], "y": y.sum(0)[:, None], "n": np.array([[float(len(x))]])}
            sq = (x * x).sum(1), (y * y).sum(1)
            parts |= {"sx": sq[0].sum()[None, None], "sy": sq[1].sum()[None, None]}
            for kind, m in parts.items():
                i, j = np.indices(m.shape)
                yield pa.RecordBatch.from_pydict({"kind": [kind] * m.size, "i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "value": m.ravel().astype(float)})

    return pairs.select("x", "y").mapInArrow(blocks, "kind string, i int, j int, value double").groupBy("kind", "i", "j").agg(F.sum("value").alias("value"))


def _centred(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = gram(pairs)
    n = F.broadcast(g.where("kind = 'n'").select(F.col("value").alias("n")))
    left = g.where("kind in ('x', 'y')").select(F.col("kind").alias("a"), F.col("i").alias("ai"), F.col("value").alias("av"))
    m = g.where("kind in ('xx', 'xy', 'yy')").select("*", F.substring("kind", 1, 1).alias("k1"), F.substring("kind", 2, 1).alias("k2")).crossJoin(n)
    m = m.join(left, (F.col("k1") == F.col("a")) & (F.col("i") == F.col("ai"))).join(left.toDF("b", "bi", "bv"), (F.col("k2") == F.col("b")) & (F.col("j") == F.col("bi")))
    return m.select("kind", (F.col("value") - F.col("av") * F.col("bv") / F.col("n")).alias("c")), n


def linear_cka(pairs: DataFrame) -> DataFrame:
    """One row: |Xc'Yc|^2 / (|Xc'Xc| |Yc'Yc|) in the feature space, d * d numbers whatever n is."""
    c, _ = _centred(pairs)
    s = lambda k: F.sum(F.when(F.col("kind") == k, F.col("c") * F.col("c")))
    return c.agg((s("xy") / (F.sqrt(s("xx")) * F.sqrt(s("yy")))).alias("cka"))


def unbiased_cka(pairs: DataFrame) -> DataFrame:
    """One row: CKA from the unbiased estimator on centred rows.

    With centred rows the n * n terms reduce to the Gram matrices and to sums
    of |x|^2 |y|^2, so no pair of rows is formed. With four rows or fewer the
    estimator has no meaning and the biased one takes its place.
    """
    mean = pairs.select(F.posexplode(F.arrays_zip("x", "y"))).groupBy("pos").agg(F.avg("col.x").alias("mx"), F.avg("col.y").alias("my"))
    mean = F.broadcast(mean.agg(F.array_sort(F.collect_list(F.struct("pos", "mx", "my"))).alias("m")))
    rows = pairs.crossJoin(mean).select(V.minus(F.col("x"), F.col("m.mx")).alias("x"), V.minus(F.col("y"), F.col("m.my")).alias("y"))
    g = gram(rows)
    p, q = V.dot(F.col("x"), F.col("x")), V.dot(F.col("y"), F.col("y"))
    d = rows.select(p.alias("p"), q.alias("q")).agg(
        F.sum(F.col("p") * F.col("q")).alias("xy_d"), F.sum(F.col("p") * F.col("p")).alias("xx_d"), F.sum(F.col("q") * F.col("q")).alias("yy_d"),
        F.sum("p").alias("p"), F.sum("q").alias("q"), F.count(F.lit(1)).cast("double").alias("n"),
    )
    s = g.agg(*(F.sum(F.when(F.col("kind") == k, F.col("value") * F.col("value"))).alias(k) for k in ("xx", "xy", "yy")))
    both = s.crossJoin(d)

    def hsic(k: str, a: str, b: str) -> Column:
        n, diagonal = F.col("n"), F.col(f"{k}_d")
        return F.col(k) - diagonal + F.try_divide(F.col(a) * F.col(b), (n - 1) * (n - 2)) - F.try_divide(2 * diagonal, n - 2)

    unbiased = F.try_divide(hsic("xy", "p", "q"), F.sqrt(F.abs(hsic("xx", "p", "p") * hsic("yy", "q", "q"))))
    biased = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    return both.select(F.when(F.col("n") > 4, unbiased).otherwise(biased).alias("cka"))


def procrustes(pairs: DataFrame) -> DataFrame:
    """One row: residual of the best orthogonal map from y to x, over |x|. The d * d matrix goes to the driver for its SVD."""
    g = gram(pairs).where("kind in ('xy', 'sx', 'sy')").toPandas()
    xy = g[g.kind == "xy"]
    m = np.zeros((xy.i.max() + 1, xy.j.max() + 1))
    m[xy.i, xy.j] = xy.value
    sx, sy = (float(g[g.kind == k].value.iloc[0]) for k in ("sx", "sy"))
    left = max(sx + sy - 2 * np.linalg.svd(m, compute_uv=False).sum(), 0.0)
    return pairs.sparkSession.createDataFrame([(float(np.sqrt(left / sx)) if sx else 0.0,)], "residual double")


def dirichlet(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: mean of |x_u - x_v|^2 over edges, and half their sum over the number of nodes."""
    r = rows.select(F.col("id"), F.col("x"))
    e = edges.join(r.toDF("src", "a"), "src").join(r.toDF("dst", "b"), "dst")
    d = V.minus(F.col("a"), F.col("b"))
    s = e.select(V.dot(d, d).alias("d")).agg(F.avg("d").alias("mean"), F.sum("d").alias("sum"))
    return s.crossJoin(rows.agg(F.count(F.lit(1)).alias("n"))).select(F.col("mean").alias("energy"), (F.col("sum") / 2 / F.col("n")).alias("per_node"))


def mean_average_distance(rows: DataFrame) -> DataFrame:
    """One row: mean cosine distance over all pairs, from the sum of the unit vectors; no pair is formed."""
    unit = rows.select(V.scaled(F.col("x"), 1 / V.norm(F.col("x"))).alias("u"))
    n = F.broadcast(unit.agg(F.count(F.lit(1)).cast("double").alias("n")))
    s = unit.select(F.posexplode("u")).groupBy("pos").agg(F.sum("col").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    return s.crossJoin(n).select((1 - (F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mad"))


# --- classification: (truth, guess) ---------------------------------------------


def class_counts(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, class, tp, predicted, actual) in one pass."""
    both = rows.select(*keys, F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("g")), F.struct(F.col("guess").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("g")))).alias("c"), (F.col("truth") == F.col("guess")).cast("int").alias("hit"))
    return both.groupBy(*keys, F.col("c.class").alias("class")).agg(F.sum(F.col("hit") * F.col("c.t")).alias("tp"), F.sum("c.g").alias("predicted"), F.sum("c.t").alias("actual"))


def class_f1(counts: DataFrame) -> DataFrame:
    f = F.when(F.col("predicted") + F.col("actual") > 0, 2 * F.col("tp") / (F.col("predicted") + F.col("actual"))).otherwise(0.0)
    return counts.withColumn("f1", f)


def macro_f1(counts: DataFrame, skip: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean F1 of the classes; ``skip`` leaves out those without a hit, else they count as 0."""
    f = class_f1(counts)
    return (f.where("tp > 0") if skip else f).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


# --- ranking -----------------------------------------------------------------------


def positive_ranks(scored: DataFrame) -> DataFrame:
    """(query, rank): 1 + negatives scoring at least as high. ``scored``: (query, score, positive)."""
    pos = scored.where("positive").select("query", F.col("score").alias("p"))
    neg = scored.where("not positive").select("query", "score")
    return pos.join(neg, "query", "left").groupBy("query").agg((1 + F.sum(F.when(F.col("score") >= F.col("p"), 1).otherwise(0))).alias("rank"))


def rank_metrics(ranks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    hit = lambda k: F.avg((F.col("rank") <= k).cast("int"))
    return ranks.groupBy(*keys).agg(F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), hit(1).alias("hits_1"), hit(10).alias("hits_10"))


def threshold_counts(scored: DataFrame, scale: float = 16.0) -> DataFrame:
    """(score, pos, all, upto_pos, upto): counts per distinct score, and running counts from the highest.

    Running sums go bucket by bucket (scores times ``scale``), so distinct
    scores need not fit one task.
    """
    from .ranking import ranked

    by = scored.groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("pos"), F.count(F.lit(1)).alias("all"))
    falling = -F.floor(F.col("score") * scale)
    by = ranked(by, [], falling, [F.col("score").desc()], F.col("pos")).withColumnRenamed("r", "upto_pos").withColumnRenamed("n", "positives")
    return ranked(by, [], falling, [F.col("score").desc()], F.col("all")).withColumnRenamed("r", "upto").withColumnRenamed("n", "total")


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row: rank-sum AUC; ties share their mean rank."""
    c = threshold_counts(scored)
    neg_below = F.col("total") - F.col("positives") - (F.col("upto") - F.col("upto_pos"))
    ties = F.col("all") - F.col("pos")
    area = F.sum(F.col("pos") * (neg_below + ties / F.lit(2).cast("double")))
    pairs = F.max(F.col("positives").cast("double") * (F.col("total") - F.col("positives")))
    return c.agg((area / pairs).alias("auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    c = threshold_counts(scored)
    return c.agg(F.sum(F.col("pos") / F.col("positives") * (F.col("upto_pos") / F.col("upto"))).alias("ap"))


# --- statistics over repeated runs ----------------------------------------------------


def mean_std(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"), F.stddev_samp(value).alias("std_samp"), F.count(value).alias("n"))


def ci95(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Normal 95 % interval: mean and 1.96 s / sqrt(n)."""
    s = mean_std(rows, keys, value)
    return s.select(*keys, "mean", (F.lit(1.96) * F.col("std_samp") / F.sqrt(F.col("n").cast("double"))).alias("half_width"))


def geo_mean(value: Column) -> Column:
    """Over the positive values."""
    return F.exp(F.avg(F.when(value > 0, F.ln(value))))


def cohen_dz(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over deviation of paired differences a - b."""
    d = F.col("a") - F.col("b")
    return pairs.groupBy(*keys).agg((F.avg(d) / F.stddev_samp(d)).alias("dz"))


def degree_bins(degrees: DataFrame) -> DataFrame:
    """(node, degree, bin): tail up to the median, mid up to the 90th percentile, hub above."""
    q = F.broadcast(quantiles(degrees, "degree", {"p50": 0.5, "p90": 0.9}))
    b = F.when(F.col("degree") <= F.col("p50"), "tail").when(F.col("degree") <= F.col("p90"), "mid").otherwise("hub")
    return degrees.crossJoin(q).select("node", "degree", b.alias("bin"))


def marginal(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, x, slope): change of y over change of x between consecutive points, where x grows."""
    by = W.partitionBy(*keys).orderBy(x)
    d = rows.withColumn("dx", F.col(x) - F.lag(x).over(by)).withColumn("dy", F.col(y) - F.lag(y).over(by))
    return d.where("dx > 0").select(*keys, x, (F.col("dy") / F.col("dx")).alias("slope"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """For each left row the right row of its keys with the closest ``value``; ties by ``name``.

    Both sides are merged in the order of ``value``: the closest row is the last
    one before or the first one behind. Left rows without any are left out.
    """
    m = right.groupBy(*keys, F.col(value).alias("v")).agg(F.min(name).alias("match"))
    m = m.select(*keys, "v", F.struct("match", "v").alias("m"), F.lit(None).alias("row"))
    both = left.select(*keys, F.col(value).alias("v"), F.lit(None).alias("m"), F.struct(*left.columns).alias("row")).unionByName(m)
    by = W.partitionBy(*keys).orderBy("v")
    before = F.last("m", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    behind = F.first("m", ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing))
    found = both.select("row", "v", F.array(before, behind).alias("near")).where("row is not null")
    near = F.transform(F.filter("near", lambda x: x.isNotNull()), lambda x: F.struct(F.abs(F.col("v") - x["v"]).alias("d"), x["match"].alias("match"), x["v"].alias("v")))
    return found.select("row", F.array_min(near).alias("m")).where("m is not null").select("row.*", "m.match", F.col("m.v").alias("match_value"))


# --- aggregation over neighbours --------------------------------------------------------


def mean_aggregate(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, pos, value): mean of the targets' vectors, dimension by dimension. ``rows``: (node, pos, value)."""
    r = rows.select(F.col("node").alias("dst"), "pos", "value")
    return edges.join(r, "dst").groupBy(F.col("src").alias("node"), "pos").agg(F.avg("value").alias("value"))
