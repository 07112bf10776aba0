"""Metrics against NumPy and by their properties; splits and samples by their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinflow.functions import paths
from hinflow.operators import metrics as X
from hinflow.operators import sampling as S
from hinflow.operators.ranking import ranked


def table(spark, x, y):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y array<double>").repartition(3)


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    return x, x + 0.1 * rng.normal(size=x.shape)


def test_identity(spark, noisy):
    t = table(spark, noisy[0], noisy[0])
    assert X.cosine_fidelity(t).first()["mean"] == pytest.approx(1)
    assert X.frobenius(t).first()[0] == 0 and X.relative_l2(t).agg(F.max("rel")).first()[0] == 0
    assert X.linear_cka(t).first()[0] == pytest.approx(1) and X.unbiased_cka(t).first()[0] == pytest.approx(1)
    assert X.procrustes(t).first()[0] == pytest.approx(0, abs=1e-6)


def test_against_numpy(spark, noisy):
    x, y = noisy
    t = table(spark, x, y)
    xc, yc = x - x.mean(0), y - y.mean(0)
    n = np.linalg.norm
    assert X.linear_cka(t).first()[0] == pytest.approx(n(xc.T @ yc) ** 2 / (n(xc.T @ xc) * n(yc.T @ yc)))
    assert X.frobenius(t).first()[0] == pytest.approx(n(x - y) / n(x))
    u, _, v = np.linalg.svd(y.T @ x)
    assert X.procrustes(t).first()[0] == pytest.approx(n(x - y @ (u @ v)) / n(x))

    def hsic(k, m):
        k, m, s = k.copy(), m.copy(), len(k)
        np.fill_diagonal(k, 0)
        np.fill_diagonal(m, 0)
        one = np.ones(s)
        return np.trace(k @ m) + (one @ k @ one) * (one @ m @ one) / ((s - 1) * (s - 2)) - 2 / (s - 2) * (one @ k @ m @ one)

    k, m = xc @ xc.T, yc @ yc.T
    assert X.unbiased_cka(t).first()[0] == pytest.approx(hsic(k, m) / np.sqrt(hsic(k, k) * hsic(m, m)))
    unit = x / n(x, axis=1, keepdims=True)
    distance = 1 - unit @ unit.T
    assert X.mean_average_distance(t).first()[0] == pytest.approx(distance[~np.eye(60, dtype=bool)].mean())


@pytest.mark.parametrize("n", (1, 2, 3, 4, 5))
def test_few_rows(spark, noisy, n):
    """Up to four rows the biased value; one row has no variance and no value."""
    t = table(spark, noisy[0][:n], noisy[1][:n])
    got, biased = X.unbiased_cka(t).first()[0], None if n == 1 else X.linear_cka(t).first()[0]
    assert got is None if n == 1 else (got == pytest.approx(biased)) == (n <= 4)


def test_rotation_and_independence(spark, noisy):
    x = noisy[0]
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(5, 5)))
    t = table(spark, x, x @ q)
    assert X.linear_cka(t).first()[0] == pytest.approx(1) and X.procrustes(t).first()[0] == pytest.approx(0, abs=1e-6)
    other = table(spark, x, np.random.default_rng(2).normal(size=x.shape))
    assert abs(X.unbiased_cka(other).first()[0]) < 0.3


def test_classification(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (3, 3)], "truth int, guess int")
    f = {r["class"]: r["f1"] for r in X.class_f1(X.class_counts(rows)).collect()}
    assert f == pytest.approx({0: 0.5, 1: 0.8, 2: 0.0, 3: 1.0})
    assert X.macro_f1(X.class_counts(rows), False).first()[0] == pytest.approx(2.3 / 4)
    assert X.macro_f1(X.class_counts(rows), True).first()[0] == pytest.approx(2.3 / 3)


def test_ranking(spark):
    rng = np.random.default_rng(3)
    score, pos = np.round(rng.normal(size=300), 1), rng.random(300) < 0.3
    t = spark.createDataFrame([(float(s), bool(p)) for s, p in zip(score, pos, strict=True)], "score double, positive boolean")
    p, n = score[pos], score[~pos]
    assert X.roc_auc(t).first()[0] == pytest.approx(((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n)))
    ap = sum((score[pos] == s).sum() / len(p) * (pos[score >= s].sum() / (score >= s).sum()) for s in set(score))
    assert X.average_precision(t).first()[0] == pytest.approx(ap)
    q = spark.createDataFrame([(1, 0.5, True), (1, 0.5, False), (1, 0.9, False), (2, 0.5, True), (2, 0.1, False)], "query long, score double, positive boolean")
    m = X.rank_metrics(X.positive_ranks(q)).first()
    assert (m["mrr"], m["hits_1"], m["hits_10"]) == (round((1 / 3 + 1) / 2, 6), 0.5, 1.0)


def test_ranked_is_row_number(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 500).alias("x"))
    got = sorted((r["g"], r["x"], r["r"], r["n"]) for r in ranked(df, ["g"], F.floor(F.col("x") / 50), ["x"]).collect())
    want = []
    for g in range(3):
        xs = sorted(i * 37 % 500 for i in range(500) if i % 3 == g)
        want += [(g, x, k + 1, len(xs)) for k, x in enumerate(xs)]
    assert got == sorted(want)


def test_splits(spark):
    df = spark.range(103).select(F.col("id"), F.when(F.col("id") < 2, "rare").when(F.col("id") < 10, None).otherwise("often").alias("y"))
    s = S.split(df, "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 61, "val": 21, "test": 21}
    st = S.stratified_split(df, "y", "id", 0.1)
    assert st.count() == 103 and st.where("split = 'train' and y = 'rare'").count() == 1 and st.where("split = 'train' and y is null").count() == 1
    sub = S.stratified_subsample(df, "y", "id", 10).groupBy("y").count().collect()
    assert sum(r["count"] for r in sub) == 10 and len(sub) == 3


def test_graph_samples(spark):
    e = spark.range(200).select((F.col("id") % 20).alias("src"), (F.col("id") * 7 % 30 + 100).alias("dst")).distinct()
    assert S.random_edges(e, 10).count() == 10
    f = S.fraction(e.withColumn("rel", F.lit("r")), ["rel"], 0.5).count()
    assert f == round(e.count() * 0.5)
    p = S.perturb(e, 0.3, spark.createDataFrame([(20,)], "n long"), spark.createDataFrame([(30,)], "n long"))
    assert p.distinct().count() == p.count() <= e.count()
    ball = S.snowball(e, spark.createDataFrame([(0,)], "node long"), 2)
    assert ball.count() == ball.distinct().count() >= 3


@pytest.mark.parametrize("per", [3, 25, 40])
def test_rejection_negatives(spark, per):
    """Exactly as many as asked for or as there are, without neighbours or the source itself, on a graph of nearly all pairs."""
    real = {(a, b) for a in range(30) for b in range(30) if (a * b) % 7 != 1 and a % 10}
    e = spark.createDataFrame(sorted(real), "src long, dst long")
    n = spark.range(30).toDF("node")
    got = [tuple(r) for r in S.rejection_negatives(n, n, e, per).collect()]
    assert len(got) == len(set(got)) and not set(got) & real and all(a != b for a, b in got)
    for a in range(30):
        assert sum(x == a for x, _ in got) == min(per, sum((a, b) not in real and a != b for b in range(30)))
    assert S.rejection_negatives(n, n.limit(0), e, per).collect() == []


def test_snowball_edges(spark):
    """A seed with a cap of two, its second hop, and an edge among kept nodes that nobody walks over."""
    e = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(1, 2), (9, 8)] + [(i, 100 + i) for i in range(1, 6)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    walked = [tuple(r) for r in S.snowball_edges(e, seeds, 2, 2).collect()]
    first = [(a, b) for h, a, b in walked if h == 1]
    assert len(first) == 2 and all(a == 0 for a, _ in first) and (2, 9, 8) not in walked
    reached = {b for _, b in first}
    for x in reached:
        assert sum(x in (a, b) for h, a, b in walked) <= 3
    assert len({(a, b) for _, a, b in walked}) == len(walked)
    every = {(a, b) for _, a, b in S.snowball_edges(e, seeds, 2, 50).collect()}
    assert every == {(0, i) for i in range(1, 6)} | {(1, 2)} | {(i, 100 + i) for i in range(1, 6)}


def test_paths(spark):
    row = spark.createDataFrame([(10, 3)], "d int, k int").select(paths.coupon_walks(F.col("d"), F.col("k"))).first()
    assert row[0] == pytest.approx(10 * (1 / 10 + 1 / 9 + 1 / 8))
