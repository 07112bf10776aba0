"""Tests, intervals, eigenvalues, restricted sketches and path rules against plain versions and known values."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinflow.functions import paths
from hinflow.operators import hubs as H
from hinflow.operators import inference as I
from hinflow.operators import sketch as K
from hinflow.operators import sketch_hubs as SH
from hinflow.operators import walks
from hinflow.operators.edges import degree
from hinflow.operators.spectral import top_eigenvalues
from hinflow.plans import metapath as M


def test_student_t(spark):
    """Critical values as printed in tables, and a distribution function that inverts them."""
    known = {1: 12.706205, 2: 4.302653, 4: 2.776445, 9: 2.262157, 30: 2.042272, 1000: 1.962339, 100_000: 1.959988}
    df = spark.createDataFrame([(d,) for d in known], "d long").withColumn("t", I.t_quantile(0.05, F.col("d")))
    for r in df.withColumn("p", I.t_tails(F.col("t"), F.col("d").cast("double"))).withColumn("u", I.t_upper(-F.col("t"), F.col("d").cast("double"))).collect():
        assert r["t"] == pytest.approx(known[r["d"]], abs=2e-6) and r["p"] == pytest.approx(0.05, abs=1e-9) and r["u"] == pytest.approx(0.975, abs=1e-9)
    z = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.959964, -3.0, 6.0, 40.0)], "z double").select("z", I.normal_tails(F.col("z")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), abs=1e-12) for r in z)


def test_incomplete_beta(spark):
    """Whole parameters: tails of the binomial law."""
    cases = [(x, a, b) for x in (0.0, 0.1, 0.5, 0.93, 1.0) for a, b in ((1, 1), (3, 2), (10, 40), (200, 5))]
    df = spark.createDataFrame([(x, float(a), float(b)) for x, a, b in cases], "x double, a double, b double").select("*", I.incomplete_beta(F.col("x"), F.col("a"), F.col("b")).alias("i"))
    for r in df.collect():
        n = int(r["a"] + r["b"] - 1)
        assert r["i"] == pytest.approx(sum(math.comb(n, j) * r["x"] ** j * (1 - r["x"]) ** (n - j) for j in range(int(r["a"]), n + 1)), abs=1e-10)


def plain_signed_rank(d):
    n, d = len(d), [x for x in d if x]
    if n < 5:
        return n, None, None
    size = sorted(map(abs, d))
    rank = [sum(s < abs(x) for s in size) + (size.count(abs(x)) + 1) / 2 for x in d]
    w = min(sum(r for r, x in zip(rank, d, strict=True) if x > 0), sum(r for r, x in zip(rank, d, strict=True) if x < 0))
    under = sum(sum(c) <= w for c in itertools.product(*((0, r) for r in rank)))
    return n, float(w), min(1.0, 2 * under / 2 ** len(d))


def test_signed_rank(spark):
    """Ties, zeros, all zeros, too few, one sign only; nulls do not count; a large group by the normal law."""
    rng = random.Random(2)
    groups = {"plain": [rng.gauss(1, 1) for _ in range(12)], "ties": [1, 1, -1, 2, 2, -3, 0, 3], "few": [1.0, 2.0], "zeros": [0.0] * 6, "up": [1, 2, 3, 4, 5], "nulls": [None, 1.0, -2.0, 3.0, 4.0, 5.0, None]}
    rows = [(g, None if x is None else float(x)) for g, d in groups.items() for x in d]
    large = [rng.gauss(0.2, 1) for _ in range(300)]
    df = spark.createDataFrame(rows + [("large", x) for x in large], "g string, d double")
    got = {r["g"]: tuple(r)[1:] for r in I.signed_rank(df, ["g"], "d").collect()}
    for g, d in groups.items():
        n, w, p = plain_signed_rank([x for x in d if x is not None])
        assert got[g][:2] == (n, w) and got[g][2] == (None if p is None else pytest.approx(p, abs=1e-9))
    order = np.argsort(np.abs(large))
    ranks = np.empty(300)
    ranks[order] = np.arange(1, 301)
    w = min(ranks[np.array(large) > 0].sum(), ranks[np.array(large) < 0].sum())
    z = (w - 300 * 301 / 4) / math.sqrt(300 * 301 * 601 / 24)
    assert got["large"][1] == w and got["large"][2] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-9)


def test_equivalence(spark):
    df = spark.createDataFrame([("a", x) for x in (0.01, -0.02, 0.015, 0.0, 0.005)] + [("b", x) for x in (1.0, 1.1, 0.9, 1.2, 1.0)] + [("c", 0.1)] + [("d", 0.5)] * 5 + [("e", None)], "g string, d double")
    got = {r["g"]: r for r in I.equivalence(df, ["g"], "d", 0.05).collect()}
    # t = (0.002 + 0.05) / 0.0060415 = 8.607 and (0.05 - 0.002) / 0.0060415 = 7.945 with 4 degrees of freedom
    assert got["a"]["decision"] == "REJECT_H0" and got["a"]["p_lower"] < got["a"]["p_upper"] == pytest.approx(0.000684, abs=1e-5)
    assert got["b"]["decision"] == got["d"]["decision"] == "FAIL" and got["d"]["p_max"] == 1.0
    assert got["c"]["decision"] == got["e"]["decision"] == "INSUFFICIENT_SEEDS" and got["c"]["p_max"] is None
    one = I.t_interval(df, ["g"], "d").where("g = 'c'").first()
    assert (one["mean"], one["half_width"], one["n"]) == (0.1, 0.0, 1)


@pytest.mark.parametrize("size", [60, 4])
def test_top_eigenvalues(spark, size):
    rng = np.random.default_rng(size)
    a = np.triu(rng.random((size, size)) < 0.2, 1) * rng.normal(size=(size, size)) + 0.0
    a[0, 1] = 2.0
    a = a + a.T
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    got = [r["value"] for r in top_eigenvalues(spark.createDataFrame(rows, "src long, dst long, weight double")).orderBy("rank").collect()]
    used = np.flatnonzero(np.abs(a).sum(1))
    want = np.sort(np.linalg.eigvalsh(a[np.ix_(used, used)]))[::-1][:5]
    assert got == pytest.approx(want[: len(got)].tolist(), abs=1e-3) and len(got) == min(5, len(used))
    assert top_eigenvalues(spark.createDataFrame([], "src long, dst long, weight double")).collect() == []


def test_h_hubs_equal_the_exact_ones(spark):
    """With sketches that hold everything, estimates are exact: the hubs are those of the exact h-index at its own cut."""
    rng = random.Random(11)
    rows = sorted({(min(int(rng.expovariate(0.05)), 79), rng.randrange(40)) for _ in range(300)})
    s, path = M.GraphSchema({"r": spark.createDataFrame(rows, "src long, dst long")}), M.MetaPath.parse("r").mirrored()
    start = K.universe(spark.range(80).toDF("node"))
    g = M.metapath_edges(s, path)
    scores = degree(g).withColumnRenamed("degree", "score").persist()
    h = {r["node"]: r["h"] for r in H.h_index(g).collect()}
    for share, pivots in ((0.1, 3), (0.3, 1), (0.6, 5)):
        cut = sorted(h.values(), reverse=True)[int(share * len(h))]
        found = SH.h_hubs(s, path, start, scores, share, 1000, pivots)
        assert {tuple(r) for r in found.collect()} == {(n, cut) for n, v in h.items() if v >= cut}
    asked = spark.createDataFrame([(n,) for n in list(h)[:7]], "node long")
    peers = {}
    for a, b in g.collect():
        peers.setdefault(a, set()).add(b)
    for r in SH.personal_h(s, path, start, scores, asked, 0.3, 1000).collect():
        counts = {n: sum(len(peers[x]) >= r["h"] for x in p) for n, p in peers.items()}
        assert r["h"] == h[r["node"]] and r["is_hub"] == (sum(c >= counts[r["node"]] for n, c in counts.items() if n != r["node"]) + 1 <= int(0.3 * len(h)))


def test_coordinated_estimator(spark):
    """Sketches that hold everything give the true similarity."""
    from hinflow.operators import similarity as S

    rows = [(n, i) for n in range(12) for i in range(40) if (n * 7 + i * i) % 5 < 2]
    items = spark.createDataFrame(rows, "node long, item long")
    exact = {(r["a"], r["b"]): r["jaccard"] for r in S.jaccard(items).collect()}
    slots = items.select("node", F.col("item").alias("h"))
    assert {(r["a"], r["b"]): r["jaccard"] for r in S.coordinated(slots, 100).collect()} == exact
    e = S.errors(S.jaccard(items), S.coordinated(K.bottom_k(slots, 4), 4)).first()
    assert e["pairs"] == len(exact) and 0 <= e["mae"] <= e["worst"] <= 1


def test_validated_paths(spark):
    ends = {"ab": ("a", "b"), "ba": ("b", "a"), "bc": ("b", "c"), "ca": ("c", "a")}
    want = {"ab,ba": ("ab,ba", None), "ba,ab,ba": ("ab,ba", None), "ab,bc,ca": ("ab,bc,ca", None), "ab,x": (None, "unknown"), "x": (None, "unknown"), "ab,ca": (None, "gap"), "bc": (None, "start"), "ab,bc": (None, "end"), "ca,ab": (None, "end"), "ca,ab,ba,ab,bc,ca": ("ab,ba,ab,bc,ca", None)}
    types = F.create_map(*(x for n, (a, b) in ends.items() for x in (F.lit(n), F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")))))
    df = spark.createDataFrame([(p,) for p in want], "p string").withColumn("e", types).select("p", paths.validated(F.col("p"), F.col("e"), F.lit("a")).alias("v"))
    assert {r["p"]: tuple(r["v"]) for r in df.collect()} == want


def test_cyclic_paths(spark):
    """Every path is a chain that closes; an odd length falls back to two steps; a type without a way back raises."""
    rel = [("ab", "a", "b"), ("ba", "b", "a"), ("bc", "b", "c"), ("cb", "c", "b"), ("ad", "a", "d")]
    df = spark.createDataFrame(rel, "relation string, src string, dst string")
    ends = {r: (a, b) for r, a, b in rel}
    got = [r["path"].split(",") for r in walks.cyclic_paths(df, "a", 4, 30).collect()]
    assert len(got) == 30 and len({tuple(p) for p in got}) == 2
    for p in got:
        assert len(p) == 4 and ends[p[0]][0] == "a" == ends[p[-1]][1] and all(ends[x][1] == ends[y][0] for x, y in zip(p, p[1:], strict=False))
    assert {r["path"] for r in walks.cyclic_paths(df, "a", 3, 5).collect()} == {"ab,ba"}
    with pytest.raises(ValueError):
        walks.cyclic_paths(df, "d", 4, 5)
