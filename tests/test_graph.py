"""Meta-paths, degrees, hubs, sketches and walks on small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from hinflow.operators import edges as E
from hinflow.operators import hubs as H
from hinflow.operators import similarity as S
from hinflow.operators import sketch as K
from hinflow.operators import walks as R
from hinflow.operators.components import components
from hinflow.operators.spectral import spectral_radius
from hinflow.plans import metapath as M


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def pairs(df):
    return sorted(tuple(r) for r in df.select("src", "dst").collect())


@pytest.fixture(scope="module")
def triangle(spark):
    return M.GraphSchema({"ab": edges(spark, [(0, 0), (0, 1), (1, 0), (2, 1)]), "ba": edges(spark, [(0, 0), (0, 1), (1, 1), (1, 2)])})


@pytest.fixture(scope="module")
def papers(spark):
    return M.GraphSchema({"ap": edges(spark, [(0, 0), (0, 1), (1, 1), (1, 2), (2, 3), (3, 4)]), "pv": edges(spark, [(0, 0), (1, 0), (2, 1), (3, 1), (4, 0)])})


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(4)
    return M.GraphSchema({"r": edges(spark, list({(rng.randrange(40), rng.randrange(25)) for _ in range(140)}))})


APV = M.MetaPath.parse("ap,pv")
RR = M.MetaPath.parse("r").mirrored()


def test_path_counts_triangle(triangle):
    c = M.path_counts(triangle, M.MetaPath.parse("ab,ba"))
    assert sorted(map(tuple, c.collect())) == [(0, 0, 1), (0, 1, 2), (0, 2, 1), (1, 0, 1), (1, 1, 1), (2, 1, 1), (2, 2, 1)]


def test_materialised_triangle(triangle, spark):
    g = M.metapath_edges(triangle, M.MetaPath.parse("ab,ba"))
    assert pairs(E.undirected(g)) == [(0, 1), (0, 2), (1, 2)]
    assert E.with_loops(E.symmetrized(g), spark.range(3).toDF("node")).count() == 9


def test_dead_end(spark):
    s = M.GraphSchema({"ab": edges(spark, [(0, 0), (1, 0), (2, 1)]), "ba": edges(spark, [(0, 0)])})
    g = M.metapath_edges(s, M.MetaPath.parse("ab,ba"))
    assert pairs(g) == [(0, 0), (1, 0)] and pairs(E.undirected(g)) == [(0, 1)]


def test_papers(papers):
    full = APV.mirrored()
    assert pairs(M.metapath_edges(papers, full)) == [(0, 0), (0, 1), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 0), (3, 1), (3, 3)]
    counts = {(r["src"], r["dst"]): r["paths"] for r in M.path_counts(papers, full).collect()}
    assert counts[0, 0] == 4 and counts[1, 3] == 1 and len(counts) == 12
    degree = lambda layer: {r["node"]: r["degree"] for r in E.degree(M.association_edges(papers, APV, layer)).collect()}
    assert degree(1) == {0: 2, 1: 2, 2: 1, 3: 1} and degree(2) == {0: 3, 1: 4, 2: 2, 3: 3}
    g = M.association_edges(papers, APV, 2)
    assert {r["node"]: r["h"] for r in H.h_index(g).collect()} == {0: 3, 1: 3, 2: 2, 3: 3}
    scores = E.degree(g).withColumnRenamed("degree", "score")
    hubs = lambda strict: {r["node"] for r in H.hubs(scores, 0.25, strict).collect()}
    assert hubs(False) == {0, 1, 3} and hubs(True) == {1}
    assert H.threshold(scores, 0.25).first()["cut"] == 3
    top = H.top_share(scores, 0.25)
    assert [r["node"] for r in top.orderBy("node").collect()] == [0, 1]
    f = H.f1(top, H.hubs(scores, 0.25, False), H.hubs(scores, 0.25, True)).first()
    assert (f["precision"], f["recall"], f["f1"]) == (1, 1, 1)
    assert H.epsilon(top, scores, 0.25).first()[0] == 0


def test_anchored_path_equals_filtered(papers):
    full = M.metapath_edges(papers, APV).where("dst = 0")
    anchored = M.MetaPath(APV.steps, anchor=0)
    assert pairs(M.metapath_edges(papers, anchored)) == pairs(full)
    assert sorted(r["node"] for r in M.peers(papers, anchored).collect()) == sorted(r["src"] for r in full.collect())
    assert {r["layer"] for r in M.anchored_edges(papers, anchored).collect()} == {0, 1}


def test_active_nodes_and_matching_edges(papers):
    a = M.active(papers, APV)
    assert a.where("layer = 0").count() == 4 and a.where("layer = 2").count() == 2
    assert M.matching_edges(papers, APV).groupBy("layer").count().orderBy("layer").collect()[0]["count"] == 6


def test_paths_parse_and_fail():
    p = M.MetaPath.parse(" writes, rev_cites ")
    assert str(p) == "writes,rev_cites" and str(p.mirrored()) == "writes,rev_cites,cites,rev_writes" and p.mirrored().is_palindrome()
    with pytest.raises(ValueError):
        M.MetaPath.parse("")
    with pytest.raises(KeyError):
        M.GraphSchema({}).step(M.Step("nothing"))


def test_mirrored_path_is_symmetric_and_is_the_association(random_graph):
    g = M.metapath_edges(random_graph, RR)
    assert pairs(g) == pairs(E.reverse(g)) == pairs(M.association_edges(random_graph, M.MetaPath.parse("r"), 1))


@pytest.mark.parametrize("k", [1, 4, 100])
def test_propagated_sketch_is_exact_bottom_k(random_graph, spark, k):
    u = K.universe(spark.range(40).toDF("node"))
    exact = K.exact_bottom_k(M.metapath_edges(random_graph, RR), u, k)
    assert sorted(map(tuple, K.propagate(random_graph, RR, u, k).collect())) == sorted(map(tuple, exact.collect()))
    if k == 100:
        d = K.decode(K.propagate(random_graph, RR, u, k), u)
        assert pairs(d) == pairs(M.metapath_edges(random_graph, RR))
        assert {r["node"]: int(r["degree"]) for r in K.estimate(exact, k).collect()} == {r["node"]: r["degree"] for r in E.degree(M.metapath_edges(random_graph, RR)).collect()}


def test_sketches_without_self(random_graph, spark):
    u = K.universe(spark.range(40).toDF("node"))
    plain = M.metapath_edges(random_graph, RR)
    without = K.propagate(random_graph, RR, u, 100, exclude_self=True)
    assert pairs(K.decode(without, u)) == pairs(E.without_loops(plain))
    one = K.decode_one(without, u, 3)
    assert sorted(r["node"] for r in one.collect()) == sorted(b for a, b in pairs(plain) if a == 3 != b)


def test_hub_middle_nodes_are_split(spark):
    """Self-joins by parts of a middle node give what joins hop by hop give."""
    rows = [(a, 0) for a in range(60)] + [(a, 1 + a % 3) for a in range(0, 90, 2)]
    s = M.GraphSchema({"r": edges(spark, rows)})
    want = sorted({(a, b) for a, m in rows for b, n in rows if m == n})
    assert pairs(M.mirrored(s.relations["r"], share=7)) == want == pairs(M.metapath_edges(s, RR))


def test_power_by_classes(spark, random_graph):
    rows = [(a, b) for a in range(12) for b in range(12) if (a * b) % 5 == 1 or a == 7]
    e = edges(spark, rows)
    three = {(a, d) for a, b in rows for b2, c in rows if b == b2 for c2, d in rows if c == c2}
    assert pairs(M.power(e, 3)) == sorted(three) and pairs(M.power(e, 1)) == sorted(rows)


def test_schema_by_types(papers):
    s = M.GraphSchema({"writes": papers.relations["ap"], "in": papers.relations["pv"]}, {"writes": ("author", "paper"), "in": ("paper", "venue")})
    want = pairs(M.metapath_edges(papers, APV))
    for text in ("writes,in", "author_to_paper,paper_to_venue", "Author_to_Paper,in", "rev_paper_to_author,rev_venue_to_paper"):
        assert pairs(M.metapath_edges(s, M.MetaPath.parse(text))) == want
    with pytest.raises(ValueError):
        M.metapath_edges(s, M.MetaPath.parse("in,writes"))
    with pytest.raises(KeyError):
        s.step(M.Step("cites"))


def test_peer_guard(papers):
    assert M.enough_peers(papers, APV) and not M.enough_peers(papers, M.MetaPath.parse("ap,pv", 1))
    assert not M.enough_peers(papers, M.MetaPath.parse("ap", 0)) and not M.enough_peers(papers, APV, least=5)


def test_early_stop_of_personal_queries(spark):
    scores = spark.createDataFrame([(i, float(100 - i)) for i in range(100)], "node long, score double")
    own = spark.createDataFrame([(2, 98), (60, 40)], "node long, exact long")
    answers = lambda clique: {r["node"]: r["is_hub"] for r in H.personal_pruned(scores, own, spark.createDataFrame([(clique,)], "size double"), 0.05, 0.1).collect()}
    assert answers(1.0) == answers(50.0) == {2: True, 60: False}
    assert answers(150.0) == {2: False, 60: False}  # a clique of 150 rules out both without a rank


def test_walk_budget_and_coupons(random_graph, spark):
    start = spark.range(40).toDF("node")
    everything = E.without_loops(M.metapath_edges(random_graph, RR)).count()
    w, saturated, found = R.budget(random_graph, RR, start, 100)
    assert not saturated and found >= 100
    count = lambda n: R.walk_edges(R.walk(random_graph, RR, start, n)).count()
    assert count(w) == found and count(w - 1) < 100
    w, saturated, found = R.budget(random_graph, RR, start, everything + 1, most=64)
    assert saturated and found <= everything
    draws = spark.createDataFrame([(0, i, v) for i, v in enumerate("aabca")] + [(1, 0, "x"), (1, 1, "y")], "trial long, at long, value string")
    assert sorted(map(tuple, R.collected(draws, (1, 2, 3)).collect())) == [(1, 2, 1.0, 0.0), (2, 2, 2.5, 0.5), (3, 1, 4.0, 0.0)]


def test_walks(random_graph, spark):
    start = spark.range(40).toDF("node")
    few, many = (R.walk_edges(R.walk(random_graph, RR, start, w)) for w in (4, 8))
    assert set(pairs(few)) <= set(pairs(many)) <= set(pairs(E.without_loops(M.metapath_edges(random_graph, RR))))
    assert pairs(few) == pairs(R.walk_edges(R.walk(random_graph, RR, start, 4)))
    all_ = R.walk_edges(R.walk(random_graph, RR, start, 600))
    assert len(set(pairs(E.without_loops(M.metapath_edges(random_graph, RR)))) - set(pairs(all_))) <= 2
    assert R.walk_edges(R.walk(random_graph, RR, start, 16), 2).count() <= R.walk_edges(R.walk(random_graph, RR, start, 16)).count()
    want = R.profile(R.walk(random_graph, RR, start, 32), start.withColumn("target", F.lit(3)))
    assert want.groupBy("src").count().agg(F.max("count")).first()[0] <= 3


def test_jaccard(spark):
    items = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (3, 9), (4, 7)], "node long, item long")
    got = {(r["a"], r["b"]): r["jaccard"] for r in S.jaccard(items).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 1 / 3, (2, 3): 1 / 3}


def test_components(spark):
    rng = random.Random(8)
    rows = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in rows:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*rows, (None, 3)], "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in rows for x in (a, b) if a != b or x in got}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edge_helpers(spark):
    e = edges(spark, [(0, 1), (1, 0), (1, 1), (5, 2), (5, 3)])
    lines = E.rendered(e)
    assert sorted(r["line"] for r in lines.collect()) == ["0 1", "1 0 1", "5 2 3"]
    assert pairs(E.parsed(lines)) == pairs(e) and pairs(E.parsed(lines, 1, 3)) == [(0, 0)]
    assert {r["node"]: r["degree"] for r in E.line_degree(lines).collect()} == {0: 1, 1: 1, 5: 2}
    assert sorted(map(tuple, E.offsets(e, F.lit(2)).collect())) == [(0, 1, 0), (1, 2, 1), (5, 2, 3)]
    assert pairs(E.capped(e, 1)) == [(0, 1), (1, 0), (5, 2)]
    d = E.density(e, spark.createDataFrame([(6,)], "n long")).first()
    assert (d["edges"], d["undirected"]) == (5, 3)


def test_spectral_radius(spark):
    full = edges(spark, [(i, j) for i in range(5) for j in range(5) if i != j])
    assert abs(spectral_radius(full, 4, 2).first()[0] - 4) < 1e-6


def test_split_hubs_keep_counts_and_weights(spark):
    """Degrees and path numbers over middle nodes cut into parts, against plain sums; an empty half path gives no rows."""
    rows = [(a, 0) for a in range(30)] + [(a, 1 + a % 3) for a in range(0, 50, 2)]
    half = edges(spark, rows)
    want = {(a, b): 0 for a, m in rows for b, n in rows if m == n}
    for a, m in rows:
        for b, n in rows:
            if m == n:
                want[a, b] += (1 + a % 4) * (1 + b % 4)
    weighted = half.withColumn("paths", 1 + F.col("src") % 4)
    assert {(r["src"], r["dst"]): r["paths"] for r in M.shared_paths(weighted, share=4).collect()} == want
    assert {r["node"]: r["degree"] for r in M.mirrored_degree(half, share=4).collect()} == {a: sum(x == a for x, _ in want) for a, _ in want}
    assert M.shared_paths(weighted.where("src < 0")).isEmpty() and M.mirrored_degree(half.where("src < 0")).isEmpty()


def test_f1_by_one_ranking(spark):
    """Ties at the cut, and no proposal at all: as with both sets given."""
    scores = spark.createDataFrame([(n, float(min(n // 3, 4))) for n in range(20)], "node long, score double")
    for wanted in ("node > 11", "node in (3, 13, 14)", "node < 0"):
        top = scores.where(wanted)
        assert H.f1_at(top, scores, 0.25).first() == H.f1(top, H.hubs(scores, 0.25, False), H.hubs(scores, 0.25, True)).first()
