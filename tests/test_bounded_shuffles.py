"""Steps that shuffle less than pairs or slots must give what the plain ones give."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from hinflow.operators import hubs as H
from hinflow.operators import sampling as S
from hinflow.operators import similarity as SIM
from hinflow.operators import sketch as K
from hinflow.operators.edges import degree
from hinflow.operators.spectral import spectral_radius
from hinflow.plans import metapath as M


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def peers_of(edges):
    return sorted({(a, b) for a, x in edges for b, y in edges if x == y})


def half_of(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def test_few_classes(spark):
    """Sixty sources with three sets of ends: one graph, its powers, degrees and radius, by pairs of classes in small chunks."""
    edges = [(i, m) for i in range(60) for m in ((0,), (0, 1), (2,))[i % 3]]
    half, want = half_of(spark, edges), peers_of(edges)
    assert M.few(half) and rows(M.mirrored(half)) == want
    classes, links = M.quotient(half)
    assert classes.select("of").distinct().count() == 3
    pairs = M.class_pairs(classes, links, chunk=4)
    assert pairs.count() > 20 and rows(M.spread(pairs)) == want
    marked = classes.withColumn("even", F.col("node") % 2 == 0)
    got = rows(M.spread(M.class_pairs(marked, links, "even", chunk=4), "x_even", "y_even"))
    assert got == [(a, b, a % 2 == 0, b % 2 == 0) for a, b in want]
    assert rows(M.mirrored_degree(half)) == rows(degree(M.mirrored(half)))
    two = sorted({(a, d) for a, b in want for c, d in want if b == c})
    assert rows(M.mirrored_power(half, 2)) == two
    sizes = classes.groupBy(F.col("of").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    by_class = spectral_radius(links.toDF("src", "dst"), 4, 2, sizes).first()[0]
    assert abs(by_class - spectral_radius(M.mirrored(half), 4, 2).first()[0]) < 1e-6


def test_pairs_leave_in_pieces(spark):
    """A task that lists the pairs of two chunks holds a piece of them, not all, when the first one leaves."""
    chunk = list(range(300))
    one = spark.createDataFrame([(chunk, chunk)], "xs array<long>, ys array<long>").coalesce(1)
    listed = M.spread(one, held=900)
    execution = listed._jdf.queryExecution()
    execution.toRdd().toJavaRDD().first()
    made, plans = 0, [execution.executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "Generate":
            made = max(made, plan.metrics().apply("numOutputRows").value())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    assert 0 < made <= 900
    assert listed.distinct().count() == 300 * 300 == M.spread(one).count()
    assert M.spread(one.select(F.array().cast("array<long>").alias("xs"), "ys")).isEmpty()


def test_sets_of_one_hash(spark):
    """Two ends of one 64-bit hash (made by its arithmetic) do not make one class of sources that share no end."""
    p1, p2, word = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1

    def mixed(x):
        acc = (42 + p1 + p2 + x * p2) & word
        return ((acc << 31 | acc >> 33) * p1) & word

    pack = lambda *w: b"".join(x.to_bytes(8, "little") for x in w)
    end = pack(1, 0, 0, 0, 7, 0, 0, 0)
    twin = pack(2, 0, 0, 0, (7 + (mixed(1) - mixed(2)) * pow(p2, -1, 1 << 64)) & word, 0, 0, 0)
    half = spark.createDataFrame([(i, end if i % 2 else twin) for i in range(12)], "src long, dst binary")
    assert end != twin and half.select(F.xxhash64("dst")).distinct().count() == 1 and M.few(half)
    assert rows(M.mirrored_degree(half)) == [(i, 6) for i in range(12)]
    assert rows(M.mirrored(half)) == [(a, b) for a in range(12) for b in range(12) if a % 2 == b % 2]


def test_pairs_hashed_an_array_at_a_time(spark, monkeypatch):
    """Hashes of many pairs at once are those of each pair, with numbers of any length; no pair is listed for a hash of its own."""
    xs, ys = [0, 7, 12, 123456, -5, 1 << 62], [0, 9, 10, -8, 654321, 7, -(1 << 63)]
    want = sorted((x, y, int(hashlib.md5(f"42:{x}-{y}".encode()).hexdigest()[:8], 16)) for x in xs for y in ys if x != y)
    one = spark.createDataFrame([(xs, ys, 1 << 32), (xs, ys, 1 << 31), (xs, [], 1 << 32)], "xs array<long>, ys array<long>, limit long")
    low = sorted(want + [w for w in want if w[2] < 1 << 31])
    named = one.select(*(F.col(c).cast("array<string>").alias(c) for c in ("xs", "ys")), "limit")
    assert rows(S.low_pairs(named, 42).selectExpr("cast(src as long) src", "cast(dst as long) dst", "h")) == low
    monkeypatch.setattr(M, "spread", None)
    for hashed in (1, 8, 1 << 14):
        monkeypatch.setattr(S, "HASHED", hashed)
        assert rows(S.low_pairs(one, 42)) == low


def test_peer_arrays(spark):
    """Degrees and h-indexes from arrays of members, also where a node takes them in several shares and numbers need 64 bits."""
    rnd = random.Random(3)
    for shift in (0, 1 << 40):
        edges = sorted({(shift + rnd.randrange(40), rnd.randrange(3) if rnd.random() < 0.1 else rnd.randrange(60)) for _ in range(150)})
        half, want = half_of(spark, edges), peers_of(edges)
        assert not M.few(half)
        for met in (8, 1 << 20):
            sets = M.peer_sets(half, 4, met=met).collect()
            assert sorted((r["node"], p) for r in sets for p in r["peers"]) == want
            assert (max(r["of"] for r in sets) > 1) == (met == 8)
        graph = M.mirrored(half)
        d = M.mirrored_degree(half)
        assert rows(d) == rows(degree(graph))
        plain = rows(H.h_index(graph))
        assert rows(H.mirrored_h_index(half, d)) == plain == rows(H.mirrored_h_index(half, d, met=8))


def test_bounded_step(spark):
    """Slots that cannot be kept stay behind; keys, own slots and excluded ones as in the plain step."""
    rnd = random.Random(4)
    hop = half_of(spark, sorted({(rnd.randrange(30), 100 + rnd.randrange(12)) for _ in range(150)} | {(40, 200)}))
    sketch = spark.createDataFrame([(r, n, h) for r in range(2) for n in [*range(30), 40] for h in rnd.sample(range(500), 8)], "rep int, node long, h long")
    assert rows(K.bounded_step(sketch, hop, 8)) == rows(K.step(sketch, hop, 8))
    one = sketch.where("rep = 0").select("node", "h")
    own = spark.createDataFrame([(100 + i, i) for i in range(12)], "node long, h long")
    gone = K.step(one, hop, 8).where("h % 3 = 0")
    assert rows(K.bounded_step(one, hop, 8, own)) == rows(K.step(one, hop, 8, own))
    assert rows(K.bounded_step(one, hop, 8, None, gone)) == rows(K.step(one, hop, 8, None, gone))


def test_negatives_from_the_beginning_of_the_hash_order(spark):
    """Half paths instead of graphs; with one try in the first round, most sources take further rounds, and one has no negative at all."""
    rng = random.Random(4)
    far = [(i, i % 2) for i in range(40)]
    near = sorted({(i, rng.randrange(12)) for i in range(40) for _ in range(2)} | {(0, m) for m in range(12)})
    close = set(peers_of(near))
    want = []
    for a, b in itertools.groupby(peers_of(far), lambda e: e[0]):
        free = [y for x, y in b if x != y and (x, y) not in close]
        want += [(a, y) for y in sorted(free, key=lambda y, a=a: (hashlib.md5(f"42:{a}-{y}".encode()).hexdigest()[:8], y))[:3]]
    for tries in (1, 12, 100):
        assert rows(S.two_hop_negatives(half_of(spark, far), half_of(spark, near), 3, tries=tries)) == sorted(want)
    assert 0 not in {a for a, _ in want} and S.two_hop_negatives(half_of(spark, []), half_of(spark, near), 3).count() == 0


def test_nested_sketches_move_as_one(spark, monkeypatch):
    """Counts of all levels from one sketch equal those of a sketch a level, also at crowded nodes; a slot travels once for all its levels."""
    rnd = random.Random(6)
    edges = half_of(spark, sorted({(rnd.randrange(60), 100 + rnd.randrange(9)) for _ in range(260)} | {(70, 200)}))
    s, path = M.GraphSchema({"r": edges}), M.MetaPath.parse("r,rev_r")
    start = spark.createDataFrame([(n, rnd.randrange(1 << 60), rnd.randrange(1, 5)) for n in [*range(60), 70]], "node long, h long, level int")
    some = spark.createDataFrame([(n,) for n in range(0, 60, 2)], "node long")
    for crowd in (1 << 16, 3):
        monkeypatch.setattr(K, "CROWD", crowd)
        for k in (2, 8, 100):
            plain = {i: rows(K.estimate(K.propagate(s, path, start.where(F.col("level") >= i).select("node", "h"), k), k)) for i in range(1, 5)}
            assert rows(K.levelled_counts(s, path, start, 4, k)) == [(i, n, c) for i in plain for n, c in plain[i]]
            kept = [(i, n, c) for i in plain for n, c in plain[i] if n < 60 and n % 2 == 0]
            assert rows(K.levelled_counts(s, path, start, 4, k, some)) == kept
    moved = K.levelled(start.select(F.lit(1).alias("node"), "h", "level"), 8, 4)
    assert 8 <= moved.count() < 4 * 8


def test_graphs_from_arrays_of_members(spark, monkeypatch):
    """Pairs that share many middle nodes are not made once per middle node."""
    half = half_of(spark, [(i, m) for i in range(24) for m in range(40) if (i * m) % 7 < 5])
    monkeypatch.setattr(M, "paired", None)
    edges = sorted({(i, m) for i in range(24) for m in range(40) if (i * m) % 7 < 5})
    monkeypatch.setattr(M, "few", lambda half: False)
    got = M.mirrored(half)
    assert rows(got) == peers_of(edges) and got.dtypes == [("src", "bigint"), ("dst", "bigint")]


def test_composed_size(spark, monkeypatch):
    """Pairs over middle nodes are counted, also where ends are null and nodes meet many, without being listed."""
    rnd = random.Random(9)
    left = {(rnd.randrange(30), rnd.randrange(12)) for _ in range(90)} | {(None, 3), (7, None)}
    right = {(rnd.randrange(12), rnd.randrange(50)) for _ in range(150)} | {(3, None), (4, None), (None, 8)}
    want = len({(a, d) for a, b in left for c, d in right if b == c and b is not None})
    monkeypatch.setattr(M, "composed", None)
    a, b = half_of(spark, sorted(left, key=repr)), half_of(spark, sorted(right, key=repr))
    for share, met in ((1024, 1 << 20), (2, 16)):
        assert rows(M.composed_size(a, b, share, met)) == [(want,)]
    assert rows(M.composed_size(a.where("false"), b)) == [(0,)]


def test_written_edges_stay(spark, monkeypatch):
    """A graph that is a file already is not shuffled and written a second time to draw non-neighbours."""
    nodes = spark.range(8).select(F.col("id").alias("node"))
    edges = [(a, b) for a in range(8) for b in range(8) if (a + b) % 3]
    graph, names = M.written(half_of(spark, edges + edges), "graph"), []
    monkeypatch.setattr(S, "written", lambda df, name: names.append(name) or M.written(df, name))
    got = rows(S.rejection_negatives(nodes, nodes, graph, 2))
    assert "edges" not in names and not set(got) & set(edges) and all(a != b for a, b in got)
    free = {a: sum((a, b) not in edges and a != b for b in range(8)) for a in range(8)}
    assert len(set(got)) == len(got) == sum(min(2, n) for n in free.values())


def test_pairs_with_common_items(spark):
    """Similarities, exact and estimated, from arrays of members in few and many parts, and of nodes that meet many."""
    rng = random.Random(8)
    edges = sorted({(rng.randrange(40), int(rng.random() ** 3 * 60)) for _ in range(500)})
    hash_of = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16)
    items = spark.createDataFrame([(n, i, hash_of(i)) for n, i in edges], "node long, item long, h long")
    of = {n: {i for m, i in edges if m == n} for n in {n for n, _ in edges}}
    want = {(a, b): len(of[a] & of[b]) / len(of[a] | of[b]) for a, b in itertools.combinations(sorted(of), 2) if of[a] & of[b]}
    low = {k: {n: set(sorted(map(hash_of, s))[:k]) for n, s in of.items()} for k in (6, 70)}
    for share, met in ((1024, 1 << 20), (3, 50)):
        got = SIM.jaccard(items.select("node", "item"), share=share, met=met)
        assert dict(((a, b), j) for a, b, j in rows(got)) == want
        for k, sketch in low.items():
            est = {}
            for a, b in itertools.combinations(sorted(of), 2):
                merged = set(sorted(sketch[a] | sketch[b])[:k])
                if sketch[a] & sketch[b]:
                    est[a, b] = len(merged & sketch[a] & sketch[b]) / len(merged)
            slots = spark.createDataFrame([(n, h) for n, s in sketch.items() for h in s], "node long, h long")
            assert dict(((a, b), j) for a, b, j in rows(SIM.coordinated(slots, k))) == est
            e = SIM.coordinated_errors(items, k, share, met).first()
            off = [est.get(p, 0.0) - j for p, j in want.items()]
            assert e["pairs"] == len(off) and abs(e["bias"] - sum(off) / len(off)) < 1e-12
            assert abs(e["mae"] - sum(map(abs, off)) / len(off)) < 1e-12 and abs(e["worst"] - max(map(abs, off))) < 1e-12


def test_pairs_are_shuffled_as_arrays(spark):
    """What meets by a common item is grouped without a shuffle of pairs."""
    items = spark.createDataFrame([(n, i) for n in range(20) for i in range(n % 5 + 1)], "node long, item long")
    o = SIM.meetings(items).groupBy("bucket", "a", "b").count()
    plan = o._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(a") == 1


def test_layers_that_lead_back_at_once(spark):
    """Where every middle node has one source, a layer's sketches go back along the whole half path; elsewhere step by step. The sketches are the same."""
    rng = random.Random(5)
    first = [(m % 15, 100 + m) for m in range(60)]
    second = sorted({(100 + rng.randrange(60), 200 + rng.randrange(12)) for _ in range(240)})
    third = sorted({(200 + rng.randrange(12), 300 + rng.randrange(4)) for _ in range(30)})
    edges = lambda e: spark.createDataFrame(e, "src long, dst long")
    start = K.universe(spark.createDataFrame([(n,) for n in range(15)], "node long"))
    hash_of = {r["node"]: r["h"] for r in start.collect()}
    for more, at_once in (([], {2, 3}), ([(3, 100)], set())):
        relations = {"a": edges(first + more), "b": edges(second), "c": edges(third)}
        path = M.MetaPath.parse("a,b,c")
        schema = M.GraphSchema(relations)
        assert set(K.halves(schema.hops(path))) - {3} == at_once - {3}
        reach, want = {n: {n} for n in range(15)}, []
        for layer, hop in enumerate((first + more, second, third), 1):
            reach = {n: {d for s, d in hop if s in at} for n, at in reach.items()}
            for n in range(15):
                peers = {m for m in range(15) if reach[n] & reach[m]}
                want += [(layer, n, h) for h in sorted(hash_of[m] for m in peers)[:4]]
        got = K.association_by_layer(schema, path, start, 4).select("layer", "node", "h")
        assert rows(got) == sorted(want)
