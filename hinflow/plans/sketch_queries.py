"""Queries over sketches, walks, hub estimates and similarity."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import DIGITS, RANGE, keyed
from ..operators import edges as E
from ..operators import hubs as H
from ..operators import similarity as S
from ..operators import sketch as K
from ..operators import sketch_hubs as SH
from ..operators import walks as R_
from ..sources.fixtures import with_relations as R
from . import metapath as M
from .graph_queries import CUT, DEG, H2, SHARE, degrees, nodes, schema, two_hop
from .registry import query
from .scratch import scratch, written

PATH = "cust_part,rev_cust_part"


def hx(*parts: str, digits: int = 8) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(f"({p})::varchar" for p in parts) + f"), 1, {digits}))::bigint"


def ident(*parts: str) -> str:
    return hx(*parts, digits=DIGITS)


U = f"u as (select c_custkey as node, {ident('42', 'c_custkey')} as h from customer)"


def bk(rel: str, k: int) -> str:
    return f"(select node, h from (select node, h, row_number() over (partition by node order by h) as r from (select distinct node, h from {rel})) where r <= {k})"


def sk(k: int, tag: str = "") -> str:
    """Two-hop sketch sk(node, h) of customers over parts, over the universe u."""
    start = f"{U}, " if not tag else ""
    return f"{start}s1{tag} as {bk('(select c.dst as node, h from cust_part c join u on u.node = c.src)', k)}, sk{tag} as {bk(f'(select c.src as node, h from cust_part c join s1{tag} s1 on s1.node = c.dst)', k)}"


def est(k: int, of: str = "sk") -> str:
    return f"est as (select node, case when count(*) < {k} then count(*)::double else {(k - 1) * RANGE:.1f}::double / greatest(max(h), 1) end as score from {of} group by node)"


def customers(t):
    return nodes(t, "customer", "c_custkey")


def two_hop_sketch(t, k, seed=42, graph=None):
    return K.propagate(graph or schema(t, "cust_part"), M.MetaPath.parse(PATH), K.universe(customers(t), seed), k)


def estimates(t, k=32, graph=None):
    """One row a node, written, since thresholds, ranks and scores all read it."""
    return written(K.estimate(two_hop_sketch(t, k, graph=graph), k).withColumnRenamed("degree", "score"), "estimates")


# --- sketches -----------------------------------------------------------------


@query("hash_universe", f"with {U} select node, h from u")
def hash_universe(t):
    return K.universe(customers(t))


@query("kmv_step", R("cust_part", f", {U} select node, h from {bk('(select c.dst as node, h from cust_part c join u on u.node = c.src)', 8)}"))
def kmv_step(t):
    return K.step(K.universe(customers(t)), t.rel("cust_part"), 8)


@query("kmv_propagate_2hop", R("cust_part", f", {sk(8)} select node, h from sk"))
def kmv_propagate_2hop(t):
    return two_hop_sketch(t, 8)


ASSOC = R("cust_order order_part", f""", {U}, p1 as {bk('(select c.dst as node, h from cust_order c join u on u.node = c.src)', 8)},
    p2 as {bk('(select c.dst as node, h from order_part c join p1 on p1.node = c.src)', 8)}, b1 as {bk('(select c.src as node, h from order_part c join p2 on p2.node = c.dst)', 8)}
    select node, h from {bk('(select c.src as node, h from cust_order c join b1 on b1.node = c.dst)', 8)}""")


@query("kmv_propagate_4hop", ASSOC)
def kmv_propagate_4hop(t):
    s = schema(t, "cust_order", "order_part")
    return K.propagate(s, M.MetaPath.parse("cust_order,order_part").mirrored(), K.universe(customers(t)), 8)


@query("stream_sketch_layers", R("cust_part", f", {sk(8)} select node, h from sk"))
def stream_sketch_layers(t):
    """The two-hop sketch after three batches of growing size, by change only; the log is compacted on the way."""
    from ..streaming.sketch_stream import LayeredSketch

    s = LayeredSketch(t.spark, scratch(t.spark, "stream"), M.MetaPath.parse(PATH), 8, compact=2)
    e = written(t.rel("cust_part").select(F.lit("cust_part").alias("relation"), "src", "dst").withColumn("at", keyed(9, F.col("src"), F.col("dst")) % 100), "edges")
    for i, (lo, hi) in enumerate(((0, 80), (80, 99), (99, 100))):
        s.merge(e.where((F.col("at") >= lo) & (F.col("at") < hi)).select("relation", "src", "dst"), i)
    return s.sketch()


@query("kmv_propagate_accumulating", R("cust_part", f", {U}, s1 as {bk('(select c.dst as node, h from cust_part c join u on u.node = c.src)', 8)} select node, h from {bk('(select c.src as node, h from cust_part c join s1 on s1.node = c.dst union all select node, h from u)', 8)}"))
def kmv_propagate_accumulating(t):
    return K.propagate_accumulating(schema(t, "cust_part"), M.MetaPath.parse(PATH), ["c", "p", "c"], K.universe(customers(t)), 8)


@query("exact_bottomk", R("cust_part", f", {H2}, {U} select node, h from {bk('(select g.src as node, u.h from h g join u on u.node = g.dst)', 8)}"))
def exact_bottomk(t):
    return K.exact_bottom_k(two_hop(t), K.universe(customers(t)), 8)


@query("kmv_association_sketch", ASSOC)
def kmv_association_sketch(t):
    return K.association(schema(t, "cust_order", "order_part"), M.MetaPath.parse("cust_order,order_part"), 2, K.universe(customers(t)), 8)


@query("kmv_degree_estimate", R("cust_part", f", {sk(8)}, {est(8)} select node, score as degree from est"))
def kmv_degree_estimate(t):
    return K.estimate(two_hop_sketch(t, 8), 8)


UL = f"ul as (select rep, c_custkey as node, {ident('42', 'rep', 'c_custkey')} as h from customer, (select unnest(range(4)) as rep))"


def bkl(rel, k):
    return f"(select rep, node, h from (select rep, node, h, row_number() over (partition by rep, node order by h) as r from (select distinct rep, node, h from {rel})) where r <= {k})"


@query("kmv_degree_estimate_L", R("cust_part", f""", {UL}, s1 as {bkl('(select rep, c.dst as node, h from cust_part c join ul on ul.node = c.src)', 8)}, s2 as {bkl('(select rep, c.src as node, h from cust_part c join s1 on s1.node = c.dst)', 8)}
    select node, round(avg(e), 6) as degree from (select rep, node, case when count(*) < 8 then count(*)::double else {7 * RANGE:.1f}::double / greatest(max(h), 1) end as e from s2 group by rep, node) group by node"""))
def kmv_degree_estimate_l(t):
    s = K.propagate(schema(t, "cust_part"), M.MetaPath.parse(PATH), K.repeated_starts(customers(t), 4), 8)
    return K.estimate(s, 8).select("node", F.round("degree", 6).alias("degree"))


@query("sketch_decode", R("cust_part", f", {sk(8)} select sk.node as src, u.node as dst from sk join u using (h)"))
def sketch_decode(t):
    return K.decode(two_hop_sketch(t, 8), K.universe(customers(t)))


SPARSE = f"d as (select sk.node as src, u.node as dst from sk join u using (h)), sp as (select src, dst from d where src <> dst union select dst, src from d where src <> dst union select c_custkey, c_custkey from customer)"


@query("kmv_sparsified_edges", R("cust_part", f", {sk(8)}, {SPARSE} select src, dst from sp"))
def kmv_sparsified_edges(t):
    d = E.without_loops(K.decode(two_hop_sketch(t, 8), K.universe(customers(t))))
    return E.with_loops(E.symmetrized(d), customers(t))


def multi(t):
    u = K.universe(customers(t))
    out = {}
    for name in ("cust_part", "cust_nation"):
        s = K.propagate(schema(t, name), M.MetaPath.parse(name).mirrored(), u, 8)
        out[name] = s
    return u, out


MULTI = R("cust_part cust_nation", f""", {sk(8)}, n1 as {bk('(select c.dst as node, h from cust_nation c join u on u.node = c.src)', 8)}, n2 as {bk('(select c.src as node, h from cust_nation c join n1 on n1.node = c.dst)', 8)}""")


@query("kmv_multi_metapath", MULTI + " select 'cust_part' as path, node, h from sk union all select 'cust_nation', node, h from n2")
def kmv_multi_metapath(t):
    _, s = multi(t)
    parts = [x.select(F.lit(n).alias("path"), "node", "h") for n, x in s.items()]
    return parts[0].union(parts[1])


@query("sparsifier_union", MULTI + """, d as (select s.node as src, u.node as dst from (select * from sk union all select * from n2) s join u using (h))
    select src, dst from d where src <> dst union select c_custkey, c_custkey from customer""")
def sparsifier_union(t):
    u, s = multi(t)
    parts = [K.decode(x, u) for x in s.values()]
    return E.with_loops(E.without_loops(parts[0].union(parts[1])), customers(t))


@query("sketch_fill_rate", R("cust_part", f", {sk(32)} select node, count(*) / 32e0 as fill from sk group by node"))
def sketch_fill_rate(t):
    return K.fill_rate(two_hop_sketch(t, 32), 32)


@query("kmv_leak_rate", R("cust_part", f", {H2}, {sk(8)}, d as (select sk.node as src, u.node as dst from sk join u using (h)) select count(*) as slots, count(*) filter (where h.src is null) as leaked from d left join h on h.src = d.src and h.dst = d.dst"))
def kmv_leak_rate(t):
    d = K.decode(two_hop_sketch(t, 8), K.universe(customers(t)))
    g = two_hop(t).withColumn("real", F.lit(1))
    return d.join(g, ["src", "dst"], "left").agg(F.count(F.lit(1)).alias("slots"), F.count(F.when(F.col("real").isNull(), 1)).alias("leaked"))


@query("kmv_nested_k", R("cust_part", f", {sk(8)}, {sk(4, '4')}, l4 as {bk('sk', 4)} select a.node, count(*) as slots, count(b.h) as nested from sk4 a left join l4 b on a.node = b.node and a.h = b.h group by a.node"))
def kmv_nested_k(t):
    small = two_hop_sketch(t, 4)
    large = K.bottom_k(two_hop_sketch(t, 8), 4).withColumn("in_large", F.lit(1))
    return small.join(large, ["node", "h"], "left").groupBy("node").agg(F.count(F.lit(1)).alias("slots"), F.count("in_large").alias("nested"))


@query("kmv_structural_equality", R("cust_part", f", {H2}, {sk(8)}, x as {bk('(select g.src as node, u.h from h g join u on u.node = g.dst)', 8)} select count(*) as slots, count(x.h) as equal from sk full join x on x.node = sk.node and x.h = sk.h"))
def kmv_structural_equality(t):
    a, b = two_hop_sketch(t, 8), K.exact_bottom_k(two_hop(t), K.universe(customers(t)), 8).withColumn("there", F.lit(1))
    return a.join(b, ["node", "h"], "full").agg(F.count(F.lit(1)).alias("slots"), F.count("there").alias("equal"))


@query("lag_dedup", R("cust_part", f", {U} select distinct c.dst as node, u.h from cust_part c join u on u.node = c.src"))
def lag_dedup(t):
    """Distinct by comparing with the row before in sorted order."""
    e = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_partkey").alias("node"), keyed(42, F.col("o_custkey"), digits=DIGITS).alias("h"))
    before = F.lag("h").over(W.partitionBy("node").orderBy("h"))
    return e.withColumn("before", before).where("before is null or before <> h").select("node", "h")


@query("saturation_k", R("cust_part", f""", {H2}, d as (select src, count(*) as d from h group by src), k as (select unnest([4, 8, 16, 32, 64, 128, 256, 512, 1024]) as k),
    e as (select k, sum(least(d, k))::bigint as edges from d, k group by k), g as (select k, edges, lead(edges) over (order by k) as nxt from e) select min(k)::int as k from g where (nxt - edges) / edges::double < 0.02"""))
def saturation_k(t):
    d = M.mirrored_degree(t.rel("cust_part")).withColumn("k", F.explode(F.array(*(F.lit(k) for k in (4, 8, 16, 32, 64, 128, 256, 512, 1024)))))
    e = d.groupBy("k").agg(F.sum(F.least(F.col("degree"), F.col("k"))).alias("edges"))
    e = e.withColumn("next", F.lead("edges").over(W.orderBy("k")))
    return e.where((F.col("next") - F.col("edges")) / F.col("edges").cast("double") < 0.02).agg(F.min("k").alias("k"))


# --- hub estimates ---------------------------------------------------------------

EST = R("cust_part", f", {DEG}, {sk(32)}, {est(32)}, {CUT.format('deg', SHARE)}, top as (select node, score from (select node, score, row_number() over (order by score desc, node) as rn, count(*) over () as n from est) where rn <= floor({SHARE} * n) + 1)")
SETS = ", inc as (select node from deg, cut where score >= cut), str as (select node from deg, cut where score > cut)"


def top_estimates(t):
    return H.top_share(estimates(t), SHARE)


@query("hub_topk_sketch", EST + " select node, score from top")
def hub_topk_sketch(t):
    return top_estimates(t)


@query("hub_glo_degree", EST + " select top.node, top.score as estimate, deg.score as degree from top join deg using (node)")
def hub_glo_degree(t):
    return top_estimates(t).withColumnRenamed("score", "estimate").join(degrees(t).withColumnRenamed("score", "degree"), "node").select("node", "estimate", "degree")


F1 = """, c as (select (select count(*) from top) as np, (select count(*) from top join inc using (node)) as tp, (select count(*) from str) as ns, (select count(*) from top join str using (node)) as ts),
    pr as (select case when np > 0 then tp / np::double else 0 end as p, case when ts > 0 then ts / ns::double else 1 end as r from c)
    select p as precision, r as recall, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from pr"""


@query("hub_f1", EST + SETS + F1)
def hub_f1(t):
    return H.f1_at(top_estimates(t), degrees(t), SHARE)


SEEDS, LK = 5, 16


def by_layer_sql() -> str:
    """est(layer, rep, node, score) over customers, orders and parts, dx(layer, node, score) with the true degrees."""
    rb = lambda rel: f"(select rep, node, h from (select rep, node, h, row_number() over (partition by rep, node order by h) as r from (select distinct rep, node, h from {rel})) where r <= {LK})"
    ul = UL.replace("range(4)", f"range({SEEDS})")
    up = lambda rel, hop: rb(f"(select rep, c.dst as node, h from {hop} c join {rel} x on x.node = c.src)")
    down = lambda rel, hop: rb(f"(select rep, c.src as node, h from {hop} c join {rel} x on x.node = c.dst)")
    size = lambda layer, rel: f"select {layer} as layer, rep, node, case when count(*) < {LK} then count(*)::double else {(LK - 1) * RANGE:.1f}::double / greatest(max(h), 1) end as score from {rel} group by rep, node"
    pairs = lambda layer, rel: f"select {layer} as layer, src as node, count(*) as score from (select distinct a.src, b.src as dst from {rel} a join {rel} b on a.dst = b.dst) group by src"
    return f"""{ul}, a1 as {up('ul', 'cust_order')}, a2 as {up('a1', 'order_part')}, b2 as {down(down('a2', 'order_part'), 'cust_order')}, b1 as {down('a1', 'cust_order')}, est as ({size(1, 'b1')} union all {size(2, 'b2')}),
    cp as (select distinct a.src, b.dst from cust_order a join order_part b on a.dst = b.src), dx as ({pairs(1, 'cust_order')} union all {pairs(2, 'cp')})"""


QUALITY = f"""{by_layer_sql()}, top as (select layer, rep, node from (select *, row_number() over (partition by layer, rep order by score desc, node) as rn, count(*) over (partition by layer, rep) as n from est) where rn <= floor({SHARE} * n) + 1),
    cut as (select layer, score as cut from (select layer, score, row_number() over (partition by layer order by score desc) as rn, count(*) over (partition by layer) as n from dx) where rn = floor({SHARE} * n) + 1),
    al as (select g.layer, g.rep, dx.score as x, cut, top.node is not null as p from (select distinct layer, rep from est) g join dx using (layer) join cut using (layer) left join top on top.layer = g.layer and top.rep = g.rep and top.node = dx.node),
    c as (select layer, rep, count(*) filter (where p) as np, count(*) filter (where p and x >= cut) as tp, count(*) filter (where x > cut) as ns, count(*) filter (where p and x > cut) as ts,
        coalesce(max(case when cut >= 1 and ((p and x < cut) or (not p and x > cut)) then abs(x - cut) / cut::double end), 0) as epsilon from al group by 1, 2),
    pr as (select layer, rep, case when np > 0 then tp / np::double else 0 end as p, case when ts > 0 then ts / ns::double else 1 end as r, epsilon from c)"""


@query("hub_quality_by_layer", R("cust_order order_part", f", {QUALITY} select coalesce(layer, 0)::int as layer, count(*) as runs, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0 end), 6) as f1, round(avg(epsilon), 6) as epsilon from pr group by rollup (layer)"))
def hub_quality_by_layer(t):
    """Quality of sketched hubs of customers by orders (layer 1) and parts (layer 2), the mean over five hash functions and, as layer 0, over both layers."""
    s, path = schema(t, "cust_order", "order_part"), M.MetaPath.parse("cust_order,order_part")
    sketch = K.association_by_layer(s, path, K.repeated_starts(customers(t), SEEDS), LK)
    est = written(K.estimates_by(sketch, LK, ("layer", "rep", "node")).withColumnRenamed("degree", "score"), "estimates")
    exact = [M.association_degree(s, path, i).select(F.lit(i).alias("layer"), "node", F.col("degree").alias("score")) for i in (1, 2)]
    q = H.quality_by(est, written(exact[0].union(exact[1]), "exact"), SHARE, ("layer", "rep"), ("layer",))
    return q.rollup("layer").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("epsilon"), 6).alias("epsilon")).fillna(0, ["layer"])


@query("hub_epsilon", EST + """ select coalesce(max(case when cut >= 1 and ((top.node is not null and deg.score < cut) or (top.node is null and deg.score > cut)) then abs(deg.score - cut) / cut::double end), 0) as epsilon
    from deg left join top using (node), cut""")
def hub_epsilon(t):
    return H.epsilon(top_estimates(t), degrees(t), SHARE)


def asked(t):
    """Query nodes: the ten customers with the smallest hashes."""
    return customers(t).orderBy(keyed(7, F.col("node")), "node").limit(10)


ASK = f", q as (select c_custkey as node from customer order by {hx('7', 'c_custkey')}, c_custkey limit 10)"


@query("per_degree", EST + ASK + f" select q.node, (select count(*) from est x where x.score > e.score) + 1 <= floor({SHARE} * (select count(*) from est)) as is_hub from q join est e using (node)")
def per_degree(t):
    return H.personal(estimates(t), asked(t), SHARE)


BETA = 0.1
CLIQUE = ", mc as (select max(e) as size from (select case when count(*) < 32 then count(*)::double else " + f"{31 * RANGE:.1f}::double" + " / greatest(max(h), 1) end as e from s1 group by node)), n as (select count(*) as n from est)"


def clique(t, k=32):
    """One row: the largest estimated number of customers around one part."""
    mids = K.step(K.universe(customers(t)), t.rel("cust_part"), k)
    return K.estimate(mids, k).agg(F.max("degree").alias("size"))


def asked_degrees(t):
    """(node, exact): true degrees of the query nodes, whose peers alone are expanded."""
    peers = M.peers_of(schema(t, "cust_part"), M.MetaPath.parse("cust_part"), 1, asked(t))
    return peers.groupBy("node").agg(F.count(F.lit(1)).alias("exact"))


@query("per_degree_pruned", EST + ASK + CLIQUE + f""" select q.node, case when size >= deg.score * (1 + {BETA}e0) and size > {SHARE} * n * (1 + {BETA}e0) then false
    else (select count(*) from est x where x.score > e.score) + 1 <= floor({SHARE} * n) end as is_hub from q join est e using (node) join deg using (node), mc, n""")
def per_degree_pruned(t):
    return H.personal_pruned(estimates(t), asked_degrees(t), clique(t), SHARE, BETA)


@query("per_accuracy", EST + SETS + ASK + f""", a as (select q.node, (select count(*) from est x where x.score > e.score) + 1 <= floor({SHARE} * (select count(*) from est)) as hub from q join est e using (node))
    select avg((case when hub then node in (select node from inc) else node not in (select node from str) end)::int) as accuracy from a""")
def per_accuracy(t):
    d = degrees(t)
    return H.accuracy(H.personal(estimates(t), asked(t), SHARE), H.hubs(d, SHARE, False), H.hubs(d, SHARE, True))


@query("hub_rank_ratio", EST + ASK + " select q.node, (select count(*) from est x where x.score >= e.score) / (select count(*) from est)::double as ratio from q join est e using (node)")
def hub_rank_ratio(t):
    return H.rank_of(estimates(t), asked(t)).select("node", (F.col("at_least") / F.col("n").cast("double")).alias("ratio"))


def restricted(pivots: str, k: int = 32) -> str:
    """rc(piv, node, count): two-hop sketches from customers with an estimate of at least ``pivot``, for each row of ``pivots``."""
    rb = lambda rel: f"(select piv, node, h from (select piv, node, h, row_number() over (partition by piv, node order by h) as r from (select distinct piv, node, h from {rel})) where r <= {k})"
    first = rb(f"(select piv, c.dst as node, u.h from {pivots} join est on est.score >= piv join u on u.node = est.node join cust_part c on c.src = u.node)")
    second = rb(f"(select piv, c.src as node, h from cust_part c join {first} x on x.node = c.dst)")
    return f"(select piv, node, case when count(*) < {k} then count(*)::double else {(k - 1) * RANGE:.1f}::double / greatest(max(h), 1) end as count from {second} group by 1, 2)"


BISECT = (EST + f""", lim as (select floor({SHARE} * count(*)) + 1 as room from est), {CUT.format('est', SHARE).replace('cut as', 'top_cut as')},
    rounds(lo, hi) as (select 0::bigint, floor(cut)::bigint from top_cut union all select case when c >= room then mid else lo end, case when c >= room then hi else mid - 1 end
        from (select lo, hi, (lo + hi + 1) // 2 as mid, room, (select count(*) from {restricted('(select (lo + hi + 1) // 2 as piv from rounds where lo < hi)')} where count >= piv) as c from rounds, lim where lo < hi)),
    last as (select max(lo) as cut from rounds) select node, (select cut from last) as cut from {restricted('(select cut as piv from last)')} where count >= piv""").replace("with ", "with recursive ", 1)


@query("hub_glo_hindex", BISECT)
def hub_glo_hindex(t):
    """Hubs by h-index; sketches only. The SQL halves the interval of the cut, the operator tries several values a round; the cut is the same."""
    path = M.MetaPath.parse(PATH)
    s = M.stored(schema(t, "cust_part"), path)
    return SH.h_hubs(s, path, K.universe(customers(t)), estimates(t, graph=s), SHARE, 32)


PERH = EST + ASK + f""", hp as (select distinct a.src as q, b.src as peer from cust_part a join cust_part b on a.dst = b.dst where a.src in (select node from q)),
    hn as (select q, score, row_number() over (partition by q order by score desc, peer) as rn from hp join est on est.node = peer), hq as (select q, max(least(rn, floor(score)::bigint)) as h from hn group by q),
    rc as (select * from {restricted('(select distinct h as piv from hq)')}), own as (select hq.q, hq.h, coalesce(rc.count, 0) as own from hq left join rc on rc.piv = hq.h and rc.node = hq.q),
    perh as (select q as node, h, (select count(*) from rc where piv = own.h and rc.node <> own.q and rc.count >= own.own) + 1 <= floor({SHARE} * (select count(*) from est)) as is_hub from own)"""


@query("per_hindex", PERH + " select node, h, is_hub from perh")
def per_hindex(t):
    path = M.MetaPath.parse(PATH)
    s = M.stored(schema(t, "cust_part"), path)
    return SH.personal_h(s, path, K.universe(customers(t)), estimates(t, graph=s), asked(t), SHARE, 32)


@query("per_hindex_pruned", PERH + CLIQUE + f""" select perh.node, case when size >= deg.score * (1 + {BETA}e0) and size > {SHARE} * n * (1 + {BETA}e0) then false
    when size >= h and size >= floor({SHARE} * n) then false else is_hub end as is_hub from perh join deg using (node), mc, n""")
def per_hindex_pruned(t):
    """As by degree; besides, a clique of at least the node's h-index and the hubs' number rules it out. Sketches start only for the queries that are left."""
    path = M.MetaPath.parse(PATH)
    s = M.stored(schema(t, "cust_part"), path)
    c = written(clique(t), "clique")
    return SH.personal_h_stopped(s, path, K.universe(customers(t)), estimates(t, graph=s), asked_degrees(t), c, asked(t), SHARE, 32, BETA).select("node", "is_hub")


#: Documents over their language: one large clique beside smaller ones, so that the early stop decides queries.
DOCS = f"""with dl as (select distinct doc_id as src, lang as dst from documents where doc_id is not null and lang is not null),
    u as (select doc_id as node, {ident('42', 'doc_id')} as h from documents where doc_id is not null), q as (select node from u order by {hx('7', 'node')}, node limit 10),
    s1 as {bk('(select c.dst as node, h from dl c join u on u.node = c.src)', 32)}, sk as {bk('(select c.src as node, h from dl c join s1 on s1.node = c.dst)', 32)}, {est(32)},
    deg as (select q.node, count(distinct b.src) as score from q join dl a on a.src = q.node join dl b on b.dst = a.dst group by 1){CLIQUE}"""
STOPPED = f"size >= deg.score * (1 + {BETA}e0) and size > {SHARE} * n * (1 + {BETA}e0)"


def by_language(t):
    """Schema, path, universe, written estimates, query nodes with their degrees, and the largest clique of documents over languages."""
    docs = t["documents"].where("doc_id is not null")
    s = M.GraphSchema({"doc_lang": docs.where("lang is not null").select(F.col("doc_id").alias("src"), F.col("lang").alias("dst")).distinct()})
    path, u = M.MetaPath.parse("doc_lang,rev_doc_lang"), K.universe(docs.select(F.col("doc_id").alias("node")))
    e = written(K.estimate(K.propagate(s, path, u, 32), 32).withColumnRenamed("degree", "score"), "estimates")
    queries = docs.select(F.col("doc_id").alias("node")).orderBy(keyed(7, F.col("doc_id")), "doc_id").limit(10)
    own = written(M.peers_of(s, path, 1, queries).groupBy("node").agg(F.count(F.lit(1)).alias("exact")), "degrees")
    largest = written(K.estimate(K.step(u, s.step(path.steps[0]), 32), 32).agg(F.max("degree").alias("size")), "clique")
    return s, path, u, e, own, largest


@query("per_degree_stopped", DOCS + f""" select q.node, deg.score as exact, {STOPPED} as stopped, case when {STOPPED} then false
    else (select count(*) from est x where x.score > e.score) + 1 <= floor({SHARE} * n) end as is_hub from q join est e using (node) join deg using (node), mc, n""")
def per_degree_stopped(t):
    """Which queries the largest clique decides before any ranking, and the answers."""
    _, _, _, e, own, largest = by_language(t)
    return H.personal_stopped(e, own, largest, SHARE, BETA)


DOC_H = "hp" + PERH.partition(", hp")[2].replace("cust_part", "dl")
STOPPED_H = f"(({STOPPED}) or (size >= perh.h and size >= floor({SHARE} * n)))"


@query("per_hindex_stopped", DOCS + f", {DOC_H} select perh.node, {STOPPED_H} as stopped, not {STOPPED_H} and is_hub as is_hub from perh join deg using (node), mc, n")
def per_hindex_stopped(t):
    """The same by h-index; sketches start only for the queries that are left."""
    s, path, u, e, own, largest = by_language(t)
    return SH.personal_h_stopped(s, path, u, e, own, largest, own.select("node"), SHARE, 32, BETA)


@query("cod_sets", EST.replace(f"floor({SHARE}", "floor(0.1") + """ select top.node, top.score as estimate, deg.score >= cut as exact from top join deg using (node), cut""")
def cod_sets(t):
    """The sketch's tenth of the nodes, and whether the exact threshold v_0.1 agrees."""
    top = H.top_share(estimates(t), 0.1).withColumnRenamed("score", "estimate")
    d = degrees(t)
    return top.join(d, "node").crossJoin(F.broadcast(H.threshold(d, 0.1).select("cut"))).select("node", "estimate", (F.col("score") >= F.col("cut")).alias("exact"))


@query("hub_scatter", EST + " select deg.node, deg.score as degree, est.score as estimate from deg join est using (node), cut where deg.score >= cut")
def hub_scatter(t):
    """True hubs with their degrees and what the sketch makes of them."""
    return H.hubs(degrees(t), SHARE, False).withColumnRenamed("score", "degree").join(estimates(t).withColumnRenamed("score", "estimate"), "node").select("node", "degree", "estimate")


@query("kmv_self_excluded", R("cust_part", f", {U}, s1 as {bk('(select c.dst as node, h from cust_part c join u on u.node = c.src)', 8)} select node, h from {bk('(select x.node, x.h from (select c.src as node, h from cust_part c join s1 on s1.node = c.dst) x join u on u.node = x.node where u.h <> x.h)', 8)}"))
def kmv_self_excluded(t):
    return K.propagate(schema(t, "cust_part"), M.MetaPath.parse(PATH), K.universe(customers(t)), 8, exclude_self=True)


@query("decode_one", R("cust_part", f", {sk(8)} select u.node from sk join u using (h) where sk.node = 1"))
def decode_one(t):
    return K.decode_one(two_hop_sketch(t, 8), K.universe(customers(t)), 1)


@query("rule_density_estimate", R("cust_part", f", {sk(32)}, {est(32)} select round(2 * sum(score) / (count(*)::double * (count(*) - 1)), 6) as density, 2 * sum(score) / (count(*)::double * (count(*) - 1)) <= 0.5 as keep from est"))
def rule_density_estimate(t):
    n = F.count(F.lit(1))
    d = estimates(t).agg((2 * F.sum("score") / (n.cast("double") * (n - 1))).alias("d"))
    return d.select(F.round("d", 6).alias("density"), (F.col("d") <= 0.5).alias("keep"))


@query("snapshot_kmv_vs_exact", R("cust_part", f""", o as (select o_custkey as src, l_partkey as dst, row_number() over (order by o_orderdate, o_orderkey, l_linenumber) as r, count(*) over () as n from orders join lineitem on o_orderkey = l_orderkey),
    s as (select distinct f, src, dst from o, (values (0.25e0), (0.5e0), (1e0)) v(f) where r <= greatest(1, floor(f * n))), d as (select f, src, count(distinct dst) as d from s group by 1, 2)
    select f as fraction, sum(d)::bigint as exact, sum(least(d, 8))::bigint as kept from d group by f"""))
def snapshot_kmv_vs_exact(t):
    from ..streaming.snapshots import snapshots

    e = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
    e = e.select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), "o_orderdate", "o_orderkey", "l_linenumber")
    s = snapshots(e, ["o_orderdate", "o_orderkey", "l_linenumber"], (0.25, 0.5, 1.0)).select("fraction", "src", "dst").distinct()
    exact = s.groupBy("fraction").agg(F.count(F.lit(1)).alias("exact"))
    slots = K.bottom_k(s.select("fraction", F.col("src").alias("node"), keyed(42, F.col("dst"), digits=15).alias("h")), 8, ("fraction", "node"))
    return exact.join(slots.groupBy("fraction").agg(F.count(F.lit(1)).alias("kept")), "fraction")


# --- walks -----------------------------------------------------------------------


def ix(rel: str) -> str:
    return (f"ix as (select src, dst, row_number() over (partition by src order by dst) - 1 as i, count(*) over (partition by src) as d from {rel}), "
            f"xi as (select dst as src, src as dst, row_number() over (partition by dst order by src) - 1 as i, count(*) over (partition by dst) as d from {rel})")


def walked(w: int, who: str = "s") -> str:
    a, b = ("s", "s") if who == "s" else ("s", "m")
    return (f"{ix('cust_part')}, w0 as (select c_custkey as s, w from customer, (select unnest(range({w})) as w)), "
            f"w1 as (select s, w, ix.dst as m from w0 join ix on ix.src = s and ix.i = {hx('42', a, 'w', '0')} % ix.d), "
            f"w2 as (select s, w, xi.dst as e from w1 join xi on xi.src = m and xi.i = {hx('42', b, 'w', '1')} % xi.d)")


def ends(t, w, shared=False):
    return R_.walk(schema(t, "cust_part"), M.MetaPath.parse(PATH), customers(t), w, shared=shared)


@query("walk_step", R("cust_part", f", {walked(4)} select s as src, w::int as walk, m as node from w1"))
def walk_step(t):
    return R_.walk(schema(t, "cust_part"), M.MetaPath.parse("cust_part"), customers(t), 4)


@query("mprw_edges", R("cust_part", f", {walked(4)} select distinct s as src, e as dst from w2 where s <> e"))
def mprw_edges(t):
    return R_.walk_edges(ends(t, 4)).select("src", "dst")


@query("min_visits_filter", R("cust_part", f", {walked(16)} select s as src, e as dst, count(*) as visits from w2 where s <> e group by s, e having count(*) >= 2"))
def min_visits_filter(t):
    return R_.walk_edges(ends(t, 16), 2)


@query("mprw_profile", R("cust_part", f""", {walked(16)}, f as (select s as src, e as dst, min(w)::int as walk from w2 where s <> e group by s, e),
    r as (select *, row_number() over (partition by src order by walk, dst) as r from f) select src, dst, walk from r where r <= 6"""))
def mprw_profile(t):
    return R_.profile(ends(t, 16), customers(t).withColumn("target", F.lit(6)))


@query("walk_budget", R("cust_part", f""", {walked(64)}, f as (select s, e, min(w) as w from w2 where s <> e group by s, e), c as (select w + 1 as w, (sum(count(*)) over (order by w))::bigint as edges from f group by w),
    g as (select 8 * count(*) as target from customer) select min(c.w)::int as walks, false as saturated, min(edges)::bigint as edges from c, g where edges >= target"""))
def walk_budget(t):
    """The fewest walks a source that give eight edges a customer."""
    target = 8 * t["customer"].count()
    walks, saturated, edges = R_.budget(schema(t, "cust_part"), M.MetaPath.parse(PATH), customers(t), target)
    return t.spark.createDataFrame([(walks, saturated, edges)], "walks int, saturated boolean, edges long")


@query("coupon_collector", """with d as (select l_suppkey as trial, l_partkey as v, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) - 1 as o from lineitem), f as (select trial, v, min(o) as pos from d group by 1, 2),
    r as (select pos + 1 as walks, row_number() over (partition by trial order by pos) as k from f) select k::int as k, count(*) as trials, round(avg(walks), 6) as mean, round(stddev_pop(walks), 6) as sd from r where k in (8, 16, 32) group by k""")
def coupon_collector(t):
    """How many of a supplier's lines, in order, it takes until 8, 16 and 32 different parts are met."""
    at = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")) - 1
    s = R_.collected(t["lineitem"].select(F.col("l_suppkey").alias("trial"), at.alias("at"), F.col("l_partkey").alias("value")), (8, 16, 32))
    return s.select("k", "trials", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("random_kernel_edges", R("cust_part", f", {walked(4, 'node')} select distinct s as src, e as dst from w2 where s <> e"))
def random_kernel_edges(t):
    return R_.walk_edges(ends(t, 4, shared=True)).select("src", "dst")


@query("kgrw_edges", R("cust_part", f""", {U}, s1 as {bk('(select c.dst as node, h from cust_part c join u on u.node = c.src)', 4)}, src as (select s1.node as mid, u.node as s from s1 join u using (h)), {ix('cust_part')},
    w as (select distinct p.p_partkey as mid, xi.dst as e from part p, (select unnest(range(2)) as w) v, xi where xi.src = p.p_partkey and xi.i = {hx('42', 'p.p_partkey', 'v.w', '1')} % xi.d),
    pr as (select s, e from src join w using (mid) where s <> e) select s as src, e as dst from pr union select e, s from pr"""))
def kgrw_edges(t):
    s = schema(t, "cust_part")
    u = K.universe(customers(t))
    mids = K.step(u, t.rel("cust_part"), 4)
    back = R_.walk(s, M.MetaPath.parse("rev_cust_part"), nodes(t, "part", "p_partkey"), 2, first_hop=1)
    return R_.hybrid(mids, u, back)


# --- similarity --------------------------------------------------------------------

SAMPLE = f"smp as (select c_custkey as node from customer order by {hx('42', 'c_custkey')}, c_custkey limit 100), it as (select src as node, dst as item from cust_part where src in (select node from smp)), sl as {bk('(select node, ' + ident('42', 'item') + ' as h from it)', 16)}"


def jac(rel: str, key: str) -> str:
    return f"(select a.node as a, b.node as b, count(*) / (any_value(na) + any_value(nb) - count(*))::double as jaccard from {rel} a join {rel} b on a.{key} = b.{key} and a.node < b.node join (select node, count(*) as na from {rel} group by node) x on x.node = a.node join (select node, count(*) as nb from {rel} group by node) y on y.node = b.node group by 1, 2)"


def sample(t):
    return customers(t).orderBy(keyed(42, F.col("node")), "node").limit(100)


def items(t):
    return t.rel("cust_part").join(sample(t).select(F.col("node").alias("src")), "src", "left_semi").toDF("node", "item")


def slots(of):
    return K.bottom_k(of.select("node", keyed(42, F.col("item"), digits=DIGITS).alias("h")), 16)


@query("hash_sample", f"select c_custkey as node from customer order by {hx('42', 'c_custkey')}, c_custkey limit 100")
def hash_sample(t):
    return sample(t)


ALL = f"it as (select src as node, dst as item from cust_part), sl as {bk('(select node, ' + ident('42', 'item') + ' as h from it)', 16)}"


def all_items(t):
    return t.rel("cust_part").toDF("node", "item")


@query("jaccard_exact", R("cust_part", f", {ALL} select * from {jac('it', 'item')}"))
def jaccard_exact(t):
    return S.jaccard(all_items(t))


@query("jaccard_sketch", R("cust_part", f", {ALL} select * from {jac('sl', 'h')}"))
def jaccard_sketch(t):
    return S.jaccard(slots(all_items(t)), "h")


COORD = f"""{ALL}, ls as (select node, list(h order by h) as s from sl group by node), cp as (select distinct a.node as a, b.node as b from sl a join sl b on a.h = b.h and a.node < b.node),
    cm as (select a, b, x.s as sa, y.s as sb, list_sort(list_distinct(list_concat(x.s, y.s)))[1:16] as m from cp join ls x on x.node = a join ls y on y.node = b),
    jc as (select a, b, len(list_filter(m, lambda v: list_contains(sa, v) and list_contains(sb, v))) / len(m)::double as jaccard from cm)"""


@query("jaccard_coordinated", R("cust_part", f", {COORD} select a, b, jaccard from jc"))
def jaccard_coordinated(t):
    return S.coordinated(slots(all_items(t)), 16)


@query("jaccard_estimator_error", R("cust_part", f", {COORD}, je as {jac('it', 'item')}, o as (select coalesce(jc.jaccard, 0) - je.jaccard as o from je left join jc using (a, b)) select count(*) as pairs, round(avg(o), 6) as bias, round(avg(abs(o)), 6) as mae, round(max(abs(o)), 6) as worst from o"))
def jaccard_estimator_error(t):
    """Of all pairs of customers with a part in common."""
    i = all_items(t).withColumn("h", keyed(42, F.col("item"), digits=DIGITS))
    return S.coordinated_errors(i, 16).select("pairs", *(F.round(c, 6).alias(c) for c in ("bias", "mae", "worst")))


def layer_sql(k: int) -> str:
    up = {n: f"up_{n} as (select {c} as node, {ident('42', c)} as h from {n})" for n, c in (("part", "p_partkey"), ("supplier", "s_suppkey"))}
    to_supp = lambda rel: bk(f"(select c.dst as node, h from part_supp c join {rel} x on x.node = c.src)", 16)
    to_part = lambda rel: bk(f"(select c.src as node, h from part_supp c join {rel} x on x.node = c.dst)", 16)
    layers = (to_supp("up_part"), to_supp(to_part("up_supplier")), to_supp(to_part(to_supp("up_part"))))
    size = lambda i, rel: f"select node, {i}e0 as layer, ln(case when count(*) < {k} then count(*)::double else {(k - 1) * RANGE:.1f}::double / greatest(max(h), 1) end) as size from {rel} x group by node"
    return f"{up['part']}, {up['supplier']}, gr as ({' union all '.join(size(i, r) for i, r in enumerate(layers, 1))})"


@query("sketch_growth_slope", R("part_supp", f", {layer_sql(16)} select node, round(regr_slope(size, layer), 6) as slope from gr group by node"))
def sketch_growth_slope(t):
    """From suppliers one, two and three hops over parts: how fast the estimated neighbourhood grows."""
    s, parts, supps = schema(t, "part_supp"), K.universe(nodes(t, "part", "p_partkey")), K.universe(nodes(t, "supplier", "s_suppkey"))
    layers = [K.propagate(s, M.MetaPath.parse(p), u, 16) for p, u in (("part_supp", parts), ("rev_part_supp,part_supp", supps), ("part_supp,rev_part_supp,part_supp", parts))]
    return K.growth(layers, 16).select("node", F.round("slope", 6).alias("slope"))


PAIRS = f"pairs as (select a.node as a, b.node as b from smp a join smp b on a.node < b.node), jx as {jac('it', 'item')}, js as {jac('sl', 'h')}, xy as (select a, b, coalesce(jx.jaccard, 0) as x, coalesce(js.jaccard, 0) as y from pairs left join jx using (a, b) left join js using (a, b))"


@query("sample_pairs_jaccard", R("cust_part", f", {SAMPLE}, {PAIRS} select a, b, x::double as jaccard from xy"))
def sample_pairs_jaccard(t):
    return S.sample_pairs(sample(t)).join(S.jaccard(items(t)), ["a", "b"], "left").select("a", "b", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))


@query("jaccard_fidelity", R("cust_part", f", {SAMPLE}, {PAIRS} select round(avg(abs(x - y)), 6) as mae, round(corr(x, y), 6) as pearson from xy"))
def jaccard_fidelity(t):
    f = S.fidelity(S.sample_pairs(sample(t)), S.jaccard(items(t)), S.jaccard(slots(items(t)), "h"))
    return f.select(F.round("mae", 6).alias("mae"), F.round("pearson", 6).alias("pearson"))


