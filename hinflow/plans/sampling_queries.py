"""Queries over splits, samples, snapshots and table preparation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.hashing import keyed
from ..operators import edges as E
from ..operators import sampling as S
from ..operators import spectral, walks
from ..operators.components import components
from ..operators.spectral import spectral_radius
from ..sources.fixtures import with_relations as R
from ..streaming import snapshots as G
from ..streaming.snapshots import snapshots
from . import metapath as M
from .graph_queries import nodes, schema
from .registry import query
from .scratch import written
from .sketch_queries import hx, ident

C = f"c as (select c_custkey, c_mktsegment, c_nationkey, row_number() over (order by {hx('42', 'c_custkey')}, c_custkey) as r, count(*) over () as n from customer)"


@query("split_60_20_20", f"with {C} select c_custkey, case when r <= floor(n * 0.6e0) then 'train' when r <= floor(n * 0.8e0) then 'val' else 'test' end as split from c")
def split_60_20_20(t):
    return S.split(t["customer"], "c_custkey")


@query("temporal_split", "select o_orderkey, case when row_number() over (order by o_orderdate, o_orderkey) <= greatest(1, floor(0.8e0 * count(*) over ())) then 'train' else 'test' end as split from orders")
def temporal_split(t):
    return S.temporal_split(t["orders"], "o_orderdate", "o_orderkey", 0.8)


@query("stratified_split", f"select c_custkey, c_mktsegment, case when row_number() over (partition by c_mktsegment order by {hx('42', 'c_custkey')}, c_custkey) <= greatest(1, floor(0.7e0 * count(*) over (partition by c_mktsegment))) then 'train' else 'test' end as split from customer")
def stratified_split(t):
    return S.stratified_split(t["customer"], "c_mktsegment", "c_custkey", 0.7)


@query("stratified_subsample", f"""with k as (select c_mktsegment, 100 * count(*) / (select count(*) from customer)::double as exact from customer group by 1),
    b as (select *, greatest(floor(exact), 1) as base, row_number() over (order by exact - greatest(floor(exact), 1) desc, c_mktsegment) as rk from k), q as (select c_mktsegment, base + (rk <= 100 - sum(base) over ())::int as quota from b),
    r as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by {hx('42', 'c_custkey')}, c_custkey) as r from customer) select c_custkey, c_mktsegment from r join q using (c_mktsegment) where r <= quota""")
def stratified_subsample(t):
    return S.stratified_subsample(t["customer"], "c_mktsegment", "c_custkey", 100)


EH = hx("42", "src || '-' || dst")


@query("edge_fraction_subgraph", R("part_supp cust_part", f""", e as (select 'part_supp' as rel, src, dst from part_supp union all select 'cust_part', src, dst from cust_part),
    r as (select *, row_number() over (partition by rel order by {EH}, src || '-' || dst) as r, count(*) over (partition by rel) as n from e) select rel, src, dst from r where r <= greatest(1, round(n * 0.25e0))"""))
def edge_fraction_subgraph(t):
    e = t.rel("part_supp").select(F.lit("part_supp").alias("rel"), "src", "dst").union(t.rel("cust_part").select(F.lit("cust_part").alias("rel"), "src", "dst"))
    return S.fraction(e, ["rel"], 0.25)


@query("random_edge_subgraph", R("cust_part", f" select src, dst from cust_part order by {EH}, src || '-' || dst limit 1000"))
def random_edge_subgraph(t):
    return S.random_edges(t.rel("cust_part"), 1000)


@query("edge_perturb", R("part_supp", f""", e as (select src, dst, {EH} < 429496729 as gone, {ident('43', "src || '-' || dst")} % (select count(*) from part) as ns, {ident('44', "src || '-' || dst")} % (select count(*) from supplier) as nd from part_supp)
    select src, dst from e where not gone union all select distinct ns, nd from e where gone and not exists (select 1 from part_supp p where p.src = ns and p.dst = nd)"""))
def edge_perturb(t):
    size = lambda name: t[name].agg(F.count(F.lit(1)))
    return S.perturb(t.rel("part_supp"), 0.1, size("part"), size("supplier"))


@query("induced_subgraph", R("cust_part", " select src, dst from cust_part where src in (select c_custkey from customer where c_mktsegment = 'BUILDING')"))
def induced_subgraph(t):
    return S.induced(t.rel("cust_part"), t["customer"].where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node")))


@query("temporal_induced_subgraph", R("order_part", ", o as (select o_orderkey from orders where year(o_orderdate) <= (select quantile_cont(year(o_orderdate), 0.5) from orders)), k as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as local from o) select local as src, dst from order_part join k on src = o_orderkey"))
def temporal_induced_subgraph(t):
    cut = F.broadcast(t["orders"].agg(F.percentile(F.year("o_orderdate"), F.lit(0.5)).alias("cut")))
    kept = t["orders"].crossJoin(cut).where(F.year("o_orderdate") <= F.col("cut")).select(F.col("o_orderkey").alias("node"))
    local = S.local_ids(kept, [], "node")
    return t.rel("order_part").join(local, F.col("src") == F.col("node")).select(F.col("local").alias("src"), "dst")


@query("snowball_sample", R("part_supp", ", s as (select p_partkey as n from part where p_size = 1), a as (select distinct dst as n from part_supp where src in (select n from s)), b as (select distinct src as n from part_supp where dst in (select n from a)) select src, dst from part_supp where src in (select n from s union select n from b) and dst in (select n from a)"))
def snowball_sample(t):
    """Two hops over parts and suppliers; suppliers get ids of their own, below zero."""
    e = t.rel("part_supp").select("src", (-F.col("dst") - 1).alias("dst"))
    kept = S.snowball(e, t["part"].where("p_size = 1").select(F.col("p_partkey").alias("node")), 2)
    return S.induced(e, kept, kept).select("src", (-F.col("dst") - 1).alias("dst"))


@query("snowball_capped", R("part_supp", """, b0 as (select src as a, -dst - 1 as b from part_supp union select -dst - 1, src from part_supp), both_ as (select a, b from (select a, b, row_number() over (partition by a order by b) as r from b0) where r <= 20),
    s as (select p_partkey as n from part where p_size = 1), h1 as (select distinct b as n from both_ where a in (select n from s)), h2 as (select distinct b as n from both_ where a in (select n from h1)) select n as node from s union select n from h1 union select n from h2"""))
def snowball_capped(t):
    e = t.rel("part_supp").select("src", (-F.col("dst") - 1).alias("dst"))
    return S.snowball(e, t["part"].where("p_size = 1").select(F.col("p_partkey").alias("node")), 2, cap=20)


@query("two_hop_negatives", R("cust_part cust_nation", f""", h2 as (select distinct a.src, b.src as dst from cust_nation a join cust_nation b on a.dst = b.dst where a.src <> b.src), h1 as (select distinct a.src, b.src as dst from cust_part a join cust_part b on a.dst = b.dst),
    f as (select * from h2 where not exists (select 1 from h1 where h1.src = h2.src and h1.dst = h2.dst)), r as (select *, row_number() over (partition by src order by {EH}, dst) as r from f) select src, dst from r where r <= 3"""))
def two_hop_negatives(t):
    return S.two_hop_negatives(t.rel("cust_nation"), t.rel("cust_part"), 3)


@query("rejection_negatives", R("part_supp", """, g as (select distinct a.dst as src, b.dst from part_supp a join part_supp b on a.src = b.src), d as (select src, count(*) filter (where src <> dst) as d from g group by src)
    select s_suppkey as src, least(10, (select count(*) from supplier) - 1 - coalesce(d, 0))::bigint as drawn, 0::bigint as wrong from supplier left join d on d.src = s_suppkey"""))
def rejection_negatives(t):
    """Suppliers that share no part, ten for each or as many as there are, in a graph of nearly all pairs; how many of them are wrong."""
    g = written(M.metapath_edges(schema(t, "part_supp"), M.MetaPath.parse("rev_part_supp,part_supp")), "graph")
    all_ = t["supplier"].select(F.col("s_suppkey").alias("node"))
    drawn = S.rejection_negatives(all_, all_, g, 10)
    judged = drawn.join(g.withColumn("real", F.lit(1)), ["src", "dst"], "left").groupBy("src")
    judged = judged.agg(F.count_distinct("dst").alias("drawn"), F.count(F.when(F.col("real").isNotNull() | (F.col("src") == F.col("dst")), 1)).alias("wrong"))
    return all_.select(F.col("node").alias("src")).join(judged, "src", "left").select("src", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("drawn", "wrong")))


@query("lp_edge_split", R("cust_nation", f", {C}, e as (select a.src, b.src as dst from cust_nation a join cust_nation b on a.dst = b.dst and a.src < b.src), tr as (select c_custkey from c where r <= floor(n * 0.6e0)) select src, dst, case when src in (select * from tr) and dst in (select * from tr) then 'train' else 'test' end as part from e"))
def lp_edge_split(t):
    """Whether an end trains is told with the chunks of nodes that pairs are listed from, so no pair is joined or shuffled."""
    classes, links = M.quotient(t.rel("cust_nation"))
    train = S.split(t["customer"], "c_custkey").select(F.col("c_custkey").alias("node"), (F.col("split") == "train").alias("train"))
    pairs = M.class_pairs(classes.join(train, "node"), links, "train")
    pairs = pairs.withColumn("part", F.when(F.col("x_train") & F.col("y_train"), "train").otherwise("test"))
    return E.upper_triangle(M.spread(pairs, "part")).select("src", "dst", "part")


@query("giant_component", R("cust_nation supp_nation", """, e as (select src as u, -(dst * 2 + 1)::bigint as v from cust_nation union all select -(src * 2 + 2)::bigint, -(dst * 2 + 1)::bigint from supp_nation), b as (select u, v from e union select v, u from e),
    reach as (select node, label from l), c as (select node, min(label) as label from reach group by node), g as (select label from c group by label order by count(*) desc, label limit 1) select node from c join g using (label)""").replace("with ", "with recursive ", 1).replace("reach as (", "l(node, label) as (select u, u from b union select b.v, l.label from l join b on b.u = l.node), reach as (", 1))
def giant_component(t):
    """Nodes of the largest component, of customers and suppliers over nations; of equals the one with the smallest node."""
    place = -(F.col("dst") * 2 + 1).cast("bigint")
    e = t.rel("cust_nation").select(F.col("src").alias("u"), place.alias("v")).union(t.rel("supp_nation").select(-(F.col("src") * 2 + 2).cast("bigint"), place))
    c = components(e)
    big = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("g"))
    return c.join(F.broadcast(big), F.col("component") == F.col("g")).select("node")


SNAP = "o as (select o_custkey as src, o_orderkey as dst, row_number() over (order by o_orderdate, o_orderkey) as r, count(*) over () as n from orders), s as (select f as fraction, src, dst from o, (values (0.2e0), (0.4e0), (0.6e0), (0.8e0), (1e0)) v(f) where r <= greatest(1, floor(f * n)))"


def order_snapshots(t):
    e = t["orders"].select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), "o_orderdate", "o_orderkey")
    return snapshots(e, ["o_orderdate", "o_orderkey"], (0.2, 0.4, 0.6, 0.8, 1.0)).select("fraction", "src", "dst")


@query("snapshot_by_time", f"with {SNAP} select fraction, src, dst from s")
def snapshot_by_time(t):
    return order_snapshots(t)


@query("snapshot_degree_growth", f"with {SNAP} select fraction, count(*) as edges, count(distinct src) as nodes, round(count(*) / count(distinct src)::double, 6) as mean_degree from s group by 1")
def snapshot_degree_growth(t):
    n, d = F.count(F.lit(1)), F.count_distinct("src")
    return order_snapshots(t).groupBy("fraction").agg(n.alias("edges"), d.alias("nodes"), F.round(n / d, 6).alias("mean_degree"))


FRACTIONS = (0.7, 0.8, 0.9, 1.0)


def _arrived(timed: bool) -> str:
    """arr(rel, src, dst, fraction); orders carry the time, so relations of theirs take it and others come in random order."""
    time = "o_orderdate" if timed else "null"
    join = " join orders on o_orderkey = {}" if timed else ""
    steps = " ".join(f"when r <= greatest(1, floor({f}e0 * n)) then {f}e0" for f in FRACTIONS)
    return f""", te as (select 'cust_order' as rel, src, dst, {time} as time from cust_order{join.format('dst')} union all select 'order_part', src, dst, {time} from order_part{join.format('src')} union all select 'part_supp', src, dst, null from part_supp),
    ro as (select rel, src, dst, row_number() over (partition by rel order by time nulls last, {hx('42', 'rel', 'src', 'dst')}, src, dst) as r, count(*) over (partition by rel) as n from te),
    arr as (select rel, src, dst, case {steps} end as fraction from ro)"""


def arrived(t, timed: bool):
    day = t["orders"].select(F.col("o_orderkey").alias("o"), F.col("o_orderdate").alias("time"))
    never = F.lit(None).cast(day.schema["time"].dataType).alias("time")
    tables = []
    for rel, end in (("cust_order", "dst"), ("order_part", "src"), ("part_supp", None)):
        e = t.rel(rel).select(F.lit(rel).alias("rel"), "src", "dst")
        tables.append(e.join(day, F.col(end) == F.col("o")).drop("o") if timed and end else e.withColumn("time", never))
    return G.arrivals(G.union_of(tables), FRACTIONS)


@query("snapshot_arrivals", R("cust_order order_part part_supp", _arrived(True) + " select rel, src, dst, fraction from arr"))
def snapshot_arrivals(t):
    """Every edge with the first snapshot of its relation: by the order's date where the relation has one, else in random order."""
    return arrived(t, True)


@query("snapshot_random_order", R("cust_order order_part part_supp", _arrived(False) + " select rel, src, dst, fraction from arr"))
def snapshot_random_order(t):
    return arrived(t, False)


GROWTH = """, pa as (select a.src, c.dst, min(greatest(a.fraction, b.fraction, c.fraction)) as fraction from arr a join arr b on b.src = a.dst join arr c on c.src = b.dst where a.rel = 'cust_order' and b.rel = 'order_part' and c.rel = 'part_supp' group by 1, 2)
    select f as fraction, count(*) as edges, count(distinct src) as nodes, round(count(*) / count(distinct src)::double, 6) as mean_degree from pa join (values (0.7e0), (0.8e0), (0.9e0), (1e0)) v(f) on fraction <= f group by 1"""


@query("snapshot_metapath_growth", R("cust_order order_part part_supp", _arrived(True) + GROWTH))
def snapshot_metapath_growth(t):
    """Customers over orders and parts to suppliers, at every snapshot, from one pass over the path."""
    path = M.MetaPath.parse("cust_order,order_part,part_supp")
    return G.growth(G.path_arrivals(arrived(t, True), path), FRACTIONS).withColumn("mean_degree", F.round("mean_degree", 6))


# --- table preparation ---------------------------------------------------------------------


@query("local_id_assignment", "select 'customer' as type, c_custkey as id, row_number() over (order by c_custkey) - 1 as local from customer union all select 'supplier', s_suppkey, row_number() over (order by s_suppkey) - 1 from supplier")
def local_id_assignment(t):
    both = nodes(t, "customer", "c_custkey").select(F.lit("customer").alias("type"), F.col("node").alias("id")).union(nodes(t, "supplier", "s_suppkey").select(F.lit("supplier"), "node"))
    return S.local_ids(both, ["type"], "id")


@query("global_id_offsets", "with n as (select 'customer' as type, count(*) as n from customer union all select 'part', count(*) from part union all select 'supplier', count(*) from supplier) select type, n, (sum(n) over (order by type) - n)::bigint as start from n")
def global_id_offsets(t):
    n = None
    for table in ("customer", "part", "supplier"):
        one = t[table].agg(F.lit(table).alias("type"), F.count(F.lit(1)).alias("n"))
        n = one if n is None else n.union(one)
    return n.select("type", "n", (F.sum("n").over(W.orderBy("type")) - F.col("n")).alias("start"))


@query("homogenize", R("part_supp", ", n as (select (select count(*) from part) as parts) select src, dst + parts as dst, 'part_to_supp' as rel from part_supp, n union all select dst + parts, src, 'rev_part_to_supp' from part_supp, n"))
def homogenize(t):
    n = F.broadcast(t["part"].agg(F.count(F.lit(1)).alias("parts")))
    e = t.rel("part_supp").crossJoin(n)
    return e.select("src", (F.col("dst") + F.col("parts")).alias("dst"), F.lit("part_to_supp").alias("rel")).union(e.select(F.col("dst") + F.col("parts"), "src", F.lit("rev_part_to_supp")))


@query("standardize_relations", R("cust_order order_part", " select 'cust_order' as rel, count(*) as edges from cust_order union all select 'rev_cust_order', count(*) from cust_order union all select 'order_part', count(*) from order_part union all select 'rev_order_part', count(*) from order_part"))
def standardize_relations(t):
    out = None
    for name, e in schema(t, "cust_order", "order_part").standardised().relations.items():
        one = e.agg(F.lit(name).alias("rel"), F.count(F.lit(1)).alias("edges"))
        out = one if out is None else out.union(one)
    return out


@query("edge_type_inference", R("cust_part user_event", ", k as (select c_custkey as id, 'customer' as type from customer), e as (select src, dst from cust_part) select 'customer_to_part' as rel, count(*) as edges, count(distinct src) as sources from e join k on k.id = e.src join part on p_partkey = e.dst"))
def edge_type_inference(t):
    """Edges take their relation from the types of their ends; edges with an unknown end drop out."""
    a = t["customer"].select(F.col("c_custkey").alias("src"), F.lit("customer").alias("st"))
    b = t["part"].select(F.col("p_partkey").alias("dst"), F.lit("part").alias("dt"))
    e = t.rel("cust_part").join(a, "src").join(b, "dst").withColumn("rel", F.concat_ws("_to_", "st", "dt"))
    return e.groupBy("rel").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"))


@query("label_encoding", "with k as (select c_mktsegment, dense_rank() over (order by c_mktsegment) - 1 as class from (select distinct c_mktsegment from customer)) select c_custkey as node, class from customer join k using (c_mktsegment)")
def label_encoding(t):
    """Classes are numbered on the distinct labels, not on the rows."""
    k = t["customer"].select("c_mktsegment").distinct().withColumn("class", F.dense_rank().over(W.orderBy("c_mktsegment")) - 1)
    return t["customer"].join(k, "c_mktsegment").select(F.col("c_custkey").alias("node"), F.col("class").cast("bigint").alias("class"))


@query("label_sanitize", "select doc_id, nullif(case when l.quality is null then -1 else l.quality end, -1) as label, (select max(quality) + 1 from labels) as classes from documents left join labels l using (doc_id)")
def label_sanitize(t):
    l = t["labels"].select("doc_id", "quality")  # noqa: E741
    classes = F.broadcast(l.agg((F.max("quality") + 1).alias("classes")))
    return t["documents"].select("doc_id").join(l, "doc_id", "left").crossJoin(classes).select("doc_id", F.nullif(F.coalesce("quality", F.lit(-1)), F.lit(-1)).alias("label"), "classes")


@query("pad_features", "select s_suppkey as node, list_concat([s_acctbal, s_nationkey::double], [0::double, 0, 0]) as x from supplier")
def pad_features(t):
    return t["supplier"].select(F.col("s_suppkey").alias("node"), V.padded(F.array("s_acctbal", F.col("s_nationkey").cast("double")), 5).alias("x"))


@query("diagonal_padding", "select 'supplier' as type, s_suppkey as node, [0::double, 0, s_acctbal] as x from supplier union all select 'part', p_partkey, [p_retailprice, p_size::double, 0] from part")
def diagonal_padding(t):
    part = t["part"].select(F.lit("part").alias("type"), F.col("p_partkey").alias("node"), V.in_block(F.array(F.col("p_retailprice"), F.col("p_size").cast("double")), 0, 1).alias("x"))
    return part.union(t["supplier"].select(F.lit("supplier"), "s_suppkey", V.in_block(F.array("s_acctbal"), 2, 0)))


@query("feature_fill", f"select s_suppkey as node, ({hx('42', 's_suppkey')} + 0.5e0) / 4294967296e0 as x from supplier")
def feature_fill(t):
    """Missing features from a keyed hash, so that a rerun fills the same values."""
    return t["supplier"].select(F.col("s_suppkey").alias("node"), ((keyed(42, F.col("s_suppkey")) + F.lit(0.5).cast("double")) / F.lit(4294967296.0)).alias("x"))


@query("resume_antijoin", "select distinct l_partkey as p, l_linenumber as seed from lineitem where (l_partkey, l_linenumber) not in (select l_partkey, l_linenumber from lineitem where l_returnflag = 'A')")
def resume_antijoin(t):
    runs = t["lineitem"].select(F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("seed"), "l_returnflag")
    return runs.select("p", "seed").distinct().join(runs.where("l_returnflag = 'A'").select("p", "seed"), ["p", "seed"], "left_anti")


@query("cache_key_md5", "select p_partkey as p, md5(p_brand || '|' || p_type || '|' || p_size) as key from part")
def cache_key_md5(t):
    return t["part"].select(F.col("p_partkey").alias("p"), F.md5(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string"))).alias("key"))


@query("best_conf_per_path", "select path, conf from (select p_brand || ',' || p_type as path, max(p_retailprice) as conf from part group by 1) order by conf desc, path limit 20")
def best_conf_per_path(t):
    """Duplicates of a path keep their best confidence; the top 20 are the feature."""
    return t["part"].groupBy(F.concat_ws(",", "p_brand", "p_type").alias("path")).agg(F.max("p_retailprice").alias("conf")).orderBy(F.col("conf").desc(), "path").limit(20)


POWER = ", ".join(f"x{k} as (select g.src as node, sum(x)::double as x from g join x{k - 1} on x{k - 1}.node = g.dst group by g.src)" for k in range(1, 5))


@query("power_iteration", R("cust_nation", f""", g as (select a.src, b.src as dst from cust_nation a join cust_nation b on a.dst = b.dst), x0 as (select distinct src as node, 1e0 as x from g), {POWER}
    select round((select sum(a.x * b.x) from g join x4 a on a.node = src join x4 b on b.node = dst) / (select sum(x * x) from x4), 6) as radius"""))
def power_iteration(t):
    """Four steps towards the largest eigenvalue of the customer-nation-customer graph."""
    classes, links = M.quotient(t.rel("cust_nation"))
    sizes = classes.groupBy(F.col("of").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    return spectral_radius(links.toDF("src", "dst"), 4, every=2, sizes=sizes)


@query("top_eigenvalues")
def top_eigenvalues(t):
    """Five largest eigenvalues of the normalised adjacency of users and event types, weighted by events; types have numbers below zero."""
    e = t["events"].groupBy(F.col("user_id").cast("long").alias("src"), "event_type").agg(F.count(F.lit(1)).alias("w"))
    e = e.select("src", (-F.conv(F.substring(F.md5("event_type"), 1, 8), 16, 10).cast("long") - 1).alias("dst"), "w")
    both = e.union(e.select("dst", "src", "w"))
    d = both.groupBy("src").agg(F.sum("w").cast("double").alias("d"))
    w = both.join(d, "src").join(d.toDF("dst", "e"), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))
    return spectral.top_eigenvalues(w).select("rank", F.round("value", 4).alias("value"))


#: Relations between nations and brands that a few lines tell, both ways.
RELATED = "select distinct 'N' || s_nationkey || '>' || p_brand as relation, 'N' || s_nationkey as src, p_brand as dst from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey where l_linenumber = 7 and l_quantity <= 3"


def cyclic_sql(length: int, draws: int) -> str:
    """p(draw, path): ``draws`` closed walks of ``length`` steps over rel, the smallest hash among the steps that can still close."""
    out = f"rel as (with a as ({RELATED}) select * from a union all select 'rev_' || relation, dst, src from a), b0 as (select min(src) as type from rel where relation not like 'rev%')"
    for k in range(1, length):
        out += f", b{k} as (select distinct src as type from rel where dst in (select type from b{k - 1}))"
    out += f", w0 as (select range as draw, (select type from b0) as here, '' as path from range({draws}))"
    for k in range(length):
        out += f", w{k + 1} as (select draw, dst as here, path || case when path = '' then '' else ',' end || relation as path from (select w.draw, w.path, r.dst, r.relation, row_number() over (partition by draw order by {hx('42', 'draw', str(k), 'relation')}, relation) as o from w{k} w join rel r on r.src = w.here and r.dst in (select type from b{length - 1 - k})) where o = 1)"
    return out


@query("cyclic_metapaths", f"with {cyclic_sql(4, 50)} select draw, path from w4")
def cyclic_metapaths(t):
    """Fifty closed meta-paths of four steps from the first nation that has relations, over relations that lines tell."""
    a = t.spark.sql(RELATED.replace("from lineitem", "from {lineitem}").replace("join supplier", "join {supplier}").replace("join part", "join {part}"), **{n: t[n] for n in ("lineitem", "supplier", "part")})
    rel = a.union(a.select(F.concat(F.lit("rev_"), "relation"), "dst", "src"))
    return walks.cyclic_paths(rel, a.agg(F.min("src")).first()[0], 4, 50)
