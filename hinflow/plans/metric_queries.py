"""Queries over metrics, statistics and neighbour aggregation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import edges as E
from ..operators import inference as I
from ..operators import metrics as X
from ..operators import sketch as K
from ..sources.fixtures import with_relations as R
from . import metapath as M
from .graph_queries import nodes, schema
from .registry import query
from .sketch_queries import bk, sk, two_hop_sketch

VEC = "v as (select vec_id as id, embedding::double[] as x, list_transform(embedding::double[], lambda e: floor(e * 10 + 0.5) / 10) as y, label from embeddings)"
LONG = f"{VEC}, l as (select id, label, unnest(x) as x, unnest(y) as y, generate_subscripts(x, 1) as i from v)"


def pairs(t):
    """Exact and rounded vectors."""
    x = V.doubles(F.col("embedding"))
    y = F.transform(x, lambda e: F.floor(e * 10 + F.lit(0.5).cast("double")).cast("double") / F.lit(10).cast("double"))
    return t["embeddings"].select(F.col("vec_id").alias("id"), x.alias("x"), y.alias("y"), "label")


def r6(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


@query("row_cosine", f"with {VEC}, c as (select list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))) as c from v) select round(avg(c), 6) as mean, round(stddev_samp(c), 6) as std from c")
def row_cosine(t):
    return r6(X.cosine_fidelity(pairs(t)), "mean", "std")


DIFF = "list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))"


@query("row_rel_l2", f"with {VEC} select id, round(sqrt(list_sum({DIFF})) / sqrt(list_inner_product(x, x)), 6) as rel from v")
def row_rel_l2(t):
    return r6(X.relative_l2(pairs(t)), "rel")


@query("frobenius_error", f"with {VEC} select round(sqrt(sum(list_sum({DIFF}))) / sqrt(sum(list_inner_product(x, x))), 6) as error from v")
def frobenius_error(t):
    return r6(X.frobenius(pairs(t)), "error")


@query("linear_cka", f"""with {LONG}, m as (select i, avg(x) as mx, avg(y) as my from l group by i), c as (select id, l.i, x - mx as x, y - my as y from l join m using (i)),
    g as (select a.i, b.i as j, sum(a.x * b.x) as xx, sum(a.x * b.y) as xy, sum(a.y * b.y) as yy from c a join c b using (id) group by 1, 2)
    select round(sum(xy * xy) / (sqrt(sum(xx * xx)) * sqrt(sum(yy * yy))), 6) as cka from g""")
def linear_cka(t):
    return r6(X.linear_cka(pairs(t)), "cka")


@query("unbiased_cka", f"""with {LONG}, m as (select i, avg(x) as mx, avg(y) as my from l group by i), c as (select id, l.i, x - mx as x, y - my as y from l join m using (i)),
    g as (select a.i, b.i as j, sum(a.x * b.x) as xx, sum(a.x * b.y) as xy, sum(a.y * b.y) as yy from c a join c b using (id) group by 1, 2),
    s as (select sum(xx * xx) as xx, sum(xy * xy) as xy, sum(yy * yy) as yy from g), p as (select id, sum(x * x) as p, sum(y * y) as q from c group by id),
    d as (select sum(p * p) as pp, sum(p * q) as pq, sum(q * q) as qq, sum(p) as sp, sum(q) as sq, count(*)::double as n from p),
    h as (select xy - pq + sp * sq / ((n - 1) * (n - 2)) - 2 * pq / (n - 2) as hxy, xx - pp + sp * sp / ((n - 1) * (n - 2)) - 2 * pp / (n - 2) as hxx, yy - qq + sq * sq / ((n - 1) * (n - 2)) - 2 * qq / (n - 2) as hyy from s, d)
    select round(hxy / sqrt(abs(hxx * hyy)), 6) as cka from h""")
def unbiased_cka(t):
    return r6(X.unbiased_cka(pairs(t)), "cka")


@query("procrustes")
def procrustes(t):
    return r6(X.procrustes(pairs(t)), "residual")


N = "(select count(*) from embeddings)"


def ring(t):
    """A fixed graph over the vectors: id to (7 id + 1) mod n."""
    n = F.broadcast(t["embeddings"].agg(F.count(F.lit(1)).alias("n")))
    return t["embeddings"].crossJoin(n).select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 1) % F.col("n")).alias("dst"))


@query("dirichlet_energy", f"with {VEC}, e as (select a.x as x, b.x as y from v a join v b on b.id = (a.id * 7 + 1) % {N}) select round(avg(list_sum({DIFF})), 6) as energy, round(sum(list_sum({DIFF})) / 2 / {N}, 6) as per_node from e")
def dirichlet_energy(t):
    return r6(X.dirichlet(ring(t), pairs(t)), "energy", "per_node")


@query("mean_average_distance", f"with {LONG}, n as (select id, sqrt(sum(x * x)) as n from l group by id), s as (select sum(x / n) as s from l join n using (id) group by i) select round(1 - (sum(s * s) - {N}) / ({N}::double * ({N} - 1)), 6) as mad from s")
def mean_average_distance(t):
    return r6(X.mean_average_distance(pairs(t)), "mad")


GUESS = f"{VEC}, g as (select id, label as truth, list_position(y[1:6], list_max(y[1:6])) - 1 as guess, list_position(x[1:6], list_max(x[1:6])) - 1 as other from v)"


def guesses(t):
    six = lambda c: V.argmax(F.slice(c, 1, 6))
    return pairs(t).select("id", F.col("label").cast("int").alias("truth"), six("y").alias("guess"), six("x").alias("other"))


@query("prediction_agreement", f"with {GUESS} select avg((guess = other)::int) as agreement from g")
def prediction_agreement(t):
    return guesses(t).agg(F.avg((F.col("guess") == F.col("other")).cast("int")).alias("agreement"))


FS = "c as (select k, count(*) filter (where truth = k and guess = k) as tp, count(*) filter (where guess = k) as p, count(*) filter (where truth = k) as a from g, (select unnest(range(100)) as k) group by k), f as (select k, tp, 2 * tp / (p + a)::double as f1 from c where p + a > 0)"


@query("macro_f1_skip", f"with {GUESS}, {FS} select round(avg(f1), 6) as macro_f1 from f where tp > 0")
def macro_f1_skip(t):
    return r6(X.macro_f1(X.class_counts(guesses(t)), True), "macro_f1")


@query("macro_f1_zero", f"with {GUESS}, {FS} select round(avg(f1), 6) as macro_f1 from f")
def macro_f1_zero(t):
    return r6(X.macro_f1(X.class_counts(guesses(t)), False), "macro_f1")


@query("micro_f1", f"with {GUESS} select avg((truth = guess)::int) as micro_f1 from g")
def micro_f1(t):
    return guesses(t).agg(F.avg((F.col("truth") == F.col("guess")).cast("int")).alias("micro_f1"))


@query("macro_f1_multilabel", f"""with {VEC}, b as (select id, i, x[i] > 0 as truth, y[i] > 0.1 as guess from v, (select unnest(range(1, 7)) as i)),
    c as (select i, count(*) filter (where truth and guess) as tp, count(*) filter (where truth) as a, count(*) filter (where guess) as p from b group by i) select round(avg(2 * tp / (p + a)::double), 6) as macro_f1 from c""")
def macro_f1_multilabel(t):
    bits = F.posexplode(F.slice(F.arrays_zip("x", "y"), 1, 6))
    b = pairs(t).select(bits).select("pos", (F.col("col.x") > 0).alias("a"), (F.col("col.y") > F.lit(0.1)).alias("p"))
    n = lambda c: F.sum(c.cast("int"))
    c = b.groupBy("pos").agg((2 * n(F.col("a") & F.col("p")) / (n(F.col("a")) + n(F.col("p")))).alias("f1"))
    return c.agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


@query("per_class_f1", f"with {GUESS}, {FS} select k::int as class, round(f1, 6) as f1 from f")
def per_class_f1(t):
    return r6(X.class_f1(X.class_counts(guesses(t))).select("class", "f1"), "f1")


QB = ", d as (select src as node, count(*) as degree from cust_part group by src), q as (select quantile_cont(degree, 0.5) as q5, quantile_cont(degree, 0.9) as q9 from d), bins as (select node, degree, case when degree <= q5 then 'tail' when degree <= q9 then 'mid' else 'hub' end as bin from d, q)"


def bins(t):
    return X.degree_bins(E.degree(t.rel("cust_part")))


@query("degree_bins", R("cust_part", QB + " select node, degree, bin from bins"))
def degree_bins(t):
    return bins(t)


@query("per_bin_agreement", R("cust_part", QB + f", {GUESS} select bin, count(*) as n, avg((guess = other)::int) as agreement from bins join g on id = node group by bin"))
def per_bin_agreement(t):
    j = bins(t).join(guesses(t), F.col("node") == F.col("id"))
    return j.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("guess") == F.col("other")).cast("int")).alias("agreement"))


SCORED = f"{VEC}, sc as (select a.id as query, k = 0 as positive, floor(list_inner_product(a.x, b.x) * 1000) / 1000 as score from v a, (select unnest(range(11)) as k), v b where b.id = (a.id + 1 + k * 13) % {N})"


def scored(t):
    """Each vector against its successor (positive) and ten further ones, by dot product."""
    n = F.broadcast(t["embeddings"].agg(F.count(F.lit(1)).alias("n")))
    v = pairs(t).select("id", "x")
    c = v.crossJoin(n).select(F.col("id").alias("query"), "x", "n", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"))
    c = c.withColumn("target", (F.col("query") + 1 + F.col("k") * 13) % F.col("n"))
    s = c.join(v.toDF("target", "y"), "target")
    return s.select("query", (F.col("k") == 0).alias("positive"), (F.floor(V.dot(F.col("x"), F.col("y")) * 1000) / F.lit(1000).cast("double")).alias("score"))


@query("lp_dot_scores", f"with {SCORED} select query, positive, score from sc")
def lp_dot_scores(t):
    return scored(t)


RANKS = f"{SCORED}, rk as (select p.query, 1 + count(*) filter (where n.score >= p.score) as rank from sc p join sc n on n.query = p.query and not n.positive where p.positive group by p.query)"
RM = "round(avg(1 / rank::double), 6) as mrr, avg((rank <= 1)::int) as hits_1, avg((rank <= 10)::int) as hits_10"


@query("lp_rank_metrics", f"with {RANKS} select {RM} from rk")
def lp_rank_metrics(t):
    return X.rank_metrics(X.positive_ranks(scored(t)))


@query("lp_metrics_by_bin", R("cust_part", QB + f", {RANKS} select bin, {RM} from rk join bins on node = query group by bin"))
def lp_metrics_by_bin(t):
    return X.rank_metrics(X.positive_ranks(scored(t)).join(bins(t), F.col("query") == F.col("node")), ("bin",))


@query("roc_auc", f"""with {SCORED}, r as (select positive, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2e0 as r from sc)
    select round((sum(case when positive then r end) - count(*) filter (where positive) * (count(*) filter (where positive) + 1) / 2e0) / (count(*) filter (where positive)::double * count(*) filter (where not positive)), 6) as auc from r""")
def roc_auc(t):
    return r6(X.roc_auc(scored(t)), "auc")


@query("average_precision", f"""with {SCORED}, g as (select score, sum(positive::int) as p, count(*) as n from sc group by score),
    c as (select p, sum(p) over (order by score desc) as cp, sum(n) over (order by score desc) as cn, sum(p) over () as tp from g) select round(sum(p / tp::double * (cp / cn::double)), 6) as ap from c""")
def average_precision(t):
    return r6(X.average_precision(scored(t)), "ap")


# --- statistics over result tables: brand as data set, return flag as method, line number as seed ----


RES = "r as (select p_brand as dataset, l_returnflag as method, l_linenumber as seed, avg(l_quantity) as value, count(*) as edges from lineitem join part on p_partkey = l_partkey group by 1, 2, 3)"


def results(t):
    j = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_brand").alias("dataset"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_quantity").alias("value"), F.count(F.lit(1)).alias("edges"))


KEYS = ["dataset", "method"]


@query("seed_mean_std", f"with {RES} select dataset, method, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std_pop, round(stddev_samp(value), 6) as std_samp, count(value) as n from r group by 1, 2")
def seed_mean_std(t):
    return r6(X.mean_std(results(t), KEYS, "value"), "mean", "std_pop", "std_samp")


@query("seed_ci95", f"with {RES} select dataset, method, round(avg(value), 6) as mean, round(1.96e0 * stddev_samp(value) / sqrt(count(value)), 6) as half_width from r group by 1, 2")
def seed_ci95(t):
    return r6(X.ci95(results(t), KEYS, "value"), "mean", "half_width")


@query("geo_mean", f"with {RES} select dataset, round(exp(avg(case when value > 0 then ln(value) end)), 6) as geo_mean from r group by 1")
def geo_mean(t):
    return results(t).groupBy("dataset").agg(F.round(X.geo_mean(F.col("value")), 6).alias("geo_mean"))


@query("winrate_within_1pp", f"with {RES}, b as (select method, value, max(value) over (partition by dataset, seed) as best from r) select method, avg((best - value <= 0.5e0)::int) as winrate from b group by method")
def winrate_within_1pp(t):
    best = F.max("value").over(W.partitionBy("dataset", "seed"))
    return results(t).withColumn("best", best).groupBy("method").agg(F.avg((F.col("best") - F.col("value") <= 0.5).cast("int")).alias("winrate"))


@query("cost_at_quality", f"""with {RES}, e as (select dataset, max(value) as exact from r where method = 'N' group by dataset)
    select dataset, arg_min(seed, (edges, seed)) as seed, min(edges) as edges from r join e using (dataset) where method <> 'N' and value >= 0.9e0 * exact group by dataset""")
def cost_at_quality(t):
    r = results(t)
    e = r.where("method = 'N'").groupBy("dataset").agg(F.max("value").alias("exact"))
    good = r.where("method <> 'N'").join(e, "dataset").where(F.col("value") >= 0.9 * F.col("exact"))
    return good.groupBy("dataset").agg(F.min_by("seed", F.struct("edges", "seed")).alias("seed"), F.min("edges").alias("edges"))


@query("convergence_verdict", f"with {RES} select dataset, method, sum((value >= 25)::int)::bigint as converged, case when sum((value >= 25)::int) >= 4 then 'converged' when sum((value >= 25)::int) >= 2 then 'mixed' else 'failed' end as verdict from r group by 1, 2")
def convergence_verdict(t):
    c = results(t).groupBy(*KEYS).agg(F.sum((F.col("value") >= 25).cast("int")).alias("converged"))
    return c.select(*KEYS, "converged", F.when(F.col("converged") >= 4, "converged").when(F.col("converged") >= 2, "mixed").otherwise("failed").alias("verdict"))


@query("majority_baseline_f1", "with p as (select avg(quality) as q, avg(toxic) as t from labels) select name, rate, case when rate >= 0.5e0 then 2 * rate / (1 + rate) else 0 end as f1 from (select 'quality' as name, q as rate from p union all select 'toxic', t from p)")
def majority_baseline_f1(t):
    p = t["labels"].agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    r = p.select(F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))).alias("name", "rate"))
    return r.select("name", "rate", F.when(F.col("rate") >= 0.5, 2 * F.col("rate") / (1 + F.col("rate"))).otherwise(0.0).alias("f1"))


@query("marginal_cost", f"with {RES}, d as (select dataset, method, seed, edges, value, edges - lag(edges) over w as dx, value - lag(value) over w as dy from r window w as (partition by dataset, method order by edges, seed)) select dataset, method, seed, edges, round(dy / dx, 6) as slope from d where dx > 0")
def marginal_cost(t):
    by = W.partitionBy(*KEYS).orderBy("edges", "seed")
    d = results(t).withColumn("dx", F.col("edges") - F.lag("edges").over(by)).withColumn("dy", F.col("value") - F.lag("value").over(by))
    return d.where("dx > 0").select(*KEYS, "seed", "edges", F.round(F.col("dy") / F.col("dx"), 6).alias("slope"))


@query("densest_metapath", f"with {RES}, m as (select dataset, method, max(edges) as edges from r group by 1, 2) select dataset, method, edges from (select *, row_number() over (partition by dataset order by edges desc, method) as k from m) where k = 1")
def densest_metapath(t):
    m = results(t).groupBy(*KEYS).agg(F.max("edges").alias("edges"))
    return m.withColumn("k", F.row_number().over(W.partitionBy("dataset").orderBy(F.col("edges").desc(), "method"))).where("k = 1").drop("k")


@query("density_match", f"with {RES}, a as (select dataset, seed, edges from r where method = 'A'), b as (select dataset, seed as match, edges as match_value from r where method = 'R') select dataset, seed, edges, match, match_value from (select *, row_number() over (partition by dataset, seed, edges order by abs(edges - match_value), match) as k from a join b using (dataset)) where k = 1")
def density_match(t):
    r = results(t)
    a = r.where("method = 'A'").select("dataset", "seed", "edges")
    return X.nearest(a, r.where("method = 'R'"), ["dataset"], "edges", "seed")


@query("cohen_dz", f"with {RES} select a.dataset, round(avg(a.value - b.value) / stddev_samp(a.value - b.value), 6) as dz from r a join r b on a.dataset = b.dataset and a.seed = b.seed where a.method = 'A' and b.method = 'R' group by 1")
def cohen_dz(t):
    r = results(t)
    a = r.where("method = 'A'").select("dataset", "seed", F.col("value").alias("a"))
    b = r.where("method = 'R'").select("dataset", "seed", F.col("value").alias("b"))
    return r6(X.cohen_dz(a.join(b, ["dataset", "seed"]), ["dataset"]), "dz")


def tails_sql(t: str, df: str) -> str:
    """P(|T| >= |t|) for whole degrees of freedom, by the finite sums over powers of the cosine."""
    a = f"atan(abs({t}) / sqrt({df}::double))"
    sums = lambda n, odd: f"coalesce(list_sum(list_transform(range(0, {n}), lambda j: pow(cos({a}), 2 * j) * coalesce(list_product(list_transform(range(1, j + 1), lambda i: {odd})), 1e0))), 0e0)"
    even = f"sin({a}) * {sums(f'({df}) // 2', '(2 * i - 1) / (2e0 * i)')}"
    return f"(1 - case when ({df}) % 2 = 1 then 2 / pi() * ({a} + sin({a}) * cos({a}) * {sums(f'(({df}) - 1) // 2', '2e0 * i / (2 * i + 1)')}) else {even} end)"


@query("seed_ci95_t", f"""with recursive {RES}, s as (select dataset, method, avg(value) as mean, stddev_samp(value) as sd, count(value)::bigint as n from r group by 1, 2),
    q(n, lo, hi, i) as (select distinct n, 0e0, 1000e0, 0 from s where n > 1 union all select n, case when p > 0.05 then mid else lo end, case when p > 0.05 then hi else mid end, i + 1
        from (select n, lo, hi, i, (lo + hi) / 2 as mid, {tails_sql('((lo + hi) / 2)', '(n - 1)')} as p from q where i < 70))
    select dataset, method, round(mean, 6) as mean, round(case when s.n = 1 then 0 else lo * sd / sqrt(s.n) end, 6) as half_width, s.n from s left join (select * from q where i = 70) q on q.n = s.n""")
def seed_ci95_t(t):
    return r6(I.t_interval(results(t), KEYS, "value"), "mean", "half_width")


DIFF = f"{RES}, d as (select a.dataset, a.seed, a.value - b.value as d from r a join r b on a.dataset = b.dataset and a.seed = b.seed where a.method = 'A' and b.method = 'R')"
MARGIN = 1.0


def differences(t):
    r = results(t)
    side = lambda m, c: r.where(F.col("method") == m).select("dataset", "seed", F.col("value").alias(c))
    return side("A", "a").join(side("R", "b"), ["dataset", "seed"]).select("dataset", "seed", (F.col("a") - F.col("b")).alias("d"))


@query("signed_rank_test", f"""with {DIFF}, k as (select dataset, d, 2 * rank() over (partition by dataset order by abs(d)) + count(*) over (partition by dataset, abs(d)) - 1 as r2 from d where d <> 0),
    g as (select dataset, list(r2)::bigint[] as rs, count(*) as m, least(sum(case when d > 0 then r2 else 0 end), sum(case when d < 0 then r2 else 0 end)) as w from k group by 1),
    p as (select dataset, any_value(w) / 2e0 as statistic, least(1, 2e0 * count(*) filter (where s <= w) / count(*)) as p from (select dataset, w, list_sum(list_transform(range(0, m), lambda i: case when (b >> i) & 1 = 1 then rs[i + 1] else 0 end)) as s
        from (select *, unnest(range(0, (1::bigint << m))) as b from g)) group by 1), n as (select dataset, count(*) as n from d group by 1)
    select dataset, n, case when n >= 5 then coalesce(statistic, 0) end as statistic, round(case when n >= 5 then coalesce(p, 1) end, 6) as p from n left join p using (dataset)""")
def signed_rank_test(t):
    return r6(I.signed_rank(differences(t), ["dataset"], "d"), "p")


def upper_sql(t: str) -> str:
    return f"case when {t} >= 0 then {tails_sql(t, '(n - 1)')} / 2 else 1 - {tails_sql(t, '(n - 1)')} / 2 end"


@query("equivalence_test", f"""with {DIFF}, s as (select dataset, avg(d) as m, stddev_samp(d) as sd, count(*) as n from d group by 1), f as (select *, case when abs(m) < {MARGIN}e0 then 0e0 else 1e0 end as flat from s),
    e as (select dataset, n, case when n >= 5 then case when sd > 0 then {upper_sql(f'((m + {MARGIN}e0) / (sd / sqrt(n)))')} else flat end end as p_lower, case when n >= 5 then case when sd > 0 then {upper_sql(f'(({MARGIN}e0 - m) / (sd / sqrt(n)))')} else flat end end as p_upper from f)
    select dataset, n, round(p_lower, 6) as p_lower, round(p_upper, 6) as p_upper, round(greatest(p_lower, p_upper), 6) as p_max,
    case when p_lower is null then 'INSUFFICIENT_SEEDS' when greatest(p_lower, p_upper) < 0.05 then 'REJECT_H0' else 'FAIL' end as decision from e""")
def equivalence_test(t):
    return r6(I.equivalence(differences(t), ["dataset"], "d", MARGIN), "p_lower", "p_upper", "p_max")


@query("gap_tstat", f"""with {RES}, s as (select dataset, method, avg(value) as m, stddev_samp(value) as s, count(*) as n from r group by 1, 2)
    select a.dataset, round((a.m - b.m) / sqrt(a.s * a.s / a.n + b.s * b.s / b.n), 6) as t, least(a.n, b.n) as seeds from s a join s b using (dataset) where a.method = 'A' and b.method = 'R'""")
def gap_tstat(t):
    s = X.mean_std(results(t), KEYS, "value")
    side = lambda m, p: s.where(F.col("method") == m).select("dataset", F.col("mean").alias(f"{p}m"), F.col("std_samp").alias(f"{p}s"), F.col("n").alias(f"{p}n"))
    j = side("A", "a").join(side("R", "b"), "dataset")
    se = F.sqrt(F.col("as") * F.col("as") / F.col("an") + F.col("bs") * F.col("bs") / F.col("bn"))
    return j.select("dataset", F.round((F.col("am") - F.col("bm")) / se, 6).alias("t"), F.least("an", "bn").alias("seeds"))


@query("donor_backfill", "with r as (select l_partkey as cell, l_orderkey as id, case when l_linenumber % 2 = 0 then l_quantity end as x from lineitem) select cell, id, coalesce(x, max(x) over (partition by cell)) as x from r")
def donor_backfill(t):
    """Nulls take a value from their group; the largest one, so that the choice is fixed."""
    r = t["lineitem"].select(F.col("l_partkey").alias("cell"), F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("x"))
    return r.select("cell", "id", F.coalesce("x", F.max("x").over(W.partitionBy("cell"))).alias("x"))


@query("amortization_totals", f"with {RES}, m as (select dataset, sum(edges) filter (where method = 'N')::double as exact, sum(edges) filter (where method = 'A')::double as once, sum(edges) filter (where method = 'R')::double / 100 as each from r group by 1) select dataset, q, exact * q as exact_total, once + each * q as sketch_total, round(exact * q / (once + each * q), 6) as speedup from m, (values (1), (10), (100)) v(q)")
def amortization_totals(t):
    s = lambda m: F.sum(F.when(F.col("method") == m, F.col("edges"))).cast("double")
    m = results(t).groupBy("dataset").agg(s("N").alias("exact"), s("A").alias("once"), (s("R") / 100).alias("each"))
    m = m.withColumn("q", F.explode(F.array(F.lit(1), F.lit(10), F.lit(100))))
    total = F.col("once") + F.col("each") * F.col("q")
    return m.select("dataset", "q", (F.col("exact") * F.col("q")).alias("exact_total"), total.alias("sketch_total"), F.round(F.col("exact") * F.col("q") / total, 6).alias("speedup"))


# --- aggregation over neighbours ------------------------------------------------------------

XF = "xf as (select p_partkey as node, 0 as pos, p_retailprice as value from part union all select p_partkey, 1, p_size::double from part)"


def part_features(t):
    both = F.posexplode(F.array(F.col("p_retailprice"), F.col("p_size").cast("double")))
    return t["part"].select(F.col("p_partkey").alias("node"), both).toDF("node", "pos", "value")


AGG1 = R("cust_part", f", {XF}, a1 as (select src as node, pos, avg(value) as value from cust_part join xf on dst = node group by 1, 2)")


@query("mean_aggregate_1layer", AGG1 + " select node, pos, round(value, 9) as value from a1")
def mean_aggregate_1layer(t):
    return X.mean_aggregate(t.rel("cust_part"), part_features(t)).withColumn("value", F.round("value", 9))


@query("mean_aggregate_2layer", AGG1 + " select dst as node, pos, round(avg(value), 6) as value from cust_part join a1 on src = node group by 1, 2")
def mean_aggregate_2layer(t):
    e = t.rel("cust_part")
    return r6(X.mean_aggregate(E.reverse(e), X.mean_aggregate(e, part_features(t))), "value")


@query("hopwise_mean_aggregate", R("cust_order order_part", f", {XF}, o as (select src as node, pos, avg(value) as value from order_part join xf on dst = node group by 1, 2) select src as node, pos, round(avg(value), 9) as value from cust_order join o on dst = node group by 1, 2"))
def hopwise_mean_aggregate(t):
    """One layer per hop of the matching graph, from its far end; the graph itself is never composed."""
    rows = part_features(t)
    for hop in reversed(schema(t, "cust_order", "order_part").hops(M.MetaPath.parse("cust_order,order_part"))):
        rows = X.mean_aggregate(hop, rows)
    return rows.withColumn("value", F.round("value", 9))


SF = R("cust_part", f", {sk(8)}, d as (select sk.node, u.node as dst from sk join u using (h)), b as (select c_custkey as dst, c_acctbal as value from customer)")


def decoded(t):
    d = K.decode(two_hop_sketch(t, 8), K.universe(nodes(t, "customer", "c_custkey")))
    return d.join(t["customer"].select(F.col("c_custkey").alias("dst"), F.col("c_acctbal").alias("value")), "dst")


@query("sketch_feature_mean", SF + " select node, round(avg(value), 6) as value from d join b using (dst) group by node")
def sketch_feature_mean(t):
    return decoded(t).groupBy(F.col("src").alias("node")).agg(F.round(F.avg("value"), 6).alias("value"))


@query("sketch_feature_sum", SF + " select node, round(sum(value), 4) as value from d join b using (dst) group by node")
def sketch_feature_sum(t):
    return decoded(t).groupBy(F.col("src").alias("node")).agg(F.round(F.sum("value"), 4).alias("value"))


@query("sketch_view_mean", R("cust_part cust_nation", f""", {sk(8)}, n1 as {bk('(select c.dst as node, h from cust_nation c join u on u.node = c.src)', 8)}, n2 as {bk('(select c.src as node, h from cust_nation c join n1 on n1.node = c.dst)', 8)},
    f as (select 0 as view, s.node, avg(c_acctbal) as value from sk s join u using (h) join customer on c_custkey = u.node group by 2 union all select 1, s.node, avg(c_acctbal) from n2 s join u using (h) join customer on c_custkey = u.node group by 2)
    select node, round(avg(value), 6) as value from f group by node"""))
def sketch_view_mean(t):
    u = K.universe(nodes(t, "customer", "c_custkey"))
    balance = t["customer"].select(F.col("c_custkey").alias("dst"), F.col("c_acctbal").alias("value"))
    views = []
    for k, name in enumerate(("cust_part", "cust_nation")):
        s = K.propagate(schema(t, name), M.MetaPath.parse(name).mirrored(), u, 8)
        views.append(K.decode(s, u).join(balance, "dst").groupBy(F.col("src").alias("node")).agg(F.lit(k).alias("view"), F.avg("value").alias("value")))
    return views[0].union(views[1]).groupBy("node").agg(F.round(F.avg("value"), 6).alias("value"))


