"""The queries opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact, licenses, lm, mixing, packing, pii, quality, secrets, simhash, substrings, urls, variants
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.id").alias("component_id"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(spark, table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(f"quality.{n}" for n in names))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(table(spark, sf_dir, "documents"), pii.DEMO_KEY).withColumnRenamed("id", "doc_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = F.filter("spans", lambda x: x["kind"] < 3)

    def n(kind: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{secrets.KINDS[kind]}")

    return found.select("doc_id", n(0), n(1), n(2), F.sha2(secrets.rendered(base), 256).alias("base_sha256"), secrets.rendered(F.col("spans")).alias("spans"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op9_mixing": op9_mixing,
    "op10_secret_scan": op10_secret_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lm_scores": op12_lm_scores,
    "op13_source_divergence": op13_source_divergence,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        with t as (select doc_id, {LOWER} as x from documents)
        select doc_id, max(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
               doc_id = max(doc_id) over (partition by x) as kept, sha256(x) as text_sha256
        from t""",
    "op4_quality_rules": r"""
        with t as (select doc_id, source, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        win as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as g
                from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from t where len(w) >= 3)),
        rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
        cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i+1, i+2]) as p from rep) group by doc_id),
        ln as (select doc_id, unnest(string_split(x, chr(10))) as l from t),
        lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup from ln where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
        c as (select t.doc_id, t.source, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
                     length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup, 0) as n_dup_lines,
                     coalesce(n_lines, 0) as n_lines, coalesce(cov.n, 0) as n_repeat_words
              from t left join cov using (doc_id) left join lines using (doc_id)),
        f as (select *, (n_words < 50)::int as f_short, (100 * n_repeat_words > 50 * n_words)::int as f_repeats,
                     (10 * n_symbols > word_chars)::int as f_symbols, (10 * n_dup_lines > 3 * n_lines)::int as f_lines from c),
        h as (select source, count(*) as n, sum(f_symbols) as s, sum(f_lines) as l from f group by source),
        m as (select sum(s) / sum(n) as ms, sum(l) / sum(n) as ml, sum(n) as nn, count(*) as hh from h),
        v as (select any_value(ms) as ms, any_value(ml) as ml, any_value(nn) as nn, any_value(hh) as hh,
                     greatest(sum(n * pow(s / n - ms, 2)) / any_value(nn) - any_value(ms * (1 - ms) * hh / nn), 0) as vs,
                     greatest(sum(n * pow(l / n - ml, 2)) / any_value(nn) - any_value(ml * (1 - ml) * hh / nn), 0) as vl from h, m),
        k as (select ms, ml, least(greatest(case when vs > 0 then ms * (1 - ms) / vs - 1 else 1e6 end, 1), 1e6) as ks,
                     least(greatest(case when vl > 0 then ml * (1 - ml) / vl - 1 else 1e6 end, 1), 1e6) as kl from v),
        e as (select source, (s + ms * ks) / (n + ks) >= 0.2 as es, (l + ml * kl) / (n + kl) >= 0.2 as el from h, k)
        select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
               n_repeat_words::bigint as n_repeat_words, f_short + f_repeats > 0 as base_failed,
               not (f_short + f_repeats > 0 or (f_symbols = 1 and es) or (f_lines = 1 and el)) as kept
        from f join e on f.source is not distinct from e.source""",
    "op9_mixing": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                          greatest(1.0::double - (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::double
                                   / greatest(length(coalesce(text, '')), 1)::double, 0.1::double) as w,
                          (('0x' || substr(md5('42:' || doc_id::varchar), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u from documents),
        s0 as (select source, sum(size)::bigint as total, row_number() over (order by source nulls last) as r from d group by source),
        s1 as (select *, case (r - 1) % 3 when 0 then 5 when 1 then 2 else 1 end::double as sw, 2.0::double * total as most from s0),
        s2 as (select *, row_number() over (order by most / sw, r) as k,
                      1.5::double * (sum(total) over ())::double - coalesce(sum(most) over (order by most / sw, r rows between unbounded preceding and 1 preceding), 0) as lft,
                      sum(sw) over () - coalesce(sum(sw) over (order by most / sw, r rows between unbounded preceding and 1 preceding), 0) as wl from s1),
        s3 as (select *, lft / wl as lvl from s2),
        f as (select min(k) as fk, arg_min(lvl, k) as fl from s3 where lvl <= most / sw),
        s4 as (select source, total, case when k < fk then most else fl * sw end as target from s3, f),
        s5 as (select *, case when total > 0 then floor(target / total) else 0 end::bigint as ep from s4),
        s6 as (select *, target - ep * total as rest from s5),
        p as (select d.doc_id, d.size, d.source, total, target, ep, rest, -ln(u) / w as key,
                     sum(size) over (partition by d.source order by -ln(u) / w, doc_id rows unbounded preceding) as upto
              from d join s6 on d.source is not distinct from s6.source),
        g as (select source, max(rest) - coalesce(max(case when upto <= rest then upto end), 0) as gap from p group by source),
        c as (select p.source, arg_min(doc_id, {'a': abs(size - gap), 'b': key, 'c': doc_id}) as cid
              from p join g on p.source is not distinct from g.source where not (upto <= rest) and abs(size - gap) < gap group by p.source)
        select doc_id, size, total as source_size, target, (size * (ep + (upto <= rest or coalesce(doc_id = cid, false))::int))::bigint as taken
        from p left join c on p.source is not distinct from c.source""",
    "op13_source_divergence": r"""
        with t as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
        x as (select d, lang, source, unnest(w) as term from t),
        k as (select lang, term, count(*)::hugeint as n from x group by all having count(distinct d) >= 10),
        l as (select lang, sum(n)::hugeint as total, count(*)::hugeint as v from k group by lang),
        g as (select distinct lang, source from t),
        c as (select x.lang, source, term, count(*)::hugeint as n from x join k using (lang, term) group by all),
        gt as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint as total from g left join c on c.lang = g.lang and c.source = g.source group by all),
        p as (select k.lang, gt.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (gt.total + 2 * l.v) as p,
                     1 + (1000000000::hugeint * (k.n + 2)) // (l.total + 2 * l.v) as q
              from k join gt using (lang) join l using (lang) left join c on c.lang = k.lang and c.term = k.term and c.source = gt.source),
        pv as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        pr as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
               from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
        tm as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where n > 0 and p > q),
        r as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pr union all select * from tm))
        select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10""",
}
