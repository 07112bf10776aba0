"""Meta-path strings and closed formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(path: Column) -> Column:
    """Relation names trimmed, in small letters, with doubled ``rev_`` marks taken off."""
    one = lambda r: F.regexp_replace(F.regexp_replace(F.lower(F.trim(r)), "^inverse_", "rev_"), "^(rev_rev_)+", "")
    return F.array_join(F.transform(F.split(path, ","), one), ",")


def mirrored(path: Column) -> Column:
    """``a,b`` becomes ``a,b,rev_b,rev_a``; a reversed step turns forward again."""
    turn = lambda r: F.when(r.startswith("rev_"), F.substring(r, 5, 1 << 20)).otherwise(F.concat(F.lit("rev_"), r))
    steps = F.split(path, ",")
    return F.array_join(F.concat(steps, F.transform(F.reverse(steps), turn)), ",")


def short_name(path: Column) -> Column:
    """Initials of the node types along ``a_to_b,b_to_c``: ``ABC``."""
    steps = F.split(path, ",")
    first = F.upper(F.substring(F.get(steps, F.lit(0)), 1, 1))
    ends = F.transform(steps, lambda s: F.upper(F.substring(F.element_at(F.split(s, "_to_"), -1), 1, 1)))
    return F.concat(first, F.array_join(ends, ""))


def coupon_walks(d: Column, k: Column) -> Column:
    """Expected uniform draws until ``k`` of ``d`` kinds are seen: d (H_d - H_{d-k})."""
    terms = F.when(k >= 1, F.sequence(d - k + 1, d)).otherwise(F.array().cast("array<int>"))
    return d * F.aggregate(terms, F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)


def validated(path: Column, ends: Column, target: Column) -> Column:
    """struct(path, reason): the part of ``path`` from the first step that leaves ``target`` on, if the path is sound.

    ``ends`` maps a relation to struct(src, dst) of types. Reasons, the first
    that applies: ``unknown`` (a relation without types), ``gap`` (a step does
    not start where the one before ends), ``start`` (no step leaves the
    target), ``end`` (the last one does not reach it); null if sound. A step
    that is there counts even where it is trimmed off.
    """
    start = F.struct(F.lit(None).cast("string").alias("at"), F.lit(False).alias("unknown"), F.lit(False).alias("gap"), F.array().cast("array<string>").alias("kept"), target.alias("target"))

    def follow(s: Column, name: Column) -> Column:
        types = ends[name]
        on = (F.size(s["kept"]) > 0) | F.coalesce(types["src"] == s["target"], F.lit(False))
        gap = F.coalesce(s["at"] != types["src"], F.lit(False))
        return F.struct(types["dst"].alias("at"), (s["unknown"] | types.isNull()).alias("unknown"), (s["gap"] | gap).alias("gap"), F.when(on, F.concat(s["kept"], F.array(name))).otherwise(s["kept"]).alias("kept"), s["target"].alias("target"))

    def judged(s: Column) -> Column:
        reason = F.when(s["unknown"], "unknown").when(s["gap"], "gap").when(F.size(s["kept"]) == 0, "start").when(s["at"] != s["target"], "end")
        return F.struct(F.when(reason.isNull(), F.array_join(s["kept"], ",")).alias("path"), reason.alias("reason"))

    return F.aggregate(F.split(path, ","), start, follow, judged)
