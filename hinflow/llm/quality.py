"""Quality rules judged by host (operator 4, built-in functions only).

Per document a few counts are taken in one scan. Per host (the ``source`` of a
document) the failures of each rule are added up, and the failure rate is
shrunk towards the corpus with a beta prior fitted to the spread of the hosts'
rates. A host whose shrunk rate reaches ``host_limit`` has the rule *enforced*:
its documents that fail the rule go. Elsewhere a failure of a host-level rule
is tolerated. Documents that fail a base rule go everywhere.

Plan: one scan makes narrow counts; hosts are a partial and a final aggregate;
the join back is a broadcast only while Spark finds the written host table
small, else a sort-merge join whose hot hosts AQE splits.

Defined results: a null or empty text has no words and fails; a null host is a
host of its own; repeated rows are judged each for itself; an empty table gives
an empty table; further columns are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, words_of, written

MIN_WORDS = 50
HOST_RULES = ("symbols", "lines")
RULES = ("short", "repeats", *HOST_RULES)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash within one document. Only a document
    with a repeated window pays for the sort that finds its positions.
    """

    def positions(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return bind(
            pairs,
            lambda s: F.array_sort(
                F.filter(
                    F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, j - 1)["h"]), x["i"])),
                    lambda p: p.isNotNull(),
                )
            ),
        )

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - v, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(positions(h), covered)))


def counts(text: Column) -> Column:
    """A struct of the counts that the rules look at."""
    text = F.coalesce(text, F.lit(""))
    from_words = bind(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    from_lines = bind(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))
    return F.struct(from_words.alias("w"), from_lines.alias("l"), symbols.cast("long").alias("n_symbols"))


def failures(c: Column) -> dict[str, Column]:
    """Which rules a document fails, given its counts."""
    w, lines = c["w"], c["l"]
    return {
        "short": w["n_words"] < MIN_WORDS,
        "repeats": 100 * w["n_repeat_words"] > 50 * w["n_words"],
        "symbols": 10 * c["n_symbols"] > w["word_chars"],
        "lines": 10 * lines["n_dup_lines"] > 3 * lines["n_lines"],
    }


def host_verdicts(judged: DataFrame, host: str, failed: str, host_limit: float) -> DataFrame:
    """Per host: documents, and per rule whether it is enforced there.

    ``failed`` is a struct of booleans named as RULES. The prior of a rule has
    the corpus rate m as its mean; its strength s follows from the variance v
    of the hosts' rates beyond sampling noise: s = m(1-m)/v - 1, kept in
    [1, 1e6]. The shrunk rate is (failures + m s) / (documents + s).
    """
    hosts = judged.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(failed)[r].cast("long")).alias(f"f_{r}") for r in RULES))
    hosts = written(hosts, "hosts")
    totals = hosts.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("H"), *(F.sum(f"f_{r}").alias(f"F_{r}") for r in RULES)).first()
    n, h = totals["N"] or 1, totals["H"] or 1
    mean = {r: (totals[f"F_{r}"] or 0) / n for r in RULES}
    spread = hosts.agg(*(F.sum(F.pow(F.col(f"f_{r}") / F.col("n") - F.lit(mean[r]), 2) * F.col("n")).alias(r) for r in RULES)).first()
    shrunk = {}
    for r in RULES:
        noise = mean[r] * (1 - mean[r])
        between = max((spread[r] or 0.0) / n - noise * h / n, 0.0)
        strength = min(max(noise / between - 1 if between > 0 else 1e6, 1.0), 1e6)
        shrunk[r] = (F.col(f"f_{r}") + F.lit(mean[r] * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select(host, *(shrunk[r].alias(f"rate_{r}") for r in RULES), *((shrunk[r] >= host_limit).alias(f"enforced_{r}") for r in RULES))


def quality_rules(docs: DataFrame, *, text: str = "text", host: str = "source", carry: list[str] | None = None, host_limit: float = 0.2) -> DataFrame:
    """``carry`` (default: all columns of ``docs``) and a struct ``quality``.

    ``quality`` holds the counts, ``base_failed``, ``kept`` and the host's
    shrunk failure rates. If ``docs`` has a column of that name, it is replaced.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != "quality"]
    c = counts(F.col(text))
    base = docs.select(F.struct(*(docs[x] for x in carry)).alias("__doc"), F.col(host).alias("__host"), c.alias("__counts"))
    failed = F.struct(*(v.alias(k) for k, v in failures(F.col("__counts")).items()))
    base = written(base.withColumn("__failed", failed), "quality")
    verdicts = host_verdicts(base, "__host", "__failed", host_limit)
    verdicts = written(verdicts.withColumnRenamed("__host", "__h"), "verdicts")
    joined = base.join(verdicts, base["__host"].eqNullSafe(verdicts["__h"]), "left")
    base_failed = F.col("__failed.short") | F.col("__failed.repeats")
    by_host = F.lit(False)
    for r in HOST_RULES:
        by_host = by_host | (F.col(f"__failed.{r}") & F.col(f"enforced_{r}"))
    quality = F.struct(
        *(F.col(f"__counts.{f}").alias(f.rpartition(".")[2]) for f in ("w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words")),
        base_failed.alias("base_failed"),
        (~base_failed & ~by_host).alias("kept"),
        *(F.col(f"rate_{r}") for r in RULES),
    )
    return joined.select("__doc.*", quality.alias("quality"))
