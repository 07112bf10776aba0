"""Tests and intervals over repeated runs: Student's t, equivalence, signed ranks.

Distribution functions are column expressions: a continued fraction or a series
folded over a sequence, so that they run where the groups are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import mean_std
from .ranking import ranked

#: Groups with fewer differences are not tested.
LEAST = 5
#: Up to so many differences the law of the rank sum is exact; beyond, normal.
EXACT = 50


def _lit(x: float) -> Column:
    return F.lit(float(x))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x), x > 0: Stirling's series eight steps up, some 1e-13."""
    z = x + _lit(8)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, _lit(3))) + 1 / (1260 * F.pow(z, _lit(5))) - 1 / (1680 * F.pow(z, _lit(7)))
    steps = x
    for i in range(1, 8):
        steps = steps * (x + _lit(i))
    return (z - 0.5) * F.ln(z) - z + _lit(0.5 * math.log(2 * math.pi)) + series - F.ln(steps)


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 100) -> Column:
    """I_x(a, b), the regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    swap = x > (a + 1) / (a + b + 2)
    value = lambda s: F.pow(s["x"], s["a"]) * F.pow(1 - s["x"], s["b"]) / s["a"] * F.exp(log_gamma(s["a"] + s["b"]) - log_gamma(s["a"]) - log_gamma(s["b"])) * s["h"]
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    d = 1 / (1 - (p + q) * y / (p + 1))
    start = F.struct(p.alias("a"), q.alias("b"), y.alias("x"), _lit(1).alias("c"), d.alias("d"), d.alias("h"), swap.alias("swap"))

    def fraction(s: Column, up: Column) -> Column:
        c, d = 1 + up / s["c"], 1 / (1 + up * s["d"])
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), s["x"].alias("x"), c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"), s["swap"].alias("swap"))

    def term(s: Column, k: Column) -> Column:
        """Terms alternate: the even ones of the fraction, then the odd ones."""
        m = F.floor(k / 2).cast("double")
        even = m * (s["b"] - m) * s["x"] / ((s["a"] + 2 * m - 1) * (s["a"] + 2 * m))
        odd = -(s["a"] + m) * (s["a"] + s["b"] + m) * s["x"] / ((s["a"] + 2 * m) * (s["a"] + 2 * m + 1))
        return fraction(s, F.when(k % 2 == 0, even).otherwise(odd))

    done = F.aggregate(F.sequence(F.lit(2), F.lit(2 * terms + 1)), start, term, lambda s: F.when(s["swap"], 1 - value(s)).otherwise(value(s)))
    return F.when(x <= 0, _lit(0)).when(x >= 1, _lit(1)).otherwise(done)


def t_tails(t: Column, df: Column) -> Column:
    """P(|T| >= |t|)."""
    return incomplete_beta(df / (df + t * t), df / 2, _lit(0.5))


def t_upper(t: Column, df: Column) -> Column:
    """P(T >= t)."""
    half = t_tails(t, df) / 2
    return F.when(t >= 0, half).otherwise(1 - half)


def t_quantile(tails: float, df: Column) -> Column:
    """The t with P(|T| >= t) = ``tails``, by halving the interval of df / (df + t t) sixty times."""

    def halved(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        more = incomplete_beta(mid, s["df"] / 2, _lit(0.5)) > tails
        return F.struct(F.when(more, s["lo"]).otherwise(mid).alias("lo"), F.when(more, mid).otherwise(s["hi"]).alias("hi"), s["df"].alias("df"))

    start = F.struct(_lit(0).alias("lo"), _lit(1).alias("hi"), df.cast("double").alias("df"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halved, lambda s: F.sqrt(s["df"] * (1 - s["lo"]) / s["lo"]))


def normal_tails(z: Column) -> Column:
    """P(|Z| >= |z|), by the series of the error function whose terms are all positive."""
    x = F.least(F.abs(z), _lit(12)) / _lit(math.sqrt(2))
    start = F.struct((x * F.exp(-x * x)).alias("t"), (x * F.exp(-x * x)).alias("s"), x.alias("x"))
    step = lambda s, n: F.struct((s["t"] * 2 * s["x"] * s["x"] / (2 * n + 1)).alias("t"), (s["s"] + s["t"] * 2 * s["x"] * s["x"] / (2 * n + 1)).alias("s"), s["x"].alias("x"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(400)), start, step, lambda s: F.greatest(1 - s["s"] * _lit(2 / math.sqrt(math.pi)), _lit(0)))


def t_interval(rows: DataFrame, keys: list[str], value: str, tails: float = 0.05) -> DataFrame:
    """(keys, mean, half_width) by Student's t with n - 1 degrees of freedom; a single value has half-width 0, none has null."""
    s = mean_std(rows, keys, value).where("n > 0")
    # One quantile for each size of a group, not for each group.
    t = s.select("n").distinct().withColumn("t", t_quantile(tails, F.greatest(F.col("n") - 1, F.lit(1))))
    s = s.join(t, "n")
    width = F.col("t") * F.col("std_samp") / F.sqrt(F.col("n").cast("double"))
    return s.select(*keys, "mean", F.when(F.col("n") == 1, _lit(0)).otherwise(width).alias("half_width"), "n")


def equivalence(rows: DataFrame, keys: list[str], diff: str, margin: float, level: float = 0.05) -> DataFrame:
    """(keys, n, p_lower, p_upper, p_max, decision): two one-sided t-tests that the mean difference lies within +-``margin``.

    Below LEAST differences p-values are null and the decision says so; without
    spread they are 0 within the margin and 1 outside. Null differences do not count.
    """
    s = mean_std(rows, keys, diff)
    tested, spread = F.col("n") >= LEAST, F.col("std_samp") > 0
    error, df = F.col("std_samp") / F.sqrt(F.col("n").cast("double")), (F.col("n") - 1).cast("double")
    flat = F.when(F.abs(F.col("mean")) < margin, _lit(0)).otherwise(_lit(1))
    p = lambda t: F.when(tested, F.when(spread, t_upper(t, df)).otherwise(flat))
    s = s.select(*keys, "n", p((F.col("mean") + margin) / error).alias("p_lower"), p((_lit(margin) - F.col("mean")) / error).alias("p_upper"))
    s = s.withColumn("p_max", F.greatest("p_lower", "p_upper"))
    return s.withColumn("decision", F.when(F.col("p_max").isNull(), "INSUFFICIENT_SEEDS").when(F.col("p_max") < level, "REJECT_H0").otherwise("FAIL"))


def _sums_up_to(ranks: Column, most: Column) -> Column:
    """Share of the 2^n choices of ``ranks`` (whole numbers) whose sum is at most ``most``: their numbers by sum, one rank at a time."""
    zeros = lambda n: F.array_repeat(_lit(0), n)
    both = lambda a, r: F.zip_with(F.concat(a, zeros(r.cast("int"))), F.concat(zeros(r.cast("int")), a), lambda x, y: (x + y) / 2)
    law = F.aggregate(ranks, F.array(_lit(1)), both)
    return F.aggregate(F.slice(law, F.lit(1), most.cast("int") + 1), _lit(0), lambda a, x: a + x)


def signed_rank(rows: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """(keys, n, statistic, p): Wilcoxon's signed-rank test of differences against 0, both sides.

    Zeros are left out, ties share their mean rank, and the law of the rank sum
    given those ranks is exact up to EXACT differences, normal with the tie
    correction beyond. Below LEAST differences (zeros included) statistic and p
    are null; if all are zero they are 0 and 1. Null differences do not count.
    Differences are ranked in buckets, so a large group spreads over tasks.
    """
    rows = rows.where(F.col(diff).isNotNull())
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    by = rows.where(F.col(diff) != 0).groupBy(*keys, F.abs(diff).alias("size")).agg(F.count(F.lit(1)).alias("c"), F.sum((F.col(diff) > 0).cast("long")).alias("pos"))
    by = ranked(by.withColumnRenamed("c", "ties"), keys, F.floor(F.log1p(F.col("size")) * 64), ["size"], F.col("ties")).withColumnRenamed("n", "m")
    # Twice the mean rank is a whole number.
    twice = (2 * F.col("r") - F.col("ties") + 1).cast("long")
    sums = by.groupBy(*keys).agg(
        F.max("m").alias("m"), F.sum(twice * F.col("pos")).alias("up"), F.sum(twice * (F.col("ties") - F.col("pos"))).alias("down"),
        F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t3"), F.flatten(F.collect_list(F.when(F.col("m") <= EXACT, F.array_repeat(twice, F.col("ties").cast("int"))))).alias("ranks"),
    )
    s = whole.join(sums, keys, "left")
    least, m = F.least("up", "down"), F.col("m").cast("double")
    exact = F.least(2 * _sums_up_to(F.col("ranks"), least), _lit(1))
    z = (least / _lit(2) - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("t3") / 48)
    p = F.when(m <= EXACT, exact).when(m > EXACT, normal_tails(z))
    tested = F.col("n") >= LEAST
    return s.select(*keys, "n", F.when(tested, F.coalesce(least / _lit(2), _lit(0))).alias("statistic"), F.when(tested, F.coalesce(p, _lit(1))).alias("p"))
