"""URL filter by rules and a character language-model ratio (operator 6).

Rules come first: a rule fits its host and all subdomains if the path starts
with the rule's, and the longest one that fits decides. All other URLs are
judged by two smoothed variable-order Markov models over bytes, one fitted to
URLs that the rules allow, one to URLs that they block. The score is the
log-likelihood difference per byte; a logistic curve fitted to labelled URLs
held out from the models turns it into a probability.

What the models gather grows with the input, and nothing is hashed: a gram, a
byte with the ORDERS - 1 bytes before it, is a number of 40 bits, and the
counts of all grams of all labelled URLs are a Spark table. A byte's score is a
function of its gram, so it is worked out once per different gram, by joins
with the counts of each order. The FREQUENT most frequent grams are then
broadcast (a megabyte, whatever the input), and every URL adds up those in one
pass; only its rare grams are joined with the table of scores, and since the
frequent ones are not among them no join key is hot. Scores are whole numbers
of a millionth, so sums do not depend on their order.

Only the two-parameter calibration takes a sample: URLs whose hash falls below
a cut that lets through some ``max_calibration`` rows of each class, and one in
five at most; a URL that repeats counts once. These alone are left out of the models.

Defined results: a null URL, or one without "://", has an empty host and path
and is judged by the models; if a class has no labelled URL there is no model
and URLs without a rule are allowed with probability 1; repeated rows get equal
results; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import located, locator, lower_ascii, written

#: verdict, host, path
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDERS = 5
#: Orders whose tables have 256 ** SMALL_ORDERS rows at most, whatever the input: they are broadcast, since their few keys would be hot.
SMALL_ORDERS = 2
STRENGTH = 2.0
FREQUENT = 1 << 16
MAX_CALIBRATION = 20_000
UNIT = 1e6


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The deciding rule as a struct (rule, verdict), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))

    def fits(r):
        return ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])

    def told(r):
        return F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))

    return reduce(lambda chain, r: chain.when(fits(r), told(r)), ordered[1:], F.when(fits(ordered[0]), told(ordered[0])))


def grams_of(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all bytes and the URLs' lengths; URLs end with a zero byte and begin behind zero bytes."""
    raw = [(u or "").encode() + b"\0" for u in urls]
    pad = b"\0" * (ORDERS - 1)
    flat = np.frombuffer(b"".join(pad + r for r in raw), np.uint8).astype(np.int64)
    lengths = np.array([len(r) for r in raw], np.int64)
    shift = np.repeat((np.arange(len(raw)) + 1) * len(pad), lengths)
    at = np.arange(lengths.sum()) + shift
    grams = np.zeros(len(at), np.int64)
    for k in range(ORDERS):
        grams |= flat[at - k] << (8 * k)
    return grams, lengths


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n0, n1, n) of each batch: counts in the URLs of either class, and in all."""
    for batch in batches:
        urls, label = batch.column("url").to_pylist(), batch.column("label").to_numpy(zero_copy_only=False)
        grams, lengths = grams_of(urls)
        found, place = np.unique(grams, return_inverse=True)
        of = np.repeat(label, lengths)
        n = [np.bincount(place[of == y], minlength=len(found)) for y in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (found, *n, np.bincount(place, minlength=len(found)))], ["gram", "n0", "n1", "n"])


def gram_scores(grams: DataFrame) -> DataFrame:
    """(gram, n, w): occurrences and score of all grams in (gram, n0, n1, n), in units of 1 / UNIT.

    The probability of a byte after k bytes mixes its count there with the
    probability after k - 1 bytes, which weighs STRENGTH counts.
    """
    counts = grams.where("n0 + n1 > 0")
    out = grams.select("gram", "n")
    p = [F.lit(1 / 256), F.lit(1 / 256)]
    for k in range(ORDERS):
        mask = F.lit((1 << 8 * (k + 1)) - 1)
        byte = counts.groupBy(F.col("gram").bitwiseAND(mask).alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        context = byte.groupBy(F.shiftright("key", 8).alias("ck")).agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
        out = out.withColumn("k", F.col("gram").bitwiseAND(mask)).withColumn("kc", F.shiftright("k", 8))
        if k < SMALL_ORDERS:
            byte, context = F.broadcast(byte), F.broadcast(context)
        out = out.join(byte, F.col("k") == F.col("key"), "left").join(context, F.col("kc") == F.col("ck"), "left")
        none = F.lit(0)
        p = [(F.coalesce(F.col(f"n{y}"), none) + STRENGTH * F.col(f"p{y}") if k else F.coalesce(F.col(f"n{y}"), none) + STRENGTH * p[y]) / (F.coalesce(F.col(f"c{y}"), none) + STRENGTH) for y in (0, 1)]
        out = out.select("gram", "n", p[0].alias("p0"), p[1].alias("p1"))
    return out.select("gram", "n", F.round((F.log("p1") - F.log("p0")) * UNIT).cast("long").alias("w"))


def _added(known):
    """Per URL the sum over frequent grams, the number of bytes, and the rare grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = known.value
        for batch in batches:
            grams, lengths = grams_of(batch.column("url").to_pylist())
            place = np.minimum(np.searchsorted(keys, grams), max(len(keys) - 1, 0))
            hit = keys[place] == grams if len(keys) else np.zeros(len(grams), bool)
            of = np.repeat(np.arange(len(lengths)), lengths)
            total = np.zeros(len(lengths), np.int64)
            np.add.at(total, of[hit], weights[place[hit]])
            rare = np.bincount(of[~hit], minlength=len(lengths))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)]).astype(np.int32)), pa.array(grams[~hit]))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), pa.array(total), pa.array(lengths), lists], ["file", "row", "frequent", "length", "rare"])

    return run


def scores(urls: DataFrame, weights: DataFrame) -> DataFrame:
    """(file, row, score): log-likelihood difference per byte of (file, row, url)."""
    top = weights.orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram", "w").orderBy("gram").toArrow()
    known = urls.sparkSession.sparkContext.broadcast((top["gram"].to_numpy(), top["w"].to_numpy()))
    parts = written(urls.mapInArrow(_added(known), "file string, row long, frequent long, length long, rare array<long>"), "url-parts")
    rare = parts.select("file", "row", F.explode("rare").alias("gram")).join(weights.select("gram", "w"), "gram")
    rest = rare.groupBy("file", "row").agg(F.sum("w").alias("rest"))
    total = F.col("frequent") + F.coalesce(F.col("rest"), F.lit(0))
    return parts.select("file", "row", "frequent", "length").join(rest, ["file", "row"], "left").select("file", "row", (total / F.col("length") / UNIT).alias("score"))


def _platt(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(allow) by ridge Newton steps, classes weighing the same."""
    if label.min(initial=1) == label.max(initial=0) or not len(score):
        return 1.0, 0.0
    spread = score.std() or 1.0
    x = np.stack([score / spread, np.ones_like(score)], 1)
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (label - p)) - 1e-2 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(hess, g)
    return float(beta[0] / spread), float(beta[1])


def held_out(url: Column, label: Column, sizes: dict[int, int], most: int) -> Column:
    """Whether a labelled URL serves calibration: by hash, some ``most`` rows of each class, and one in five at most."""
    place = F.pmod(F.xxhash64(url), F.lit(1_000_000))
    cut = {y: int(1_000_000 * min(0.2, most / max(n, 1))) for y, n in sizes.items()}
    return reduce(lambda c, y: c | ((label == y) & (place < cut[y])), cut, F.lit(False))


def url_filter(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_calibration: int = MAX_CALIBRATION) -> DataFrame:
    """(id, host, path, rule, verdict, score, p_allow), one row per page; URLs with a rule have no score."""
    pages = located(pages)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), *locator()).select("id", "url", "file", "row", host.alias("host"), path.alias("path"))
    label = F.coalesce((F.col("r.verdict") == "allow").cast("int"), F.lit(-1))
    parsed = written(parsed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("label", label), "urls")
    sizes = {r["label"]: r["n"] for r in parsed.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ruled = F.col("r.verdict")
    if len(sizes) < 2:
        out = parsed.select("*", F.lit(None).cast("double").alias("score"), F.when(ruled.isNull(), F.lit(1.0)).alias("p_allow"))
    else:
        held = held_out(F.col("url"), F.col("label"), sizes, max_calibration)
        fed = parsed.select("url", F.when(held, -1).otherwise(F.col("label")).alias("label"))
        grams = fed.mapInArrow(_counted, "gram long, n0 long, n1 long, n long").groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "n")))
        weights = written(gram_scores(written(grams, "grams")), "gram-scores")
        asked = parsed.where((F.col("label") < 0) | held)
        scored = written(scores(asked.select("file", "row", "url"), weights), "scores").withColumnsRenamed({"file": "s_file", "row": "s_row"})
        joined = parsed.join(scored, (F.col("file") == F.col("s_file")) & (F.col("row") == F.col("s_row")), "left")
        sample = joined.where(held).select("url", "score", "label").distinct().toPandas()
        slope, intercept = _platt(sample["score"].to_numpy(float), sample["label"].to_numpy(float))
        odds = F.greatest(F.least(F.lit(slope) * F.col("score") + F.lit(intercept), F.lit(30.0)), F.lit(-30.0))
        out = joined.withColumn("score", F.when(ruled.isNull(), F.col("score"))).withColumn("p_allow", F.when(ruled.isNull(), 1 / (1 + F.exp(-odds))))
    verdict = F.coalesce(ruled, F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block"))
    return out.select("id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score", "p_allow")
