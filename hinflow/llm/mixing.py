"""Mixing sources to target weights by weighted sampling without replacement
(operator 9, built-in functions only).

Targets: sources in code-point order, null last, weigh 5, 2, 1 and so on; they
share ``share`` times all words by weight. A source stops at ``cap`` times its
words; what it leaves is shared again by weight (water filling, in closed form
over the sources sorted by cap / weight).

Selection: with u uniform in (0, 1) from a hash of seed and identifier, and w
the quality weight of a document, the key -ln(u) / w orders a source as
Efraimidis and Spirakis sample it. Complete epochs come first; the rest of a
target is filled in key order by a prefix sum of words, and the one document
whose size is nearest to the remaining gap closes it.

Prefix sums do not gather a source in one task. Keys are cut into ranges of
about RANGE rows, sums of ranges are accumulated per source, and each range is
summed by itself, so a source with a third of all rows spreads over many tasks.

Defined results: a null text has size 0 and takes nothing; a null source is a
source; repeated rows count each for itself; an empty table gives an empty
table; further columns are not read. Reruns agree: nothing depends on
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import located, locator, words_of, written

WEIGHTS = (5, 2, 1)
RANGE = 2000


def uniform(key: Column, seed: int) -> Column:
    """A double in (0, 1) from 52 bits of a digest."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less with the share of symbols, at least 0.1."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))
    return F.greatest(F.lit(1.0) - symbols / F.greatest(F.length(text), F.lit(1)), F.lit(0.1))


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Adds target, epochs and rest to one row per source (source, total, ...)."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("rank", rank).withColumn("w", w).withColumn("most", F.lit(cap) * F.col("total"))
    order = W.orderBy(F.col("most") / F.col("w"), "rank")
    before, everyone = order.rowsBetween(W.unboundedPreceding, -1), W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.select(
        "*",
        F.row_number().over(order).alias("k"),
        (F.lit(share) * F.sum("total").over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
    )
    s = s.withColumn("level", F.col("left") / F.col("w_left"))
    first = F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct("k", "level"))).over(everyone)
    s = s.withColumn("first", first)
    s = s.withColumn("target", F.when(F.col("k") < F.col("first.k"), F.col("most")).otherwise(F.col("first.level") * F.col("w")))
    epochs = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    return s.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("total"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 42,
) -> DataFrame:
    """One row per row of ``docs``: file, row, id, source, size, source_size, target, copies.

    ``docs`` must be a plain read of parquet files: file and row are its locator.
    """
    text, weight = F.col(text_col), quality_weight(F.col(text_col))
    rows = docs.select(
        *locator(), F.col(id_col).alias("id"),
        F.col(source_col).alias("source"), F.size(words_of(text)).cast("long").alias("size"), weight.alias("w"),
    )
    rows = written(rows.select("*", (-F.log(uniform(F.col("id"), seed)) / F.col("w")).alias("key")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_w"))
    sources = written(
        source_targets(sources, weights, share, cap).select(F.col("source").alias("of"), "total", "n", "mean_w", "target", "epochs", "rest"), "sources"
    )
    ranges = F.ceil(F.col("n") / RANGE)
    cut = F.floor(ranges * (1 - F.exp(-F.col("key") * F.col("mean_w"))))
    known = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("cut", cut)
    sums = known.groupBy("source", "cut").agg(F.sum("size").alias("s"))
    ahead = F.coalesce(F.sum("s").over(W.partitionBy("source").orderBy("cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s_of"), F.col("cut").alias("s_cut"), ahead.alias("ahead"))
    placed = known.join(sums, F.col("source").eqNullSafe(F.col("s_of")) & (F.col("cut") == F.col("s_cut")))
    within = W.partitionBy("source", "cut").orderBy("key", "id", "file", "row").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.select("file", "row", "id", "source", "size", "key", "total", "target", "epochs", "rest", (F.col("ahead") + F.sum("size").over(within)).alias("upto"))
    placed = written(placed.withColumn("chosen", F.col("upto") <= F.col("rest")), "placed")

    gaps = placed.groupBy("source").agg((F.max("rest") - F.coalesce(F.max(F.when(F.col("chosen"), F.col("upto"))), F.lit(0))).alias("gap"))
    gaps = written(gaps.withColumnRenamed("source", "g_of"), "gaps")
    near = F.abs(F.col("size") - F.col("gap"))
    closing = placed.where(~F.col("chosen")).join(gaps, F.col("source").eqNullSafe(F.col("g_of"))).where(near < F.col("gap"))
    closing = closing.groupBy("source").agg(F.min(F.struct(near.alias("near"), F.col("key"), F.col("id"), F.col("file"), F.col("row"))).alias("c"))
    closing = written(closing.select(F.col("source").alias("c_of"), F.col("c.file").alias("c_file"), F.col("c.row").alias("c_row")), "closing")
    out = placed.join(closing, F.col("source").eqNullSafe(F.col("c_of")), "left")
    closes = F.coalesce((F.col("file") == F.col("c_file")) & (F.col("row") == F.col("c_row")), F.lit(False))
    copies = F.col("epochs") + (F.col("chosen") | closes).cast("long")
    return out.select("file", "row", "id", "source", "size", F.col("total").alias("source_size"), "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: documents with the columns of ``docs``, each as often as it is taken."""
    docs = located(docs)
    taken = mix(docs, **options).where("copies > 0").select("file", "row", "copies")
    doc = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__doc"), *locator())
    repeated = doc.join(taken, ["file", "row"]).select("__doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return repeated.select("__doc.*")
