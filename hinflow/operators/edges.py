"""Edge tables: columns src, dst. All built-in, all one shuffle at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def coalesced(edges: DataFrame) -> DataFrame:
    """Distinct edges."""
    return edges.select("src", "dst").distinct()


def symmetrized(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    return edges.select("src", "dst").union(reverse(edges)).distinct()


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def with_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` and one loop per node of ``nodes`` (column node); a loop that is there stays single."""
    return edges.select("src", "dst").union(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))).distinct()


def upper_triangle(edges: DataFrame) -> DataFrame:
    return edges.where("src < dst")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs as (smaller, larger), loops left out."""
    return without_loops(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def attached(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Edges whose ends are both known nodes (column node)."""
    targets = sources if targets is None else targets
    kept = edges.join(sources.select(F.col("node").alias("src")), "src", "left_semi")
    return kept.join(targets.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree) of the sources of distinct edges."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, nbrs): sorted distinct neighbours. Rows grow with a hub's degree; use for sinks only."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("nbrs"))


def rendered(edges: DataFrame) -> DataFrame:
    """One text line per source: ``src nbr nbr ...``."""
    return adjacency(edges).select(F.concat_ws(" ", F.col("src").cast("string"), F.array_join(F.col("nbrs").cast("array<string>"), " ")).alias("line"))


def parsed(lines: DataFrame, lo: Column | int = 0, n: int | None = None) -> DataFrame:
    """Edges from text lines (column line); ids are shifted by ``lo`` and kept within [0, n)."""
    parts = F.split(F.trim("line"), r"\s+")
    edges = lines.select(F.get(parts, F.lit(0)).try_cast("bigint").alias("src"), F.explode(F.transform(F.slice(parts, 2, 1 << 30), lambda x: x.try_cast("bigint"))).alias("dst"))
    edges = edges.select((F.col("src") - lo).alias("src"), (F.col("dst") - lo).alias("dst"))
    inside = (F.col("src") >= 0) & (F.col("dst") >= 0)
    return edges.where(inside if n is None else inside & (F.col("src") < n) & (F.col("dst") < n)).distinct()


def line_degree(lines: DataFrame) -> DataFrame:
    """(node, degree) straight from text lines; a node is not its own neighbour."""
    parts = F.split(F.trim("line"), r"\s+")
    own = F.get(parts, F.lit(0))
    return lines.select(own.try_cast("bigint").alias("node"), F.size(F.filter(F.slice(parts, 2, 1 << 30), lambda x: x != own)).cast("bigint").alias("degree"))


def offsets(edges: DataFrame, group: Column | None = None) -> DataFrame:
    """(src, degree, start): where a source's slice starts in an edge list sorted by source.

    The prefix sum runs over ranges of sources: sums of the ranges first, then
    each range by itself, so no task holds all sources.
    """
    d = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    share = F.floor(F.col("src") / (group if group is not None else F.lit(4096)))
    d = d.withColumn("share", share)
    before = F.coalesce(F.sum("n").over(W.orderBy("share").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = d.groupBy("share").agg(F.sum("degree").alias("n")).select("share", before.alias("ahead"))
    within = F.coalesce(F.sum("degree").over(W.partitionBy("share").orderBy("src").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.join(ahead, "share").select("src", "degree", (F.col("ahead") + within).alias("start"))


def capped(edges: DataFrame, n: int) -> DataFrame:
    """The first ``n`` neighbours of each source, by id."""
    return edges.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("dst"))).where(F.col("r") <= n).select("src", "dst")


def normalised(edges: DataFrame, d: DataFrame | None = None) -> DataFrame:
    """(src, dst, row_weight, sym_weight): 1/d(src) and 1/sqrt(d(src) d(dst)), by out-degree or by ``d`` (node, degree)."""
    d = degree(edges) if d is None else d
    s, t = d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), d.select(F.col("node").alias("dst"), F.col("degree").alias("dt"))
    return edges.join(s, "src").join(t, "dst").select(
        "src", "dst", (F.lit(1.0) / F.col("ds")).alias("row_weight"), (F.lit(1.0) / F.sqrt(F.col("ds").cast("double") * F.col("dt"))).alias("sym_weight")
    )


def density(edges: DataFrame, n: DataFrame) -> DataFrame:
    """Directed, undirected and per-peer-pair density of a graph on ``n`` (one row, column n) nodes."""
    e = edges.agg(F.count(F.lit(1)).alias("e"), F.count_distinct(F.when(F.col("src") != F.col("dst"), F.struct(F.least("src", "dst"), F.greatest("src", "dst")))).alias("u"))
    pairs = F.col("n").cast("double") * (F.col("n") - 1)
    return e.crossJoin(n).select(
        F.col("e").alias("edges"), F.col("u").alias("undirected"), (F.col("e") / pairs).alias("density"),
        (2 * F.col("u") / pairs).alias("undirected_density"), (F.col("e") / (F.col("n").cast("double") * F.col("n"))).alias("peer_density"),
    )


def density_class(d: Column) -> Column:
    """Fixed limits: 0.05, 0.2, 0.5."""
    return F.when(d < 0.05, "sparse").when(d < 0.2, "medium").when(d < 0.5, "dense").otherwise("saturated")
