"""Readers and writers of graph folders: native and HNE layouts, adjacency lists, triples."""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import ranked
from ..operators.sampling import induced, local_ids
from ..plans.scratch import written


def _lines(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


def _ints(c: str):
    return F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("int"))


def read_native(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node, types) and edges (src, dst, etype) of node.dat and link.dat; types are comma lists."""
    tsv = lambda name, cols: spark.read.csv(f"{folder}/{name}", sep="\t", schema=_lines(cols))
    nodes = tsv("node.dat", "node other types").select(F.col("node").try_cast("bigint").alias("node"), _ints("types").alias("types"))
    edges = tsv("link.dat", "src dst types").select(F.col("src").try_cast("bigint").alias("src"), F.col("dst").try_cast("bigint").alias("dst"), F.explode(_ints("types")).alias("etype"))
    return nodes, edges


def node_count(spark: SparkSession, folder: str) -> int:
    """The count in the first line of meta.dat, after its colon."""
    line = spark.read.text(f"{folder}/meta.dat").select(F.regexp_extract("value", r":\D*(\d+)", 1).alias("n")).where("n <> ''").first()
    return int(line["n"])


def of_type(nodes: DataFrame, kind: int) -> DataFrame:
    """Nodes that have the type among theirs."""
    return nodes.where(F.array_contains("types", kind)).select("node")


def read_hne(spark: SparkSession, folder: str, type_names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (node, type, local, x) and edges (src, dst, rel) of an HNE folder.

    Local ids follow the node ids within a type; a relation takes its name from
    the types of its ends; edges with an unknown end drop out.
    """
    raw = spark.read.csv(f"{folder}/node.dat", sep="\t", schema=_lines("id name type info"))
    kind = F.concat(F.lit("type_"), F.col("type"))
    if type_names:
        known = F.create_map(*(F.lit(x) for pair in type_names.items() for x in pair))
        kind = F.coalesce(known[F.col("type")], kind)
    nodes = raw.select(F.col("id").try_cast("bigint").alias("node"), kind.alias("type"), F.transform(F.split("info", ","), lambda v: v.try_cast("float")).alias("x"))
    nodes = nodes.join(local_ids(nodes.select("type", "node"), ["type"], "node"), ["type", "node"]).select("node", "type", "local", "x")
    ends = nodes.select("node", "type")
    links = spark.read.csv(f"{folder}/link.dat", sep="\t", schema=_lines("src dst kind weight")).select(F.col("src").try_cast("bigint").alias("src"), F.col("dst").try_cast("bigint").alias("dst"))
    edges = links.join(ends.toDF("src", "st"), "src").join(ends.toDF("dst", "dt"), "dst")
    return nodes, edges.select("src", "dst", F.concat_ws("_to_", "st", "dt").alias("rel"))


def read_labels(spark: SparkSession, folder: str) -> tuple[DataFrame, bool]:
    """(node, type, classes) with class numbers in label order, and whether some node has several."""
    raw = spark.read.csv(f"{folder}/label.dat", sep="\t", schema=_lines("id name type label"))
    rows = raw.select(F.col("id").try_cast("bigint").alias("node"), "type", F.explode(F.split("label", ",")).alias("label"))
    names = rows.select("label").distinct()
    numbered = ranked(names, [], F.substring("label", 1, 2), ["label"]).select("label", (F.col("r") - 1).alias("class"))
    out = rows.join(numbered, "label").groupBy("node", "type").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    return out, bool(out.where(F.size("classes") > 1).limit(1).count())


def write_native(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """node.dat, link.dat and meta.dat from nodes (node, types) and edges (src, dst, etype)."""
    rows = nodes.select(F.col("node").cast("string"), F.lit(""), F.array_join(F.col("types").cast("array<string>"), ","))
    rows.write.csv(f"{folder}/node.dat", sep="\t", emptyValue="")
    edges.select("src", "dst", "etype").write.csv(f"{folder}/link.dat", sep="\t")
    nodes.agg(F.concat(F.lit("Node Total: Count "), F.count(F.lit(1)).cast("string")).alias("value")).write.text(f"{folder}/meta.dat")


def write_typed(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A native folder of nodes (type, id) and edges (src_type, src, rel, dst_type, dst), with offsets.json.

    Types follow each other by name and nodes by id, so a global id is the
    type's offset plus the local id. offsets.json holds the offsets and the
    names of the relations by number; both are as many as the schema has.
    Ids are integers; edges with an end that is no node drop out.
    """
    counts = {r["type"]: r["count"] for r in nodes.groupBy("type").count().collect()}
    types = sorted(counts)
    offsets = dict(zip(types, accumulate((counts[t] for t in types), initial=0), strict=False))
    relations = sorted(r["rel"] for r in edges.select("rel").distinct().collect())
    number = lambda names, c: F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))), F.col(c)) if names else F.lit(0)
    start = F.element_at(F.create_map(*(F.lit(x) for t in types for x in (t, offsets[t]))), F.col("type")) if types else F.lit(0)
    ids = written(local_ids(nodes.select("type", "id"), ["type"], "id").select("type", "id", (F.col("local") + start).alias("node")), "ids")
    end = lambda side: ids.select(F.col("type").alias(f"{side}_type"), F.col("id").alias(side), F.col("node").alias(f"{side}_node"))
    links = edges.join(end("src"), ["src_type", "src"]).join(end("dst"), ["dst_type", "dst"])
    write_native(
        ids.select("node", F.array(number(types, "type")).alias("types")),
        links.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), number(relations, "rel").alias("etype")), folder,
    )
    nodes.sparkSession.createDataFrame([(json.dumps({"offsets": offsets, "relations": relations}),)], "value string").write.text(f"{folder}/offsets.json")


def read_offsets(spark: SparkSession, folder: str) -> tuple[dict[str, int], list[str]]:
    """First global id by type, and relation names by number."""
    found = json.loads(spark.read.text(f"{folder}/offsets.json").first()["value"])
    return found["offsets"], found["relations"]


def placed(node: Column, offsets: dict[str, int]) -> Column:
    """(type, local) of a global id; null before the first offset."""
    starts = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(at).cast("bigint").alias("at")) for t, at in sorted(offsets.items(), key=lambda x: x[1]))).cast("array<struct<type:string,at:bigint>>")
    own = F.try_element_at(F.filter(starts, lambda s: s["at"] <= node), F.lit(-1))
    return F.when(own.isNotNull(), F.struct(own["type"].alias("type"), (node - own["at"]).alias("local")))


def read_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Edges (rel, src_type, src, dst_type, dst) of a folder with offsets; src and dst are local ids."""
    offsets, relations = read_offsets(spark, folder)
    edges = read_native(spark, folder)[1].select(F.get(F.array(*map(F.lit, relations)).cast("array<string>"), F.col("etype")).alias("rel"), placed(F.col("src"), offsets).alias("a"), placed(F.col("dst"), offsets).alias("b"))
    return edges.select("rel", F.col("a.type").alias("src_type"), F.col("a.local").alias("src"), F.col("b.type").alias("dst_type"), F.col("b.local").alias("dst"))


def write_snowball(walked: DataFrame, seeds: DataFrame, folder: str) -> None:
    """A graph folder of the seeds (column node) and the edges (src, dst) that a snowball walked over, with their ends."""
    ends = walked.select(F.col("src").alias("node")).union(walked.select(F.col("dst").alias("node"))).union(seeds.select("node")).distinct()
    write_native(ends.select("node", F.array(F.lit(0)).alias("types")), walked.select("src", "dst", F.lit(0).alias("etype")), folder)


def write_adjacency(edges: DataFrame, path: str) -> None:
    """One text line per source; sources without neighbours have none."""
    from ..operators.edges import rendered

    rendered(edges).write.text(path)


def read_adjacency(spark: SparkSession, path: str, lo: int = 0, n: int | None = None) -> DataFrame:
    from ..operators.edges import parsed

    return parsed(spark.read.text(path).withColumnRenamed("value", "line"), lo, n)


def write_repetitions(edges: DataFrame, path: str) -> None:
    """One folder per sketch repetition (column rep)."""
    edges.write.partitionBy("rep").parquet(path)


def write_triples(edges: DataFrame, path: str) -> None:
    """type_id, relation, type_id lines from (src_type, src, rel, dst_type, dst)."""
    end = lambda a, b: F.concat_ws("_", a, F.col(b).cast("string"))
    edges.select(F.concat_ws("\t", end("src_type", "src"), "rel", end("dst_type", "dst")).alias("value")).write.text(path)


def write_core_input(nodes: DataFrame, edges: DataFrame, path_types: list[int], folder: str) -> None:
    """The three text files of a core-decomposition tool: graph with types from 1, meta-path, and its target vertices."""
    spark = nodes.sparkSession
    lines = edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), (F.col("etype") + 1).cast("string")).alias("value"))
    lines.write.text(f"{folder}/graph")
    spark.createDataFrame([(" ".join(str(t + 1) for t in path_types),)], "value string").write.text(f"{folder}/metapath")
    of_type(nodes, path_types[0]).select(F.col("node").cast("string").alias("value")).write.text(f"{folder}/vertices")


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the table at ``path`` lacks; returns how many. A rerun appends nothing."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        done = rows.select(*keys).limit(0)
    fresh = rows.join(done, keys, "left_anti").persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n
