"""Queries over the tables of a folder, and meta-path operators over a graph folder.

  python -m hinflow query FOLDER NAME [OUTPUT]
      a catalogued query over the parquet tables of a folder
  python -m hinflow COMMAND FOLDER PATH [--layout native|hne] [--anchor N] [-k K] [--share S] [--walks W]
                    [--nodes A,B,...] [--nodes-from FILE] [--beta B] [-o OUTPUT]
      over a graph folder (node.dat, link.dat); PATH names relations between commas,
      in the native layout the numbers of edge types, with rev_ for a step against its direction:
      materialize  all edges of the meta-path's graph
      sketch       bottom-k sketches of its nodes
      sparsify     the edges that sketches keep
      walk         edges that W random walks a node find
      kgrw         edges by sketches up to the middle of a mirrored path and W walks on from there
      degree       exact degrees;  estimate  degrees from sketches;  hindex  h-indexes
      hubs         nodes whose degree is at the threshold of the share S or above
      glo          the same from sketches
      epsilon      how far the degrees of nodes that the sketches misjudge lie from the threshold
      per          whether the given nodes (a list, or a text file with one a line) are hubs by degree, from sketches
      perh         the same by h-index; both need a path that is its own mirror, and with a margin B
                   they stop early where the largest clique around one middle node decides
      profile      edges, nodes, mean degree

Without an output the first rows are shown. Spark is configured from outside (spark-submit or SPARK_CONF_DIR).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import edges as E
from .operators import hubs as H
from .operators import sketch as K
from .operators import sketch_hubs as SH
from .operators import walks as R
from .plans import metapath as M
from .plans.catalog import QUERIES
from .plans.scratch import cleared, written
from .sources import registry, rules


def graph(spark: SparkSession, folder: str, layout: str) -> M.GraphSchema:
    """The relations of a graph folder: edge types by number, or by the types of their ends."""
    _, edges = registry.load(layout, spark, folder)
    name = "rel" if "rel" in edges.columns else "etype"
    edges = written(edges.select(F.col(name).cast("string").alias("rel"), "src", "dst"), "graph")
    names = [r["rel"] for r in edges.select("rel").distinct().collect()]
    types = {n: tuple(n.split("_to_")) for n in names if n.count("_to_") == 1}
    return M.GraphSchema({n: edges.where(F.col("rel") == n).select("src", "dst") for n in names}, types)


def starts(schema: M.GraphSchema, path: M.MetaPath) -> DataFrame:
    return schema.hops(path)[0].select(F.col("src").alias("node")).distinct()


def asked(spark: SparkSession, listed: str | None, file: str | None) -> DataFrame:
    """(node): the query nodes of a comma list or a file."""
    if file:
        return rules.query_nodes(spark, file).distinct()
    return spark.createDataFrame([(int(x),) for x in (listed or "").split(",") if x], "node long").distinct()


def personal(command: str, schema: M.GraphSchema, path: M.MetaPath, queries: DataFrame, k: int, share: float, beta: float | None) -> DataFrame:
    """The personalised queries; nodes that do not start the path have no row."""
    if not path.is_palindrome():
        raise ValueError(f"{command} needs a path that is its own mirror")
    half = len(path.steps) // 2
    u = K.universe(starts(schema, path))
    mids = K.propagate(schema, path.prefix(half), u, k)
    scores = written(K.estimate(K.propagate(schema, path, u, k), k).withColumnRenamed("degree", "score"), "estimates")
    if beta is None:
        return H.personal(scores, queries, share) if command == "per" else SH.personal_h(schema, path, u, scores, queries, share, k)
    own = written(M.peers_of(schema, path, half, queries).groupBy("node").agg(F.count(F.lit(1)).alias("exact")), "degrees")
    clique = written(K.estimate(mids, k).agg(F.max("degree").alias("size")), "clique")
    if command == "per":
        return H.personal_stopped(scores, own, clique, share, beta)
    return SH.personal_h_stopped(schema, path, u, scores, own, clique, queries, share, k, beta)


def run(command: str, schema: M.GraphSchema, path: M.MetaPath, k: int, share: float, walks: int) -> DataFrame:
    """The result of one command; sketches and walks start at the nodes of the path's first step."""
    if command == "walk":
        return R.walk_edges(R.walk(schema, path, starts(schema, path), walks)).select("src", "dst")
    if command == "kgrw":
        if not path.is_palindrome():
            raise ValueError("kgrw needs a path that is its own mirror")
        half = len(path.steps) // 2
        u = K.universe(starts(schema, path))
        back = M.MetaPath(path.steps[half:])
        mids = K.propagate(schema, path.prefix(half), u, k)
        return R.hybrid(mids, u, R.walk(schema, back, starts(schema, back), walks, first_hop=half))
    if command in ("sketch", "sparsify", "estimate", "glo"):
        u = K.universe(starts(schema, path))
        s = K.propagate(schema, path, u, k)
        if command == "sketch":
            return s
        if command == "sparsify":
            return E.symmetrized(E.without_loops(K.decode(s, u)))
        e = K.estimate(s, k)
        return e if command == "estimate" else H.top_share(written(e.withColumnRenamed("degree", "score"), "estimates"), share)
    if command == "epsilon":
        e = written(K.estimate(K.propagate(schema, path, K.universe(starts(schema, path)), k), k).withColumnRenamed("degree", "score"), "estimates")
        d = written(E.degree(M.metapath_edges(schema, path)).withColumnRenamed("degree", "score"), "degrees")
        return H.epsilon(H.top_share(e, share), d, share)
    g = M.metapath_edges(schema, path)
    if command == "materialize":
        return g
    if command == "hindex":
        return H.h_index(written(g, "edges"))
    d = E.degree(g)
    if command == "profile":
        n, e = F.count(F.lit(1)), F.sum("degree")
        return d.agg(e.alias("edges"), n.alias("nodes"), (e / n).alias("mean_degree"))
    return d if command == "degree" else H.hubs(written(d.withColumnRenamed("degree", "score"), "degrees"), share, False)


COMMANDS = ("materialize", "sketch", "sparsify", "walk", "kgrw", "degree", "estimate", "hindex", "hubs", "glo", "epsilon", "per", "perh", "profile")


def main(args: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("hinflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("query", *COMMANDS))
    parser.add_argument("folder")
    parser.add_argument("path", help="the meta-path, or the name of the query")
    parser.add_argument("output", nargs="?")
    parser.add_argument("-o", dest="to")
    parser.add_argument("--layout", default="native", choices=registry.supported())
    parser.add_argument("--anchor", type=int)
    parser.add_argument("-k", type=int, default=32)
    parser.add_argument("--share", type=float, default=0.05)
    parser.add_argument("--walks", type=int, default=16)
    parser.add_argument("--nodes", help="query nodes between commas")
    parser.add_argument("--nodes-from", help="text file with one query node a line")
    parser.add_argument("--beta", type=float, help="margin of the early stop; without it none")
    a = parser.parse_args(args)
    if a.command in ("per", "perh") and not (a.nodes or a.nodes_from):
        parser.error(f"{a.command} needs --nodes or --nodes-from")
    if a.command == "query" and a.path not in QUERIES:
        parser.error("no such query; there are " + ", ".join(sorted(QUERIES)))
    spark = spark or SparkSession.builder.appName("hinflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with cleared(spark):
        if a.command == "query":
            result = QUERIES[a.path](spark, a.folder)
        elif a.command in ("per", "perh"):
            result = personal(a.command, graph(spark, a.folder, a.layout), M.MetaPath.parse(a.path, a.anchor), asked(spark, a.nodes, a.nodes_from), a.k, a.share, a.beta)
        else:
            result = run(a.command, graph(spark, a.folder, a.layout), M.MetaPath.parse(a.path, a.anchor), a.k, a.share, a.walks)
        if to := a.to or a.output:
            result.write.parquet(to)
        else:
            result.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
