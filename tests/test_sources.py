"""Readers, writers, rules, result files and the streaming sketch."""

import json

import pytest
from pyspark.sql import functions as F

from hinflow.operators.sketch import bottom_k
from hinflow.plans.metapath import MetaPath
from hinflow.sources import hin, registry, results, rules
from hinflow.streaming.sketch_stream import SketchTable, edge_sketch


def put(path, text):
    path.write_text(text)
    return str(path)


def test_native_folder(spark, tmp_path):
    put(tmp_path / "node.dat", "0\tx\t0\n1\ty\t0,1\n2\tz\t1\n")
    put(tmp_path / "link.dat", "0\t1\t0\n1\t2\t0,2\n")
    put(tmp_path / "meta.dat", "Node Total: Count 3\n")
    nodes, edges = hin.read_native(spark, str(tmp_path))
    assert sorted((r["src"], r["dst"], r["etype"]) for r in edges.collect()) == [(0, 1, 0), (1, 2, 0), (1, 2, 2)]
    assert [r["node"] for r in hin.of_type(nodes, 1).orderBy("node").collect()] == [1, 2]
    assert hin.node_count(spark, str(tmp_path)) == 3
    hin.write_native(nodes, edges, str(tmp_path / "out"))
    again, links = hin.read_native(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, nodes.collect())) and links.count() == 3
    assert hin.node_count(spark, str(tmp_path / "out")) == 3


def test_typed_folder(spark, tmp_path):
    nodes = spark.createDataFrame([("b", 7), ("a", 5), ("a", 3), ("b", 9), ("c", 1)], "type string, id long")
    edges = spark.createDataFrame([("a", 5, "r", "b", 9), ("b", 7, "q", "c", 1), ("a", 3, "r", "b", 8)], "src_type string, src long, rel string, dst_type string, dst long")
    hin.write_typed(nodes, edges, str(tmp_path / "g"))
    assert hin.read_offsets(spark, str(tmp_path / "g")) == ({"a": 0, "b": 2, "c": 4}, ["q", "r"])
    assert sorted(tuple(r) for r in hin.read_typed(spark, str(tmp_path / "g")).collect()) == [("q", "b", 0, "c", 0), ("r", "a", 1, "b", 1)]
    assert hin.node_count(spark, str(tmp_path / "g")) == 5
    where = spark.createDataFrame([(-1,), (0,), (3,), (4,), (None,)], "node long").select(hin.placed(F.col("node"), {"b": 2, "a": 0, "c": 4}).alias("p"))
    assert [r["p"] and tuple(r["p"]) for r in where.collect()] == [None, ("a", 0), ("b", 1), ("c", 0), None]
    hin.write_typed(nodes.limit(0), edges.limit(0), str(tmp_path / "none"))
    assert hin.read_typed(spark, str(tmp_path / "none")).count() == 0


def test_hne_folder(spark, tmp_path):
    put(tmp_path / "node.dat", "7\tn\t0\t0.5,1\n3\tn\t0\t1,2\n9\tn\t1\t\n")
    put(tmp_path / "link.dat", "3\t9\t0\t1\n7\t9\t0\t1\n7\t99\t0\t1\n")
    put(tmp_path / "label.dat", "3\tn\t0\tb\n7\tn\t0\ta,b\n")
    nodes, edges = hin.read_hne(spark, str(tmp_path), {"0": "paper"})
    assert {(r["node"], r["type"], r["local"]) for r in nodes.collect()} == {(3, "paper", 0), (7, "paper", 1), (9, "type_1", 0)}
    assert {(r["src"], r["rel"]) for r in edges.collect()} == {(3, "paper_to_type_1"), (7, "paper_to_type_1")}
    labels, several = hin.read_labels(spark, str(tmp_path))
    assert several and {r["node"]: r["classes"] for r in labels.collect()} == {3: [1], 7: [0, 1]}


def test_adjacency_and_other_sinks(spark, tmp_path):
    e = spark.createDataFrame([(0, 1), (0, 2), (3, 0)], "src long, dst long")
    hin.write_adjacency(e, str(tmp_path / "a"))
    assert sorted(map(tuple, hin.read_adjacency(spark, str(tmp_path / "a")).collect())) == [(0, 1), (0, 2), (3, 0)]
    hin.write_repetitions(e.withColumn("rep", F.col("src") % 2), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).where("rep = 1").count() == 1
    hin.write_triples(e.select(F.lit("a").alias("src_type"), "src", F.lit("r").alias("rel"), F.lit("b").alias("dst_type"), "dst"), str(tmp_path / "t"))
    assert "a_3\tr\tb_0" in [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()]
    nodes = spark.createDataFrame([(0, [0]), (1, [1])], "node long, types array<int>")
    hin.write_core_input(nodes, e.withColumn("etype", F.lit(0)), [0, 1, 0], str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c/metapath")).first()[0] == "1 2 1"


def test_append_new_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert hin.append_new(rows, str(tmp_path / "t"), ["k"]) == 2
    assert hin.append_new(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), str(tmp_path / "t"), ["k"]) == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_rules(spark, tmp_path):
    path = put(tmp_path / "rules.tsv", "1\t1\t0.9\tr(X,Y) <= a(X,Z), b(Y,Z)\n1\t1\t0.5\tr(X,Y) <= a(X,Z), b(Y,Z)\n1\t1\t0.7\tr(X,Y) <= a(X,part_7)\n1\t1\t0.01\tr(X,Y) <= c(X,Y)\n")
    mined = rules.mined_rules(spark, path, 0.1)
    assert mined.count() == 3 and mined.where("conf = 0.7").first()["instances"] == ["part_7"]
    assert [tuple(r) for r in rules.body_path(mined).collect()] == [("a,rev_b", 0.9)]
    p, q = MetaPath.parse("x,rev_y"), MetaPath.parse("x", anchor=5)
    code = rules.compile_rule(p, {"x": 1, "y": 2}) + " " + rules.compile_rule(q, {"x": 1})
    assert list(rules.decode_rules([int(c) for c in code.split()], {1: "x", 2: "y"})) == [p, q]
    table = rules.rules_of(spark, put(tmp_path / "code", code), {1: "x", 2: "y"})
    assert sorted((r["length"], r["anchor"]) for r in table.collect() if r["anchor"]) == [(0, 5)]
    rules.write_by_length(table, str(tmp_path / "by"))
    peers = spark.range(5).toDF("node")
    lines = rules.hub_lines(spark, put(tmp_path / "hubs", "(1 2\n)0 1\nnoise\n"))
    got = sorted(sorted(r["node"] for r in rules.hub_set(lines, x["line"], peers).collect()) for x in lines.select("line").distinct().collect())
    assert got == [[1, 2], [2, 3, 4]]
    assert rules.query_nodes(spark, put(tmp_path / "q", "3\n\n4\n")).count() == 2


def test_results(spark, tmp_path):
    put(tmp_path / "ACM_kmv_42.json", json.dumps({"f1": 0.5}))
    r = results.compiled(spark, str(tmp_path / "*.json")).first()
    assert (r["dataset"], r["method"], r["seed"], r["f1"]) == ("ACM", "kmv", 42, 0.5)
    d = tmp_path / "m" / "results_43" / "ACM"
    d.mkdir(parents=True)
    put(d / "master_results.csv", "Dataset,F1\nACM,0.5\nACM,\nACM,OOM\n")
    c = results.seeded_csv(spark, str(tmp_path / "m"), ["F1"]).collect()
    assert sorted((r["F1"] or 0, r["F1_status"], r["run_seed"]) for r in c) == [(0, "ok", 43), (0, "oom", 43), (0.5, "ok", 43)]
    df = spark.range(3)
    results.cached(df, str(tmp_path / "cache"), ["a", "1"])
    assert results.cached(spark.range(9), str(tmp_path / "cache"), ["a", "1"]).count() == 3
    s = spark.createDataFrame([(1, 2)], "node long, h long")
    results.write_bundle({"p": s}, s, str(tmp_path / "bundle"))
    assert results.read_bundle(spark, str(tmp_path / "bundle"))[0].first()["metapath"] == "p"


def test_loader_registry(spark):
    registry.register_loader("mine", lambda s: "loaded")
    assert "mine" in registry.supported() and registry.load("mine", spark) == "loaded"
    with pytest.raises(KeyError):
        registry.load("nothing", spark)


def test_streaming_sketch_equals_batch(spark, tmp_path):
    rows = [(i % 5, i * 7 % 90) for i in range(200)]
    table = SketchTable(spark, str(tmp_path / "sketch"), 6)
    for part in (rows[:80], rows[80:]):
        spark.createDataFrame(part, "src long, dst long").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
        table.follow(stream, str(tmp_path / "check")).awaitTermination()
    whole = edge_sketch(spark.createDataFrame(rows, "src long, dst long"), 6)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, whole.collect()))
    assert bottom_k(whole, 6).count() == whole.count()
