"""Commands over a graph folder."""

import pytest
from pyspark.sql import functions as F

from hinflow.__main__ import main
from hinflow.sources import hin

AP, PV = [(0, 0), (0, 1), (1, 1), (1, 2), (2, 3), (3, 4)], [(0, 0), (1, 0), (2, 1), (3, 1), (4, 0)]
EDGES = {(0, 0), (0, 1), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 0), (3, 1), (3, 3)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("graph") / "g")
    links = [(a, 10 + p, 0) for a, p in AP] + [(10 + p, 20 + v, 1) for p, v in PV]
    nodes = spark.range(30).select(F.col("id").alias("node"), F.array(F.floor(F.col("id") / 10).cast("int")).alias("types"))
    hin.write_native(nodes, spark.createDataFrame(links, "src long, dst long, etype int"), path)
    return path


def rows(spark, folder, tmp_path, command, *options):
    out = str(tmp_path / command)
    assert main([command, folder, "0,1,rev_1,rev_0", "-o", out, *options], spark) == 0
    return spark.read.parquet(out).collect()


def test_commands(spark, folder, tmp_path):
    run = lambda *a: rows(spark, folder, tmp_path, *a)
    assert {(r["src"], r["dst"]) for r in run("materialize")} == EDGES
    degrees = {0: 3, 1: 4, 2: 2, 3: 3}
    assert {r["node"]: r["degree"] for r in run("degree")} == degrees
    assert {r["node"]: r["degree"] for r in run("estimate", "-k", "8")} == degrees
    assert {r["node"] for r in run("hubs", "--share", "0.25")} == {0, 1, 3}
    assert {r["node"] for r in run("glo", "-k", "8", "--share", "0.25")} == {0, 1}
    assert {r["node"]: r["h"] for r in run("hindex")} == {0: 3, 1: 3, 2: 2, 3: 3}
    assert {(r["src"], r["dst"]) for r in run("sparsify", "-k", "8")} == {(a, b) for a, b in EDGES if a != b}
    for command in ("walk", "kgrw"):
        assert {(r["src"], r["dst"]) for r in run(command, "--walks", "40")} == {(a, b) for a, b in EDGES if a != b}
    assert run("profile")[0]["edges"] == 12
    assert len(run("sketch", "-k", "1")) == 4


def test_personalised_commands(spark, folder, tmp_path):
    nodes = tmp_path / "nodes.txt"
    nodes.write_text("0\n1\n2\nx\n99\n")
    answer = lambda name, *a: {r["node"]: r["is_hub"] for r in rows(spark, folder, tmp_path / name, *a, "-k", "8", "--share", "0.25")}
    assert answer("a", "per", "--nodes", "0,1,2") == answer("b", "per", "--nodes-from", str(nodes)) == {0: False, 1: True, 2: False}
    # The first three nodes share a middle node, a clique of three; only the node of degree two is below it.
    stopped = {r["node"]: (r["exact"], r["stopped"], r["is_hub"]) for r in rows(spark, folder, tmp_path / "c", "per", "--nodes-from", str(nodes), "-k", "8", "--share", "0.25", "--beta", "0.1")}
    assert stopped == {0: (3, False, False), 1: (4, False, True), 2: (2, True, False)}
    assert set(answer("d", "perh", "--nodes", "0,1,2")) == set(answer("e", "perh", "--nodes", "0,1,2", "--beta", "0.1")) == {0, 1, 2}
    assert rows(spark, folder, tmp_path / "f", "epsilon", "-k", "8", "--share", "0.25")[0]["epsilon"] == 0
    with pytest.raises(SystemExit):
        main(["per", folder, "0,1,rev_1,rev_0"], spark)
    with pytest.raises(ValueError):
        main(["per", folder, "0,1", "--nodes", "0"], spark)


def test_unknown_query(folder):
    with pytest.raises(SystemExit):
        main(["query", folder, "no such query"])
