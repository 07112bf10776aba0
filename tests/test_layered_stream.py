"""Sketches of several hops kept up to date by a stream: equal to one batch, touching only what changes, across restarts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from hinflow.operators import sketch as K
from hinflow.plans import metapath as M
from hinflow.streaming.sketch_stream import LayeredSketch

PATH = M.MetaPath.parse("ab,bc,rev_bc")


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(3)
    rows = {("ab", rng.randrange(40), rng.randrange(20)) for _ in range(120)} | {("bc", rng.randrange(20), rng.randrange(15)) for _ in range(60)}
    rows = sorted(rows)
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "relation string, src long, dst long")


def at_once(spark, rows, k):
    e = table(spark, rows)
    s = M.GraphSchema({n: e.where(F.col("relation") == n).select("src", "dst") for n in ("ab", "bc")})
    start = K.universe(e.where("relation = 'ab'").select(F.col("src").alias("node")).distinct())
    return {tuple(r) for r in K.propagate(s, PATH, start, k).collect()}


@pytest.mark.parametrize("cuts", [[], [60], [1, 2, 90, 179]])
def test_any_split_equals_one_batch(spark, edges, tmp_path, cuts):
    s = LayeredSketch(spark, str(tmp_path / "log"), PATH, 4, compact=3)
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(edges)], strict=True)):
        s.merge(table(spark, edges[a:b]), i)
    assert {tuple(r) for r in s.sketch().collect()} == at_once(spark, edges, 4)
    kept = [n for kind in ("base", "batch") if os.path.isdir(tmp_path / "log" / kind) for n in os.listdir(tmp_path / "log" / kind)]
    assert len(kept) <= 3


def test_only_changes_travel(spark, edges, tmp_path):
    """An edge that is there already moves nothing beyond its own step; a batch that runs twice is left out."""
    s = LayeredSketch(spark, str(tmp_path / "log"), PATH, 4)
    s.merge(table(spark, edges), 0)
    full = {i: n for _, i, n, _ in s.touched}
    s.merge(table(spark, edges[:1]), 1)
    again = [t for t in s.touched if t[0] == 1]
    assert all(new == 0 for *_, new in again) and sum(n for _, _, n, _ in again) < sum(full.values()) / 10
    n = len(s.touched)
    s.merge(table(spark, edges), 1)
    assert len(s.touched) == n


def test_restart_and_unfinished_batch(spark, edges, tmp_path):
    """A new object goes on from the log; what a lost driver left of a batch does not count and is written again. An empty batch is a batch."""
    folder = str(tmp_path / "log")
    LayeredSketch(spark, folder, PATH, 4, compact=2).merge(table(spark, edges[:100]), 0)
    table(spark, [("ab", 999, 1)]).select("src", "dst").write.parquet(f"{folder}/batch/1/edges-1")
    s = LayeredSketch(spark, folder, PATH, 4, compact=2)
    assert s.last() == 0
    s.merge(table(spark, edges[100:]), 1)
    s.merge(table(spark, []), 2)
    assert s.last() == 2 and {tuple(r) for r in s.sketch().collect()} == at_once(spark, edges, 4)


def test_follows_a_stream(spark, edges, tmp_path):
    table(spark, edges[:90]).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = LayeredSketch(spark, str(tmp_path / "log"), PATH, 4)
    read = lambda: spark.readStream.schema("relation string, src long, dst long").parquet(str(tmp_path / "in"))
    s.follow(read(), str(tmp_path / "check")).awaitTermination()
    table(spark, edges[90:]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    LayeredSketch(spark, str(tmp_path / "log"), PATH, 4).follow(read(), str(tmp_path / "check")).awaitTermination()
    assert {tuple(r) for r in s.sketch().collect()} == at_once(spark, edges, 4)
