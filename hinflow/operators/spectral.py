"""Spectral quantities by iteration over edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import keyed
from ..plans.scratch import written


def spectral_radius(edges: DataFrame, rounds: int = 40, every: int = 5, sizes: DataFrame | None = None) -> DataFrame:
    """One row: the Rayleigh quotient after ``rounds`` power steps on a symmetric graph.

    The vector is scaled by its largest entry in each step; every few steps it
    is written to the shared folder, which keeps the lineage short. With
    ``sizes`` (node, size) a node stands for a class of so many that have the
    same neighbours; the vector is the same for all of them.
    """
    e = edges.select("src", "dst")
    sizes = e.select(F.col("src").alias("node")).distinct().withColumn("size", F.lit(1)) if sizes is None else sizes
    edges = written(e.join(sizes.select(F.col("node").alias("dst"), F.col("size").alias("w")), "dst").select("src", "dst", "w"), "edges")
    x = edges.select(F.col("src").alias("node")).distinct().withColumn("x", F.lit(1.0))
    for k in range(1, rounds + 1):
        y = edges.join(x, edges["dst"] == x["node"]).groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        top = F.broadcast(y.agg(F.max("x").alias("top")))
        x = y.crossJoin(top).select("node", (F.col("x") / F.col("top")).alias("x"))
        if k % every == 0:
            x = written(x, "vector")
    return rayleigh(x.join(sizes, "node"), edges)


def rayleigh(x: DataFrame, edges: DataFrame) -> DataFrame:
    """The Rayleigh quotient x'Ax / x'x of ``x`` (node, x, size) and ``edges`` (src, dst, w), w being the size of dst."""
    a, b = x.select(F.col("node").alias("src"), (F.col("x") * F.col("size")).alias("a")), x.select(F.col("node").alias("dst"), F.col("x").alias("b"))
    up = edges.join(a, "src").join(b, "dst").agg(F.sum(F.col("a") * F.col("w") * F.col("b")).alias("up"))
    down = x.agg(F.sum(F.col("x") * F.col("x") * F.col("size")).alias("down"))
    return up.crossJoin(down).select(F.round(F.col("up") / F.col("down"), 6).alias("radius"))


def top_eigenvalues(edges: DataFrame, k: int = 5, extra: int = 5, degree: int = 6, rounds: int = 30, tolerance: float = 1e-5, seed: int = 42) -> DataFrame:
    """(rank, value): the ``k`` largest eigenvalues (fewer on a smaller graph) of a symmetric matrix ``edges`` (src, dst, weight).

    Subspace iteration: k + extra vectors are columns beside the node. A round
    makes them orthonormal, projects the matrix on them, and sends them through
    a Chebyshev polynomial that damps all eigenvalues between the lower bound
    (largest absolute row sum) and the smallest projected one. A product with
    the lower bound is minus a bound of the largest absolute eigenvalue: the
    largest growth of a positive vector under the matrix of absolute weights,
    after a few steps that make it small. A product with the matrix is one join and one sum; only Gram matrices of (k + extra)
    squared numbers come to the driver. Vectors are
    written after every product, as the next one reads them twice.
    It stops when no value of the k moves by more than ``tolerance``, and
    raises if they do not settle. No edges give no rows.
    """
    spark = edges.sparkSession
    a = written(edges.select("src", "dst", F.col("weight").cast("double").alias("w")), "matrix")
    nodes = a.select(F.col("src").alias("node")).union(a.select(F.col("dst").alias("node"))).distinct()
    v = nodes.withColumn("v", F.lit(1.0))
    for _ in range(3):
        grown = a.join(v, a["dst"] == v["node"]).groupBy(F.col("src").alias("node")).agg(F.sum(F.abs("w") * F.col("v")).alias("g"))
        v = written(v.join(grown, "node", "left").select("node", F.col("v").alias("before"), (F.col("v") + F.coalesce("g", F.lit(0.0))).alias("v")), "bound")
    bound = v.agg(F.max(F.col("v") / F.col("before") - 1)).first()[0]
    if bound is None:
        return spark.createDataFrame([], "rank int, value double")
    names = [f"x{i}" for i in range(k + extra)]
    x = written(nodes.select("node", *((keyed(seed, F.col("node"), i) / F.lit(float(1 << 31)) - 1).alias(n) for i, n in enumerate(names))), "vectors")

    def gram(x: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
        row = x.agg(*(F.sum(F.col(p) * F.col(q)) for p in left for q in right)).first()
        return np.array(row, float).reshape(len(left), len(right))

    def mixed(names: list[str], by: np.ndarray, to: list[str]) -> list:
        return [sum((F.col(n) * float(c) for n, c in zip(names[1:], col[1:], strict=True)), F.col(names[0]) * float(col[0])).alias(t) for t, col in zip(to, by.T, strict=True)]

    def product(x: DataFrame, names: list[str], carry: list[str]) -> DataFrame:
        """(node, ``names``, ``carry``, a product for each name): own columns and what arrives meet in one sum."""
        arrives = a.join(x, a["dst"] == x["node"]).select(F.col("src").alias("node"), *(F.lit(0.0).alias(c) for c in names + carry), *((F.col("w") * F.col(n)).alias(f"a{n}") for n in names))
        own = x.select("node", *names, *carry, *(F.lit(0.0).alias(f"a{n}") for n in names))
        return own.union(arrives).groupBy("node").agg(*(F.sum(c).alias(c) for c in [*names, *carry, *(f"a{n}" for n in names)]))

    before = None
    for _ in range(rounds):
        size, axes = np.linalg.eigh(gram(x, names, names))
        kept = size > size[-1] * 1e-12
        names = names[: int(kept.sum())]
        x = x.select("node", *mixed([c for c in x.columns if c != "node"], axes[:, kept] / np.sqrt(size[kept]), names))
        x = written(product(written(x, "vectors"), names, []), "vectors")
        values, turned = np.linalg.eigh(gram(x, names, [f"a{n}" for n in names]))
        top = values[::-1][:k]
        if before is not None and np.abs(top - before).max() < tolerance or len(names) <= k:
            break
        before = top
        middle, half = (values[0] - bound) / 2, max((values[0] + bound) / 2, 1e-9)
        last = [f"z{i}" for i in range(len(names))]
        x = x.select("node", *mixed(names, turned, last), *mixed([f"a{n}" for n in names], turned, [f"t{i}" for i in range(len(names))]))
        x = x.select("node", *last, *(((F.col(f"t{i}") - middle * F.col(z)) / half).alias(n) for i, (n, z) in enumerate(zip(names, last, strict=True))))
        # A higher degree would blow up the first vectors beyond what a Gram matrix can tell apart.
        steep = np.arccosh(max((values[-1] - middle) / half, 1 + 1e-9))
        for _ in range(2, max(1, min(degree, int(np.log(1e6) / steep))) + 1):
            x = product(written(x, "vectors"), names, last).select("node", *(F.col(n).alias(z) for n, z in zip(names, last, strict=True)), *((2 / half * (F.col(f"a{n}") - middle * F.col(n)) - F.col(z)).alias(n) for n, z in zip(names, last, strict=True)))
        x = x.select("node", *names)
    else:
        raise RuntimeError(f"eigenvalues did not settle in {rounds} rounds")
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(top, 1)], "rank int, value double")
