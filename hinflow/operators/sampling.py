"""Splits, samples and graph surgery, all by keyed hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import Tails
from ..functions.hashing import DIGITS, keyed
from ..plans import metapath as M
from ..plans.scratch import written
from .ranking import hash_bucket, ranked


def hash_ranked(df: DataFrame, keys: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """``df`` with r, n: place by hash within ``keys``; ties by id."""
    d = df.withColumn("__h", keyed(seed, F.col(id_col)))
    return ranked(d, keys, hash_bucket(F.col("__h")), ["__h", id_col]).drop("__h")


def split(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """60/20/20 into train, val, test."""
    r = hash_ranked(df, [], id_col, seed)
    s = F.when(F.col("r") <= F.floor(F.col("n") * F.lit(0.6)), "train").when(F.col("r") <= F.floor(F.col("n") * F.lit(0.8)), "val").otherwise("test")
    return r.select(id_col, s.alias("split"))


def temporal_split(df: DataFrame, ts: str, id_col: str, share: float) -> DataFrame:
    """The oldest share trains; ties by id; at least one."""
    r = ranked(df, [], F.to_date(ts), [ts, id_col])
    return r.select(id_col, F.when(F.col("r") <= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n"))), "train").otherwise("test").alias("split"))


def stratified_split(df: DataFrame, label: str, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """A share of every class trains, at least one row each; rows without a label are a class."""
    r = hash_ranked(df, [label], id_col, seed)
    return r.select(id_col, label, F.when(F.col("r") <= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n"))), "train").otherwise("test").alias("split"))


def stratified_subsample(df: DataFrame, label: str, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows in proportion to the classes by largest remainder, at least one of each."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(W.partitionBy())
    exact = F.lit(size) * F.col("c") / total.cast("double")
    c = c.select(label, "c", exact.alias("exact"), F.greatest(F.floor(exact), F.lit(1)).alias("base"))
    left = F.lit(size) - F.sum("base").over(W.partitionBy())
    rising = F.row_number().over(W.orderBy((F.col("exact") - F.col("base")).desc(), label))
    # What classes below one row took beyond their share comes off the largest ones.
    falling = F.row_number().over(W.orderBy(F.col("base").desc(), label))
    c = c.select(F.col(label).alias("__l"), (F.col("base") + (rising <= left).cast("int") - (falling <= -left).cast("int")).alias("quota"))
    r = hash_ranked(df, [label], id_col, seed)
    return r.join(c, F.col(label).eqNullSafe(F.col("__l"))).where("r <= quota").select(id_col, label)


def edge_id(*parts: str) -> Column:
    return F.concat_ws("-", *(F.col(p).cast("string") for p in parts))


def fraction(edges: DataFrame, keys: list[str], share: float, seed: int = 42) -> DataFrame:
    """round(n share) edges, at least one, per ``keys``."""
    e = edges.withColumn("__e", edge_id("src", "dst"))
    r = hash_ranked(e, keys, "__e", seed)
    return r.where(F.col("r") <= F.greatest(F.lit(1), F.round(F.col("n") * F.lit(share)).cast("long"))).select(*edges.columns)


def random_edges(edges: DataFrame, m: int, seed: int = 42) -> DataFrame:
    e = edges.withColumn("__e", edge_id("src", "dst"))
    return hash_ranked(e, [], "__e", seed).where(F.col("r") <= m).select(*edges.columns)


def perturb(edges: DataFrame, share: float, n_src: DataFrame, n_dst: DataFrame, seed: int = 42) -> DataFrame:
    """A share of the edges, picked by hash, is replaced by hashed pairs that are not edges yet.

    Ends are drawn from [0, n), with n from the one row of ``n_src`` and ``n_dst``.

    Replacements may meet; the result is distinct, so it can be a little smaller.
    """
    e = edges.select("src", "dst").withColumn("e", edge_id("src", "dst"))
    gone = keyed(seed, F.col("e")) < int(share * (1 << 32))
    sizes = F.broadcast(n_src.toDF("n_src").crossJoin(n_dst.toDF("n_dst")))
    end = lambda k, n: keyed(seed + k, F.col("e"), digits=DIGITS) % F.col(n)
    new = e.where(gone).crossJoin(sizes).select(end(1, "n_src").alias("src"), end(2, "n_dst").alias("dst"))
    new = new.distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return e.where(~gone).select("src", "dst").union(new)


def induced(edges: DataFrame, keep_src: DataFrame | None = None, keep_dst: DataFrame | None = None) -> DataFrame:
    """Edges whose ends are kept (column node)."""
    out = edges
    if keep_src is not None:
        out = out.join(keep_src.select(F.col("node").alias("src")), "src", "left_semi")
    if keep_dst is not None:
        out = out.join(keep_dst.select(F.col("node").alias("dst")), "dst", "left_semi")
    return out.select(*edges.columns)


def local_ids(df: DataFrame, keys: list[str], id_col: str, width: int = 4096) -> DataFrame:
    """(keys, id, local): dense ids from 0 in the order of the ids, per ``keys``."""
    r = ranked(df, keys, F.floor(F.col(id_col) / width), [id_col])
    return r.select(*keys, id_col, (F.col("r") - 1).alias("local"))


def snowball(edges: DataFrame, seeds: DataFrame, hops: int, cap: int | None = None) -> DataFrame:
    """(node) reached within ``hops`` in either direction; ``cap`` limits each node's neighbours, by id."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    if cap is not None:
        both = both.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("dst"))).where(F.col("r") <= cap).select("src", "dst")
    seen = at = seeds.select("node").distinct()
    for _ in range(hops):
        reached = both.join(at.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        at = reached.join(seen, "node", "left_anti")
        seen = seen.union(at)
    return seen


#: Pairs that are hashed at once: arrays that stay in a core's cache, and not too short.
HASHED = 1 << 14


def low_pairs(pairs: DataFrame, seed: int) -> DataFrame:
    """(src, dst, h): pairs of the arrays xs and ys of a row, loops left out, whose hash h lies below the row's ``limit``.

    Whole numbers are hashed an array at a time; a call for each pair costs
    some ten times as much.
    """
    kind = pairs.schema["xs"].dataType.elementType
    if not isinstance(kind, T.IntegralType):
        listed = M.spread(pairs, "limit").where("src <> dst").withColumn("h", keyed(seed, edge_id("src", "dst")))
        return listed.where("h < limit").select("src", "dst", "h")

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, limits = (batch.column(c) for c in ("xs", "ys", "limit"))
            names = pa.schema([("src", xs.type.value_type), ("dst", xs.type.value_type), ("h", pa.int64())])
            for i in range(batch.num_rows):
                tails, limit = Tails(ys[i].values.to_numpy()), limits[i].as_py()
                by_size: dict[int, list[int]] = {}
                for x in xs[i].values.to_pylist():
                    by_size.setdefault(len(str(x)), []).append(x)
                # About HASHED pairs at once.
                many = max(1, HASHED // max(1, len(tails.numbers)))
                for some in (sized[k:k + many] for sized in by_size.values() for k in range(0, len(sized), many)):
                    h = tails.heads([f"{seed}:{x}-" for x in some])
                    src = np.array(some, tails.numbers.dtype)
                    a, b = np.nonzero((h < limit) & (src[:, None] != tails.numbers))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(src[a]), pa.array(tails.numbers[b]), pa.array(h[a, b].astype(np.int64))], schema=names)

    return pairs.mapInArrow(low, T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("h", T.LongType())]))


def two_hop_negatives(far: DataFrame, near: DataFrame, per: int, seed: int = 42, tries: int = 12) -> DataFrame:
    """Per source the ``per`` first, by hash, of its peers over a middle node of ``far`` that are no peers over one of ``near`` (both src, dst).

    Every peer is hashed where it is listed. Those whose hash is so low that
    about ``tries`` of a source's have one lower are looked up in ``near``:
    they are the beginning of its order. Sources that still lack some take 16
    times as many, until all their peers are looked up. Neither graph is
    shuffled or written.
    """
    classes, links = M.quotient(far)
    links = written(links.join(M.class_degree(classes, links).select(F.col("of").alias("a"), "degree"), "a"), "links")
    most = links.agg(F.coalesce(F.max("degree"), F.lit(0))).first()[0]
    near = written(near.select("src", "dst").distinct(), "near")
    here, there = near.toDF("src", "mid"), near.toDF("dst", "mid")
    lacking, out = classes.withColumn("lacks", F.lit(True)), None
    while True:
        limit = F.when(F.col("degree") > tries, F.floor(F.lit(tries) / F.col("degree") * (1 << 32))).otherwise(F.lit(1 << 32)).cast("bigint")
        asked = low_pairs(M.class_pairs(lacking, links, "lacks").where("x_lacks").select("xs", "ys", limit.alias("limit")), seed)
        asked = written(asked, "asked")
        met = asked.select("src", "dst").join(here, "src").join(there, ["dst", "mid"], "left_semi").select("src", "dst").distinct()
        left = asked.join(met, ["src", "dst"], "left_anti").withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("h", "dst"))).where(F.col("r") <= per)
        left = written(left.select("src", "dst"), "negatives")
        if most <= tries:
            return left if out is None else out.union(left)
        have = left.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        lacking = written(lacking.join(have, "node", "left").select("node", "of", (F.col("lacks") & (F.coalesce("n", F.lit(0)) < per)).alias("lacks")), "lacking")
        done = left.join(lacking.where("not lacks").select(F.col("node").alias("src")), "src", "left_semi")
        out = done if out is None else out.union(done)
        if lacking.where("lacks").isEmpty():
            return out
        tries *= 16


def rejection_negatives(sources: DataFrame, targets: DataFrame, edges: DataFrame, per: int, rounds: int = 4, seed: int = 42) -> DataFrame:
    """(src, dst): per source exactly min(``per``, what there is) targets that are neither neighbours nor itself.

    For dense graphs, where listing all non-neighbours costs more than drawing.
    Each round draws as many numbered targets as a source still lacks, drops
    neighbours and what it has already, and goes on with the sources that are
    not done. Sources that ``rounds`` draws do not fill have few
    non-neighbours, or few targets: only theirs are listed, and the missing
    ones taken by hash. ``sources`` and ``targets`` (node) are distinct. Edges
    are only asked for, so repeats do no harm, and those that ``written`` has
    written are not written again.
    """
    known = edges.select("src", "dst")
    if not hasattr(edges, "scratch_path"):
        known = written(known, "edges")
    numbered = written(local_ids(targets.select("node"), [], "node").select(F.col("node").alias("dst"), "local"), "targets")
    n = numbered.count()
    taken = written(sources.select(F.col("node").alias("src"), F.lit(None).cast(targets.schema["node"].dataType).alias("dst")).where("false"), "negatives")
    lack = sources.select(F.col("node").alias("src"), F.lit(per).alias("lacks"))
    for k in range(rounds if n else 0):
        draws = lack.select("src", "lacks", F.explode(F.sequence(F.lit(1), F.col("lacks"))).alias("i"))
        draws = draws.select("src", (keyed(seed, k, F.col("src"), F.col("i"), digits=DIGITS) % n).alias("local")).distinct()
        new = draws.join(numbered, "local").where("src <> dst").select("src", "dst").join(known, ["src", "dst"], "left_anti").join(taken, ["src", "dst"], "left_anti")
        taken = written(taken.union(new), "negatives")
        have = taken.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        lack = written(lack.select("src").join(have, "src", "left").select("src", (F.lit(per) - F.coalesce("n", F.lit(0))).cast("int").alias("lacks")).where("lacks > 0"), "lacks")
        if lack.isEmpty():
            return taken
    # Each unfinished source against all targets: these rows are what there is to choose from.
    shares = F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)), F.lit(4096))).alias("share")
    listed = lack.select("src", "lacks", shares).join(numbered.withColumn("share", F.floor(F.col("local") / 4096) * 4096), "share").where("src <> dst")
    listed = listed.select("src", "dst", "lacks").join(known, ["src", "dst"], "left_anti").join(taken, ["src", "dst"], "left_anti").withColumn("h", keyed(seed, rounds, edge_id("src", "dst")))
    rest = listed.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("h", "dst"))).where("r <= lacks")
    return taken.union(rest.select("src", "dst"))


def snowball_edges(edges: DataFrame, seeds: DataFrame, hops: int, cap: int, seed: int = 42) -> DataFrame:
    """(hop, src, dst): the edges that a snowball walks over, each once, with the hop that does first.

    Nodes reached for the first time go on, in either direction, over at most
    ``cap`` of their edges, drawn by hash. The edge travels with the frontier,
    so the result is the walked tree and its cross edges, not all that lies
    among its nodes.
    """
    e = edges.select("src", "dst").distinct()
    both = e.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src", "dst").union(e.select(F.col("dst").alias("at"), F.col("src").alias("to"), "src", "dst"))
    both = written(both.withColumn("h", keyed(seed, F.col("at"), F.col("to"))), "both-ways")
    seen = at = written(seeds.select("node").distinct(), "seeds")
    walked = None
    for k in range(1, hops + 1):
        drawn = both.join(at.select(F.col("node").alias("at")), "at", "left_semi").withColumn("r", F.row_number().over(W.partitionBy("at").orderBy("h", "to", "src"))).where(F.col("r") <= cap)
        part = written(drawn.select(F.lit(k).alias("hop"), "to", "src", "dst"), "walked")
        walked = part if walked is None else walked.union(part)
        at = written(part.select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti"), "frontier")
        seen = seen.union(at)
    return walked.groupBy("src", "dst").agg(F.min("hop").alias("hop")).select("hop", "src", "dst")
