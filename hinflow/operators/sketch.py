"""Bottom-k minimum-value sketches in long form: one row (node, h) per slot.

A slot that is empty is a row that is not there. Merging is union and the k
smallest distinct values per node. The dense_rank filter runs as a partial and
a final group limit: each task cuts a hub to its k smallest values before the
only shuffle, and the k survivors of a node lose their repeats where they are.

Hashes have 60 bits, because decoding joins on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import DIGITS, RANGE, keyed
from ..plans.metapath import GraphSchema, MetaPath, composed, stored
from ..plans.scratch import written
from .edges import reverse


def universe(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """(node, h)."""
    return nodes.select("node", keyed(seed, F.col("node"), digits=DIGITS).alias("h"))


def bottom_k(rows: DataFrame, k: int, keys: tuple[str, ...] = ("node",)) -> DataFrame:
    """The k smallest distinct h per key."""
    order = W.partitionBy(*keys).orderBy("h")
    kept = rows.select(*keys, "h").withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k)
    return kept.select(*keys, "h").distinct()


def step(sketch: DataFrame, hop: DataFrame, k: int, own: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Sketches move along ``hop`` (src, dst); ``own`` (node, h) joins what arrives, ``excluded`` (node, h) stays out."""
    keys = tuple(c for c in sketch.columns if c not in ("node", "h"))
    moved = sketch.join(hop, sketch["node"] == hop["src"]).select(*keys, F.col("dst").alias("node"), "h")
    return _kept(moved, k, keys, own, excluded)


def _kept(moved: DataFrame, k: int, keys: tuple[str, ...], own: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    if excluded is not None:
        moved = moved.join(excluded, ["node", "h"], "left_anti")
    return bottom_k(moved if own is None else moved.unionByName(own), k, (*keys, "node"))


def bounded_step(sketch: DataFrame, hop: DataFrame, k: int, own: DataFrame | None = None, excluded: DataFrame | None = None, kept: bool = False) -> DataFrame:
    """``step``, with the same result, for sketches of several slots a node: slots that cannot be kept are not shuffled.

    The lowest slots of every node go first. If k different ones arrive at a
    node, the largest of its k smallest bounds what it keeps, and of the other
    slots only those up to that bound follow. Nodes where fewer than k arrive
    take all. Sketches with hardly more slots than go first take one step.
    ``kept``: ``hop`` is read from a written table, so it is not written again.
    """
    keys = tuple(c for c in sketch.columns if c not in ("node", "h"))
    lead = -(-k // 16)
    sketch = written(sketch, "sketch")
    held = sketch.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n")).first()[0]
    if held is None or held <= 3 * lead:
        return step(sketch, hop, k, own, excluded)
    hop = hop.select("src", "dst") if kept else written(hop.select("src", "dst"), "hop")
    first = written(step(bottom_k(sketch, lead, (*keys, "node")), hop, k, None, excluded), "first-slots")
    bound = first.groupBy(*keys, F.col("node").alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("most"))
    bound = bound.where(F.col("n") == k).select(*keys, "dst", "most")
    if keys:
        groups = F.broadcast(sketch.select(*keys).distinct())
        hop = hop.crossJoin(groups)
    aimed = hop.join(bound, [*keys, "dst"], "left").withColumnsRenamed({"src": "node"})
    moved = sketch.join(aimed, [*keys, "node"]).where(F.col("most").isNull() | (F.col("h") <= F.col("most")))
    return _kept(moved.select(*keys, F.col("dst").alias("node"), "h"), k, keys, own, excluded)


def propagate(schema: GraphSchema, path: MetaPath, start: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """Layered propagation of ``start`` (node, h, ...) to the end of ``path``. ``exclude_self``: no node keeps its own hash at the end."""
    out, last = start, len(path.steps) - 1
    if last:
        schema = stored(schema, path)
    for i, hop in enumerate(schema.hops(path)):
        excluded = start if exclude_self and i == last else None
        # What starts with one slot a node has nothing to leave behind.
        out = bounded_step(out, hop, k, excluded=excluded, kept=True) if i else step(out, hop, k, excluded=excluded)
    return out


#: Levels that sketches of several levels keep apart at once, and edges into one node from which on slots are cut before the shuffle.
LEVELS, CROWD = 32, 1 << 16


def _places(rows: DataFrame, levels: int) -> DataFrame:
    """The distinct (node, h, level) of ``rows`` with columns c1, c2, ...: in how many slots of at least that level, up to h and with it, the node has."""
    order = W.partitionBy("node").orderBy("h")
    before = F.lag("h").over(order)
    rows = rows.select("node", "h", "level", (before.isNull() | (before != F.col("h"))).alias("new"))
    upto = W.partitionBy("node").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = [F.sum(F.when(F.col("new") & (F.col("level") >= i), 1).otherwise(0)).over(upto).alias(f"c{i}") for i in range(1, levels + 1)]
    return rows.select("*", *counts).where("new").drop("new")


def levelled(rows: DataFrame, k: int, levels: int) -> DataFrame:
    """Nested sketches in one: ``rows`` (node, h, level), where a slot belongs to the sketches 1 to ``level``.

    Sketch i has the k smallest distinct h of level i or more. A slot is in
    one of its sketches only if it is in that of its own level, where it meets
    the fewest others, so that is asked alone. Equal h have equal levels.
    """
    own = F.coalesce(*(F.when(F.col("level") == i, F.col(f"c{i}")) for i in range(1, levels + 1)))
    return _places(rows, levels).where(own <= k).select("node", "h", "level")


def _moved(sketch: DataFrame, hop: DataFrame) -> DataFrame:
    return sketch.join(hop, sketch["node"] == hop["src"]).select(F.col("dst").alias("node"), "h", "level")


def _code(h: Column) -> Column:
    """16 bits, in the order of ``h``, that two values share if they differ by less than a part in 700."""
    return F.ceil(F.log2(h.cast("double") + 1) * 512).cast("short")


def _bounded(sketch: DataFrame, hop: DataFrame, k: int, levels: int, thin: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What moves along ``hop``, without slots that cannot be kept: as in ``bounded_step``, with a bound for every level."""
    sketch = written(sketch, "sketch")
    lead = -(-k // 16)
    first = _places(thin(_moved(levelled(sketch, lead, levels), hop)), levels)
    bounds = [F.coalesce(_code(F.min(F.when(F.col(f"c{i}") == k, F.col("h")))), F.lit(32767).cast("short")) for i in range(1, levels + 1)]
    bound = first.groupBy(F.col("node").alias("dst")).agg(F.array(*bounds).alias("most"))
    aimed = hop.join(bound, "dst").withColumnRenamed("src", "node")
    moved = sketch.join(aimed, "node").where(_code(F.col("h")) <= F.get("most", F.col("level") - 1))
    return moved.select(F.col("dst").alias("node"), "h", "level")


def levelled_counts(schema: GraphSchema, path: MetaPath, start: DataFrame, levels: int, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """(level, node, count): estimates from the sketches that start (node, h, level) leaves along ``path``, for every level.

    The same as ``estimates_by`` of one sketch a level, but a slot is moved
    once for all its levels. ``candidates`` (node): the ends that count.
    """
    hops = schema.hops(path)
    out = start
    for i, hop in enumerate(hops):
        hop = hop.select("src", "dst")
        if candidates is not None and i == len(hops) - 1:
            hop = hop.join(candidates.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
        thin = lambda rows: rows
        if (hop.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > CROWD:
            # Each task leaves such a node at most k slots a level, as in ``bottom_k``.
            thin = lambda rows: bottom_k(rows, k, ("node", "level")).select("node", "h", "level")
        out = thin(_bounded(out, hop, k, levels, thin) if i else _moved(out, hop))
        if i < len(hops) - 1:
            out = levelled(out, k, levels)
    ends = [F.struct(F.lit(i).alias("level"), F.max(f"c{i}").alias("n"), F.min(F.when(F.col(f"c{i}") == k, F.col("h"))).alias("top")) for i in range(1, levels + 1)]
    each = _places(out, levels).groupBy("node").agg(F.array(*ends).alias("e")).select("node", F.explode("e").alias("e")).select("node", "e.*").where("n > 0")
    value = F.when(F.col("n") < k, F.col("n").cast("double")).otherwise(F.lit((k - 1) * RANGE) / F.greatest("top", F.lit(1)))
    return each.select("level", "node", value.alias("count"))


def propagate_accumulating(schema: GraphSchema, path: MetaPath, types: list[str], start: DataFrame, k: int) -> DataFrame:
    """Sketches kept per node type: a type met again keeps its earlier slots, the start its own hash.

    ``types`` names the node type before each step and after the last.
    """
    held = {types[0]: start}
    for kind, hop, after in zip(types, schema.hops(path), types[1:], strict=False):
        held[after] = bounded_step(held[kind], hop, k, held.get(after))
    return held[types[len(path.steps)]]


def association(schema: GraphSchema, path: MetaPath, layer: int, start: DataFrame, k: int) -> DataFrame:
    """Sketch of the association peers: ``layer`` steps forward, then back."""
    out = propagate(schema, path.prefix(layer), start, k)
    for hop in reversed(schema.hops(path.prefix(layer))):
        out = bounded_step(out, reverse(hop), k)
    return out


def association_by_layer(schema: GraphSchema, path: MetaPath, start: DataFrame, k: int) -> DataFrame:
    """(layer, ..., node, h): sketches of the association peers for every layer of ``path``, in one pass forward and one back.

    What comes forward to a layer joins what comes back from the layers behind
    it, so there are two steps a layer, however many layers there are; other
    columns of ``start`` (node, h, ...) are keys as well. A layer of ``halves``
    goes back in one step: what a merged sketch holds does not depend on the
    steps, and the layers between need no sketches then.
    """
    hops = stored(schema, path).hops(path)
    ahead = [start]
    for hop in hops:
        ahead.append(written(bounded_step(ahead[-1], hop, k, kept=True) if len(ahead) > 1 else step(ahead[-1], hop, k), "ahead"))
    at_once = halves(hops)
    back = None
    for layer in range(len(hops), 0, -1):
        if layer not in at_once:
            own = ahead[layer].withColumn("layer", F.lit(layer))
            back = own if back is None else back.unionByName(own)
        if back is not None:
            back = bounded_step(back, reverse(hops[layer - 1]), k, kept=True)
    for layer, half in at_once.items():
        back = back.unionByName(bounded_step(ahead[layer].withColumn("layer", F.lit(layer)), reverse(half), k, kept=True))
    return back


def halves(hops: list[DataFrame]) -> dict[int, DataFrame]:
    """By layer (2 and up) the distinct (src, dst) from layer 0, written, as long as every node of the layer before it is reached from one node only, so that it has no more rows than the layer's own hop."""
    out, half = {}, hops[0]
    for layer, hop in enumerate(hops[1:], 2):
        if not half.distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
        half = out[layer] = written(composed(half, hop), "half")
    return out


def estimates_by(sketch: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, degree): exact below k slots, else (k - 1) / (largest slot as a fraction)."""
    n, top = F.count(F.lit(1)), F.greatest(F.max("h"), F.lit(1))
    value = F.when(n < k, n.cast("double")).otherwise(F.lit((k - 1) * RANGE) / top)
    return sketch.groupBy(*keys).agg(value.alias("degree"))


def estimate(sketch: DataFrame, k: int) -> DataFrame:
    """(node, degree), the mean over all other columns of the sketch."""
    keys = [c for c in sketch.columns if c != "h"]
    per = estimates_by(sketch, k, tuple(keys))
    return per if keys == ["node"] else per.groupBy("node").agg(F.avg("degree").alias("degree"))


def decode(sketch: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst): the nodes behind each node's slots. Catalyst broadcasts ``known`` only while it is small."""
    u = known.select(F.col("node").alias("dst"), F.col("h"))
    return sketch.join(u, "h").select(F.col("node").alias("src"), "dst")


def decode_one(sketch: DataFrame, known: DataFrame, node: int) -> DataFrame:
    """(node): what one node's sketch holds."""
    return decode(sketch.where(F.col("node") == node), known).select(F.col("dst").alias("node"))


def exact_bottom_k(edges: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Bottom-k of the true neighbourhoods: what propagation must equal."""
    u = known.select(F.col("node").alias("dst"), "h")
    return bottom_k(edges.join(u, "dst").select(F.col("src").alias("node"), "h"), k)


def fill_rate(sketch: DataFrame, k: int) -> DataFrame:
    return sketch.groupBy("node").agg((F.count(F.lit(1)) / F.lit(float(k))).alias("fill"))


def repeated_starts(nodes: DataFrame, reps: int, seed: int = 42) -> DataFrame:
    """(rep, node, h) with independent hashes per repetition."""
    rep = F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))
    return nodes.select(rep.alias("rep"), "node").select("rep", "node", keyed(seed, F.col("rep"), F.col("node"), digits=DIGITS).alias("h"))


def growth(layers: list[DataFrame], k: int) -> DataFrame:
    """(node, slope): by how much ln(estimated neighbours) grows a layer, by least squares over the layers 1, 2, ... that a node has; null with fewer than two."""
    rows = None
    for i, sketch in enumerate(layers, 1):
        part = estimate(sketch, k).select("node", F.lit(float(i)).alias("layer"), F.ln("degree").alias("size"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("node").agg(F.regr_slope("size", "layer").alias("slope"))
