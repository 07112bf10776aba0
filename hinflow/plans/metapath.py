"""Meta-paths: parsing, binding to relations, and the joins they stand for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.edges import reverse
from .scratch import written


@dataclass(frozen=True)
class Step:
    relation: str
    forward: bool = True

    def back(self) -> Step:
        return Step(self.relation, not self.forward)


@dataclass(frozen=True)
class MetaPath:
    """A chain of relations, optionally ending at one node (``anchor``)."""

    steps: tuple[Step, ...]
    anchor: int | None = None

    @classmethod
    def parse(cls, text: str, anchor: int | None = None) -> MetaPath:
        """``writes,rev_writes``: names between commas, ``rev_`` for a step against its direction."""
        names = [n.strip() for n in text.split(",") if n.strip()]
        if not names:
            raise ValueError("a meta-path needs a relation")
        return cls(tuple(Step(n.removeprefix("rev_"), not n.startswith("rev_")) for n in names), anchor)

    def prefix(self, n: int) -> MetaPath:
        return MetaPath(self.steps[:n])

    def mirrored(self) -> MetaPath:
        return MetaPath(self.steps + tuple(s.back() for s in reversed(self.steps)))

    def is_palindrome(self) -> bool:
        return len(self.steps) > 1 and self.steps == tuple(s.back() for s in reversed(self.steps))

    def __str__(self) -> str:
        return ",".join(s.relation if s.forward else f"rev_{s.relation}" for s in self.steps)


class GraphSchema:
    """Relations by name; a name that is not there raises instead of guessing.

    With ``types`` (relation: source type, target type) a step may also name
    the types, as in ``author_to_paper``, in any case, and paths must chain.
    """

    def __init__(self, relations: dict[str, DataFrame], types: dict[str, tuple[str, str]] | None = None):
        self.relations, self.types = relations, types or {}

    def match(self, name: str) -> tuple[str, bool]:
        """The relation that ``name`` means, and whether it runs in its direction: by types, then by name, then as the types of a reverse."""
        if name in self.relations:
            return name, True
        low = name.lower()
        by_types = {f"{a}_to_{b}".lower(): n for n, (a, b) in reversed(self.types.items())}
        by_name = {n.lower(): n for n in reversed(self.relations)}
        back = {f"{b}_to_{a}".lower(): n for n, (a, b) in reversed(self.types.items())}
        if low in by_types or low in by_name:
            return by_types.get(low) or by_name[low], True
        if low in back:
            return back[low], False
        raise KeyError(f"no relation {name!r}; there are {sorted(self.relations)}")

    def step(self, step: Step) -> DataFrame:
        name, ahead = self.match(step.relation)
        edges = self.relations[name].select("src", "dst")
        return edges if step.forward == ahead else reverse(edges)

    def ends(self, step: Step) -> tuple[str, str] | None:
        name, ahead = self.match(step.relation)
        types = self.types.get(name)
        return types if types is None or step.forward == ahead else types[::-1]

    def hops(self, path: MetaPath) -> list[DataFrame]:
        ends = [self.ends(s) for s in path.steps]
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False), 1):
            if a and b and a[1] != b[0]:
                raise ValueError(f"{path}: step {k} ends at {a[1]}, step {k + 1} starts at {b[0]}")
        return [self.step(s) for s in path.steps]

    def standardised(self) -> GraphSchema:
        """With a reverse relation for every one that lacks it."""
        return GraphSchema(self.relations | {f"rev_{n}": reverse(e) for n, e in self.relations.items() if f"rev_{n}" not in self.relations and not n.startswith("rev_")})


def stored(schema: GraphSchema, path: MetaPath) -> GraphSchema:
    """``schema`` with the relations of ``path`` written, so that no step computes them again; those that are files already stay."""
    names = {schema.match(s.relation)[0] for s in path.steps}
    fresh = {n: schema.relations[n] for n in names if not hasattr(schema.relations[n], "scratch_path")}
    return GraphSchema(schema.relations | {n: written(e.select("src", "dst"), "relation") for n, e in fresh.items()}, schema.types)


def composed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (src, dst) over a shared middle node. The early distinct keeps chains from multiplying paths."""
    r = right.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    return left.join(r, left["dst"] == r["mid"]).select("src", F.col("end").alias("dst")).distinct()


#: Members of a middle node that meet in one key of a self-join.
SHARE = 1024


def dealt(half: DataFrame, share: int = SHARE) -> DataFrame:
    """``half`` (src, dst and more) with the members of each ``dst`` dealt into parts of about ``share``: (one, mid, part, parts and more), written.

    Both sides of a self-join read it, so the half path is computed once.
    """
    ends = written(half.withColumnsRenamed({"src": "one", "dst": "mid"}), "half")
    parts = ends.groupBy("mid").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("parts"))
    return written(ends.join(parts, "mid").withColumn("part", F.pmod(F.xxhash64("one"), F.col("parts")).cast("int")), "dealt")


def paired(members: DataFrame, weight: str | None = None) -> DataFrame:
    """(a, b), a < b, of the nodes of ``members`` (as ``dealt`` writes them) that share a middle node, once per middle node.

    A middle node with d members makes d * d / 2 pairs. Each pair of its parts
    is a join key of its own, so one middle node spreads over many tasks. With
    ``weight`` the product of both members' values follows under that name.
    """
    side = lambda node, value: [F.col("one").alias(node), "mid", *([F.col(weight).alias(value)] if weight else [])]
    left = members.select(*side("one", "v"), "part", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("other"))
    right = members.select(*side("two", "w"), F.col("part").alias("other"), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("part"))
    pairs = left.join(right, ["mid", "part", "other"]).where("part < other or one < two")
    return pairs.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), *([(F.col("v") * F.col("w")).alias(weight)] if weight else []))


def both_ways(pairs: DataFrame, *more: str) -> DataFrame:
    """(src, dst and more) of unordered ``pairs`` (a, b and more), in either order, without a join."""
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), *more)
    return pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*")


#: Nodes of a class that travel as one row.
CHUNK = 4096


def classed(half: DataFrame) -> DataFrame:
    """(node, of): sources of ``half`` (distinct src, dst) with equal sets of ends are one class, ``of`` its smallest node; written.

    Sets of equal size and hash sums are compared end by end with that of the
    smallest node; a source whose set differs all the same is a class of its own.
    """
    word = lambda salt: F.sum(F.xxhash64("dst", F.lit(salt)).cast("decimal(20,0)"))
    sets = written(half.groupBy("src").agg(F.count(F.lit(1)).alias("n"), word(1).alias("a"), word(2).alias("b")), "sets")
    alike = written(sets.join(sets.groupBy("n", "a", "b").agg(F.min("src").alias("of")), ["n", "a", "b"]).select("src", "of", "n"), "alike")
    others = alike.where("src <> of")
    first = half.join(others.select(F.col("of").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("first"), F.col("dst").alias("end"))
    met = half.join(others, "src").join(first, (F.col("of") == F.col("first")) & F.col("dst").eqNullSafe(F.col("end")))
    same = met.groupBy("src", "n").agg(F.count(F.lit(1)).alias("met")).where("met = n").select("src", F.lit(True).alias("same"))
    return written(alike.join(same, "src", "left").select(F.col("src").alias("node"), F.when(F.col("same"), F.col("of")).otherwise(F.col("src")).alias("of")), "classes")


def few(half: DataFrame) -> bool:
    """Whether sources of ``half`` have so few different sets of ends that pairs of classes are worth making instead of pairs of nodes; both ways give the same graph."""
    sets = half.groupBy("src").agg(F.bit_xor(F.xxhash64("dst")).alias("set"))
    n = sets.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("set").alias("c")).first()
    return n["c"] * 4 <= n["n"]


def class_links(half: DataFrame, classes: DataFrame, share: int = SHARE) -> DataFrame:
    """(a, b): classes whose nodes share a middle node of ``half``, both ways, each with itself; written."""
    first = half.join(classes.where("node = of").select(F.col("node").alias("src")), "src", "left_semi")
    return written(_mirrored(first, share).toDF("a", "b"), "links")


def quotient(half: DataFrame, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of the graph of ``mirrored``: node, of; and a, b."""
    half = written(half.select("src", "dst").distinct(), "half")
    classes = classed(half)
    return classes, class_links(half, classes, share)


def class_pairs(classes: DataFrame, links: DataFrame, *kinds: str, chunk: int = CHUNK) -> DataFrame:
    """Chunks of the classes that ``links`` (a, b and more) names: its columns, the arrays xs and ys of their nodes, and for each of ``kinds``, columns of ``classes``, x_ and y_ with their values.

    Every pair of nodes lies in one row, so what is exploded from it needs no
    shuffle and no distinct. Chunks hold about ``chunk`` nodes, so a class
    spreads over many tasks.
    """
    parts = classes.groupBy("of", *kinds).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts"))
    same = F.lit(True)
    for k in ("of", *kinds):
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}"))
    chunks = classes.alias("c").join(parts.alias("p"), same).select("c.of", *(f"c.{k}" for k in kinds), "node", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    chunks = written(chunks.groupBy("of", *kinds, "part").agg(F.collect_list("node").alias("nodes")), "chunks")
    side = lambda end, x: chunks.select(F.col("of").alias(end), *(F.col(k).alias(f"{x}_{k}") for k in kinds), F.col("nodes").alias(f"{x}s"))
    pairs = links.join(side("a", "x"), "a").join(side("b", "y"), "b")
    # Rows are few and wide; each stands for up to chunk * chunk pairs, so they are dealt a handful to a task.
    sizes = chunks.groupBy("of").agg(F.count(F.lit(1)).alias("n"))
    rows = links.join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    return pairs.repartition(max(1, min((rows or 0) // 2, 16384)))


#: Pairs that a task holds at once while it lists them.
HELD = 1 << 16


def spread(pairs: DataFrame, *more: str, held: int = HELD) -> DataFrame:
    """(src, dst and more) of all pairs in the rows of ``class_pairs``.

    A task keeps all rows that compiled code makes of one row until it has
    made the last of them. So rows are first cut into pieces of about ``held``
    pairs; ``transform`` is not compiled, and its pieces leave one by one.
    """
    step = F.greatest(F.lit(1), F.floor(F.lit(held) / F.greatest(F.lit(1), F.size("ys"))).cast("int"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("xs")), step)
    pieces = pairs.select(F.explode(F.transform(starts, lambda i: F.slice("xs", i, step))).alias("xs"), "ys", *more)
    return pieces.select(F.explode("xs").alias("src"), "ys", *more).select("src", F.explode("ys").alias("dst"), *more)


def _mirrored(half: DataFrame, share: int) -> DataFrame:
    members = dealt(half.select("src", "dst"), share)
    return both_ways(paired(members).distinct()).union(members.select(F.col("one").alias("src"), F.col("one").alias("dst")).distinct())


def mirrored(half: DataFrame, share: int = SHARE) -> DataFrame:
    """Distinct (src, dst) of sources that share a middle node of ``half`` (distinct src, dst), both ways, each with itself.

    Where many sources have equal sets of middle nodes, pairs of such classes
    are made, and their nodes listed without a shuffle. Otherwise arrays of
    members are shuffled, and pairs listed from what is left of them.
    """
    half = written(half.select("src", "dst"), "half")
    if few(half):
        classes = classed(half)
        return spread(class_pairs(classes, class_links(half, classes, share)))
    return peer_sets(half, share).select(F.col("node").alias("src"), F.explode("peers").alias("dst")).withColumn("dst", F.col("dst").cast(half.schema["src"].dataType))


def class_degree(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(of, size, degree): nodes of each class, and nodes of all classes that it links to; one row a class, written."""
    sizes = classes.groupBy("of").agg(F.count(F.lit(1)).alias("size"))
    reached = links.join(sizes.toDF("b", "there"), "b").groupBy(F.col("a").alias("of")).agg(F.sum("there").alias("degree"))
    return written(sizes.join(reached, "of"), "class-degrees")


def mirrored_degree(half: DataFrame, share: int = SHARE) -> DataFrame:
    """(node, degree) in ``mirrored``, itself included: the union of its middle nodes' members, counted without listing pairs of equal classes."""
    half = written(half.select("src", "dst"), "half")
    if few(half):
        classes = classed(half)
        d = class_degree(classes, class_links(half, classes, share))
        return classes.join(d, "of").select("node", "degree")
    # A node that meets many members has several rows.
    return peer_sets(half, share).select("node", F.size("peers").cast("bigint").alias("n")).groupBy("node").agg(F.sum("n").alias("degree"))


#: Members of its middle nodes that a node takes at once; a node that meets more takes them in several shares.
MET = 1 << 20


def peer_sets(half: DataFrame, share: int = SHARE, value: str = "src", met: int = MET) -> DataFrame:
    """(node, bucket, of, peers): each node's distinct peers in ``mirrored`` as an array, in ``of`` rows if it meets more than about ``met`` members.

    ``value``: a column of ``half`` that stands for the peer, one for each source.
    """
    return reached_sets(half.select(F.col("src").alias("node"), "dst"), half.select("dst", F.col(value).alias("peer")), share, met)


def reached_sets(starts: DataFrame, members: DataFrame, share: int = SHARE, met: int = MET) -> DataFrame:
    """(node, bucket, of, peers): the distinct peers that each node of ``starts`` (node, dst) meets among ``members`` (dst, peer), as ``peer_sets``; null is no peer.

    What is shuffled are arrays of a middle node's members, a chunk for each
    start that leads there, not pairs; numbers that fit go in 32 bits. Repeats
    are dropped where they arrive.
    """
    by = written(_by_middle(members, share), "middles")
    lo, hi = by.agg(F.min("lo"), F.max("hi")).first()
    pairs = starts.groupBy("dst").agg(F.count(F.lit(1)).alias("m")).join(by, "dst").agg(F.sum(F.col("m") * F.col("n"))).first()[0]
    if lo is not None and -(1 << 31) <= lo and hi < 1 << 31:
        members = members.withColumn("peer", F.col("peer").cast("int"))
    parts = by.select("dst", "n", "parts")
    chunks = members.join(parts, "dst").groupBy("dst", F.pmod(F.xxhash64("peer"), F.col("parts")).alias("part")).agg(F.sort_array(F.collect_list("peer")).alias("peers"))
    rows = starts.join(chunks.select("dst", "peers"), "dst").select("node", "peers")
    large = written(starts.join(parts, "dst").groupBy("node").agg(F.ceil(F.sum("n") / met).cast("int").alias("of")).where("of > 1"), "large")
    n = max(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min((pairs or 0) // 8_000_000, 16384))
    peers = F.array_distinct(F.flatten(F.collect_list("peers"))).alias("peers")
    if large.isEmpty():
        return rows.repartition(n, "node").groupBy("node").agg(peers).select("node", F.lit(0).alias("bucket"), F.lit(1).alias("of"), "peers")
    rows = rows.join(large, "node", "left").withColumn("of", F.coalesce("of", F.lit(1)))
    rows = rows.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    mine = F.filter("peers", lambda x: F.pmod(F.xxhash64(x), F.col("of")) == F.col("bucket"))
    rows = rows.select("node", "bucket", "of", F.when(F.col("of") == 1, F.col("peers")).otherwise(mine).alias("peers"))
    return rows.repartition(n, "node", "bucket").groupBy("node", "bucket", "of").agg(peers)


def composed_size(left: DataFrame, right: DataFrame, share: int = SHARE, met: int = MET) -> DataFrame:
    """(n): rows of ``composed``, counted from arrays of what a middle node leads to; both are distinct."""
    left, right = written(left.select("src", "dst"), "left"), written(right.select(F.col("src").alias("dst"), F.col("dst").alias("peer")), "right")
    sets = reached_sets(left.select(F.col("src").alias("node"), "dst"), right.where("peer is not null"), share, met)
    # Arrays drop nulls, which are an end like any other.
    none = left.join(right.where("peer is null"), "dst", "left_semi").select("src").distinct().agg(F.count(F.lit(1)).alias("n"))
    found = sets.agg(F.sum(F.size("peers").cast("bigint")).alias("n"))
    return found.union(none).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def peer_ranks(half: DataFrame, ranks: DataFrame, keep: int, share: int = SHARE, met: int = MET) -> DataFrame:
    """(node, ranks): the ``keep`` smallest ranks of each node's peers in ``mirrored``, in order; ``ranks`` (node, rank), no two alike."""
    ranked = half.join(ranks.select(F.col("node").alias("src"), "rank"), "src")
    sets = peer_sets(ranked, share, "rank", met).select("node", "of", F.slice(F.sort_array("peers"), 1, keep).alias("ranks"))
    if not _large(half, met):
        return sets.select("node", "ranks")
    sets = written(sets, "rank-sets")
    merged = sets.where("of > 1").groupBy("node").agg(F.flatten(F.collect_list("ranks")).alias("p")).select("node", F.slice(F.sort_array("p"), 1, keep).alias("ranks"))
    return sets.where("of = 1").select("node", "ranks").union(merged)


def _by_middle(ends: DataFrame, share: int) -> DataFrame:
    """(dst, n, parts, lo, hi): members of each middle node, their parts, and the range of their peers' numbers (null where these are none)."""
    v = F.col("peer") if ends.schema["peer"].dataType.typeName() in ("long", "integer") else F.lit(None).cast("long")
    return ends.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / share).alias("parts"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def _large(half: DataFrame, met: int) -> bool:
    """Whether some node meets more than ``met`` members of its middle nodes."""
    n = half.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    return not half.join(n, "dst").groupBy("src").agg(F.sum("n").alias("n")).where(F.col("n") > met).isEmpty()


def metapath_edges(schema: GraphSchema, path: MetaPath) -> DataFrame:
    """The relational graph of ``path``: (u, v) if an instance of the path leads from u to v.

    An anchored path is built from its anchor backwards, so only nodes that
    reach the anchor are ever expanded. A palindrome is its half path joined
    with itself; its graph is symmetric and has a loop at every node with an
    instance of the half path.
    """
    if path.anchor is None and path.is_palindrome():
        return mirrored(metapath_edges(schema, path.prefix(len(path.steps) // 2)))
    hops = schema.hops(path)
    if path.anchor is not None:
        out = hops[-1].where(F.col("dst") == path.anchor)
        for hop in reversed(hops[:-1]):
            out = composed(hop, out)
        return out
    out = hops[0].distinct()
    for hop in hops[1:]:
        out = composed(out, hop)
    return out


def power(edges: DataFrame, exponent: int) -> DataFrame:
    """Distinct (src, dst) of walks of ``exponent`` edges.

    Nodes with equal neighbour sets are expanded once: only the smallest of
    each class takes part in the joins.
    """
    e = edges.select("src", "dst").distinct()
    classes = classed(e).toDF("src", "of")
    steps = e.join(classes.where("src = of").select("src"), "src", "left_semi")
    ends = classes.toDF("dst", "of_dst")
    out = steps
    for _ in range(exponent - 1):
        to_class = out.join(ends, "dst").select("src", F.col("of_dst").alias("dst")).distinct()
        out = composed(to_class, steps)
    return classes.join(out.withColumnRenamed("src", "of"), "of").select("src", "dst")


def mirrored_power(half: DataFrame, exponent: int, share: int = SHARE) -> DataFrame:
    """``power`` of ``mirrored``: walks are joined between classes of sources, and nodes listed at the end, without a shuffle."""
    classes, links = quotient(half, share)
    step = links.toDF("src", "dst")
    out = step
    for _ in range(exponent - 1):
        out = composed(out, step)
    return spread(class_pairs(classes, written(out.toDF("a", "b"), "walks")))


def shared_paths(half: DataFrame, share: int = SHARE) -> DataFrame:
    """(src, dst, paths): over all middle nodes, instances of ``half`` (one row per src and dst, paths) from either side multiplied and summed.

    The numbers of (a, b) and (b, a) are equal, so one order is made, shuffled
    and summed; the other follows.
    """
    members = dealt(half.select("src", "dst", "paths"), share)
    pairs = paired(members, "paths").groupBy("a", "b").agg(F.sum("paths").alias("paths"))
    own = members.groupBy(F.col("one").alias("src")).agg(F.sum(F.col("paths") * F.col("paths")).alias("paths"))
    return both_ways(pairs, "paths").union(own.select("src", F.col("src").alias("dst"), "paths"))


def enough_peers(schema: GraphSchema, path: MetaPath, least: int = 3) -> bool:
    """Whether a path is worth evaluating: at least ``least`` peers, and more than one step if it is anchored."""
    if path.anchor is not None and len(path.steps) <= 1:
        return False
    return peers(schema, path).limit(least).count() >= least


def path_counts(schema: GraphSchema, path: MetaPath) -> DataFrame:
    """(src, dst, paths): number of instances, summed after each hop."""
    hops = schema.hops(path)
    out = hops[0].groupBy("src", "dst").agg(F.count(F.lit(1)).alias("paths"))
    for hop in hops[1:]:
        h = hop.groupBy(F.col("src").alias("mid"), F.col("dst").alias("end")).agg(F.count(F.lit(1)).alias("n"))
        out = out.join(h, out["dst"] == h["mid"]).groupBy("src", F.col("end").alias("dst")).agg(F.sum(F.col("paths") * F.col("n")).alias("paths"))
    return out


def association_edges(schema: GraphSchema, path: MetaPath, layer: int) -> DataFrame:
    """Pairs of layer-0 nodes that share a node at ``layer``, each with itself included.

    The half path is computed once and joined with itself.
    """
    return mirrored(metapath_edges(schema, path.prefix(layer)))


def association_degree(schema: GraphSchema, path: MetaPath, layer: int) -> DataFrame:
    """(node, degree) of ``association_edges``, without its pairs."""
    return mirrored_degree(metapath_edges(schema, path.prefix(layer)))


def frontier(schema: GraphSchema, path: MetaPath, start: DataFrame) -> DataFrame:
    """(node, layer) reached from ``start`` (column node), layer by layer, layer 0 included."""
    at = start.select("node").distinct()
    out = at.withColumn("layer", F.lit(0))
    for k, hop in enumerate(schema.hops(path), 1):
        at = hop.join(at.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        out = out.union(at.withColumn("layer", F.lit(k)))
    return out


def back_frontier(schema: GraphSchema, path: MetaPath, end: DataFrame) -> DataFrame:
    """(node, layer) from which ``end`` (column node, the last layer) is reached."""
    at, n = end.select("node").distinct(), len(path.steps)
    out = at.withColumn("layer", F.lit(n))
    for k, hop in reversed(list(enumerate(schema.hops(path)))):
        at = hop.join(at.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        out = out.union(at.withColumn("layer", F.lit(k)))
    return out


def peers(schema: GraphSchema, path: MetaPath) -> DataFrame:
    """(node): layer-0 nodes with an instance of the path (to its anchor, if it has one)."""
    hops = schema.hops(path)
    at = hops[-1].where(F.col("dst") == path.anchor) if path.anchor is not None else hops[-1]
    at = at.select(F.col("src").alias("node")).distinct()
    for hop in reversed(hops[:-1]):
        at = hop.join(at.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    return at


def peers_of(schema: GraphSchema, path: MetaPath, layer: int, nodes: DataFrame) -> DataFrame:
    """(node, peer) for the given nodes only: ``layer`` hops forward, then back."""
    out = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    for hop in schema.hops(path.prefix(layer)):
        out = composed(out, hop)
    for hop in reversed(schema.hops(path.prefix(layer))):
        out = composed(out, reverse(hop))
    return out.select(F.col("src").alias("node"), F.col("dst").alias("peer"))


def active(schema: GraphSchema, path: MetaPath) -> DataFrame:
    """(node, layer) on some instance of the path: both semi-join passes of a full reduction."""
    forward = written(frontier(schema, path, peers(schema, path)), "forward")
    last = forward.where(F.col("layer") == len(path.steps))
    return forward.join(back_frontier(schema, path, last), ["node", "layer"], "left_semi")


def matching_edges(schema: GraphSchema, path: MetaPath) -> DataFrame:
    """(layer, src, dst): edges between active nodes of consecutive layers, of the step's relation only."""
    nodes = written(active(schema, path), "active")
    out = None
    for k, hop in enumerate(schema.hops(path)):
        here = nodes.where(F.col("layer") == k).select(F.col("node").alias("src"))
        there = nodes.where(F.col("layer") == k + 1).select(F.col("node").alias("dst"))
        part = hop.distinct().join(here, "src", "left_semi").join(there, "dst", "left_semi").select(F.lit(k).alias("layer"), "src", "dst")
        out = part if out is None else out.union(part)
    return out


def anchored_edges(schema: GraphSchema, path: MetaPath) -> DataFrame:
    """(layer, src, dst) on instances that end at the anchor."""
    if path.anchor is None:
        raise ValueError("the path has no anchor")
    out, at = None, None
    for k, hop in reversed(list(enumerate(schema.hops(path)))):
        kept = hop.where(F.col("dst") == path.anchor) if at is None else hop.join(at.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
        kept = kept.distinct()
        at = kept.select(F.col("src").alias("node")).distinct()
        part = kept.select(F.lit(k).alias("layer"), "src", "dst")
        out = part if out is None else out.union(part)
    return out
