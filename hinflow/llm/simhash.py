"""SimHash near-deduplication by tiled exact comparison (operator 1).

1. Fingerprints: the JVM lower-cases, splits and hashes shingles; numpy counts
   the bits of a batch of hashes at once.
2. Equal fingerprints are one node from here on, however many documents share
   them, so copies cost nothing more.
3. Blocks: a fingerprint is cut into radius + e sections. Two fingerprints
   within the radius agree in at least e whole sections, so every choice of e
   sections makes a block of the fingerprints that agree there, and no link is
   lost. e grows with the number of nodes, so that blocks stay small: blocks
   hold N / 2^16, N / 2^25 or N / 2^32 of N random fingerprints at radius 3.
4. Within a block, tiles are runs of fingerprints in order of their population
   counts. Tile pairs whose counts differ beyond the radius are skipped, which
   loses nothing either; the others are compared exactly, by numpy
   exclusive-or and bit counts. The comparison returns a spanning forest of its
   links, not the links: connectivity is all that groups need, and n near
   copies of one text give n - 1 rows instead of n * n / 2.
5. Components of the forest edges are found by joins and minima.

Blocks are cut into chunks of at most about CHUNK fingerprints, and one task
row compares one chunk with itself or with one other.

``near_dedup`` finds near copies by similarity of shingle sets (at least
``percent``). The radius is then too wide for sections, so its blocks are the
documents that share a MinHash of BAND shingles under one of BANDS
permutations; within blocks tiles and comparisons are the same, and a pair
within the radius only counts as a link if the shingle sets of both texts are
similar enough:

* first every node is checked against the centre of its largest block, which
  joins large groups at a cost in proportion to their size;
* then the candidate pairs between different components are found in blocks.
  A forest of them comes back, whose components ("blobs") hold every candidate
  pair. The sets of a blob's nodes meet in chunks of bounded size, where all
  pairs between different components are compared by products of 0/1 matrices.
  A forest of the links comes back, never the pairs.

Defined results: null and empty texts, and texts of white space, have the
fingerprint zero and link like any other (in ``near_dedup``: the empty set,
which links with itself only); texts of fewer words than a shingle
are one shingle; repeated rows share a group; a null identifier never names a
group unless all its members lack one; an empty table gives an empty table;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.scratch import discard
from .common import bind, join_hot, located, locator, lower_ascii, only, words_of, written

RADIUS = 3
SHINGLE = 3
#: Similarity in per cent, width and radius of ``near_dedup``, and its blocks.
PERCENT, WIDE, WIDE_RADIUS = 80, 5, 24
BANDS, BAND = 30, 5
CHUNK = 32768
#: Shingles of one chunk of sets.
SET_SHINGLES = 1 << 18
#: Elements of one comparison matrix, and the largest block that is compared by offsets.
MATRIX, SMALL = 1 << 20, 48

U = np.uint64


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of all shingles of ``width`` words, repeats included."""

    def hashes(w: Column) -> Column:
        shingle = lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(width)))
        return (
            F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(shingle(i))))
            .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return bind(words_of(lower_ascii(text)), hashes)


def majority(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per slice of ``values`` the word whose bits are set in over half of the slice."""
    n = np.diff(offsets)
    out = np.zeros(len(n), U)
    rows = np.flatnonzero(n)
    step = max(1, len(rows) * 100_000 // max(1, int(n.sum())))
    for k in range(0, len(rows), step):
        own = rows[k : k + step]
        lo, hi = offsets[own[0]], offsets[own[-1] + 1]
        bits = np.unpackbits(np.ascontiguousarray(values[lo:hi]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, offsets[own] - lo, axis=0, dtype=np.int32)
        out[own] = np.packbits(2 * ones > n[own, None], axis=1, bitorder="little").view(U).ravel()
    return out


def _slices(h: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return h.values.to_numpy(zero_copy_only=False).view(U), h.offsets.to_numpy().astype(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = majority(*_slices(batch.column("h")))
        names = [n for n in batch.schema.names if n != "h"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fp.view(np.int64))], [*names, "fp"])


def _hashed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), *locator(), shingle_hashes(F.col(text_col), width).alias("h"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, file, row, fp), one row per row of ``docs``, a plain read."""
    rows = _hashed(docs, id_col, text_col, width)
    return rows.mapInArrow(_fingerprints, f"id {rows.schema['id'].dataType.simpleString()}, file string, row long, fp long")


# --- comparison ------------------------------------------------------------------


def star(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the edges (u, v): each node and the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != (deeper := new[new])).any():
            new = deeper
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def near(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs within ``radius``, tile pair by tile pair; each pair of one array with itself once."""
    same = left is right
    by_left, by_right = np.argsort(np.bitwise_count(left), kind="stable"), np.argsort(np.bitwise_count(right), kind="stable")
    sorted_left, sorted_right = left[by_left], right[by_right]
    ones_left, ones_right = np.bitwise_count(sorted_left).astype(int), np.bitwise_count(sorted_right).astype(int)
    width = 2048
    rows = MATRIX // width
    for k in range(0, len(left), rows):
        part = sorted_left[k : k + rows]
        last = min(k + rows, len(left)) - 1
        # Tiles of the other side whose population counts come within the radius of this one's.
        lo = k if same else int(np.searchsorted(ones_right, ones_left[k] - radius))
        hi = int(np.searchsorted(ones_right, ones_left[last] + radius, side="right"))
        for c in range(lo, hi, width):
            other = sorted_right[c : min(c + width, hi)]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, :]) <= radius)
            if same:
                once = j + c > i + k
                i, j = i[once], j[once]
            if len(i):
                yield by_left[i + k], by_right[j + c]


def near_in_blocks(fps: np.ndarray, offsets: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``near`` within each slice of ``fps``: small slices all at once by offsets, large ones by tiles."""
    sizes = np.diff(offsets)
    for b in np.flatnonzero(sizes > SMALL):
        own = fps[offsets[b] : offsets[b + 1]]
        for i, j in near(own, own, radius):
            yield i + offsets[b], j + offsets[b]
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    if not len(small):
        return
    n = sizes[small]
    at = np.repeat(offsets[small] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    left = np.repeat(n, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) - 1
    x = fps[at]
    for d in range(1, int(n.max())):
        i = np.flatnonzero(left >= d)
        i = i[np.bitwise_count(x[i] ^ x[i + d]) <= radius]
        if len(i):
            yield at[i], at[i + d]


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
    us, vs, held, most = [], [], 0, MATRIX
    for u, v in pairs:
        us.append(u)
        vs.append(v)
        held += len(u)
        if held > most:
            u, v = star(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], len(u)
            most = max(MATRIX, 2 * held)
    return star(np.concatenate(us), np.concatenate(vs)) if us else None


def _compared(radius: int):
    """Forest edges from blocks ``fps``, each compared with itself or, where there is one, with the chunk ``other``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, offsets = _slices(batch.column("fps"))
            if "other" in batch.schema.names:
                others, bounds = _slices(batch.column("other"))
                chunks = ((fps[a:b], others[c:d]) for a, b, c, d in zip(offsets[:-1], offsets[1:], bounds[:-1], bounds[1:], strict=True))
                forest = _forest((left[i], right[j]) for left, right in chunks for i, j in near(left, right, radius))
            else:
                forest = _forest((fps[i], fps[j]) for i, j in near_in_blocks(fps, offsets, radius))
            if forest is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in forest], ["u", "v"])

    return run


# --- blocks ----------------------------------------------------------------------


def sections(radius: int, agree: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + agree sections of a word."""
    n = radius + agree
    cuts = [64 * k // n for k in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def agreeing(radius: int, nodes: int, most: int = 4096) -> int:
    """The number of sections that a block agrees in, so that random fingerprints fill a block to ``most`` at most."""
    for agree in range(1, 5):
        bits = sum(sorted(b for _, b in sections(radius, agree))[:agree])
        if nodes <= most << bits:
            break
    return agree


def block_keys(fp: Column, radius: int, agree: int) -> Column:
    """The blocks of a fingerprint: number of the choice of sections, and the bits there."""
    parts = sections(radius, agree)

    def kept(choice: tuple[int, ...]) -> Column:
        mask = sum(((1 << bits) - 1) << lo for lo, bits in (parts[c] for c in choice))
        return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))

    choices = combinations(range(len(parts)), agree)
    return F.array(*(F.struct(F.lit(k).cast("short").alias("choice"), kept(c).alias("bits")) for k, c in enumerate(choices)))


def blocks_of(nodes: DataFrame, radius: int, agree: int = 1, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Blocks (fps) to be compared with themselves, and chunk pairs (fps, other) of larger blocks, from distinct ``fp``."""
    keyed = nodes.select("fp", F.explode(block_keys(F.col("fp"), radius, agree)).alias("key")).select("fp", "key.*")
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    dealt = keyed.join(sizes, ["choice", "bits"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / chunk)).cast("int"))
    chunks = written(dealt.groupBy("choice", "bits", "chunk").agg(F.collect_list("fp").alias("fps"), F.first("n").alias("n")), "chunks")
    large = chunks.where(F.col("n") > chunk)
    right = large.select("choice", "bits", F.col("chunk").alias("second"), F.col("fps").alias("other"))
    crossed = large.join(right, ["choice", "bits"]).where("second > chunk").select("fps", "other")
    return chunks.select("fps"), crossed


def links(nodes: DataFrame, radius: int, agree: int = 1, chunk: int = CHUNK) -> DataFrame:
    """(u, v): forest edges with the components of all pairs within ``radius``."""
    own, crossed = blocks_of(nodes, radius, agree, chunk)
    schema = "u long, v long"
    return own.mapInArrow(_compared(radius), schema).unionByName(crossed.mapInArrow(_compared(radius), schema))


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component) of all distinct fingerprints in ``prints``; component: its smallest fingerprint."""
    nodes = written(prints.select("fp").distinct(), "nodes")
    found = components(links(nodes, radius, agreeing(radius, nodes.count())))
    return nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def _firsts(prints: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``prints`` with ``first``, the smallest (id, file, row) of the component that ``labels`` (key, component) gives."""
    least = prints.groupBy(key).agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("file"), F.col("row"))).alias("least"), F.count(F.lit(1)).alias("n"))
    members = written(labels.join(least, key), "members")
    firsts = members.groupBy("component").agg(F.min("least").alias("first"))
    named = written(members.join(firsts, "component").select(key, "first", "n"), "named")
    discard(members)
    return join_hot(prints, named, key, "n").drop("n")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(id, file, row, fp, first) per row; ``first`` (id, file, row) is its group's smallest member. ``docs`` is a plain read."""
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "prints")
    return _firsts(prints, groups(prints, radius), "fp").select("id", "file", "row", "fp", "first")


# --- similarity ------------------------------------------------------------------


def _permutations(n: int) -> list[tuple[np.uint64, np.uint64]]:
    words = [int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=16).digest(), "little") for k in range(n)]
    return [(U(w & (1 << 64) - 1), U(w >> 64 | 1)) for w in words]


def band_keys(values: np.ndarray, offsets: np.ndarray, bands: int = BANDS, band: int = BAND) -> np.ndarray:
    """Per slice of ``values`` (none may be empty) one key a band, from the least values of ``band`` permutations."""
    out = np.empty((len(offsets) - 1, bands), U)
    permutations = iter(_permutations(bands * band))
    for b in range(bands):
        key = np.full(len(offsets) - 1, b + 1, U)
        for _ in range(band):
            salt, odd = next(permutations)
            x = values ^ salt
            x *= odd
            key = (key ^ np.minimum.reduceat(x, offsets[:-1])) * U(0x9E3779B97F4A7C15)
            key ^= key >> U(29)
        out[:, b] = key
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: the name of its shingle set (128 bits of a cryptographic hash), size, fingerprint, bands."""
    for batch in batches:
        values, offsets = _slices(batch.column("h"))
        fp, n = majority(values, offsets), np.diff(offsets)
        sets = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        keys = np.zeros((len(n), BANDS), U)
        full = np.flatnonzero(n)
        step = max(1, len(full) * 200_000 // max(1, int(n.sum())))
        for k in range(0, len(full), step):
            own = full[k : k + step]
            parts = [sets[i] for i in own]
            keys[own] = band_keys(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
        names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("id", "file", "row")), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp.view(np.int64)), flat],
            ["id", "file", "row", "node", "size", "fp", "bands"],
        )


def _candidates(radius: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A forest of the pairs of nodes of different components within ``radius`` and of possible sizes, from blocks and chunk pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c) for c in ("own", "other") if c in batch.schema.names]
            items = pa.concat_arrays([side.flatten() for side in sides])
            fps, sizes = items.field("fp").to_numpy(zero_copy_only=False).view(U), items.field("size").to_numpy(zero_copy_only=False).astype(np.int64)
            nodes, groups = (items.field(c).dictionary_encode() for c in ("node", "component"))
            code, group = (x.indices.to_numpy(zero_copy_only=False) for x in (nodes, groups))
            bounds = [np.concatenate([[0], np.cumsum(side.value_lengths().to_numpy(zero_copy_only=False))]) for side in sides]
            if len(sides) == 1:
                pairs = near_in_blocks(fps, bounds[0], radius)
            else:
                k = bounds[0][-1]
                edges = zip(bounds[0][:-1], bounds[0][1:], bounds[1][:-1] + k, bounds[1][1:] + k, strict=True)
                pairs = ((i + a, j + c) for a, b, c, d in edges for i, j in near(fps[a:b], fps[c:d], radius))

            def fitting(pairs=pairs, sizes=sizes, code=code, group=group):
                for i, j in pairs:
                    a, b = sizes[i], sizes[j]
                    fit = (group[i] != group[j]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                    if fit.any():
                        yield code[i[fit]], code[j[fit]]

            if (forest := _forest(fitting())) is not None:
                yield pa.RecordBatch.from_arrays([nodes.dictionary.take(pa.array(x)) for x in forest], ["u", "v"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right`` (or of ``left``), by products of 0/1 matrices of the elements that occur twice."""
    sets = left if right is None else [*left, *right]
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    often = np.cumsum(n > 1) - 1
    use = n[place] > 1
    column, of = often[place[use]], of[use]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    k = len(left)
    out = np.zeros((k, k if right is None else len(right)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[of[a:b], column[a:b] - lo] = 1
        out += m[:k] @ (m if right is None else m[k:]).T
    return out


def _similar(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A forest of the pairs of different components whose sets are similar enough, from chunks of nodes with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch.column(c).slice(row, 1).flatten() for c in ("own", "other") if c in batch.schema.names]
                items = pa.concat_arrays(sides)
                nodes, groups = (items.field(c).dictionary_encode() for c in ("node", "component"))
                code, group = (x.indices.to_numpy(zero_copy_only=False) for x in (nodes, groups))
                s = items.field("s")
                ends = np.cumsum(s.value_lengths().to_numpy(zero_copy_only=False))
                sets = np.split(s.flatten().to_numpy(zero_copy_only=False), ends[:-1])
                k = len(sides[0])
                size = np.array([len(x) for x in sets])
                cols = np.arange(k, len(sets)) if len(sides) == 2 else np.arange(k)
                shared = shared_counts(sets[:k], sets[k:] if len(sides) == 2 else None)
                total = size[:k, None] + size[cols][None, :]
                i, j = np.nonzero((100 * shared >= percent * (total - shared)) & (group[:k, None] != group[cols][None, :]))
                if len(i):
                    u, v = star(code[i], code[cols[j]])
                    yield pa.RecordBatch.from_arrays([nodes.dictionary.take(pa.array(x)) for x in (u, v)], ["u", "v"])

    return run


def _sets(wanted: DataFrame, members: DataFrame, docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(node, s): the shingle sets of the nodes ``wanted``, from their texts."""
    places = wanted.join(members, "node").select("node", "least.file", "least.row")
    texts = docs.select(*locator(), F.col(text_col).alias("text")).join(places, ["file", "row"]).select("node", "text")
    return texts.select("node", F.array_distinct(shingle_hashes(F.col("text"), width)).alias("s"))


def _checked(pairs: DataFrame, members: DataFrame, docs: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""
    sets = written(_sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), members, docs, text_col, width), "sets")
    both = pairs.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v")
    both = both.select("u", "v", (F.size("su") + F.size("sv")).alias("total"), F.size(F.array_intersect("su", "sv")).alias("shared"))
    found = written(both.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("u", "v"), "links")
    discard(sets)
    return found


def _links_within(blobs: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): a forest of all links between different components of a blob. ``blobs``: (node, blob, component), ``sizes``: (node, size).

    A blob is cut into chunks of some SET_SHINGLES shingles. Components with more
    than that have chunks of their own, and a chunk is not compared with chunks
    of its own component, so that a large group of copies meets the nodes
    beside it but not itself.
    """
    rows = written(blobs.join(sizes, "node"), "blobs")
    per = rows.groupBy("blob", "component").agg(F.sum("size").alias("of"))
    large = F.when(F.col("of") > SET_SHINGLES, F.col("component"))
    per = per.withColumn("own", large)
    sums = per.groupBy("blob", "own").agg(F.sum("of").alias("total"))
    parts = per.join(sums.withColumnsRenamed({"blob": "b", "own": "o"}), (F.col("blob") == F.col("b")) & F.col("own").eqNullSafe(F.col("o"))).select(
        F.col("blob").alias("b"), F.col("component").alias("c"), "own", F.ceil(F.col("total") / SET_SHINGLES).cast("int").alias("parts")
    )
    dealt = rows.join(parts, (F.col("blob") == F.col("b")) & (F.col("component") == F.col("c")))
    number = F.pmod(F.when(F.col("own").isNull(), F.xxhash64("component", F.lit(1))).otherwise(F.xxhash64("node", F.lit(1))), F.col("parts")).cast("int")
    dealt = dealt.select("node", "blob", "component", "own", number.alias("chunk")).join(sets, "node")
    key = F.struct(F.col("own").isNull().alias("small"), "own", "chunk").alias("chunk")
    chunks = written(dealt.select("blob", key, F.struct("node", "component", "s").alias("x")).groupBy("blob", "chunk").agg(F.collect_list("x").alias("own")), "set-chunks")
    discard(rows)
    names = written(chunks.select("blob", "chunk"), "chunk-names")
    crossed = names.join(names.withColumnRenamed("chunk", "second"), "blob").where("chunk < second and not coalesce(chunk.own = second.own, false)")
    right = chunks.select("blob", F.col("chunk").alias("second"), F.col("own").alias("other"))
    crossed = crossed.join(chunks, ["blob", "chunk"]).join(right, ["blob", "second"]).select("own", "other")
    work, schema = _similar(percent), "u binary, v binary"
    found = written(chunks.where("chunk.small").select("own").mapInArrow(work, schema).unionByName(crossed.mapInArrow(work, schema)), "links")
    discard(chunks)
    return found


def similar_groups(members: DataFrame, docs: DataFrame, text_col: str, width: int, percent: int, radius: int) -> DataFrame:
    """(node, component) of all nodes that have a link."""
    blocks = members.select("node", "size", "fp", F.posexplode("bands").alias("band", "key"))
    shared = blocks.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("node", "size", "fp"), F.xxhash64("node", "band")).alias("c")).where("n > 1")
    blocks = written(blocks.join(shared, ["band", "key"]), "blocks")

    # First every node against the centre of its largest block.
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("c.fp"))) <= radius
    tried = blocks.where((F.col("node") != F.col("c.node")) & close & (100 * F.least("size", "c.size") >= percent * F.greatest("size", "c.size")))
    tried = tried.groupBy("node").agg(F.max_by("c.node", F.struct("n", "c.node")).alias("centre"))
    tried = written(tried.select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct(), "pairs")
    sure = _checked(tried, members, docs, text_col, width, percent)
    found = components(sure).select(F.col("node").alias("of"), "component")

    # Then blocks in which several components are left: candidates, and what they connect.
    labelled = blocks.join(found, F.col("node") == F.col("of"), "left").select("band", "key", "n", F.struct("node", "size", "fp", F.coalesce("component", "node").alias("component")).alias("x"))
    labelled = written(labelled, "labelled")
    discard(blocks)
    mixed = labelled.groupBy("band", "key").agg(F.min("x.component").alias("lo"), F.max("x.component").alias("hi")).where("lo < hi").select("band", "key")
    dealt = labelled.join(mixed, ["band", "key"]).withColumn("chunk", F.pmod(F.xxhash64("x.node"), F.ceil(F.col("n") / CHUNK)).cast("int"))
    chunks = written(dealt.groupBy("band", "key", "chunk").agg(F.collect_list("x").alias("own"), F.first("n").alias("n")), "chunks")
    discard(labelled)
    large = chunks.where(F.col("n") > CHUNK)
    right = large.select("band", "key", F.col("chunk").alias("second"), F.col("own").alias("other"))
    crossed = large.join(right, ["band", "key"]).where("second > chunk").select("own", "other")
    work = _candidates(radius, percent)
    candidates = written(chunks.select("own").mapInArrow(work, "u binary, v binary").unionByName(crossed.mapInArrow(work, "u binary, v binary")), "candidates")
    discard(chunks)
    blobs = components(candidates).withColumnRenamed("component", "blob")
    blobs = blobs.join(found, F.col("node") == F.col("of"), "left").select("node", "blob", F.coalesce("component", "node").alias("component"))
    blobs = written(blobs, "blobs")
    sets = written(_sets(blobs.select("node"), members, docs, text_col, width), "sets")
    rest = _links_within(blobs, members.select("node", "size"), sets, percent)
    discard(sets)
    return components(sure.unionByName(rest))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDE, percent: int = PERCENT, radius: int = WIDE_RADIUS) -> DataFrame:
    """(id, file, row, first) per row; ``first`` (id, file, row) is the smallest member of its group of similar texts. ``docs`` is a plain read."""
    rows = _hashed(docs, id_col, text_col, width)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, file string, row long, node binary, size int, fp long, bands array<long>"
    prints = written(rows.mapInArrow(_described, schema), "prints")
    least = F.min(F.struct("file", "row")).alias("least")
    members = written(prints.groupBy("node").agg(least, *(F.first(c).alias(c) for c in ("size", "fp", "bands"))), "sets")
    found = similar_groups(members.where("size > 0"), docs, text_col, width, percent, radius).withColumnRenamed("node", "of")
    labels = members.join(found, F.col("node") == F.col("of"), "left").select("node", F.coalesce("component", "node").alias("component"))
    return _firsts(prints.select("id", "file", "row", "node"), labels, "node").select("id", "file", "row", "first")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The smallest document of each group of similar texts, with the columns of ``docs``."""
    docs = located(docs)
    found = near_copies(docs, **options)
    gone = found.where((F.col("file") != F.col("first.file")) | (F.col("row") != F.col("first.row")))
    return only(docs, gone, "left_anti")
