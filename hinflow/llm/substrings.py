"""Substring deduplication by distributed prefix doubling (operator 2).

A byte goes if a string of LENGTH bytes that covers it also starts earlier
(smaller document, or the same document further left). Ranking every position
by sorted rank pairs at offsets 1, 2, 4, ... would sort all positions several
times; three exact steps keep the sorts to positions that still matter:

1. Within a task, names of strings of 1, 2, 4, ..., CORE bytes at all positions
   come from pairs of names at the doubled offset. Each window of LENGTH bytes
   has an anchor: the position of its smallest CORE-byte name. Neighbouring
   windows with one anchor form a run, some 35 windows long. Equal windows have
   equal anchors, whatever surrounds them.
2. First ranking, at length CORE: Spark groups the runs by the name at their
   anchor. Unique anchors end here; their windows cannot repeat.
3. Second ranking, at a digest of all bytes of the run: Spark names each by the
   position where it first starts. Runs that repeat an earlier run are removed
   as a whole, so copies cost one row per run.
4. Third ranking, at length LENGTH: only windows of first runs whose anchor
   also occurs in a different run are ranked one by one, again by first start.

Rank names are positions (document and offset in one number), so the last
ranking says directly which windows start earlier elsewhere. All rankings are
grouped minima with map-side partial aggregation: a passage in a third of all
documents reaches its reducer as one row per task. Tables between the steps are
written to the shared folder, and each step's shuffle files go when it ends.

Names within a task only choose anchors: two strings with one name by accident
cost time, not text. What is removed is decided by digests of the bytes, 128
bits of BLAKE2 for runs and 95 for windows.

``ranked_by_doubling`` is the plain method, a Spark sort of all positions at
every offset; it moves too much to be the main path (figures in the README) and
serves as a second opinion in tests.

Defined results: a null text is empty; texts shorter than LENGTH keep all; a
null identifier comes before all others; identifiers may be of any type that
has an order, and of rows that share one the earlier in the files comes first;
an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..plans.scratch import discard
from .common import located, locator, written

LENGTH, CORE = 100, 32
#: Windows that share one numbering when anchors are chosen; a run never crosses its end.
SEGMENT = 1 << 20

U = np.uint64
_M1, _M4 = U(0xBF58476D1CE4E5B9), U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> U(29)
    x *= _M1
    x ^= x >> U(32)
    return x


_BYTES = _mixed((np.arange(256, dtype=U) + U(1)) * _M4)


def doubled(data: np.ndarray, longest: int = CORE) -> dict[int, np.ndarray]:
    """Names of all strings of 1, 2, 4, ... up to ``longest`` bytes in ``data``: a pair of names at the doubled offset makes the next one."""
    names, n, weight = {1: _BYTES[data]}, 1, 0xD6E8FEB86659FD93
    while n < longest and len(names[n]) > n:
        x = names[n]
        y = x[:-n] * U(weight)
        y += x[n:]
        n, weight = 2 * n, weight * weight % (1 << 64)
        names[n] = y
    return names


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor name, first start, windows) of the runs in ``data``."""
    total = len(data) - LENGTH + 1
    parts = []
    for base in range(0, max(total, 0), SEGMENT):
        m = min(SEGMENT, total - base)
        core = _mixed(doubled(data[base : base + m + LENGTH - 1])[CORE])
        key = (core & ~U(SEGMENT * 2 - 1)) | np.arange(len(core), dtype=U)
        width, span = LENGTH - CORE + 1, 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        anchor = (key & U(SEGMENT * 2 - 1)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        parts.append((core[anchor[lo]], lo + base, np.diff(np.append(lo, m))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64))


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of a cryptographic hash of each slice of bytes, as two words."""
    raw = data.tobytes()
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), U).reshape(-1, 2)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _per_document(work: Callable[[dict, np.ndarray], list[np.ndarray] | None], names: list[str], flush: int = 200_000):
    """A mapInArrow function: ``work`` gives columns of 64-bit numbers for one row and its bytes; the id comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            others = [n for n in batch.schema.names if n not in ("id", "bytes", "packed")]
            for k in range(batch.num_rows):
                if "packed" in batch.schema.names:
                    raw = unpack.decompress(batch.column("packed")[k].as_py())
                else:
                    raw = batch.column("bytes")[k].as_buffer() or b""
                columns = work({n: batch.column(n)[k] for n in others}, np.frombuffer(raw, np.uint8))
                if not len(columns[0]):
                    continue
                held.append([np.full(len(columns[0]), batch.column("id")[k].as_py(), np.int64), *columns])
                size += len(columns[0])
                if size >= flush:
                    yield pa.RecordBatch.from_arrays([_long(np.concatenate(c)) for c in zip(*held, strict=True)], ["id", *names])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(c)) for c in zip(*held, strict=True)], ["id", *names])

    return run


def _anchors_of(_row: dict, data: np.ndarray) -> list[np.ndarray]:
    return [anchors(data)[0]]


def _runs_of(_row: dict, data: np.ndarray) -> list[np.ndarray]:
    g, lo, n = anchors(data)
    d = digests(data, lo, lo + n - 1 + LENGTH)
    return [g, d[:, 0], d[:, 1], lo, n]


def _windows_of(row: dict, data: np.ndarray) -> list[np.ndarray]:
    """96 bits of digest and the start of each window in the runs that ``row`` lists."""
    runs_here = row["undecided"].values
    lo = runs_here.field("lo").to_numpy(zero_copy_only=False)
    n = runs_here.field("n").to_numpy(zero_copy_only=False)
    at = np.unique(np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()))
    at = at[at <= len(data) - LENGTH]
    if not len(at):
        return [at, at, at]
    d = digests(data, at, at + LENGTH)
    return [d[:, 0], d[:, 1] >> U(33), at]


def _numbers(x: pa.Scalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int64)


def removed_bytes(size: int, repeated: np.ndarray, n: np.ndarray, first: np.ndarray, undecided: np.ndarray, first_windows: np.ndarray) -> np.ndarray:
    """Which bytes go: runs (start ``repeated``, ``n`` windows) that are not first, and windows of undecided runs that are not first."""
    gone = np.zeros(max(size - LENGTH + 1, 0) + 1, np.int32)
    later = ~np.isin(repeated, first)
    np.add.at(gone, repeated[later], 1)
    np.add.at(gone, repeated[later] + n[later], -1)
    todo = np.isin(repeated, undecided) & ~later
    np.add.at(gone, repeated[todo], 1)
    np.add.at(gone, repeated[todo] + n[todo], -1)
    windows = np.cumsum(gone)[:-1] > 0
    own = np.zeros(len(windows), bool)
    own[first_windows] = True
    start = np.flatnonzero(windows & ~own)
    cover = np.zeros(size + 1, np.int32)
    cover[start] += 1
    cover[start + LENGTH] -= 1
    return np.cumsum(cover)[:-1] > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "spans": []}
        for k in range(batch.num_rows):
            raw = unpack.decompress(batch.column("packed")[k].as_py())
            data = np.frombuffer(raw, np.uint8)
            lists = {n: batch.column(n)[k] for n in ("repeated", "n", "first", "undecided", "windows")}
            gone = removed_bytes(len(data), *(_numbers(x) for x in lists.values())) if lists["repeated"].is_valid else np.zeros(len(data), bool)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(len(edges) // 2)
            out["kept"].append(data[~gone].tobytes())
            out["spans"].append(edges.tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary()), pa.array(out["spans"], pa.list_(pa.int64()))],
            ["id", *out],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([pack.compress(x.as_buffer()) for x in batch.column("bytes")], pa.binary())], ["id", "packed"])


class Position:
    """Document and offset in one number, ordered as (document, offset).

    64 bits where the range of identifiers allows it, else a decimal.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        r = docs.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.max(F.octet_length(text_col)).alias("n")).first()
        self.none = (r["lo"] or 0) - 1
        self.step = (r["n"] or 0) + 1
        fits = ((r["hi"] or 0) - self.none + 1) * self.step < 1 << 62
        self.kind = "bigint" if fits else "decimal(38,0)"

    def pack(self, i: str, at: str) -> Column:
        return (F.col(i).cast(self.kind) - F.lit(self.none).cast(self.kind)) * F.lit(self.step).cast(self.kind) + F.col(at).cast(self.kind)

    def unpack(self, pos: str) -> tuple[Column, Column]:
        at = F.col(pos) % F.lit(self.step).cast(self.kind)
        i = ((F.col(pos) - at) / F.lit(self.step).cast(self.kind)).cast("bigint") if self.kind != "bigint" else F.expr(f"{pos} div {self.step}L")
        return (i + F.lit(self.none)).cast("bigint").alias("id"), at.cast("bigint").alias("lo")


#: Ranges of identifiers, each of which is ranked by itself.
BUCKETS = 1024


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with one whole number for each row, and a table (id, name) of the identifiers if they had to be numbered.

    Integers that are all different stay. Others, and such that several rows
    share, are numbered in the order of identifier, file and row.
    """
    names = docs.select(F.col(id_col).alias("name"))
    kind = docs.schema[id_col].dataType.typeName()
    whole = kind in ("byte", "short", "integer", "long")
    if whole and names.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), None
    docs = located(docs)
    keys = docs.select(F.col(id_col).alias("name"), *locator())
    # Ordered shuffle borders come from Spark's own sample of the keys; a partition is a bucket, so a much repeated name spreads by file and row.
    dealt = written(keys.repartitionByRange(BUCKETS, "name", "file", "row").select("*", F.spark_partition_id().alias("bucket")), "names")
    numbers = written(ranked(dealt, [], F.col("bucket"), ["name", "file", "row"]).select("file", "row", "name", F.col("r").cast("bigint").alias("id")), "numbers")
    discard(dealt)
    texts = docs.select(F.col(text_col).alias("text"), *locator()).join(numbers, ["file", "row"]).select("id", "text")
    return written(texts, "numbered"), numbers.select("id", "name")


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, spans) per row: ``kept`` bytes, ``spans`` as start, end, start, end, ..."""
    rows, names = numbered(docs, id_col, text_col)
    cut = _substring_dedup(rows, "id", "text")
    return cut if names is None else cut.join(names, "id").drop("id").withColumnRenamed("name", "id").select(*cut.columns)


def _substring_dedup(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same for rows whose whole-number identifiers are all different, but for at most one null."""
    position = Position(docs, id_col, text_col)
    raw = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(position.none)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    anchors = raw.mapInArrow(_per_document(_anchors_of, ["g"]), "id long, g long")
    shared = written(anchors.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g"), "anchors")
    scanned = raw.mapInArrow(_per_document(_runs_of, ["g", "k1", "k2", "lo", "n"]), "id long, g long, k1 long, k2 long, lo long, n long")
    repeated = written(scanned.join(shared, "g", "left_semi"), "runs")
    discard(shared)

    first = repeated.groupBy("k1", "k2", "n").agg(F.min(position.pack("id", "lo")).alias("pos"), F.min("g").alias("g"))
    first = written(first.select("g", "n", *position.unpack("pos")), "first")
    of_runs = written(repeated.groupBy("id").agg(F.collect_list("lo").alias("repeated"), F.collect_list("n").alias("n")), "runs")
    discard(repeated)
    varied = written(first.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g"), "varied")
    undecided = written(first.join(varied, "g", "left_semi").select("id", "lo", "n"), "undecided")
    discard(varied)

    texts = raw.mapInArrow(_packed, "id long, packed binary")
    lists = undecided.groupBy("id").agg(F.collect_list(F.struct("lo", "n")).alias("undecided"))
    windows = texts.join(lists, "id").mapInArrow(_per_document(_windows_of, ["w1", "w2", "lo"]), "id long, w1 long, w2 long, lo long")
    windows = windows.select("w1", F.col("w2").cast("int").alias("w2"), position.pack("id", "lo").alias("pos"))
    ranked = windows.groupBy("w1", "w2").agg(F.min("pos").alias("pos")).select(*position.unpack("pos"))
    first_windows = written(ranked.groupBy("id").agg(F.collect_list("lo").alias("windows")), "windows")

    of_first = first.groupBy("id").agg(F.collect_list("lo").alias("first"))
    of_undecided = undecided.groupBy("id").agg(F.collect_list("lo").alias("undecided"))
    notes = of_runs.join(of_first, "id", "left").join(of_undecided, "id", "left").join(first_windows, "id", "left")
    judged = texts.join(notes, "id", "left").select("id", "packed", "repeated", "n", "first", "undecided", "windows")
    cut = judged.mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>")
    return cut.withColumn("id", F.when(F.col("id") != position.none, F.col("id")))


def ranked_by_doubling(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, at): windows of LENGTH bytes that also start earlier, by prefix doubling in Spark over all positions.

    A position's rank at a length is the place, in sorted order, of the first
    position with the same string. Ranks at length n and at n bytes further
    make the rank at 2 n. The last step overlaps, so that it ends at LENGTH. Identifiers must be different.
    """
    letters = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.hex(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), "(?<=\\G..)")).alias("at", "b")).where("b <> ''")
    place = F.struct("id", "at")
    ranks, n = letters.select("id", "at", F.struct(F.conv("b", 16, 10).cast("bigint").alias("id"), F.lit(0).alias("at")).alias("r")), 1
    while n < LENGTH:
        step = min(n, LENGTH - n)
        ahead = ranks.select("id", (F.col("at") - step).alias("at"), F.col("r").alias("r2"))
        pairs = written(ranks.join(ahead, ["id", "at"]), "rank-pairs")
        named = pairs.groupBy("r", "r2").agg(F.min(place).alias("first"))
        ranks = written(pairs.join(named, ["r", "r2"]).select("id", "at", F.col("first").alias("r")), "ranks")
        discard(pairs)
        n += step
    return ranks.where((F.col("r.id") != F.col("id")) | (F.col("r.at") != F.col("at"))).select("id", "at")


def brute_force(texts: dict[int, bytes]) -> dict[int, tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans and the digest of what stays, by a plain dictionary of windows."""
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        data = texts[i]
        gone = bytearray(len(data))
        for p in range(len(data) - LENGTH + 1):
            w = data[p : p + LENGTH]
            if w in seen:
                gone[p : p + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
