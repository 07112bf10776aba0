"""Spelling variants: words one edit apart, found through Bloom filters.

A word is a run of letters (A-Z, a-z, U+00C0 to U+00FF), of which only A-Z are
lower-cased. Some occurrences lose a letter first, decided by a checksum of
document and word, which plants typing errors that are the same in every run.

Every word makes its edits and asks blocked Bloom filters, one shard for each
length, whether the edit may be a word. Only what the filters let through is
shuffled and joined with the words, which removes false positives. Edits that
add a letter need not be made: the longer word finds the shorter one by leaving
a letter out. Of two words that differ in one letter the smaller one finds the
other.

Null texts and texts without such runs give nothing; a null identifier counts
as ''. Repeated rows count as often as they occur. An empty table gives an
empty result. Columns beyond identifier and text play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, written

LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: One in so many pairs of document and word loses a letter.
ERROR = 199
#: Words that a task holds before it hands its counts on.
HELD = 400_000
#: Words in the filters of one pass: their size, which is broadcast, is at most BITS times as many bits.
CAPACITY = 1 << 24
BITS = 16
#: Edits that are asked about at once.
ASKED = 1 << 20
_ONE = np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A number for each letter, and the odd base of the word hash with its inverse.
LETTER = _mixed(np.arange(1, 257, dtype=np.uint64))
BASE = 0x9E3779B97F4A7C15
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))
#: One odd factor for each of the eight lanes of a block.
LANES = (_mixed(np.arange(301, 309, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)) | _ONE


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sums(letters: np.ndarray) -> np.ndarray:
    """Running sums of letter times power, one row per word and one column more than letters; the last is the word's hash."""
    out = np.zeros((letters.shape[0], letters.shape[1] + 1), np.uint64)
    np.cumsum(LETTER[letters] * _powers(letters.shape[1]), axis=1, out=out[:, 1:])
    return out


def _place(hashes: np.ndarray, blocks: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, block and low bits of each hash. ``blocks`` may not exceed 2^32."""
    m = _mixed(hashes)
    high = m >> np.uint64(32)
    spread = (high * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    return (spread * np.uint64(parts)) >> np.uint64(32), (high * np.uint64(blocks)) >> np.uint64(32), m & np.uint64(0xFFFFFFFF)


def _bit(low: np.ndarray, lane: int) -> np.ndarray:
    return ((low * LANES[lane]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)


class Filter:
    """One shard: the words of one length, or one part of them."""

    def __init__(self, words: int, parts: int, part: int):
        self.parts, self.part, self.blocks = parts, part, blocks_for(words, parts)
        self.lanes = np.zeros((self.blocks, 8), np.uint32)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be in it: those that are, and about one in a thousand of the others."""
        part, block, low = _place(hashes, self.blocks, self.parts)
        at = np.flatnonzero(part == self.part) if self.parts > 1 else np.arange(len(hashes))
        for lane in range(8):
            at = at[(self.lanes[block[at], lane] >> _bit(low[at], lane).astype(np.uint32)) & 1 == 1]
        return at


def blocks_for(words: int, parts: int) -> int:
    return max(1, -(-words * BITS // (256 * parts)))


def _of_lengths(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the words of each length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size).tolist():
        yield n, np.flatnonzero(size == n)


def _letters(words: list[str], at: np.ndarray) -> np.ndarray:
    return np.frombuffer("".join([words[i] for i in at]).encode("latin-1"), np.uint8).reshape(len(at), -1)


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, error: int = ERROR) -> DataFrame:
    """(word, n): occurrences of the words of at least ``least`` letters, planted errors included."""
    run = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                own: dict[str, int] = {}
                for w in run.findall(text.as_py().translate(LOWER).decode(errors="replace")):
                    own[w] = own.get(w, 0) + 1
                start = zlib.crc32(f"{key}:".encode())
                for w, n in own.items():
                    h = zlib.crc32(w.encode(), start)
                    if h % error == 0:
                        i = h % len(w)
                        w = w[:i] + w[i + 1 :]
                        if len(w) < least:
                            continue
                    counts[w] = counts.get(w, 0) + n
                if len(counts) > HELD:
                    yield rows()
                    counts.clear()
        yield rows()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text.alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _passes(sizes: dict[int, int], capacity: int) -> Iterator[dict[tuple[int, int], int]]:
    """Shards (length, part) with the number of parts of their length, as many to a pass as its filters have room for."""
    batch, room = {}, capacity
    for length, n in sorted(sizes.items()):
        parts = -(-n // capacity)
        for part in range(parts):
            need = -(-n // parts)
            if batch and need > room:
                yield batch
                batch, room = {}, capacity
            batch[length, part] = parts
            room -= need
    if batch:
        yield batch


def _filters(words: DataFrame, sizes: dict[int, int], shards: dict[tuple[int, int], int]) -> dict[tuple[int, int], Filter]:
    """The filters of some shards. Spark sets the bits; the driver only lays out finished blocks, at most BITS times CAPACITY bits of them."""
    parts_of = {length: parts for (length, _), parts in shards.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            for length, at in _of_lengths(texts):
                part, block, low = _place(_sums(_letters(texts, at))[:, -1], blocks_for(sizes[length], parts_of[length]), parts_of[length])
                wanted = np.isin(part, [p for n, p in shards if n == length])
                columns = [np.full(wanted.sum(), length), part[wanted].astype(np.int64), block[wanted].astype(np.int64)]
                columns += [(_ONE << _bit(low[wanted], lane)).astype(np.int64) for lane in range(8)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["length", "part", "block", *(f"l{i}" for i in range(8))])

    lanes = [f"l{i}" for i in range(8)]
    kept = words.where(F.length("word").isin(list(parts_of))).select("word")
    bits = kept.mapInArrow(placed, "length long, part long, block long, " + ", ".join(f"{x} long" for x in lanes))
    bits = bits.groupBy("length", "part", "block").agg(*(F.bit_or(x).alias(x) for x in lanes))
    out = {(n, p): Filter(sizes[n], parts, p) for (n, p), parts in shards.items()}
    for batch in bits.toArrow().to_batches():
        length, part, block = (batch.column(c).to_numpy() for c in ("length", "part", "block"))
        rows = np.stack([batch.column(x).to_numpy() for x in lanes], axis=1).astype(np.uint32)
        for n, p in {*zip(length.tolist(), part.tolist(), strict=True)}:
            at = (length == n) & (part == p)
            out[n, p].lanes[block[at]] = rows[at]
    return out


def _shorter(letters: np.ndarray, sums: np.ndarray, shard: Filter) -> Iterator[tuple[int, bytes]]:
    """(row, edit) that may be words, by leaving a letter out; of equal neighbours the first."""
    step = max(1, ASKED // letters.shape[1])
    for lo in range(0, len(letters), step):
        x, s = letters[lo : lo + step], sums[lo : lo + step]
        row, i = np.nonzero(np.diff(x.astype(np.int16), axis=1, prepend=-1))
        for k in shard.may_hold(s[row, i] + (s[row, -1] - s[row, i + 1]) * INVERSE).tolist():
            w = x[row[k]].tobytes()
            yield lo + int(row[k]), w[: i[k]] + w[i[k] + 1 :]


def _replaced(letters: np.ndarray, sums: np.ndarray, alphabet: np.ndarray, shard: Filter) -> Iterator[tuple[int, bytes]]:
    """(row, edit) that may be words, by putting a larger letter in place of another."""
    power = _powers(letters.shape[1])
    wide = max(1, ASKED // len(alphabet))
    step = max(1, wide // letters.shape[1])
    for lo in range(0, len(letters), step):
        for left in range(0, letters.shape[1], wide):
            x = letters[lo : lo + step, left : left + wide]
            row, i, c = np.nonzero(alphabet[None, None, :] > x[:, :, None])
            change = (LETTER[alphabet[c]] - LETTER[x[row, i]]) * power[left + i]
            for k in shard.may_hold(sums[lo + row, -1] + change).tolist():
                w = bytearray(letters[lo + row[k]].tobytes())
                w[left + i[k]] = alphabet[c[k]]
                yield lo + int(row[k]), bytes(w)


def near_pairs(words: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """(word, n, near, near_n), both ways, of the words that differ by one letter put in, left out or replaced.

    ``words``: (word, n), distinct, of letters up to U+00FF; a written table,
    as every pass reads it. Words beyond ``capacity`` take further passes.
    """
    spark = words.sparkSession
    sizes = {r["size"]: r["count"] for r in words.groupBy(F.length("word").alias("size")).count().collect()}
    used = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.sort(np.array([ord(r["c"]) for r in used.collect()], np.uint8))
    found = None
    for shards in _passes(sizes, capacity):
        shared = spark.sparkContext.broadcast(_filters(words, sizes, shards))

        def probed(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            filters: dict[int, list[Filter]] = {}
            for (length, _), shard in shared.value.items():
                filters.setdefault(length, []).append(shard)
            for batch in batches:
                texts, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for length, at in _of_lengths(texts):
                    if not (filters.get(length) or filters.get(length - 1)):
                        continue
                    letters = _letters(texts, at)
                    sums = _sums(letters)
                    hits = [x for s in filters.get(length - 1, []) for x in _shorter(letters, sums, s)]
                    hits += [x for s in filters.get(length, []) for x in _replaced(letters, sums, alphabet, s)]
                    rows = at[[r for r, _ in hits]] if hits else at[:0]
                    columns = [pa.array([texts[i] for i in rows], pa.string()), pa.array(counts[rows]), pa.array([e.decode("latin-1") for _, e in hits], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["word", "n", "near"])

        lengths = sorted({n for n, _ in shards} | {n + 1 for n, _ in shards})
        asking = words.where(F.length("word").isin(lengths)).select("word", "n")
        part = asking.mapInArrow(probed, "word string, n long, near string")
        part = written(part.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n"), "near")
        found = part if found is None else found.unionByName(part)
        shared.unpersist()
    if found is None:
        found = words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    there = F.struct("word", "n", "near", "near_n")
    back = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.select(F.explode(F.array(there, back)).alias("e")).select("e.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms from each word ends.

    Every round doubles the steps that are behind. Counts grow along a chain,
    so chains end, and by at least the ratio of forms, so that they are short.
    """
    links = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(on, "root", "left_semi").isEmpty():
            return links
        links = written(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def spelling_variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_count: int = 5, ratio: int = 5, capacity: int = CAPACITY, error: int = ERROR
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least ``least_letters`` letters and ``least_count`` occurrences.

    ``form``: the most frequent word one edit away (ties: the smallest), if it
    occurs at least ``ratio`` times as often; ``root``: the last of the forms
    that follow each other from the word, or the word itself.
    """
    words = written(word_counts(docs, id_col=id_col, text_col=text_col, least=least_letters, error=error).where(F.col("n") >= least_count), "words")
    best = near_pairs(words, capacity=capacity).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.m") >= ratio * F.col("n")
    judged = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")
    )
    judged = written(judged, "forms")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
