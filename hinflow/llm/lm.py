"""Language-model scores of documents by a trie of word pairs.

A document is its words (runs of bytes other than white space, A-Z lower-cased)
and one end. The model gives a token after a token before it (or the beginning)

    P(w | v) = (c(v, w) + s P(w)) / (c(v) + s),   P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

with counts over the training documents and s the ``strength``. For each v it
sums to one over the V known words and one unknown one. Probabilities are kept
as whole numbers of 1 / SCALE decades, so that the sum over a document does not
depend on any order; a token's error is half a unit, or a unit where a pair has
never been seen, below 0.0005 decades.

Words are told apart by 64-bit hashes. Counts of words are a Spark table that
grows with the corpus; words that make up at least one in ``frequent`` of all
tokens, which can be no more than ``frequent`` words, are sent to all tasks as a
dictionary. Being measured against the corpus, it covers the same share of the
tokens at every size. Pairs of words of the dictionary go to one of
many shards by a hash of the pair, in which a task counts them, lays its trie
out in memory-mapped levels, and asks it about all pairs that came. Pairs of
two of the ``hot`` most frequent words are counted in a matrix of fixed size
instead, so that no pair of a shard can hold more rows than a word beyond the
``hot`` ones has. Words beyond the dictionary are counted exactly, too: their
pairs are counted in the shards, and their own counts are joined.

Null texts count as empty ones, whose only token is the end; a null identifier
counts as '' where training documents are told apart. Rows that repeat count
as often as they occur, each with a row of its own. Without training documents
all counts are 0 and every base score is 0. An empty table gives an empty
result. Columns beyond identifier and text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import located, written
from .elias_fano import Trie

#: Lower-cases A-Z and makes every white-space character a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Parts of a decade that probabilities are rounded to.
SCALE = 2048
#: Numbers of the beginning and the end among the hashes of words.
BEGIN, END = 0, 1
#: Bits of a word's number in the dictionary.
BITS = 22
#: A word of the dictionary has at least one in so many of all tokens; so many words have their pairs counted in a matrix.
FREQUENT, HOT = (1 << BITS) - 1, 512
#: Weight of P(w) against the counts after a word.
STRENGTH = 300.0
#: Training tokens that a shard is made for.
SHARD = 1 << 22
#: Bytes that are hashed at once, and pairs and documents that a task holds before it hands them on.
BLOCK, HELD, HELD_DOCS = 1 << 18, 1 << 20, 60_000
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves every output bit."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


#: A number for each byte, and the odd base of the word hash.
LETTER = _mixed(np.arange(1001, 1257, dtype=np.uint64))
BASE = 0xD1342543DE82EF95


class Hasher:
    """Hashes of all words of a text at once, by running sums of byte times power."""

    def __init__(self) -> None:
        self._grow(BLOCK)

    def _grow(self, n: int) -> None:
        up = lambda base: np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, base, np.uint64)]))
        self.power, self.inverse = up(_U(BASE)), up(_U(pow(BASE, -1, 1 << 64)))

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each word. A block ends at a space, so it is longer than BLOCK only for a longer word."""
        text = text.translate(TABLE)
        letters, hashes, starts, lo = np.frombuffer(text, np.uint8), [], [], 0
        while lo < len(text):
            hi = text.find(b" ", lo + BLOCK) if lo + BLOCK < len(text) else -1
            hi = len(text) if hi < 0 else hi
            if hi - lo > len(self.power) - 1:
                self._grow(hi - lo)
            x = letters[lo:hi]
            edge = np.diff((x != 32).astype(np.int8), prepend=0, append=0)
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(LETTER[x] * self.power[: len(x)], out=sums[1:])
            hashes.append(np.maximum(_mixed((sums[last] - sums[first]) * self.inverse[first]), _U(2)))
            starts.append(first + lo)
            lo = hi
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(starts)


def trains(identifier: str) -> bool:
    return zlib.crc32(identifier.encode()) % 10 != 0


def _documents(batches: Iterator[pa.RecordBatch], training: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, token, document, train) for some documents at a time: ``rows`` (key, id), their tokens one after the other, the place in ``rows`` of each, and which are for training.

    With ``training`` only those are returned.
    """
    hasher = Hasher()

    def told(rows, texts, train):
        hashes, starts = hasher(b" ".join(texts))
        begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        of = np.searchsorted(begin, starts, "right") - 1
        size = np.bincount(of, minlength=len(rows)) + 1
        token = np.full(len(hashes) + len(rows), END, np.uint64)
        token[np.arange(len(hashes)) + of] = hashes
        return rows, token, np.repeat(np.arange(len(rows)), size), np.array(train)

    rows, texts, train, held = [], [], [], 0
    for batch in batches:
        for key, i, name, text in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), batch.column("name").to_pylist(), batch.column("text"), strict=True):
            t = trains(name)
            if training and not t:
                continue
            rows.append((key, i))
            texts.append(text.as_py())
            train.append(t)
            held += len(texts[-1])
            if held >= BLOCK:
                yield told(rows, texts, train)
                rows, texts, train, held = [], [], [], 0
    if rows:
        yield told(rows, texts, train)


def _before(token: np.ndarray, document: np.ndarray, begin) -> np.ndarray:
    """What stands before each token; ``begin`` before the first of a document."""
    out = np.empty_like(token)
    out[1:] = token[:-1]
    out[np.flatnonzero(np.diff(document, prepend=-1))] = begin
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(parts):
        word, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in parts]), len(word)).astype(np.int64)
        return word, n

    out = lambda word, n: pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])
    parts, held = [], 0
    for _, token, _, _ in _documents(batches, True):
        parts.append(np.unique(token, return_counts=True))
        held += len(parts[-1][0])
        if held > HELD:
            parts = [rows(parts)]
            held = len(parts[0][0])
            if held > HELD // 2:
                yield out(*parts[0])
                parts, held = [], 0
    if parts:
        yield out(*rows(parts))


@dataclass
class Model:
    """What all tasks get: totals, the dictionary (sorted hashes and counts, the beginning first, places among the hot words or -1) and the costs of pairs of hot words.

    Its size is bounded by FREQUENT and HOT.
    """

    total: int
    distinct: int
    strength: float
    word: np.ndarray
    count: np.ndarray
    hot: np.ndarray
    hot_costs: np.ndarray | None = None

    def number(self, token: np.ndarray) -> np.ndarray:
        """The dictionary's number of each token; -1 if it is not in it."""
        at = np.minimum(np.searchsorted(self.word, token), len(self.word) - 1)
        return np.where(self.word[at] == token, at, -1)

    def single(self, count: np.ndarray) -> np.ndarray:
        """P(w) for counts of words."""
        return (count + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def seen(self, pair: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
        """-SCALE log10 P(w | v), rounded, of known pairs, from c(v, w), c(v) and c(w)."""
        return np.rint(-SCALE * np.log10((pair + self.strength * self.single(count)) / (before + self.strength))).astype(np.int64)

    def unseen(self, before: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The same of pairs that are not known, in two rounded parts."""
        return (np.rint(-SCALE * np.log10(self.strength / (before + self.strength))) + np.rint(-SCALE * np.log10(self.single(count)))).astype(np.int64)

    def costs(self, pair: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.where(pair > 0, self.seen(pair, before, count), self.unseen(before, count))


def _hot_pairs(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    size = int(model.hot.max()) + 1
    counts = np.zeros(size * size, np.int64)
    for _, token, document, _ in _documents(batches, True):
        number = model.number(token)
        rank = np.where(number >= 0, model.hot[number], -1)
        before = _before(rank, document, model.hot[0])
        both = (rank >= 0) & (before >= 0)
        counts += np.bincount(before[both].astype(np.int64) * size + rank[both], minlength=size * size)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["pair", "n"])


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((_mixed(key) >> _U(32)) * _U(shards)) >> _U(32)


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    first = np.flatnonzero(np.diff(sorted_values.astype(np.int64), prepend=-1))
    ends = np.append(first[1:], len(sorted_values))
    for a, b in zip(first.tolist(), ends.tolist(), strict=False):
        yield int(sorted_values[a]), slice(a, b)


_SENT = ("shard", "docs", "pairs", "pair_of", "rare", "rare_of", "key", "id", "n_tokens", "n_known", "base", "cost")
_SENT_TYPES = "shard int, docs binary, pairs binary, pair_of binary, rare binary, rare_of binary, key long, id {0}, n_tokens long, n_known long, base double, cost long"
_GOT = ("key", "id", "n_tokens", "n_known", "base", "cost", "v", "w", "cv", "cw", "pair_n", "times")
_GOT_TYPES = "key long, id {0}, n_tokens long, n_known long, base double, cost long, v long, w long, cv long, cw long, pair_n long, times long"


def _sent(batches: Iterator[pa.RecordBatch], model: Model, shards: int) -> Iterator[pa.RecordBatch]:
    """One row per document with what the dictionary and the hot pairs tell, and, for each shard, the other pairs of some documents."""
    kind = pa.int64()
    log_one = np.log10(model.single(model.count))

    def parts(docs, train, pairs, pair_of, rare, rare_of):
        """Rows of the held pairs, one for each shard."""
        marked = np.array(docs, np.int64) * 2 + np.array(train, np.int64)

        def joined(held):
            """Emptied, so that the parts go when they are joined."""
            out = np.concatenate(held) if held else np.zeros(0, np.int64)
            held.clear()
            return out

        found: dict[int, dict[str, bytes]] = {}
        pair_of, key = joined(pair_of), joined(pairs).view(np.uint64)
        key |= _shard(key, shards) << _U(2 * BITS)
        order = np.argsort(key)
        key, pair_of = key[order], pair_of[order]
        del order
        inner = (key & _U((1 << 2 * BITS) - 1)).view(np.uint16).reshape(-1, 4)[:, :3]
        for shard, s in _runs(key >> _U(2 * BITS)):
            used, of = np.unique(pair_of[s], return_inverse=True)
            found[shard] = {"docs": marked[used].tobytes(), "pairs": inner[s].tobytes(), "pair_of": of.astype(np.uint16).tobytes()}
        del key, inner, pair_of
        rare, rare_of = joined(rare), joined(rare_of)
        if len(rare):
            shard_of = _shard(rare[:, 0] ^ _mixed(rare[:, 1]), shards)
            order = np.argsort(shard_of, kind="stable")
            rare, rare_of = rare[order], rare_of[order]
            for shard, s in _runs(shard_of[order]):
                # The documents of rare pairs come behind those of the others.
                row = found.setdefault(shard, {"docs": b"", "pairs": b"", "pair_of": b""})
                used, of = np.unique(rare_of[s], return_inverse=True)
                n = len(row["docs"]) // 8
                row |= {"docs": row["docs"] + marked[used].tobytes(), "rare": rare[s].tobytes(), "rare_of": (of + n).astype(np.uint32).tobytes()}
        n = len(found)
        columns = [pa.array(list(found), pa.int32())]
        columns += [pa.array([row.pop(c, b"") for row in found.values()], pa.binary()) for c in _SENT[1:6]]
        columns += [pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, list(_SENT))

    def typed(batches):
        nonlocal kind
        for b in batches:
            kind = b.schema.field("id").type
            yield b

    held, docs, train, n_held = ([], [], [], []), [], [], 0
    for rows, token, document, told in _documents(typed(batches), False):
        number = model.number(token)
        before = _before(number, document, 0)
        known = number >= 0
        n = len(rows)
        base = np.bincount(document[known], log_one[number[known]], n)
        rank, rank_before = np.where(known, model.hot[number], -1), np.where(before >= 0, model.hot[before], -1)
        hot = (rank >= 0) & (rank_before >= 0)
        cost = np.bincount(document[hot], model.hot_costs[rank_before[hot], rank[hot]], n)
        keys = [k for k, _ in rows]
        columns = [pa.array([k % shards for k in keys], pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(5)), pa.array(keys, pa.int64()), pa.array([i for _, i in rows], kind)]
        columns += [pa.array(np.bincount(document, minlength=n)), pa.array(np.bincount(document[known], minlength=n)), pa.array(base.astype(float)), pa.array(cost.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, list(_SENT))

        ahead = len(docs)
        docs += keys
        train += told.tolist()
        pair = known & (before >= 0) & ~hot
        rest = ~(known & (before >= 0))
        held[0].append((before[pair] << BITS) | number[pair])
        held[1].append((document[pair] + ahead).astype(np.int32))
        if rest.any():
            held[2].append(np.stack([_before(token, document, _U(BEGIN))[rest], token[rest]], axis=1))
            held[3].append((document[rest] + ahead).astype(np.int32))
        n_held += len(token)
        if n_held > HELD or len(docs) > HELD_DOCS:
            yield parts(docs, train, *held)
            held, docs, train, n_held = ([], [], [], []), [], [], 0
    if docs:
        yield parts(docs, train, *held)


def _trie(model: Model, before: np.ndarray, word: np.ndarray, n: np.ndarray) -> Trie:
    """The known ones (``n`` > 0) of sorted pairs, with their costs, in memory-mapped levels."""
    known = n > 0
    before, word = before[known], word[known]
    cost = model.seen(n[known], model.count[before], model.count[word])
    return Trie(before, word, cost.astype(np.uint16 if not len(cost) or cost.max() < 1 << 16 else np.uint32))


def _scored(table: pa.Table, model: Model) -> pa.Table:
    """One shard: costs of its pairs by document, through a trie of the pairs that are known; rare pairs with their counts."""
    kind = table.schema.field("id").type
    docs, pairs, pair_of, rare, rare_of, ahead = [], [], [], [], [], 0
    # Read where they are: a filtered table would hold all of them twice.
    for d, p, po, r, ro in zip(*(table.column(c) for c in _SENT[1:6]), strict=True):
        if not d.is_valid:
            continue
        docs.append(np.frombuffer(d.as_py(), np.int64))
        wide = np.zeros((len(p.as_py()) // 6, 4), np.uint16)
        wide[:, :3] = np.frombuffer(p.as_py(), np.uint16).reshape(-1, 3)
        pairs.append(wide.view(np.uint64).ravel())
        pair_of.append(np.frombuffer(po.as_py(), np.uint16).astype(np.int32) + np.int32(ahead))
        rare.append(np.frombuffer(r.as_py(), np.uint64).reshape(-1, 2))
        rare_of.append(np.frombuffer(ro.as_py(), np.uint32).astype(np.int64) + ahead)
        ahead += len(docs[-1])
    rows = {c: [] for c in _GOT}

    def add(n: int, **columns) -> None:
        for c in _GOT:
            rows[c].append(columns.get(c, pa.nulls(n, kind if c == "id" else pa.float64() if c == "base" else pa.int64())))

    whole = table.filter(pc.is_valid(table.column("key"))).combine_chunks()
    add(len(whole), **{c: whole.column(c) for c in ("key", "id", "n_tokens", "n_known", "base", "cost")})
    if docs:
        # One at a time, so that each list goes before the next is joined: this step takes the most memory.
        docs = np.concatenate(docs)
        pairs = np.concatenate(pairs)
        pair_of = np.concatenate(pair_of)
        rare = np.concatenate(rare)
        rare_of = np.concatenate(rare_of)
        key, train = docs >> 1, docs & 1
        if len(pairs):
            order = np.argsort(pairs)
            pairs, pair_of = pairs[order], pair_of[order]
            del order
            first = np.append(True, pairs[1:] != pairs[:-1])
            pair, of = pairs[first], np.cumsum(first, dtype=np.int32) - np.int32(1)
            del pairs
            n = np.add.reduceat(train.astype(np.int32)[pair_of], np.flatnonzero(first)).astype(np.float64)
            before, word = (pair >> _U(BITS)).astype(np.int64), (pair & _U((1 << BITS) - 1)).astype(np.int64)
            # Only the trie keeps the costs of known pairs; what it does not have is priced by its two words.
            cost = _trie(model, before, word, n).find(before, word, -1)
            new = np.flatnonzero(cost < 0)
            cost[new] = model.unseen(model.count[before[new]], model.count[word[new]])
            by_doc = np.bincount(pair_of, cost[of], len(docs)).astype(np.int64)
            used = np.flatnonzero(np.bincount(pair_of, minlength=len(docs)))
            used_keys, at = np.unique(key[used], return_inverse=True)
            add(len(used_keys), key=pa.array(used_keys), cost=pa.array(np.bincount(at, by_doc[used]).astype(np.int64)))
        if len(rare):
            _, first, of = np.unique(_mixed(rare[:, 0]) + rare[:, 1], return_index=True, return_inverse=True)
            n = np.bincount(of, train[rare_of], len(first)).astype(np.int64)
            each, times = np.unique(rare_of * len(first) + of, return_counts=True)
            doc, pair = each // len(first), each % len(first)
            v, w = rare[first[pair], 0], rare[first[pair], 1]
            iv, iw = model.number(v), model.number(w)
            cv, cw = model.count[iv], model.count[iw]
            add(
                len(each), key=pa.array(key[doc]), v=pa.array(v.view(np.int64)), w=pa.array(w.view(np.int64)), cv=pa.array(cv, mask=iv < 0), cw=pa.array(cw, mask=iw < 0),
                pair_n=pa.array(n[pair]), times=pa.array(times),
            )
    return pa.table({c: pa.chunked_array([y for x in parts for y in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])]) for c, parts in rows.items()})


def _dictionary(counts: DataFrame, total: int, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words with at least one in ``frequent`` of all tokens, which are ``frequent`` words at most."""
    rows = counts.where(F.col("n").cast("decimal(20,0)") * frequent >= total).select("word", "n").toArrow()
    word = rows.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return word[order], rows.column("n").to_numpy()[order]


def scores(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", strength: float = STRENGTH, frequent: int = FREQUENT, hot: int = HOT, shard: int = SHARD
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score (by P(w) alone) and score (by P(w | v)), both log10.

    Documents whose identifier's CRC-32 is divisible by ten are held out; all others train.
    """
    spark = docs.sparkSession
    docs = located(docs)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), name.alias("name"), text.alias("text"))
    counts = written(rows.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()

    word, count = _dictionary(counts, sums[0], min(frequent, FREQUENT))
    word, count = np.append(_U(BEGIN), word), np.append(sums[2], count)
    rank = np.full(len(word), -1, np.int16)
    top = np.lexsort((word, -count))[:hot]
    rank[top] = np.arange(len(top))
    model = Model(sums[0], sums[1], strength, word, count, rank)
    bare = spark.sparkContext.broadcast(model)
    found = rows.mapInArrow(lambda batches: _hot_pairs(batches, bare.value), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(len(top) ** 2, np.int64)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    model.hot_costs = model.costs(pairs.reshape(len(top), -1), count[top][:, None], count[top][None, :])
    full = spark.sparkContext.broadcast(model)
    bare.unpersist()

    shards = max(-(-sums[0] // shard), int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.mapInArrow(lambda batches: _sent(batches, full.value, shards), _SENT_TYPES.format(kind))
    parts = written(sent.groupBy("shard").applyInArrow(lambda t: _scored(t, full.value), _GOT_TYPES.format(kind)), "parts")
    full.unpersist()

    # Counts that the dictionary does not have; those that it has stay out of the join, so that no frequent word is a key of it.
    rare = parts.where("v is not null").select("key", "v", "w", "cv", "cw", "pair_n", "times", F.col("cw").isNull().alias("new"))
    for key, n in (("v", "cv"), ("w", "cw")):
        known = counts.select(F.col("word").alias(key), F.col("n").alias("joined"))
        joined = rare.where(F.col(n).isNull()).join(known, key, "left").withColumn(n, F.coalesce("joined", F.lit(0))).drop("joined")
        rare = rare.where(F.col(n).isNotNull()).unionByName(joined)
    units = lambda p: F.rint(F.lit(-SCALE) * F.log10(p))
    single = (F.col("cw") + 0.1) / F.lit(sums[0] + 0.1 * (sums[1] + 1))
    before = F.col("cv") + F.lit(strength)
    cost = F.when(F.col("pair_n") > 0, units((F.col("pair_n") + F.lit(strength) * single) / before)).otherwise(units(F.lit(strength) / before) + units(single))
    times = F.col("times")
    rare = rare.select(
        "key", (times * cost).cast("long").alias("cost"), F.when(F.col("new") & (F.col("cw") > 0), times).otherwise(0).alias("n_known"), F.when(F.col("new"), times * F.log10(single)).otherwise(0.0).alias("base")
    )
    whole = parts.where("v is null").select("key", "id", "n_tokens", "n_known", "base", "cost")
    whole = whole.unionByName(rare.select("key", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("n_tokens"), "n_known", "base", "cost"))
    whole = whole.groupBy("key").agg(F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in ("n_known", "base", "cost")))
    out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return whole.select(
        "id", out.alias("held_out"), "n_tokens", "n_known", F.lit(sums[0]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("cost") / F.lit(-float(SCALE))).alias("score")
    )
