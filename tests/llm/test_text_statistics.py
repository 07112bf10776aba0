"""Spelling variants, divergences and language-model scores against plain versions, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from hinflow.llm import divergence, lm, variants
from hinflow.llm.elias_fano import Monotone, Trie

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, term string, p long, near string, root string, value int, rank int, v long"


def _rows():
    rng = random.Random(8)
    letters = "abcdéßÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 9))) for _ in range(60)]

    def typo(w):
        i, c, kind = rng.randrange(len(w)), rng.choice(letters), rng.randrange(3)
        return w[:i] + (c + w[i] if kind == 0 else "" if kind == 1 else c) + w[i + 1 :]

    def prose(n):
        words = [rng.choice(stems[:8] if rng.random() < 0.6 else stems) for _ in range(n)]
        return " ".join(typo(w) if rng.random() < 0.1 else w.upper() if rng.random() < 0.1 else w for w in words)

    texts = [prose(rng.randrange(1, 120)) for _ in range(150)]
    texts += [None, "", " \t\n", "12 34 %", "tie tie", texts[0], texts[0], "É" * 90 + " Éa é A a ×÷", "a" * 300_000, prose(40_000), "ab cd 漢字漢字漢字 naïve naïve", "x-y_z[w]" * 30]
    rows = [(i, t, ["en", "de", None, ""][i % 4], ["s0", "s1", "s2", None][rng.randrange(4)], "w", 1, "t", 2, "x", "r", 3, 4, 5) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[1], "en", "s0", *rows[0][4:]), (None, None, None, None, *rows[0][4:]), (10**6, "", "lone", "s9", *rows[0][4:]), (10**6 + 1, "only here once", "rare", "s8", *rows[0][4:]), (10**6 + 2, "", "rare", "s7", *rows[0][4:])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


# --- spelling variants -----------------------------------------------------------


def plain_words(rows):
    n = Counter()
    for r in rows:
        key = "" if r[0] is None else str(r[0])
        for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{key}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return out


@pytest.mark.parametrize("capacity", [variants.CAPACITY, 7])
def test_variants_equal_a_plain_version(docs, capacity):
    """``capacity`` 7 splits every length into parts and takes many passes."""
    got = variants.spelling_variants(docs, capacity=capacity)
    want = plain_variants(plain_words(_rows()))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) > 100 and set(rows) == want
    assert sum(r[1] is not None for r in rows) > 10 and max(r[4] for r in rows) > 1


def test_chains_of_forms(spark, tmp_path):
    """Forms of forms, a tie between two of them, and repeated letters, which one deletion in several places leaves the same."""
    n = {"aaaaaa": 5, "aaaaaaa": 30, "aaaaaab": 30, "aaaaabb": 151, "aaaabbb": 800, "zzzzzz": 7, "éééééé": 5, "ééééééé": 25}
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, " ".join([w] * k)) for w, k in n.items()], "doc_id long, text string").write.parquet(path)
    got = variants.spelling_variants(spark.read.parquet(path), error=1 << 40)
    assert {tuple(r) for r in got.collect()} == plain_variants(n)


def test_filters_let_through_few(spark):
    """Nothing that is in a filter is missed; of other hashes about one in a thousand passes."""
    rng = np.random.default_rng(3)
    held, other = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64), rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    f = variants.Filter(len(held), 1, 0)
    _, block, low = variants._place(held, f.blocks, 1)
    for lane in range(8):
        np.bitwise_or.at(f.lanes[:, lane], block.astype(int), (np.uint64(1) << variants._bit(low, lane)).astype(np.uint32))
    assert len(f.may_hold(held)) == len(held) and len(f.may_hold(other)) < 600


def test_variants_of_nothing(none):
    assert variants.spelling_variants(none).collect() == []


# --- divergence of sources ---------------------------------------------------------


def plain_divergence(rows):
    group, seen = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        text, lang, source = (x or "" for x in r[1:4])
        words = [w.translate(LOW) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        group[lang, source].update(words)
        seen[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in group}:
        kept = [t for t, d in seen[lang].items() if d >= 10]
        sources = sorted(s for x, s in group if x == lang)
        counts = {s: group[lang, s] for s in sources}
        counts[None] = sum(counts.values(), Counter())
        share = {}
        for s, c in counts.items():
            total = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // (p + q)
        for s in sources:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(share[s][t], share[None][t]), t) for t in kept if counts[s][t] > 0 and share[s][t] > share[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or k <= 10:
                        out.add((lang, s, part, item, value, k))
    return out


@pytest.mark.parametrize("held", [divergence.HELD, 5])
def test_divergence_equals_a_plain_version(docs, held):
    rows = [tuple(r) for r in divergence.divergence(docs, held=held).collect()]
    want = plain_divergence(_rows())
    assert len(rows) == len(want) and set(rows) == want
    assert ("rare", "s7", "pair", "s8", 0, 1) in want and len({r[0] for r in rows if r[2] == "term"}) > 2


def test_divergence_of_nothing(none):
    assert divergence.divergence(none).collect() == []


def test_shares_beyond_64_bits(spark):
    row = spark.range(1).select(divergence._share(divergence.F.lit(10**18), divergence.F.lit(3 * 10**18), divergence.F.lit(10)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**18 + 2) // (3 * 10**18 + 20)


# --- language-model scores -----------------------------------------------------------


def plain_scores(rows, strength):
    """id, held_out, n_tokens, n_known, train_tokens, base and score, by dictionaries of words and pairs."""
    told = []
    for r in rows:
        words = [w.translate(LOW) for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")] + [None]
        told.append((r[0], zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0, words))
    one, two, ahead = Counter(), Counter(), Counter()
    for _, out, words in told:
        if not out:
            one.update(words)
            two.update(zip([0, *words], words, strict=False))
            ahead.update([0, *words[:-1]])
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    rows = []
    for i, out, words in told:
        base = sum(np.log10(p(w)) for w in words)
        score = sum(np.log10((two[b, w] + strength * p(w)) / (ahead[b] + strength)) for b, w in zip([0, *words], words, strict=False))
        rows.append((i, out, len(words), sum(one[w] > 0 for w in words), n, float(base), float(score)))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


@pytest.mark.parametrize("limits", [{}, {"frequent": 50, "hot": 3}, {"frequent": 2, "hot": 1, "shard": 500}])
def test_scores_equal_a_plain_version(docs, limits):
    """A small dictionary sends most pairs the way of rare words."""
    got, want = in_order(map(tuple, lm.scores(docs, **limits).collect())), in_order(plain_scores(_rows(), lm.STRENGTH))
    assert [r[:5] for r in got] == [r[:5] for r in want] and {r[1] for r in got} == {True, False}
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and abs(a[6] - b[6]) <= a[2] / lm.SCALE


def test_scores_do_not_depend_on_limits(docs):
    """Shards, dictionary and matrix only say where a pair is counted."""
    a, b = (in_order(map(tuple, lm.scores(docs, **x).collect())) for x in ({}, {"frequent": 200, "hot": 5, "shard": 100}))
    assert [r[6] for r in a] == [r[6] for r in b]


def test_scores_of_nothing_and_without_training(none, spark, tmp_path):
    assert lm.scores(none).collect() == []
    out = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    path = str(tmp_path / "d")
    spark.createDataFrame([(out, "some words")], "doc_id long, text string").write.parquet(path)
    row = lm.scores(spark.read.parquet(path)).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_word_hashes():
    """Whatever the block, equal words have equal hashes and others do not; positions are those of the words."""
    text = (" ".join(f"Wört{i % 500}" for i in range(90_000)) + "\t" + "x" * (3 << 20) + "\n\x0bend ").encode()
    hashes, starts = lm.Hasher()(text)
    words = [(m.start(), m.group().lower()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    assert starts.tolist() == [s for s, _ in words]
    by = defaultdict(set)
    for h, (_, w) in zip(hashes.tolist(), words, strict=True):
        by[w].add(h)
    assert all(len(h) == 1 for h in by.values()) and len({h for x in by.values() for h in x}) == len(by) == 502


@pytest.mark.parametrize("top", [1, 3, 1000, 10**6, 1 << 40])
def test_monotone_sequences(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 2, 63, 64, 65, 5000):
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        m = Monotone(v)
        assert (m[np.arange(n)] == v).all()
        keys = rng.integers(0, top + 2, 200).astype(np.uint64)
        assert (m.successor(keys, np.zeros(200, int), np.full(200, n)) == np.searchsorted(v, keys)).all()
    assert Monotone(np.sort(rng.integers(0, 1 << 40, 100_000))).nbytes() < 100_000 * (2 + 25) / 8 * 1.3


def test_trie(tmp_path):
    """Every pair is found with its value, no other pair is; the files have no name any more."""
    rng = np.random.default_rng(7)
    pairs = np.unique(rng.integers(0, [[300, 5000]], (20_000, 2)), axis=0)
    value = rng.integers(0, 60_000, len(pairs)).astype(np.uint16)
    trie = Trie(pairs[:, 0], pairs[:, 1], value, str(tmp_path))
    assert (trie.find(pairs[:, 0], pairs[:, 1], -1) == value).all() and not list(tmp_path.iterdir())
    asked = rng.integers(0, [[400, 6000]], (20_000, 2))
    held = dict(zip(map(tuple, pairs.tolist()), value.tolist(), strict=True))
    assert trie.find(asked[:, 0], asked[:, 1], -1).tolist() == [held.get(tuple(x), -1) for x in asked.tolist()]
    assert trie.nbytes() < 6 * len(pairs)
    assert Trie(pairs[:0, 0], pairs[:0, 1], value[:0]).find(np.array([1]), np.array([2]), -1).tolist() == [-1]


def _lm_parts(texts, hot=2):
    """(batch, model) over training texts, without Spark."""
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(["a"] * n), pa.array([t.encode() for t in texts])], ["key", "id", "name", "text"])
    words = next(lm._word_counts(iter([batch])))
    word, count = np.append(np.uint64(lm.BEGIN), words.column(0).to_numpy().view(np.uint64)), np.append(n, words.column(1).to_numpy())
    rank = np.full(len(word), -1, np.int16)
    rank[np.lexsort((word, -count))[:hot]] = np.arange(hot)
    return batch, lm.Model(int(count[1:].sum()), len(word) - 1, lm.STRENGTH, word, count, rank, np.zeros((hot, hot)))


def test_costs_of_known_pairs_come_from_the_trie(monkeypatch):
    batch, model = _lm_parts(["a b c d a b c", "b c e a b", "d e"])
    sent = pa.Table.from_batches(list(lm._sent(iter([batch]), model, 1)))
    cost = lambda: pc.sum(lm._scored(sent, model)["cost"]).as_py()
    before = cost()
    monkeypatch.setattr(lm.Trie, "find", lambda self, context, word, none: np.full(len(context), none, np.int64))
    assert cost() > before


def test_pairs_on_their_way_are_held_in_little_memory():
    rng = np.random.default_rng(3)
    batch, model = _lm_parts([" ".join(map(str, rng.integers(0, 5000, 50_000))) for _ in range(50)])
    tracemalloc.start()
    try:
        rows = sum(len(x) for x in lm._sent(iter([batch]), model, 20))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows >= 50 + 20 and most < 100e6
