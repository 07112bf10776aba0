"""The stages of the corpus pipeline together, near copies against brute force."""

import random
import re

import corpus_pipeline
from hinflow.llm import simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain_near(texts):
    """The smallest identifier of each component of pairs with similarity 0.8 or more."""
    sets, label = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and label[a] != label[b] and (5 * both >= 4 * either):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return set(label.values())


def texts_with_copies():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = [word() for _ in range(12)]
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rng.randrange(60, 160))]
        if rng.random() < 0.5:
            base = common + base
        texts.append(base)
        for edits in (1, 2, 3, 4, 5):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    hot = [word() for _ in range(80)]
    for _ in range(90):  # near copies of one text that differ from each other
        copy = list(hot)
        copy[rng.randrange(80)] = word()
        texts.append(copy)
    far = [word() for _ in range(70)]
    for k in range(40):  # copies of a text that is not there: some pairs are similar enough, most are not
        copy = list(far)
        for _ in range(1 + k % 2):
            copy[rng.randrange(70)] = word()
        texts.append(copy)
    out = [" ".join(t) for t in texts]
    out += [out[3].upper(), out[4].replace(" ", "\n"), "short text", "", out[7]]
    rng.shuffle(out)
    return dict(enumerate(out))


def test_near_stage_and_those_before_it(spark, tmp_path, monkeypatch):
    texts = texts_with_copies()
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path))
    docs = spark.read.parquet(str(path))
    near = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(plain_near(texts))

    monkeypatch.setattr(simhash, "SET_SHINGLES", 300)  # chunks of three or four texts
    monkeypatch.setattr(simhash, "CHUNK", 5)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == sorted(plain_near(texts))

    last = {t.translate(LOW): i for i, t in texts.items() if len(t.split()) >= 50}
    kept = plain_near({i: texts[i] for i in last.values()})
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in docs.collect()} == kept
    taken = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert taken <= kept and 2 * len(taken) > len(kept)
