"""Parts that SQL cannot express against plain versions: pseudonyms, URL scores, the randomness battery."""

import math
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from hinflow.llm import pii, secrets, urls

# --- 5 ---------------------------------------------------------------------------


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def planted(rng):
    """(kind, meaning, text): a random valid value in a random way of writing it."""
    kind = rng.choice(("card", "iban", "date", "ipv4", "mail", "phone"))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "card":
        body = "4" + number(14)
        digits = body + next(c for c in "0123456789" if luhn(body + c))
        return kind, digits, rng.choice((digits, " ".join(digits[i : i + 4] for i in range(0, 16, 4)), "-".join(digits[i : i + 4] for i in range(0, 16, 4))))
    if kind == "iban":
        account = number(18)
        check = 98 - int("".join(str(int(c, 36)) for c in account + "DE00")) % 97
        whole = f"DE{check:02d}{account}"
        return kind, whole, rng.choice((whole, " ".join(whole[i : i + 4] for i in range(0, 22, 4))))
    if kind == "date":
        d = date(1900, 1, 1) + timedelta(rng.randrange(73000))
        forms = [f"{d:%Y-%m-%d}", f"{d:%d/%m/%Y}", f"{d.day}.{d.month}.{d.year}", f"{d.year}/{d.month}/{d.day}"]
        if d.day > 12:
            forms += [f"{d:%m/%d/%Y}", f"{d.month}-{d.day}-{d.year}"]
        return kind, d, rng.choice(forms)
    if kind == "ipv4":
        a = ".".join(str(rng.randrange(256)) for _ in range(4))
        return kind, a, a
    if kind == "mail":
        a = "".join(rng.choice("abcdefgh") for _ in range(7)) + "@mail.example"
        return kind, a, a
    digits = f"{rng.randrange(2, 10)}{number(2)}{rng.randrange(2, 10)}{number(6)}"
    return kind, digits, rng.choice((f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"))


def meaning(kind, text):
    """What a written value means, and whether it is valid."""
    plain = re.sub(r"[ ()-]", "", text)
    if kind == "card":
        return plain, len(plain) == 16 and luhn(plain)
    if kind == "iban":
        return plain, int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "date":
        a, b, c = map(int, re.split("[-/.]", text))
        for fields in ((a, b, c),) if a > 31 else ((c, b, a), (c, a, b)):
            try:
                return date(*fields), True
            except ValueError:
                pass
        return None, False
    if kind == "ipv4":
        return text, all(0 <= int(x) <= 255 for x in text.split("."))
    return (plain, bool(re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", plain))) if kind == "phone" else (text, text.endswith("@mail.example"))


def test_pseudonyms_of_planted_values(spark, tmp_path):
    rng = random.Random(12)
    pool = [planted(rng) for _ in range(150)]
    words = ["lorem", "Ipsum", "dolor,", "É", "sit", "(amet)", "a-b", "x_1"]
    rows, want = [], {}
    for i in range(200):
        text, spans = "", []
        for _ in range(rng.randrange(6)):
            kind, what, _ = rng.choice(pool)
            written = next(p for p in iter(lambda: rng.choice(pool), None) if p[1] == what)[2]
            if kind == "date" and rng.random() < 0.7:  # the same day in other ways of writing
                written = rng.choice((f"{what:%Y-%m-%d}", f"{what:%d/%m/%Y}", f"{what.day}/{what.month}/{what.year}"))
            text += " ".join(rng.choice(words) for _ in range(3)) + " "
            spans.append((kind, what, len(text), len(text) + len(written)))
            text += written + " "
        rows.append((i, text + "end"))
        want[i] = spans
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([*rows, (None, rows[3][1]), (3, rows[3][1]), (7000, None)], "doc_id long, text string").repartition(3).write.parquet(path)
    found = pii.pseudonyms(spark.read.parquet(path), b"key").collect()
    assert len(found) == len(rows) + 3
    again = {r["text"] for r in found if r["id"] in (None, 3)}
    assert len(again) == 1
    other = {}
    for r in found:
        if r["id"] not in want:
            continue
        before, spans = rows[r["id"]][1], want[r["id"]]
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, _, s, e in spans) and r["n_found"] == len(spans)
        at = shift = 0
        for kind, what, s, e in spans:
            assert r["text"][at + shift : s + shift] == before[at:s]
            # Only addresses may change their width.
            rest = before[e : spans[spans.index((kind, what, s, e)) + 1][2]] if (kind, what, s, e) != spans[-1] else before[e:]
            end = s + shift + (e - s) if kind != "ipv4" else s + shift + len(re.match(r"[\d.]+", r["text"][s + shift :])[0].rstrip("."))
            new, valid = meaning(kind, r["text"][s + shift : end])
            assert valid and rest
            other.setdefault((kind, what), set()).add(new)
            shift += end - (s + shift) - (e - s)
            at = e
        assert r["text"][at + shift :] == before[at:]
    assert all(len(v) == 1 for v in other.values())  # equal values stay linked
    assert len({(k[0], next(iter(v))) for k, v in other.items()}) == len(other)  # different ones stay apart


@pytest.mark.parametrize("size", (1, 2, 10, 97, 1000))
def test_permutation_is_one(size):
    p = pii.Permutation(b"key", "x", size)
    assert sorted(p.apply(x) for x in range(size)) == list(range(size))
    assert all(p.apply(p.apply(x), back=True) == x for x in range(size))


# --- 6 ---------------------------------------------------------------------------


def plain_scores(urls_by_label, asked):
    counts = {}
    for label, many in urls_by_label.items():
        for u in many:
            raw = b"\0" * 4 + u.encode() + b"\0"
            for at in range(4, len(raw)):
                for k in range(5):
                    for key in ((raw[at - k : at], raw[at]), (raw[at - k : at], None)):
                        counts[label, k, *key] = counts.get((label, k, *key), 0) + 1
    out = []
    for u in asked:
        raw, total = b"\0" * 4 + (u or "").encode() + b"\0", 0
        for at in range(4, len(raw)):
            ll = []
            for label in (0, 1):
                p = 1 / 256
                for k in range(5):
                    n, c = (counts.get((label, k, raw[at - k : at], b), 0) for b in (raw[at], None))
                    p = (n + urls.STRENGTH * p) / (c + urls.STRENGTH)
                ll.append(math.log(p))
            total += round((ll[1] - ll[0]) * 1e6)
        out.append(total / (len(raw) - 4) / 1e6)
    return out


@pytest.mark.parametrize("frequent", (0, 40, 1 << 16))
def test_url_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(urls, "FREQUENT", frequent)
    rng = random.Random(5)
    good = [f"http://h{rng.randrange(20)}.com/page/{rng.randrange(99)}" for _ in range(60)]
    bad = [f"https://s{rng.randrange(20)}.net/es/{'casino' * rng.randrange(3)}" for _ in range(60)]
    asked = [f"http://h{k}.org/page/é{k}" for k in range(10)] + [None, "", "x" * 5000, "http://s1.org/es/casino", "http://s1.org/es/casino"]
    rows = list(enumerate([*good, *bad, *asked]))
    pages = spark.createDataFrame([*rows, (None, asked[0])], "page_id long, url string").repartition(3)
    got = urls.url_filter(pages, max_calibration=0).collect()
    assert len(got) == len(rows) + 1
    by = {r["id"]: r for r in got}
    want = plain_scores({1: good, 0: bad}, asked)
    for k, w in enumerate(want):
        r = by[120 + k]
        assert r["score"] == pytest.approx(w, abs=2e-6) and r["verdict"] == ("allow" if r["p_allow"] >= 0.5 else "block")
    assert by[None]["score"] == by[120]["score"] and by[3]["score"] is None


# --- 10 --------------------------------------------------------------------------


def plain_battery(t, alphabet):
    n, a = len(t), len(alphabet)
    chi = a * sum(t.count(c) ** 2 for c in alphabet) / n - n
    spread = 2 / (9 * (a - 1))
    z1 = max(((chi / (a - 1)) ** (1 / 3) - (1 - spread)) / spread**0.5, 0)
    x = [alphabet.index(c) for c in t]
    high = [v >= a / 2 for v in x]
    n1 = sum(high)
    both = 2 * n1 * (n - n1)
    runs = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
    var = both * (both - n) / (n * n * (n - 1))
    z2 = (runs - both / n - 1) / var**0.5 if var > 0 else 10
    mean = sum(x) / n
    power = sum((v - mean) ** 2 for v in x)
    z3 = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:], strict=False)) / power * n**0.5 if power else 10
    return z1**2 + z2**2 + z3**2


def test_battery_and_encodings(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(n))) for k, (_, _, alphabet, _) in enumerate(secrets.ENCODINGS) for n in (20, 33, 90) for _ in range(4)]
    rows += [(0, "0" * 24), (3, "ab" * 15)]
    df = spark.createDataFrame(rows, "k int, t string")
    alphabets = F.array(*(F.lit(e[2]) for e in secrets.ENCODINGS))
    got = df.select("k", "t", secrets.battery(F.col("t"), F.get(alphabets, F.col("k"))).alias("q"), secrets.encoding(F.col("t")).alias("code")).collect()
    for r in got:
        assert r["q"] == pytest.approx(plain_battery(r["t"], secrets.ENCODINGS[r["k"]][2]), rel=1e-9)
        fits = [k for k, e in enumerate(secrets.ENCODINGS) if re.fullmatch(f"[{e[1]}]+", r["t"])]
        assert r["code"] == fits[0]


def test_normal_tail(spark):
    z = [-6.0, -3.0, -1.0, -0.1, 0.0, 0.5, 2.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", secrets.lower_tail(F.col("z")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / 2**0.5), abs=1e-7) for r in got)
