"""Secret scan with a battery of randomness tests (operator 10, built-in functions only).

Base spans come from three patterns. The battery looks at every run of MIN_RUN
or more characters of an encoding's kind outside base spans, as a whole and,
where - _ = divide it, by its parts:

* its encoding is inferred from the characters it uses (see ENCODINGS);
* three tests take randomness as their reference: chi-squared for uniformity
  over the encoding's alphabet (Wilson-Hilferty z), runs of the alphabet's
  upper and lower half, and lag-one serial correlation. The sum of the three
  squared z-scores is small for random text and large for ordinary text;
* what is ordinary is learned from the corpus: every word of every text is
  counted. The model of ordinary text puts each word in proportion to its count;
  STRINGS strings of WORDS words are laid out by it, each word as often as its
  share of all occurrences says, in an order by hash. Each gives, for every
  encoding, one string of a length drawn by hash in the manner of that encoding
  (joined words, capitals at word starts, paths, snake case, its digits, these
  from the words that have any). Per encoding, the logarithm of the statistic is
  fitted by a line over the logarithm of the length, with a normal spread;
* a run's p-value is the chance that ordinary text of its encoding and length
  has a statistic as small. Benjamini-Hochberg at level FDR, within bands of
  length, decides which runs are secrets. p-values are rounded up to a grid, so
  only (band, grid point) counts are aggregated.

Digits, and letters of one case, say little per character: ordinary text of
that kind passes the tests almost as well, and short random runs of them are
not found.

A run that is found is a span of kind ``random``; a part only if its run as a
whole is not. Texts are read twice, for runs and for words; what comes back to
the driver is one row per encoding and per band.

Defined results: a null or empty text has no spans, and its digest is that of
the empty string; an encoding for which fewer than MIN_ORDINARY strings have
enough characters, or whose texts have fewer than MIN_WORDS words, finds nothing; repeated rows get equal results; an empty
table gives an empty table; further columns are not read. Positions count code
points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GAP, bind, written

#: Fixed patterns: kind, expression, and what the match must have to stay.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
MIN_RUN, LONGEST = 20, 128
RUN = r"[A-Za-z0-9+/_=-]{20,}"
PART = r"[A-Za-z0-9+/]{20,}"
#: Lower ends of the bands of length within which false discoveries are controlled.
BANDS = (20, 32, 64, 128)
FDR = 0.005
MIN_ORDINARY = 10
MIN_WORDS = 256
#: Strings that the counts of words are laid out in, and words of each.
STRINGS, WORDS = 2048, 160
#: Parts of the vocabulary that its running counts are made in.
PARTS = 256
#: p-values are rounded up to powers of 10 ** (1 / GRID).
GRID = 50

SPANS = "array<struct<s:int,e:int,t:string>>"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Name, class of characters, alphabet, and how ordinary text is written in it; the first that fits a run is its encoding.
#: Capitals instead of small letters leave all three tests as they are, so such an encoding takes the null of the one it names.
ENCODINGS = (
    ("digits", "0-9", DIGITS, "plain"),
    ("hex", "0-9a-f", DIGITS + "abcdef", "plain"),
    ("HEX", "0-9A-F", DIGITS + "ABCDEF", "hex"),
    ("lower", "a-z", LOWER, "plain"),
    ("UPPER", "A-Z", UPPER, "lower"),
    ("base32", "a-z2-7", LOWER + "234567", "plain"),
    ("BASE32", "A-Z2-7", UPPER + "234567", "base32"),
    ("base36", "a-z0-9", LOWER + DIGITS, "plain"),
    ("BASE36", "A-Z0-9", UPPER + DIGITS, "base36"),
    ("letters", "A-Za-z", UPPER + LOWER, "title"),
    ("base62", "A-Za-z0-9", UPPER + LOWER + DIGITS, "title"),
    ("base64url", "A-Za-z0-9_-", UPPER + LOWER + DIGITS + "-_", "snake"),
    ("base64", "A-Za-z0-9+/_-", UPPER + LOWER + DIGITS + "+/", "path"),
)


def _total(xs: Column, zero: Column) -> Column:
    return F.aggregate(xs, zero, lambda s, v: s + v)


def running(x: Column, width: int = 64) -> Column:
    """Sums of the elements before each element of an integer array.

    Sums of blocks, of blocks of blocks, and of those: an element adds up
    ``width`` numbers a level at most, so the cost grows with the array's length.
    """
    zero = F.lit(0)

    def blocks(a: Column) -> Column:
        starts = F.sequence(zero, F.floor((F.size(a) - 1) / width).cast("int"))
        return F.when(F.size(a) > 0, F.transform(starts, lambda c: _total(F.slice(a, c * width + 1, width), zero))).otherwise(F.array().cast("array<int>"))

    def before(a: Column, i: Column) -> Column:
        """The elements of i's block that come before i."""
        return _total(F.slice(a, (i - i % width) + 1, i % width), zero)

    def up(i: Column) -> Column:
        return F.floor(i / width).cast("int")

    def summed(b1: Column) -> Column:
        def upper(b2: Column) -> Column:
            def top(b3: Column) -> Column:
                at = lambda i: before(x, i) + before(b1, up(i)) + before(b2, up(up(i))) + _total(F.slice(b3, 1, up(up(up(i)))), zero)
                return F.when(F.size(x) > 0, F.transform(F.sequence(zero, F.size(x) - 1), at)).otherwise(F.array().cast("array<int>"))

            return bind(blocks(b2), top)

        return bind(blocks(b1), upper)

    return bind(blocks(x), summed)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, text), end exclusive.

    The pieces between the matches, from ``split``, give the positions.
    """
    empty = F.array().cast(SPANS)

    def placed(m: Column) -> Column:
        def spans(gaps: Column) -> Column:
            steps = F.transform(m, lambda t, i: F.length(F.get(gaps, i)) + F.length(t))

            def told(ahead: Column) -> Column:
                def one(t: Column, i: Column) -> Column:
                    s = F.get(ahead, i) + F.length(F.get(gaps, i))
                    return F.struct(s.alias("s"), (s + F.length(t)).alias("e"), t.alias("t"))

                return F.transform(m, one).cast(SPANS)

            return bind(steps, lambda x: bind(running(x), told))

        return F.when(F.size(m) == 0, empty).otherwise(bind(F.split(text, pattern, -1), spans))

    return bind(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), placed)


def _assigned(t: Column) -> Column:
    return F.length(F.regexp_extract(t, ASSIGN, 1)) >= 6


def blanked(text: Column, pattern: str, stays: Column | None = None) -> Column:
    """``text`` with spaces in place of its matches (of those that ``stays`` says, a function of the match)."""

    def filled(m: Column) -> Column:
        def joined(gaps: Column) -> Column:
            def piece(g: Column, i: Column) -> Column:
                t = F.coalesce(F.get(m, i), F.lit(""))
                blank = F.repeat(F.lit(" "), F.length(t))
                return F.concat(g, blank if stays is None else F.when(stays(t), blank).otherwise(t))

            return F.array_join(F.transform(gaps, piece), "")

        return F.when(F.size(m) == 0, text).otherwise(bind(F.split(text, pattern, -1), joined))

    return bind(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), filled)


def base_spans(text: Column) -> Column:
    """A struct of one array of spans per base kind."""
    assign = F.filter(matches(text, ASSIGN), lambda x: _assigned(x["t"]))
    none = F.array().cast(SPANS)
    access = F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS)).otherwise(none)
    return F.struct(assign.alias("assign"), access.alias("access"), matches(text, HEX).alias("hex"))


def encoding(body: Column) -> Column:
    """The number of the run's encoding in ENCODINGS."""
    chain = F.lit(len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 2, -1, -1):
        chain = F.when(body.rlike(f"^[{ENCODINGS[k][1]}]+$"), F.lit(k)).otherwise(chain)
    return chain


def _sum_of_squares(n: Column, q: Column) -> Column:
    """Squared z-scores from the sums of a run of ``n`` characters."""
    s = q["s"]
    both = 2 * s["n1"] * (n - s["n1"])
    mean, var = both / n + 1, both * (both - n) / (n * n * (n - 1))
    z2 = F.when(var > 0, (s["runs"] - mean) / F.sqrt(var)).otherwise(F.lit(10.0))
    z3 = F.when(q["power"] > 0, q["lagged"] / q["power"] * F.sqrt(n)).otherwise(F.lit(10.0))
    return s["z1"] * s["z1"] + z2 * z2 + z3 * z3


def battery(body: Column, alphabet: Column) -> Column:
    """Sum of squared z-scores of the three tests, with randomness over ``alphabet`` as the reference."""
    a, n = F.length(alphabet).cast("double"), F.length(body).cast("double")
    zero = F.lit(0.0)
    counts = F.transform(F.split(alphabet, ""), lambda c: F.length(body) - F.length(F.replace(body, c, F.lit(""))))
    squares = F.aggregate(counts, zero, lambda s, x: s + x * x)
    spread = F.lit(2.0) / (F.lit(9.0) * (a - 1))
    z1 = F.greatest((F.pow((a * squares / n - n) / (a - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread), zero)
    codes = F.transform(F.split(body, ""), lambda c: F.instr(alphabet, c).cast("double") - 1)

    def ordered(x: Column) -> Column:
        high = F.transform(x, lambda v: F.when(v >= a / 2, 1.0).otherwise(0.0))

        def tests(h: Column) -> Column:
            # Sums that the elements' expressions use are bound, so that they are made once.
            runs = 1 + _total(F.transform(h, lambda v, i: F.when(v != F.get(h, i + 1), 1.0).otherwise(0.0)), zero)
            sums = F.struct(_total(h, zero).alias("n1"), (_total(x, zero) / n).alias("centre"), z1.alias("z1"), runs.alias("runs"))

            def scored(s: Column) -> Column:
                off = F.transform(x, lambda v: v - s["centre"])
                return bind(off, lambda o: F.struct(_total(F.transform(o, lambda v, i: F.coalesce(v * F.get(o, i + 1), zero)), zero).alias("lagged"), _total(F.transform(o, lambda v: v * v), zero).alias("power"), s.alias("s")))

            return bind(bind(sums, scored), lambda q: _sum_of_squares(n, q))

        return bind(high, tests)

    return bind(codes, ordered)


def log_statistic(t: Column) -> Column:
    """(code, n, y): a run's encoding, its length without padding, and the logarithm of its statistic."""
    alphabets = F.array(*(F.lit(e[2]) for e in ENCODINGS))

    def judged(body: Column) -> Column:
        def told(code: Column) -> Column:
            return F.struct(code.alias("code"), F.length(body).alias("n"), F.log(battery(body, F.get(alphabets, code)) + 1).alias("y"))

        return bind(encoding(body), told)

    return bind(F.regexp_replace(t, "=+$", ""), judged)


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): every word of all texts and how often it occurs, written."""
    words = docs.select(F.explode(F.split(F.col(text_col), GAP)).alias("word")).where("word <> ''")
    return written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "vocabulary")


def laid_out(words: DataFrame, strings: int = STRINGS, size: int = WORDS) -> DataFrame:
    """(kind, string, text): ``words`` (word, n) in ``strings`` texts of some ``size`` words, each in proportion to its count; kind 1 of the words with digits only, kind 0 of all.

    All occurrences in a row are cut into ``strings * size`` equal steps; a word
    is laid out once for each middle of a step that falls on it. Running counts
    are made in parts of the vocabulary, over sums of the parts.
    """
    kinds = F.when(F.col("word").rlike("[0-9]"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    w = words.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(PARTS)).alias("part"), F.explode(kinds).alias("kind"))
    parts = w.groupBy("kind", "part").agg(F.sum("n").alias("own"))
    by = W.partitionBy("kind")
    parts = parts.select("kind", "part", (F.sum("own").over(by.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(by).alias("total"))
    upto = F.sum("n").over(W.partitionBy("kind", "part").orderBy("word").rowsBetween(W.unboundedPreceding, 0))
    w = w.withColumn("upto", upto).join(F.broadcast(parts.where(F.col("total") >= MIN_WORDS)), ["kind", "part"])
    step = lambda at: F.floor(at / F.col("total") * strings * size + 0.5).cast("int")
    w = w.withColumn("first", step(F.col("before") + F.col("upto") - F.col("n"))).withColumn("end", step(F.col("before") + F.col("upto")))
    w = w.where("end > first").select("kind", "word", F.explode(F.sequence("first", F.col("end") - 1)).alias("k"))
    w = w.select("kind", F.pmod(F.xxhash64("kind", "k"), F.lit(strings)).alias("string"), F.struct(F.xxhash64("k", "kind").alias("h"), "k", "word").alias("w"))
    w = w.groupBy("kind", "string").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return w.select("kind", "string", F.array_join(F.col("w.word"), " ").alias("text"))


def ordinary(words: Column, key: Column, kind: Column) -> Column:
    """(code, n, y) of one string per encoding of ``words``, at a place drawn by hash, that has enough characters for it; of digits for kind 1, of all else for kind 0."""
    styles = {
        "plain": F.lower(words), "title": F.initcap(words),
        "snake": F.translate(words, " ", "_"), "path": F.translate(F.initcap(words), " ", "/"),
    }

    def cut(k: int, styled: Column) -> Column:
        _, kept, alphabet, style = ENCODINGS[k]
        h = lambda salt: F.xxhash64(key, F.lit(k), F.lit(salt))
        n = F.pmod(h(0), F.lit(LONGEST - MIN_RUN + 1)).cast("int") + MIN_RUN

        def window(t: Column) -> Column:
            at = F.pmod(h(1), F.greatest(F.length(t) - n, F.lit(0)).cast("bigint") + 1).cast("int") + 1
            return F.when(F.length(t) >= n, F.substring(t, at, n))

        mine = F.when(kind == (1 if k == 0 else 0), styled[style])
        piece = bind(F.regexp_replace(mine, f"[^{kept}]+", ""), window)
        return F.struct(F.lit(k).alias("code"), F.lit(alphabet).alias("alphabet"), piece.alias("t"))

    def cuts(s: Column) -> Column:
        made = F.array(*(cut(k, {name: s[name] for name in styles}) for k, e in enumerate(ENCODINGS) if e[3] in styles))
        return F.transform(
            F.filter(made, lambda x: x["t"].isNotNull()),
            lambda x: F.struct(x["code"].alias("code"), F.length(x["t"]).alias("n"), F.log(battery(x["t"], x["alphabet"]) + 1).alias("y")),
        )

    return bind(F.struct(*(c.alias(n) for n, c in styles.items())), cuts)


def fitted(texts: DataFrame) -> dict[int, tuple[float, float, float]]:
    """Per encoding (intercept, slope, spread) of the statistic's logarithm over that of the length, from the texts of ``laid_out``."""
    # Texts are few and their tests dear, so they are dealt out again.
    tasks = texts.sparkSession.sparkContext.defaultParallelism * 2
    s = texts.repartition(tasks, "kind", "string").select(F.explode(ordinary(F.col("text"), F.xxhash64("kind", "string"), F.col("kind"))).alias("o"))
    s = s.select("o.code", F.log(F.col("o.n")).alias("x"), "o.y")
    y = F.col("y")
    lines = s.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.regr_intercept(y, F.col("x")).alias("a"), F.regr_slope(y, F.col("x")).alias("b"),
        F.avg(y).alias("mean"), F.var_pop(y).alias("var"), F.regr_r2(y, F.col("x")).alias("r2"),
    )
    out = {}
    for r in lines.where(F.col("n") >= MIN_ORDINARY).collect():
        line = r["a"] is not None and r["b"] is not None and r["r2"] is not None
        a, b = (r["a"], r["b"]) if line else (r["mean"], 0.0)
        out[r["code"]] = (a, b, max((r["var"] * (1 - (r["r2"] if line else 0.0))) ** 0.5, 0.05))
    names = [e[0] for e in ENCODINGS]
    twins = {k: names.index(e[3]) for k, e in enumerate(ENCODINGS) if e[3] in names}
    return out | {k: out[of] for k, of in twins.items() if of in out}


def lower_tail(z: Column) -> Column:
    """The normal distribution function, by the polynomial of Abramowitz and Stegun, 26.2.17."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = F.lit(0.0)
    # The polynomial's coefficients, highest power first.
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        series = (series + c) * t
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * series
    return F.when(z < 0, tail).otherwise(1 - tail)


def band(n: Column) -> Column:
    chain = F.lit(len(BANDS) - 1)
    for k in range(len(BANDS) - 2, -1, -1):
        chain = F.when(n < BANDS[k + 1], F.lit(k)).otherwise(chain)
    return chain


def grid_point(x: Column, lines: dict[int, tuple[float, float, float]]) -> Column:
    """The p-value of (code, n, y), rounded up to 10 ** (result / GRID); null for an encoding without a line."""
    if not lines:
        return F.lit(None).cast("int")
    cells = F.create_map(*(c for k, v in lines.items() for c in (F.lit(k), F.array(*(F.lit(float(f)) for f in v)))))

    def told(line: Column) -> Column:
        z = (x["y"] - F.get(line, F.lit(0)) - F.get(line, F.lit(1)) * F.log(x["n"])) / F.get(line, F.lit(2))
        return F.ceil(F.log10(F.greatest(lower_tail(z), F.lit(1e-40))) * GRID).cast("int")

    return F.when((x["n"] >= MIN_RUN) & F.map_contains_key(cells, x["code"]), bind(F.element_at(cells, x["code"]), told))


def thresholds(found: DataFrame, level: float) -> list[int]:
    """Per band the largest grid point that Benjamini-Hochberg accepts; one below all others if none."""
    whole = F.transform("runs", lambda x: F.struct(x["band"], x["g"]))
    parts = F.flatten(F.transform("runs", lambda x: F.transform(x["parts"], lambda y: F.struct(y["band"], y["g"]))))
    p = found.select(F.explode(F.concat(whole, parts)).alias("r")).select("r.band", "r.g").where("g is not null").groupBy("band", "g").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("band").orderBy("g"))
    p = p.select("band", "g", upto.alias("upto"), F.sum("n").over(W.partitionBy("band")).alias("m"))
    accepted = p.where(F.pow(F.lit(10.0), F.col("g") / GRID) <= level * F.col("upto") / F.col("m"))
    best = {r["band"]: r["g"] for r in accepted.groupBy("band").agg(F.max("g").alias("g")).collect()}
    return [best.get(k, -41 * GRID) for k in range(len(BANDS))]


def scan(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, level: float = FDR) -> DataFrame:
    """``carry`` (default: all columns but the text) and ``spans``: (start, kind, end), sorted.

    ``kind`` indexes KINDS. If ``docs`` has a column named ``spans``, it is replaced.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("spans", *([text_col] if carry is None else []))]
    text = F.coalesce(F.col(text_col), F.lit(""))

    def with_parts(x: Column) -> Column:
        none = F.array().cast(SPANS)
        parts = F.when(x["t"].rlike("[_=-][^_=-]"), F.filter(matches(x["t"], PART), lambda y: y["t"] != x["t"])).otherwise(none)
        return F.struct(x.alias("whole"), parts.alias("parts"))

    def measured(x: Column, shift: Column) -> Column:
        return F.struct((x["s"] + shift).alias("s"), (x["e"] + shift).alias("e"), log_statistic(x["t"]).alias("x"))

    def both(x: Column) -> Column:
        return F.struct(measured(x["whole"], F.lit(0)).alias("whole"), F.transform(x["parts"], lambda y: measured(y, x["whole"]["s"])).alias("parts"))

    plain = lambda k: F.transform(F.col(f"base.{k}"), lambda x: F.struct(x["s"], x["e"])).alias(k)
    # One projection a step: base spans leave the text kind by kind, then come runs, their parts, and the tests.
    d = docs.select(F.struct(*carry).alias("__doc"), text.alias("t"))
    d = d.select("*", base_spans(F.col("t")).alias("base"), blanked(F.col("t"), ASSIGN, _assigned).alias("o"))
    d = d.withColumn("o", F.when(F.contains("o", F.lit("AKIA")), blanked(F.col("o"), ACCESS)).otherwise(F.col("o")))
    d = d.withColumn("o", blanked(F.col("o"), HEX))
    d = d.withColumn("runs", matches(F.col("o"), RUN)).withColumn("runs", F.transform("runs", with_parts)).withColumn("runs", F.transform("runs", both))
    found = written(d.select("__doc", *(plain(k) for k in KINDS[:3]), "runs"), "secrets")
    lines = fitted(laid_out(vocabulary(docs, text_col)))

    def graded(x: Column) -> Column:
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), band(x["x"]["n"]).alias("band"), grid_point(x["x"], lines).alias("g"))

    def regraded(r: Column) -> Column:
        whole = graded(r["whole"])
        return bind(whole, lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), w["band"].alias("band"), w["g"].alias("g"), F.transform(r["parts"], graded).alias("parts")))

    found = found.withColumn("runs", F.transform("runs", regraded))
    limit = F.array(*(F.lit(x) for x in thresholds(found, level)))

    def told(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end")))

    passes = lambda x: F.coalesce(x["g"] <= F.get(limit, x["band"]), F.lit(False))
    ends = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    random = F.flatten(F.transform("runs", lambda x: F.when(passes(x), F.array(ends(x))).otherwise(F.transform(F.filter(x["parts"], passes), ends))))
    spans = F.concat(*(told(F.col(k), i) for i, k in enumerate(KINDS[:3])), told(random, 3))
    return found.select("__doc.*", F.array_sort(spans).alias("spans"))


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
