"""How far the sources of a language diverge from each other, term by term.

A term is a run of letters: ASCII letters and everything beyond ASCII, of which
only A-Z are lower-cased. Shares are whole numbers in billionths, smoothed by
two occurrences a term, and divergences are sums of rounded-down quotients of
them, so that results are exact and do not depend on the order of additions.

Null texts, languages and sources count as ''. A document without terms still
makes its group known. Repeated rows count as often as they occur. An empty
table gives an empty result. Columns beyond the three that are named play no
part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Lower-cases A-Z and turns every ASCII character that is no letter into a space, in one pass.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Documents in the upper bits of a tally, occurrences in the lower ones.
DOCUMENT = 1 << 64
#: Terms that a task holds before it hands its tallies on.
HELD = 400_000
#: Shares are in parts of this.
WHOLE = 10**9


def terms(text: bytes) -> Counter[bytes]:
    """How often each term occurs in one text (UTF-8)."""
    return Counter(text.translate(TABLE).split())


def _tallied(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs) of the tallies, handed on whenever ``most`` terms are held."""
    tallies: dict[tuple[str, str], dict[bytes, int]] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), tally in tallies.items():
            n = len(tally)
            columns = [
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(tally, pa.binary()),
                pa.array([x % DOCUMENT for x in tally.values()], pa.int64()), pa.array([x // DOCUMENT for x in tally.values()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            tally = tallies.setdefault((lang, source), {b"": 0})
            held -= len(tally)
            for term, n in terms(text.as_py()).items():
                tally[term] = tally.get(term, 0) + n + DOCUMENT
            held += len(tally)
            if held > most:
                yield from rows()
                tallies.clear()
                held = 0
    yield from rows()


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it; one row with an empty term marks each group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    tallied = rows.mapInArrow(lambda batches: _tallied(batches, held), "lang string, source string, term binary, n long, docs long")
    return tallied.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(WHOLE (n + 2) / (total + 2 vocabulary)), exact beyond 64 bits; null without a vocabulary."""
    up = F.lit(WHOLE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    down = F.when(vocabulary > 0, total + 2 * vocabulary).cast("decimal(20,0)")
    return F.call_function("div", up, down) + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most WHOLE + 1, so nothing overflows."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, *, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank).

    ``pair``: the divergence of a source from each other one of its language,
    over all kept terms. ``term``: the ``top`` terms that the source has more
    of than its language, by their part in that divergence. A language keeps
    the terms that occur in at least ``least_docs`` of its documents.

    Only terms that occur are joined. A term that a source lacks has the
    source's least share, so the sum over all terms is V times the gap between
    two least shares, corrected for the terms that one side has (from a
    histogram of its shares) and for those that both have (from the join).
    """
    counted = written(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col, held=held), "terms")
    found = counted.where("term <> ''")
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).select("lang", "term", "lang_n")
    kept = written(found.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-terms")

    size = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    total = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term = ''").select("lang", "source").join(total, ["lang", "source"], "left").join(size, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    groups = written(groups.withColumn("least", _share(F.lit(0), F.col("total"), F.col("v"))), "groups")

    shares = kept.join(groups, ["lang", "source"])
    own, whole = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    shares = written(shares.select("lang", "source", "term", own.alias("p"), whole.alias("q"), "least"), "shares")

    by = W.partitionBy("lang", "source")
    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(by.orderBy(F.col("value").desc(), "item"))).where(F.col("rank") <= top)

    # What a source's own terms add to its gap from every other source: once per distinct share.
    others = groups.select("lang", F.col("source").alias("other"), F.col("least").alias("other_least"))
    levels = shares.groupBy("lang", "source", "p", "least").agg(F.count(F.lit(1)).alias("c"))
    one = levels.join(others, "lang").where("source <> other")
    one = one.groupBy("lang", "source", "other").agg(F.sum(F.col("c") * (_gap(F.col("p"), F.col("other_least")) - _gap(F.col("least"), F.col("other_least")))).alias("value"))
    one = one.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), "value")

    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("least").alias("la"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("least").alias("lb"))
    pa_, pb, la, lb = (F.col(c) for c in ("pa", "pb", "la", "lb"))
    both = left.join(right, ["lang", "term"]).where("a < b")
    both = both.groupBy("lang", "a", "b").agg(F.sum(_gap(pa_, pb) - _gap(pa_, lb) - _gap(la, pb) + _gap(la, lb)).alias("value"))

    base = groups.join(others, "lang").where("source < other")
    base = base.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.coalesce(F.col("v") * _gap(F.col("least"), F.col("other_least")), F.lit(0)).alias("value"))
    pairs = base.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by.orderBy(F.col("value").desc(), "item")))
    return pairs.unionByName(more)
