"""Neighbourhood similarity, exact and from sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.metapath import MET, SHARE
from ..plans.scratch import written

#: Meetings that a task takes in about.
EACH = 2_000_000


def meetings(items: DataFrame, key: str = "item", carried: tuple[str, ...] = (), share: int = SHARE, met: int = MET) -> DataFrame:
    """(bucket, a, b and, for each of ``carried``, a_ and b_ with the values of both), a < b, of nodes with a common item, once for each; ``items``: distinct (node, item, carried).

    What is shuffled are arrays of those members of an item that come after a
    node, a row for each member, not pairs. They meet by ``a`` (and bucket,
    where a node meets more than about ``met``), so grouping by (bucket, a, b)
    shuffles nothing more; numbers that fit are 32 bits wide. An item of many members is cut into parts of about
    ``share``, which meet one another part by part.
    """
    cols = ["node", *carried]
    items = written(items.select(F.col(key).alias("item"), *cols), "items")
    by = written(items.groupBy("item").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.count(F.lit(1)) / share).cast("int").alias("parts"), F.min("node").alias("lo"), F.max("node").alias("hi")), "members")
    lo, hi, pairs = by.agg(F.min("lo"), F.max("hi"), F.sum(F.col("members") * (F.col("members") - 1) / 2)).first()
    small = items.schema["node"].dataType.typeName() == "long" and lo is not None and -(1 << 31) <= lo and hi < 1 << 31
    if small:
        items = items.withColumn("node", F.col("node").cast("int"))
    sized = items.join(by.select("item", "members", "parts"), "item")
    chunks = sized.groupBy("item", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("m"))
    if not by.where("parts > 1").isEmpty():
        chunks = written(chunks, "chunks")
    rows = chunks.select("m", F.posexplode("m").alias("p", "me")).select("me", F.slice("m", F.col("p") + 2, F.greatest(F.size("m") - F.col("p") - 1, F.lit(0))).alias("rest"))
    if hasattr(chunks, "scratch_path"):
        many = chunks.where("parts > 1")
        across = many.select("item", "part", F.explode("m").alias("me")).join(many.select("item", F.col("part").alias("other"), F.col("m").alias("there")), "item").where("part <> other")
        rows = rows.union(across.select("me", F.filter("there", lambda x: x["node"] > F.col("me.node")).alias("rest")))
    rows = rows.where("size(rest) > 0").select(*(F.col(f"me.{c}").alias("a" if c == "node" else f"a_{c}") for c in cols), "rest")
    large = written(sized.groupBy(F.col("node").alias("a")).agg(F.ceil(F.sum("members") / met).cast("int").alias("of")).where("of > 1"), "large")
    by_a, bucket = ["a"], F.lit(0)
    if not large.isEmpty():
        by_a, bucket = ["bucket", "a"], F.col("bucket")
        rows = rows.join(large, "a", "left").withColumn("of", F.coalesce("of", F.lit(1))).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        mine = F.filter("rest", lambda x: F.pmod(F.xxhash64(x["node"]), F.col("of")) == F.col("bucket"))
        rows = rows.withColumn("rest", F.when(F.col("of") == 1, F.col("rest")).otherwise(mine))
    # Arrays of numbers take a third of what arrays of structs take.
    there = [F.col(f"rest.{c}").alias("b" if c == "node" else f"b_{c}") for c in cols]
    rows = rows.select(bucket.alias("bucket"), "a", *(f"a_{c}" for c in carried), *there)
    n = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int((pairs or 0) // EACH), 16384))
    rows = rows.repartition(n, *by_a)
    others = ["b", *(f"b_{c}" for c in carried)]
    return rows.select("bucket", "a", *(f"a_{c}" for c in carried), F.inline(F.arrays_zip(*others)))


def counted(items: DataFrame) -> DataFrame:
    """``items`` with ``n``, how many its node has."""
    return items.join(items.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("n")), "node")


def jaccard(items: DataFrame, key: str = "item", share: int = SHARE, met: int = MET) -> DataFrame:
    """(a, b, jaccard) for pairs that share an item; all other pairs have 0."""
    kind = items.schema["node"].dataType
    o = meetings(counted(items), key, ("n",), share, met).groupBy("bucket", "a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("a_n").alias("na"), F.max("b_n").alias("nb"))
    return o.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def sample_pairs(sample: DataFrame) -> DataFrame:
    """(a, b), a < b, of a sample whose size is the operator's parameter."""
    return sample.select(F.col("node").alias("a")).join(F.broadcast(sample.select(F.col("node").alias("b"))), F.expr("a < b"))


def fidelity(pairs: DataFrame, exact: DataFrame, estimated: DataFrame) -> DataFrame:
    """One row: mean absolute error and Pearson correlation (null without variance) over ``pairs``."""
    e = pairs.join(exact.withColumnRenamed("jaccard", "x"), ["a", "b"], "left").join(estimated.withColumnRenamed("jaccard", "y"), ["a", "b"], "left")
    e = e.select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    return e.agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"), F.corr("x", "y").alias("pearson"))


def _both_held(k: int) -> list[Column]:
    """Of a group of ``meetings`` with places (``p``, from 0, null if not in the sketch): how many shared items both sketches hold, their last places, and all places."""
    both = F.col("a_p").isNotNull() & F.col("b_p").isNotNull()
    held = [F.count(F.when(both, 1)).alias("held"), F.max(F.when(both, F.col("a_p"))).alias("pa"), F.max(F.when(both, F.col("b_p"))).alias("pb")]
    if k > 62:
        return [*held, F.sort_array(F.collect_list(F.when(both, F.struct(F.col("a_p").alias("x"), F.col("b_p").alias("y"))))).alias("places")]
    bit = lambda p: F.bit_or(F.when(both, F.pow(F.lit(2.0), F.col(p)).cast("bigint")))
    return [*held, bit("a_p").alias("ma"), bit("b_p").alias("mb")]


def _estimate(k: int) -> Column:
    """The estimate of ``coordinated`` from ``_both_held`` and both numbers of items (na, nb).

    A shared value at places x and y, the c-th that both hold (from 0), has the
    place x + y - c in the merged sketch. That grows with c, so if the last one
    is among the k smallest, all are.
    """
    if k > 62:
        places = F.col("places")
    else:
        of = lambda m: F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.getbit(m, i) == 1)
        places = F.arrays_zip(of(F.col("ma")).alias("x"), of(F.col("mb")).alias("y"))
    some = F.size(F.filter(places, lambda z, c: z["x"] + z["y"] - c < k))
    hits = F.when(F.col("held") == 0, 0).when(F.col("pa") + F.col("pb") - (F.col("held") - 1) < k, F.col("held")).otherwise(some)
    size = lambda n: F.least(F.col(n), F.lit(k))
    return hits / F.least(F.lit(k), size("na") + size("nb") - F.col("held"))


def coordinated(slots: DataFrame, k: int) -> DataFrame:
    """(a, b, jaccard) for pairs that share a slot: of the k smallest values of both sketches together, the share that both hold.

    ``slots`` (node, h): bottom-k sketches by one hash. Every value of the
    merged bottom-k is a fair draw from the union, so the estimate has no bias,
    unlike the overlap of the sketches themselves. What travels with a slot is
    its place in the sketch, not the sketch.
    """
    kind = slots.schema["node"].dataType
    placed = counted(slots.select("node", "h")).withColumn("p", (F.row_number().over(W.partitionBy("node").orderBy("h")) - 1).cast("short"))
    o = meetings(placed, "h", ("n", "p")).groupBy("bucket", "a", "b").agg(*_both_held(k), F.max("a_n").alias("na"), F.max("b_n").alias("nb"))
    return o.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), _estimate(k).alias("jaccard"))


def coordinated_errors(items: DataFrame, k: int, share: int = SHARE, met: int = MET) -> DataFrame:
    """As ``errors(jaccard(items), coordinated(bottom_k(items), k))`` for distinct (node, item, h), h a hash of the item without collisions: pairs meet once for both."""
    order = F.row_number().over(W.partitionBy("node").orderBy("h"))
    placed = counted(items).withColumn("p", order - 1).withColumn("p", F.when(F.col("p") < k, F.col("p")).cast("short"))
    held = meetings(placed, "item", ("n", "p"), share, met).groupBy("bucket", "a", "b")
    o = held.agg(F.count(F.lit(1)).alias("shared"), *_both_held(k), F.max("a_n").alias("na"), F.max("b_n").alias("nb"))
    off = _estimate(k) - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return o.select(off.alias("off")).agg(F.count(F.lit(1)).alias("pairs"), F.avg("off").alias("bias"), F.avg(F.abs("off")).alias("mae"), F.max(F.abs("off")).alias("worst"))


def errors(exact: DataFrame, estimated: DataFrame) -> DataFrame:
    """One row over the pairs of ``exact`` (a, b, jaccard): pairs, mean error, mean and largest absolute error; pairs without an estimate have 0."""
    e = exact.join(estimated.withColumnRenamed("jaccard", "y"), ["a", "b"], "left")
    off = F.coalesce("y", F.lit(0.0)) - F.col("jaccard")
    return e.agg(F.count(F.lit(1)).alias("pairs"), F.avg(off).alias("bias"), F.avg(F.abs(off)).alias("mae"), F.max(F.abs(off)).alias("worst"))
