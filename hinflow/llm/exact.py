"""Exact deduplication with streaming state (operator 3, built-in functions only).

Four steps:

1. One scan makes the index: digest of the normalised text, stable identifier,
   content locator (file and row in it).
2. A stream over the index keeps, per digest, the largest (identifier,
   locator) and the number of rows. The state lives in RocksDB, on disk, and
   has no watermark: nothing expires, so a later run of the same stream with
   the same checkpoint sees all that came before.
3. Hits (digests seen more than once) are checked on full bytes: the texts of
   a hit group are compared with the text that its locator points at. Groups
   are salted by their size, so a group with a third of all rows spreads over
   many tasks.
4. Rows that differ from their group's text in spite of an equal digest form
   groups of their own, by text.

Defined results: null counts as empty, so nulls and empty texts are one group;
of rows that share an identifier and a text the last by locator stays; a null
identifier is smaller than any other; with a continued state the keeper may be
a row of an earlier table, whose files must still be there, group sizes count
the rows of all tables fed (one fed twice counts twice), and the result has the
rows of this table only; an empty table gives an empty table;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.scratch import remove
from .common import join_hot, located, locator, lower_ascii, only, scratch, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows of one hit group that are compared in one salted share.
SHARE = 2000


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def content_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, file, row, digest) of a parquet table read as ``docs``."""
    return docs.select(
        F.col(id_col).alias("id"),
        *locator(),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
    )


def digest_state(index: DataFrame) -> DataFrame:
    """The keyed state: works on a stream and, for tests, on a batch."""
    return index.groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("n"))


def run_stream(index: DataFrame, checkpoint: str) -> StreamingQuery:
    """Feed all that is new in a streaming ``index`` into the state below ``checkpoint``."""
    return digest_state(index).writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The retained state as a table: digest, keeper, n."""
    state = spark.read.format("statestore").load(checkpoint)
    names = state.schema["value"].dataType.fieldNames()
    return state.select(F.col("key.digest").alias("digest"), F.col("value")[names[0]].alias("keeper"), F.col("value")[names[1]].alias("n"))


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which a task closes when it has committed: a run holds as many open stores as it has cores."""
    own = {PROVIDER: ROCKSDB, "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _streamed_state(spark: SparkSession, index_path: str, schema, checkpoint: str | None) -> DataFrame:
    """The state after all of the index; without a ``checkpoint`` to continue, it is read out and its folder goes."""
    folder = checkpoint or scratch(spark, "digest-state")
    with state_on_disk(spark):
        run_stream(spark.readStream.schema(schema).parquet(index_path), folder).awaitTermination()
        state = written(state_table(spark, folder), "digests")
    if checkpoint is None:
        remove(spark, folder)
    return state


def _earlier_texts(spark: SparkSession, docs: DataFrame, hits: DataFrame, index: DataFrame, text_col: str) -> DataFrame | None:
    """(digest, keep_text, n) of the keepers that lie in earlier tables, read from the files that they name; None if there are none."""
    ours = hits.join(index.select("digest").distinct(), "digest", "left_semi").select("digest", "n", "keeper.file", "keeper.row")
    away = written(ours.join(index.select("file", "row"), ["file", "row"], "left_anti"), "away")
    files = [unquote(r["file"]) for r in away.select("file").distinct().collect()]
    if not files:
        return None
    texts = spark.read.schema(docs.select(text_col).schema).parquet(*files).select(*locator(), normalised(F.col(text_col)).alias("keep_text"))
    found = written(away.join(texts, ["file", "row"], "left").select("digest", "keep_text", "n"), "earlier-texts")
    if lost := found.where("keep_text is null").count():
        raise RuntimeError(f"{lost} rows that the state names are no longer in their files")
    return found


def exact_groups(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, file, row, digest, keep_id, group_size, kept.

    ``docs`` must be a plain read of parquet files, so that each row has a
    content locator; ``located`` makes one from any DataFrame. The stream has
    a state of its own, or continues the one below ``checkpoint``.
    """
    index_path = scratch(spark, "content-index")
    index = content_index(docs, id_col, text_col)
    index.write.parquet(index_path)
    index = spark.read.schema(index.schema).parquet(index_path)
    if checkpoint is not None:
        # A continued stream has one source folder, which grows beside its checkpoint.
        index_path = f"{checkpoint.rstrip('/')}-index"
        index.write.mode("append").parquet(index_path)
    state = _streamed_state(spark, index_path, index.schema, checkpoint)

    hits = state.where("n > 1")
    located = join_hot(index, hits, "digest", "n").select("file", "row", "id", "digest", "keeper", "n")
    texts = docs.select(*locator(), F.col(text_col).alias("text"))
    hit_texts = written(texts.join(located, ["file", "row"]).withColumn("text", normalised(F.col("text"))), "hit-texts")

    shares = F.ceil(F.col("n") / SHARE).cast("int")
    is_keeper = (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))
    keepers = hit_texts.where(is_keeper).select("digest", F.col("text").alias("keep_text"), "n")
    if checkpoint is not None and (earlier := _earlier_texts(spark, docs, hits, index, text_col)) is not None:
        keepers = keepers.unionByName(earlier)
    keepers = keepers.select("digest", "keep_text", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    dealt = hit_texts.withColumn("share", F.pmod(F.xxhash64("file", "row"), shares).cast("int"))
    odd = F.when(F.col("text") != F.col("keep_text"), F.col("text"))
    checked = dealt.join(keepers, ["digest", "share"]).select("id", "file", "row", "digest", odd.alias("odd"))
    checked = written(checked, "checked")
    groups = checked.groupBy("digest", "odd").agg(F.max(F.struct("id", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    if checkpoint is not None:
        # Rows of earlier tables belong to the group of the state's keeper.
        here = groups.groupBy("digest").agg(F.sum("n").alias("here"))
        before = hits.join(here, "digest").select("digest", F.col("keeper").alias("first"), (F.col("n") - F.col("here")).alias("before"))
        main = F.col("odd").isNull()
        groups = groups.join(before, "digest").select(
            "digest", "odd", F.when(main, F.col("first")).otherwise(F.col("keeper")).alias("keeper"), F.when(main, F.col("n") + F.col("before")).otherwise(F.col("n")).alias("n")
        )
    groups = written(groups, "groups")
    main = join_hot(checked.where("odd is null").drop("odd"), groups.where("odd is null").drop("odd"), "digest", "n")
    others = checked.where("odd is not null").join(groups.where("odd is not null"), ["digest", "odd"]).drop("odd")
    of_hits = main.unionByName(others).select(
        "id", "file", "row", "digest", F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))).alias("kept"),
    )
    single = state.where("n = 1").select(
        F.col("keeper.id").alias("id"), F.col("keeper.file").alias("file"), F.col("keeper.row").alias("row"), "digest",
        F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"),
    )
    if checkpoint is not None:
        single = single.join(index.select("file", "row"), ["file", "row"], "left_semi")
    return single.unionByName(of_hits)


def exact_dedup(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    Rows are taken out by locator, so repeated and null identifiers are safe.
    """
    docs = located(docs)
    gone = exact_groups(spark, docs, id_col=id_col, text_col=text_col).where(~F.col("kept"))
    return only(docs, gone, "left_anti")
