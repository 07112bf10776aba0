"""Sketches kept up to date by a stream of edges.

Bottom-k is mergeable: a batch's sketch merged into the stored one equals the
sketch of all edges so far. The merge is idempotent, so a batch that runs twice
after a failure changes nothing, and no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import DIGITS, keyed
from ..operators.sketch import bottom_k
from ..plans.metapath import MetaPath


def edge_sketch(edges: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(node, h): bottom-k of the hashed targets of each source."""
    return bottom_k(edges.select(F.col("src").alias("node"), keyed(seed, F.col("dst"), digits=DIGITS).alias("h")), k)


class SketchTable:
    """A stored sketch in versioned folders: version n + 1 is written from version n and a batch.

    A new object goes on from the latest complete version in the folder, so
    that a restarted driver keeps what the stream's checkpoint counts as done.
    """

    def __init__(self, spark: SparkSession, folder: str, k: int, seed: int = 42):
        self.spark, self.folder, self.k, self.seed = spark, folder, k, seed
        self.version = self._latest()

    def _latest(self) -> int:
        """The number of the latest version whose write ended; -1 if there is none."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return max((int(n[1:]) for n in done), default=-1)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.version}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.version:
            return
        new = edge_sketch(batch, self.k, self.seed)
        if self.version >= 0:
            new = bottom_k(self.read().unionByName(new), self.k)
        new.write.mode("overwrite").parquet(f"{self.folder}/v{batch_id}")
        self.version = batch_id

    def follow(self, edges: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merge all that a stream of (src, dst) has by now."""
        return edges.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LayeredSketch:
    """Sketches over all steps of a meta-path, kept up to date by a stream of edges (relation, src, dst).

    A batch goes through the steps in order. What arrives at a step's nodes is
    the sketches behind the batch's own edges, and, over earlier edges, only
    the slots that this batch has put into the sketches of the step before. A
    step without new slots ends the batch. Bottom-k is idempotent and a slot
    that falls out is outrun by k smaller ones wherever it went, so the result
    equals that of all edges at once, however they are split.

    ``folder`` is a log: each batch appends its edges and the new slots of
    every step, and a mark when both are whole. Every ``compact`` batches the
    log is merged into a base, and what the base replaces is removed. A batch
    without its mark is written again, so a restarted driver goes on where the
    stream's checkpoint says. ``touched`` tells (batch, step, rows that
    arrived, slots that were new) of the batches of this object.
    """

    def __init__(self, spark: SparkSession, folder: str, path: MetaPath, k: int, seed: int = 42, compact: int = 8):
        self.spark, self.folder, self.path, self.k, self.seed, self.compact = spark, folder, path, k, seed, compact
        self.touched: list[tuple[int, int, int, int]] = []

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marked(self, kind: str) -> list[int]:
        """Numbers of the whole batches or bases, rising."""
        where, fs = self._fs(f"{self.folder}/{kind}")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._fs(f"{self.folder}/{kind}/{n}/_WHOLE")[0]))

    def _mark(self, kind: str, number: int) -> None:
        where, fs = self._fs(f"{self.folder}/{kind}/{number}/_WHOLE")
        fs.create(where).close()

    def _log(self, part: str, upto: int | None = None) -> DataFrame | None:
        """All rows of one part of the log (``edges-1``, ``slots-1``, ...), up to a batch; None if there are none."""
        bases = self._marked("base")[-1:]
        after = bases[0] if bases else -1
        paths = [f"{self.folder}/base/{b}/{part}" for b in bases] + [f"{self.folder}/batch/{b}/{part}" for b in self._marked("batch") if b > after and (upto is None or b <= upto)]
        return self.spark.read.parquet(*paths) if paths else None

    def last(self) -> int:
        return max([*self._marked("base")[-1:], *self._marked("batch")[-1:]], default=-1)

    def sketch(self, step: int | None = None) -> DataFrame:
        """(node, h) after ``step`` steps; after all of them by default."""
        rows = self._log(f"slots-{step or len(self.path.steps)}")
        return bottom_k(rows, self.k) if rows is not None else self.spark.createDataFrame([], "node long, h long")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last():
            return
        out = f"{self.folder}/batch/{batch_id}"
        held: DataFrame | None = None  # sketches before the step, as they are now
        fresh: DataFrame | None = None  # their slots that this batch has put in
        for i, s in enumerate(self.path.steps, 1):
            own = batch.where(F.col("relation") == s.relation)
            own = own.select("src", "dst") if s.forward else own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            own.distinct().write.mode("overwrite").parquet(f"{out}/edges-{i}")
            new = self.spark.read.parquet(f"{out}/edges-{i}")
            if i == 1:
                moved = new.select(F.col("dst").alias("node"), keyed(self.seed, F.col("src"), digits=DIGITS).alias("h"))
            else:
                moved = new.join(held, new["src"] == held["node"]).select(F.col("dst").alias("node"), "h")
                old = self._log(f"edges-{i}")
                if old is not None:
                    moved = moved.union(old.join(fresh, old["src"] == fresh["node"]).select(F.col("dst").alias("node"), "h"))
            arrived = bottom_k(moved, self.k)
            before = self._log(f"slots-{i}")
            if before is not None:
                # Only nodes at which something arrives are merged and compared.
                before = bottom_k(before.join(arrived.select("node").distinct(), "node", "left_semi"), self.k)
                arrived = bottom_k(before.union(arrived), self.k).join(before, ["node", "h"], "left_anti")
            arrived.write.mode("overwrite").parquet(f"{out}/slots-{i}")
            fresh = self.spark.read.parquet(f"{out}/slots-{i}")
            self.touched.append((batch_id, i, moved.count(), fresh.count()))
            slots = self._log(f"slots-{i}")
            held = bottom_k(fresh if slots is None else slots.union(fresh), self.k)
        self._mark("batch", batch_id)
        if len(self._marked("batch")) >= self.compact:
            self.compacted()

    def compacted(self) -> None:
        """Merge the log into a new base and remove what it replaces."""
        upto = self.last()
        if upto in self._marked("base"):
            return
        for i in range(1, len(self.path.steps) + 1):
            self._log(f"edges-{i}").distinct().write.mode("overwrite").parquet(f"{self.folder}/base/{upto}/edges-{i}")
            self.sketch(i).write.mode("overwrite").parquet(f"{self.folder}/base/{upto}/slots-{i}")
        gone = [("base", b) for b in self._marked("base")] + [("batch", b) for b in self._marked("batch")]
        self._mark("base", upto)
        for kind, b in gone:
            where, fs = self._fs(f"{self.folder}/{kind}/{b}")
            fs.delete(where, True)

    def follow(self, edges: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merge all that a stream of (relation, src, dst) has by now."""
        return edges.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
