"""Result files of repeated runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def number(c: str):
    """Numbers from text; empty text and status words like OOM or TIMEOUT become null."""
    return F.expr(f"try_cast(nullif(trim(`{c}`), '') as double)")


def status(c: str):
    return F.when(F.upper(F.col(c)).rlike("OOM"), "oom").when(F.upper(F.col(c)).rlike("TIMEOUT"), "timeout").otherwise("ok")


def compiled(spark: SparkSession, pattern: str) -> DataFrame:
    """All JSON results of a glob, with dataset, method and seed from the file names <dataset>_<method>_<seed>.json."""
    df = spark.read.option("multiLine", True).json(pattern)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    part = lambda k: F.regexp_extract(name, r"^(.+)_([^_]+)_(\d+)\.json$", k)
    return df.select("*", part(1).alias("dataset"), part(2).alias("method"), part(3).try_cast("int").alias("seed"))


def seeded_csv(spark: SparkSession, folder: str, numeric: list[str]) -> DataFrame:
    """master_results.csv files below results_<seed>/<dataset>/; the seed comes from the folder, text numbers become null where they are none."""
    df = spark.read.csv(folder, header=True, recursiveFileLookup=True, pathGlobFilter="master_results.csv")
    seed = F.regexp_extract(F.col("_metadata.file_path"), r"results_(\d+)", 1).try_cast("int")
    names = [c for c in df.columns if c not in numeric]
    return df.select(*names, *(number(c).alias(c) for c in numeric), *(status(c).alias(f"{c}_status") for c in numeric), seed.alias("run_seed"))


def cached(df: DataFrame, folder: str, key: list[str]) -> DataFrame:
    """``df`` from the folder of its key, written there first if it is not yet: parquet below md5 of the key parts."""
    import hashlib

    path = f"{folder}/{hashlib.md5('|'.join(key).encode()).hexdigest()}"
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.parquet(path)
    return spark.read.parquet(path)


def write_bundle(sketches: dict[str, DataFrame], known: DataFrame, folder: str) -> None:
    """Sketches of several meta-paths over one hash universe."""
    for name, s in sketches.items():
        s.write.parquet(f"{folder}/sketch/metapath={name}")
    known.write.parquet(f"{folder}/universe")


def read_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/sketch"), spark.read.parquet(f"{folder}/universe")


def write_partition(split: DataFrame, record: dict, folder: str) -> None:
    """``split`` (node, part) as JSON lines by part, beside the record of how it was made; no line grows with the input."""
    spark = split.sparkSession
    split.select("node", "part").write.partitionBy("part").json(f"{folder}/nodes")
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(f"{folder}/record")


def read_partition(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    record = json.loads(spark.read.text(f"{folder}/record").first()[0])
    return spark.read.schema("node long, part string").json(f"{folder}/nodes"), record
