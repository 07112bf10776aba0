"""Expressions and scratch tables shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import scratch, written
from ..plans.skew import join_hot

__all__ = ["GAP", "bind", "join_hot", "located", "locator", "lower_ascii", "only", "scratch", "table", "words_of", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda variable is a bound value: Catalyst never inlines the producing
    expression into an inner lambda, where it would run once per element.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Runs of characters other than white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def located(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is a plain file read, else a written copy.

    Only a plain read has a locator (file, row) for each row.
    """
    plan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    return docs if plan == "LogicalRelation" and docs.inputFiles() else written(docs, "staged")


def locator() -> tuple[Column, Column]:
    """The file and the row in it, of a plain file read."""
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")


def only(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` (a plain read) that are ("left_semi") or are not ("left_anti") among the locators ``rows``."""
    doc = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__doc"), *locator())
    return doc.join(rows.select("file", "row"), ["file", "row"], how).select("__doc.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
