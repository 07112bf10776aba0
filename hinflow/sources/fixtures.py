"""Relations of a heterogeneous graph over the parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Relation name to SQL that Spark and other engines read alike.
RELATIONS = {
    "cust_order": "select o_custkey as c, o_orderkey as o from orders",
    "order_part": "select distinct l_orderkey as o, l_partkey as p from lineitem",
    "cust_part": "select distinct o_custkey as c, l_partkey as p from orders join lineitem on o_orderkey = l_orderkey",
    "part_supp": "select distinct l_partkey as p, l_suppkey as s from lineitem",
    "cust_nation": "select c_custkey as c, c_nationkey as n from customer",
    "supp_nation": "select s_suppkey as s, s_nationkey as n from supplier",
    "user_event": "select distinct user_id as u, event_type as t from events",
    "user_hour": "select distinct user_id as u, date_trunc('hour', ts) as t from events",
}


class Tables:
    """``t["orders"]`` reads a table, ``t.rel("cust_part")`` makes a relation (src, dst)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rel(self, name: str) -> DataFrame:
        read = {"orders", "lineitem", "customer", "supplier", "events"}
        df = self.spark.sql(_templated(name, read), **{t: self[t] for t in read if t in RELATIONS[name]})
        return df.toDF("src", "dst")


def _templated(name: str, tables: set[str]) -> str:
    words = RELATIONS[name].split(" ")
    return " ".join(f"{{{w}}}" if w in tables else w for w in words)


def with_relations(names: str, body: str) -> str:
    """``body`` after common table expressions for the relations that ``names`` lists, as (src, dst)."""
    ctes = ", ".join(f"{n}(src, dst) as ({RELATIONS[n]})" for n in names.split())
    return f"with {ctes} {body}" if not body.lstrip().startswith(",") else f"with {ctes}{body}"
