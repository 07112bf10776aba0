"""Rules: mined rule files, rule codes, and query-node and result files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.metapath import MetaPath, Step

#: Fixed codes of the rule format.
VARIABLE, FORWARD, BACKWARD, POP, INSTANCE = -1, -2, -3, -4, -5


def mined_rules(spark: SparkSession, path: str, min_conf: float = 0.0) -> DataFrame:
    """(rule, conf, head, body, instances): TSV lines whose third column is the confidence and fourth the rule.

    ``body`` lists (rel, a, b) atoms; ``instances`` the tokens like type_12.
    """
    lines = spark.read.csv(path, sep="\t", schema="n long, m long, conf double, rule string").where(F.col("conf") >= min_conf)
    body = F.substring_index("rule", "<=", -1)
    atom = r"(\w+)\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*\)"
    part = lambda k: F.regexp_extract_all(body, F.lit(atom), F.lit(k))
    atoms = F.arrays_zip(part(1).alias("rel"), part(2).alias("a"), part(3).alias("b"))
    tokens = F.filter(F.concat(part(2), part(3)), lambda x: x.rlike(r"_\d+$"))
    return lines.select("rule", "conf", F.trim(F.substring_index("rule", "<=", 1)).alias("head"), atoms.alias("body"), tokens.alias("instances"))


def body_path(rules: DataFrame) -> DataFrame:
    """(path, conf): bodies that chain as relation strings, best confidence per path. A step against its atom is marked rev_."""
    start = F.struct(F.lit("X").alias("at"), F.lit("").alias("path"), F.lit(True).alias("ok"))

    def follow(acc, atom):
        ahead, back = atom["a"] == acc["at"], atom["b"] == acc["at"]
        name = F.when(ahead, atom["rel"]).otherwise(F.concat(F.lit("rev_"), atom["rel"]))
        path = F.when(acc["path"] == "", name).otherwise(F.concat_ws(",", acc["path"], name))
        return F.struct(F.when(ahead, atom["b"]).otherwise(atom["a"]).alias("at"), path.alias("path"), (acc["ok"] & (ahead | back)).alias("ok"))

    r = rules.where(F.size("instances") == 0).select("conf", F.aggregate("body", start, follow).alias("w"))
    return r.where("w.ok").groupBy(F.col("w.path").alias("path")).agg(F.max("conf").alias("conf"))


def compile_rule(path: MetaPath, etypes: dict[str, int]) -> str:
    """The rule code of one meta-path: pushes with their directions, then a trigger."""
    out: list[int] = []
    for s in path.steps:
        out += [FORWARD if s.forward else BACKWARD, etypes[s.relation]]
    out += [INSTANCE, path.anchor] if path.anchor is not None else [VARIABLE]
    return " ".join(map(str, out + [POP] * len(path.steps)))


def decode_rules(codes: list[int], names: dict[int, str]) -> Iterator[MetaPath]:
    """Meta-paths of a rule line, one per trigger: VARIABLE for open ends, INSTANCE for an anchor; POP steps back."""
    stack: list[Step] = []
    forward, it = True, iter(codes)
    for code in it:
        if code == FORWARD or code == BACKWARD:
            forward = code == FORWARD
        elif code == POP:
            stack.pop()
        elif code == VARIABLE:
            yield MetaPath(tuple(stack))
        elif code == INSTANCE:
            yield MetaPath(tuple(stack), next(it))
        else:
            stack.append(Step(names[code], forward))


def rules_of(spark: SparkSession, path: str, names: dict[int, str]) -> DataFrame:
    """(rule, length, anchor) of a rule file, which is one short line; a second line is an error."""
    lines = spark.read.text(path).where("value <> ''").limit(2).collect()
    if len(lines) > 1:
        raise ValueError(f"{path} has more than one line")
    codes = [int(x) for row in lines for x in row[0].split()]
    rows = [(str(p), len(p.steps) - (p.anchor is not None), p.anchor) for p in decode_rules(codes, names)]
    return spark.createDataFrame(rows, "rule string, length int, anchor long")


def write_by_length(rules: DataFrame, path: str, longest: int = 3) -> None:
    """One folder per length; longer rules are left out."""
    rules.where(F.col("length") <= longest).write.partitionBy("length").parquet(path)


def query_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").try_cast("bigint").alias("node")).where("node is not null")


def hub_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, complement, node): hub sets of a result file. '(' lists the hubs, ')' lists the peers that are not hubs."""
    lines = spark.read.text(path).where("value like '(%' or value like ')%'")
    listed = F.split(F.trim(F.substring("value", 2, 1 << 30)), r"\s+")
    return lines.select(F.xxhash64("value").alias("line"), F.col("value").startswith(")").alias("complement"), F.explode(F.transform(listed, lambda x: x.try_cast("bigint"))).alias("node"))


def hub_set(lines: DataFrame, line: int, peers: DataFrame) -> DataFrame:
    """(node): the hubs of one line, whichever way it lists them."""
    own = lines.where(F.col("line") == line)
    named = own.where("not complement").select("node")
    others = own.where("complement").select("node")
    return named if not others.limit(1).count() else peers.select("node").join(others, "node", "left_anti")
