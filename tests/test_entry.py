"""The entry points: with and without the optional subpackage, and every query against its SQL."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 150 and set(sql) <= set(queries)


def test_without_the_optional_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "hinflow"), tmp_path / "hinflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    wrong = []
    from hinflow.plans import catalog

    for name, sql in catalog.SQL.items():
        df = catalog.QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
        rel = con.sql(f"select {', '.join(columns)} from ({sql})")
        if sorted(rel.columns) != columns or got != sorted(map(repr, rel.fetchall())):
            wrong.append(name)
    assert not wrong


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
