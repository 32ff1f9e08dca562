"""Every registered query with SQL equals DuckDB on the same tables; the others run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([plain(r[i]) for i in order] for r in data)


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    sql = registry.oracles().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_folder(tmp_path):
    """What the guard in the entry module is for."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(entry.__file__).parent
    shutil.copytree(repo / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
n = [e.queries()[q](s, "%s").count() for q in ("store_stats", "ingest_counts")]
print(len(e.queries()), "pipeline" in e.queries(), any(q.startswith("op1_") for q in e.queries()), min(n) > 0)
""" % SF
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.stdout.split() == [str(len(registry.queries())), "False", "False", "True"], out.stderr
