"""Schema plans, migrations and their undoing; verification of stored hash chains; differences of maps."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evolution as E
from tidemark.operators import governance as V


def test_plan_and_round_trip(spark):
    old = {
        "Material": spark.createDataFrame([(1, "ruby", "1.5"), (2, None, "x")], "id long, name string, mass string"),
        "Process": spark.createDataFrame([(1, "melt", True)], "id long, step string, hot boolean"),
        "Gone": spark.createDataFrame([(7,)], "n int"),
    }
    schema = E.schema_of(old)
    new = {"Material": {"id": "bigint", "mass": "double", "colour": "string"}, "Procedure": schema["Process"], "Device": {"serial": "string"}}
    steps = E.plan(schema, new)
    assert [(s.action, s.name, s.prop) for s in steps] == [("rename", "Process", None), ("retype", "Material", "mass"), ("add", "Material", "colour"), ("remove", "Material", "name"), ("create", "Device", None), ("drop", "Gone", None)]
    assert E.level(steps) == "INCOMPATIBLE" and E.level([]) == "FULL" and E.level(steps[:1]) == "PARTIAL" and E.level(steps[:2]) == "BREAKING"
    done = E.migrate(old, steps)
    got = E.schema_of(done)
    assert {n: {p: t for p, t in got[n].items()} for n in new} == new
    assert [r.mass for r in done["Material"].orderBy("id").collect()] == [1.5, None]
    back = E.rollback(done, steps, schema)
    assert E.schema_of(back) == schema
    for name in old:
        assert E.checksum(back[name]).first() == E.checksum(old[name]).first()
    assert E.plan(schema, schema) == []


def test_renames_need_an_overlap():
    assert E.renamed({"a": {"x": "int", "y": "int", "z": "int"}}, {"b": {"x": "int"}, "c": {"x": "int", "y": "int", "w": "int"}}) == {}
    assert E.renamed({"a": {"x": "int", "y": "int"}, "d": {"x": "int", "y": "int"}}, {"b": {"x": "int", "y": "int"}}) == {"a": "b"}


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert sorted(tuple(r) for r in E.profile({"t": df}).collect()) == [("t", "a", "int", 2), ("t", "b", "string", 1)]


def log(spark):
    rows = [(k, i, f"p{i}") for k in ("u", "v", "w") for i in range(1, 9)]
    df = spark.createDataFrame([(k, i, f"p{i}") for k, i, _ in rows], "who string, at int, text string")
    return V.chained(df, "who", ["at"], F.col("text")).cache()


def test_links_are_those_of_the_fold(spark):
    df = log(spark)
    heads = {r.who: r.h for r in df.groupBy("who").agg(F.max_by("hash", "seq").alias("h")).collect()}
    head = hashlib.sha256(b"genesis").hexdigest()
    for i in range(1, 9):
        head = hashlib.sha256(f"{head}|p{i}".encode()).hexdigest()
    assert set(heads.values()) == {head}
    assert V.verify_chains(df, "who").count() == 0


@pytest.mark.parametrize(
    "change, want",
    [
        (lambda d: d.withColumn("payload", F.when(F.expr("who = 'u' and seq = 3"), "evil").otherwise(F.col("payload"))), ("u", 3, "payload")),
        (lambda d: d.where("not (who = 'v' and seq in (4, 5))"), ("v", 6, "gap")),
        (lambda d: d.where("not (who = 'w' and seq > 6)"), ("w", 7, "end")),
        (lambda d: d.where("not (who = 'w')"), ("w", 1, "end")),
        (lambda d: d.withColumn("seq", F.when(F.expr("who = 'u' and seq in (2, 3)"), 5 - F.col("seq")).otherwise(F.col("seq"))), ("u", 2, "link")),
        (lambda d: d.unionAll(d.where("who = 'v' and seq = 5")), ("v", 5, "repeat")),
        (lambda d: d.withColumn("hash", F.when(F.expr("who = 'u' and seq = 8"), F.sha2("prev", 256)).otherwise(F.col("hash"))), ("u", 8, "payload")),
        (lambda d: d.withColumn("prev", F.when(F.expr("who = 'u' and seq = 1"), F.lit(None)).otherwise(F.col("prev"))), ("u", 1, "link")),
    ],
)
def test_breaks_are_found(spark, change, want):
    df = log(spark)
    heads = df.groupBy("who").agg(F.max("seq").alias("n"), F.max_by("hash", "seq").alias("head"))
    assert [tuple(r) for r in V.verify_chains(change(df), "who", heads).collect()] == [want]


def test_a_hot_chain_is_spread(spark):
    """No window over a key: rows of one chain meet by (key, seq)."""
    plan = V.verify_chains(log(spark), "who")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join LeftOuter" in plan


def test_map_diff(spark):
    old = spark.createDataFrame([(1, {"a": 1, "b": 2}), (2, {"x": 1}), (3, None)], "id int, m map<string,int>")
    new = spark.createDataFrame([(1, {"a": 1, "b": 3, "c": None}), (3, {"n": 1})], "id int, m map<string,int>")
    got = sorted(tuple(r) for r in V.map_diff(old, new, "id", "m").select("id", "field", "change").collect())
    assert got == [(1, "b", "modified"), (1, "c", "added"), (2, "x", "removed"), (3, "n", "added")]
