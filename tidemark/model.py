"""The knowledge and learning model over the base tables: entities, triples, chunks, answers, metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A response counts as correct from this value on.
CORRECT_FROM = 35.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, entity_type, name, domain, tags, confidence."""

    def part(name, prefix, key, kind, title, domain, tags, confidence):
        t = table(spark, sf_dir, name)
        return t.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(title).alias("name"), domain.alias("domain"), tags.alias("tags"), confidence.cast("double").alias("confidence"))

    scaled = lambda c: F.least(F.lit(1.0), F.abs(F.col(c)) / 10000.0)
    geo, none = F.lit("GEO"), F.array().cast("array<string>")
    return (
        part("customer", "c:", "c_custkey", "customer", "c_name", F.col("c_mktsegment"), F.array("c_mktsegment"), scaled("c_acctbal"))
        .unionByName(part("supplier", "s:", "s_suppkey", "supplier", "s_name", F.lit("SUPPLY"), none, scaled("s_acctbal")))
        .unionByName(part("part", "p:", "p_partkey", "part", "p_name", F.col("p_brand"), F.array("p_brand", "p_type"), F.col("p_size") / 50.0))
        .unionByName(part("nation", "n:", "n_nationkey", "nation", "n_name", geo, none, F.lit(1.0)))
        .unionByName(part("region", "r:", "r_regionkey", "region", "r_name", geo, none, F.lit(1.0)))
    )


ENTITIES_SQL = """
entities AS (
  SELECT 'c:' || c_custkey AS entity_id, 'customer' AS entity_type, c_name AS name, c_mktsegment AS domain, [c_mktsegment] AS tags, least(1.0::DOUBLE, abs(c_acctbal) / 10000.0::DOUBLE) AS confidence FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name, 'SUPPLY', []::VARCHAR[], least(1.0::DOUBLE, abs(s_acctbal) / 10000.0::DOUBLE) FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, 'part', p_name, p_brand, [p_brand, p_type], p_size / 50.0::DOUBLE FROM part
  UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name, 'GEO', []::VARCHAR[], 1.0::DOUBLE FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, 'region', r_name, 'GEO', []::VARCHAR[], 1.0::DOUBLE FROM region)
"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, predicate, object, confidence, rank, valid_from, valid_until (epoch days, 0 unbounded), without repeats."""
    edge = lambda s, p, o, conf: [F.concat(F.lit(s[0]), F.col(s[1]).cast("string")).alias("subject"), F.lit(p).alias("predicate"), F.concat(F.lit(o[0]), F.col(o[1]).cast("string")).alias("object"), conf.alias("confidence")]
    always = lambda: [F.lit("normal").alias("rank"), F.lit(0).alias("valid_from"), F.lit(0).alias("valid_until")]
    one = F.lit(1.0)
    geo = [
        table(spark, sf_dir, "customer").select(*edge(("c:", "c_custkey"), "located_in", ("n:", "c_nationkey"), one), *always()),
        table(spark, sf_dir, "supplier").select(*edge(("s:", "s_suppkey"), "located_in", ("n:", "s_nationkey"), one), *always()),
        table(spark, sf_dir, "nation").select(*edge(("n:", "n_nationkey"), "part_of", ("r:", "n_regionkey"), one), *always()),
    ]
    supply = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_discount").alias("d"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"), F.max("l_quantity").alias("q"))
    day = lambda c: F.unix_date(F.to_date(c))
    out = supply.select(
        *edge(("p:", "l_partkey"), "supplied_by", ("s:", "l_suppkey"), F.lit(1.0) - F.col("d")),
        F.when(F.col("q") >= 45, "preferred").when(F.col("q") <= 3, "deprecated").otherwise("normal").alias("rank"),
        day("lo").alias("valid_from"),
        (day("hi") + 1).alias("valid_until"),
    )
    for g in geo:
        out = out.unionByName(g)
    return out


TRIPLES_SQL = """
triples AS (
  SELECT 'p:' || l_partkey AS subject, 'supplied_by' AS predicate, 's:' || l_suppkey AS object, 1.0::DOUBLE - min(l_discount) AS confidence,
    CASE WHEN max(l_quantity) >= 45 THEN 'preferred' WHEN max(l_quantity) <= 3 THEN 'deprecated' ELSE 'normal' END AS rank,
    date_diff('day', DATE '1970-01-01', CAST(min(l_shipdate) AS DATE)) AS valid_from, date_diff('day', DATE '1970-01-01', CAST(max(l_shipdate) AS DATE)) + 1 AS valid_until
  FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'c:' || c_custkey, 'located_in', 'n:' || c_nationkey, 1.0, 'normal', 0, 0 FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'located_in', 'n:' || s_nationkey, 1.0, 'normal', 0, 0 FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'part_of', 'r:' || n_regionkey, 1.0, 'normal', 0, 0 FROM nation)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kp, who, step, day: every order is a knowledge point, and a customer's orders are steps 1, 2, ... by date."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("kp"), F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("day"))
    return o.withColumn("step", F.row_number().over(Window.partitionBy("who").orderBy("day", "key"))).drop("key")


def prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, weight, kind: each point needs the one before it and is related to the second one before it.

    An edge weighs the less the more days lie between its ends.
    """
    w = Window.partitionBy("who").orderBy("step")
    ahead = F.array(*(F.struct(F.lead("kp", n).over(w).alias("kp"), F.lead("day", n).over(w).alias("day"), F.lit(kind).alias("kind")) for n, kind in ((1, "prerequisite"), (2, "related"))))
    e = points(spark, sf_dir).select("kp", "day", ahead.alias("ahead")).select("kp", "day", F.explode("ahead").alias("next")).where("next.kp is not null")
    return e.select(F.col("kp").alias("source"), F.col("next.kp").alias("target"), (F.lit(1.0) / (1 + F.datediff("next.day", "day") / 100.0)).alias("weight"), F.col("next.kind").alias("kind"))


PREREQUISITES_SQL = """
kp AS (SELECT 'k' || o_orderkey AS kp, o_custkey AS who, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS step FROM orders),
pre AS (
  SELECT a.kp AS source, b.kp AS target, 1.0::DOUBLE / (1 + date_diff('day', a.day, b.day) / 100.0::DOUBLE) AS weight, CASE b.step - a.step WHEN 1 THEN 'prerequisite' ELSE 'related' END AS kind
  FROM kp a JOIN kp b ON a.who = b.who AND b.step - a.step IN (1, 2)),
firsts AS (SELECT kp AS node FROM kp WHERE step = 1),
focus AS (SELECT min(CASE WHEN step = 1 THEN kp END) AS a, min(CASE WHEN step = 8 THEN kp END) AS b FROM kp WHERE who = (SELECT min(who) FROM kp WHERE step = 8))
"""


def focus(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """First and eighth point of the first customer that has so many: a stated pair for queries of one path."""
    p = points(spark, sf_dir).where("step in (1, 8)").groupBy("who").agg(F.min(F.when(F.col("step") == 1, F.col("kp"))).alias("a"), F.min(F.when(F.col("step") == 8, F.col("kp"))).alias("b"))
    first = p.where("b is not null").orderBy("who").first()
    return (first.a, first.b) if first else ("", "")


def mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kp, mastery: share of an order's lines whose quantity is at least CORRECT_FROM (0.5 without any)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("kp")).agg(F.avg((F.col("l_quantity") >= CORRECT_FROM).cast("double")).alias("m"))
    return points(spark, sf_dir).select("kp").join(lines, "kp", "left").select("kp", F.coalesce("m", F.lit(0.5)).alias("mastery"))


MASTERY_SQL = """
mast AS (SELECT kp.kp, coalesce(avg(CASE WHEN l_quantity >= 35 THEN 1.0 WHEN l_quantity IS NOT NULL THEN 0.0 END), 0.5)::DOUBLE AS mastery FROM kp LEFT JOIN lineitem ON kp.kp = 'k' || l_orderkey GROUP BY 1)
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """learner, kp, ts, event_id, correct, value: responses in the order of (ts, event_id)."""
    e = table(spark, sf_dir, "events").where("value is not null and user_id is not null")
    return e.select(F.col("user_id").alias("learner"), F.col("event_type").alias("kp"), "ts", "event_id", (F.col("value") >= CORRECT_FROM).alias("correct"), "value")


ANSWERS_SQL = "answers AS (SELECT user_id AS learner, event_type AS kp, ts, event_id, value >= 35 AS correct, value FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)"
