"""Streaming jobs drained over the event table; their results equal batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..model import ANSWERS_SQL, CORRECT_FROM, table
from ..operators.iterate import work_folder
from ..streaming import jobs, memory
from .learner import SEQ, STEP
from .registry import register


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parque[t]")


def _folder(spark):
    return f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"


@register("stream_tracing", f"WITH RECURSIVE {SEQ}, f(learner, kp, i, n, p, c) AS (SELECT learner, kp, 0::BIGINT, n, 0.5::DOUBLE, 0::BIGINT FROM seq WHERE i = 1 UNION ALL SELECT f.learner, f.kp, s.i, f.n, ({STEP}) + (1 - ({STEP})) * 0.1, c + CASE WHEN s.correct THEN 1 ELSE 0 END FROM f JOIN seq s ON s.learner = f.learner AND s.kp = f.kp AND s.i = f.i + 1) SELECT learner, kp, n AS attempts, c AS correct_count, round(p, 8) AS mastery FROM f WHERE i = n")
def stream_tracing(spark, sf):
    """Knowledge tracing as keyed state; the last update of each key equals the batch fold."""
    e = _events(spark, sf).where("value is not null and user_id is not null")
    a = e.select(F.col("user_id").alias("learner"), F.col("event_type").alias("kp"), "ts", "event_id", (F.col("value") >= CORRECT_FROM).alias("correct"))
    path = _folder(spark)
    jobs.run_all(jobs.trace(a), path, "update")
    got = spark.read.schema(f"{jobs.TRACED}, batch int").parquet(f"{path}/out")
    last = got.groupBy("learner", "kp").agg(F.max_by(F.struct("attempts", "correct_count", "mastery"), "batch").alias("s"))
    return last.select("learner", "kp", "s.attempts", "s.correct_count", F.round("s.mastery", 8).alias("mastery"))


@register("stream_slo_windows", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS good FROM events GROUP BY 1, CAST(ts AS DATE) HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_slo_windows(spark, sf):
    """Tumbling windows, each emitted once the watermark has passed it."""
    path = _folder(spark)
    jobs.run_all(jobs.windows(_events(spark, sf), F.col("event_type") != "error"), path)
    return spark.read.schema("start timestamp, n long, good long").parquet(f"{path}/out").select(F.to_date("start").cast("string").alias("day"), "n", "good")


@register("stream_sessions", """WITH g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
    SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(spark, sf):
    path = _folder(spark)
    jobs.run_all(jobs.sessions(_events(spark, sf), "user_id"), path)
    return spark.read.schema("user_id long, start timestamp, end timestamp, n long").parquet(f"{path}/out").select("user_id", F.unix_timestamp("start").alias("start"), "n")


@register("stream_fanout", "SELECT topic, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_type = 'error' THEN 'alerts' END, CASE WHEN value > 100 THEN 'large' END, 'all'], lambda x: x IS NOT NULL)) AS topic FROM events) GROUP BY 1")
def stream_fanout(spark, sf):
    path = _folder(spark)
    routes = {"alerts": F.col("event_type") == "error", "large": F.col("value") > 100, "all": F.lit(True)}
    jobs.run_all(jobs.topics(_events(spark, sf), routes).select("event_id", "topic"), path)
    return spark.read.schema("event_id long, topic string").parquet(f"{path}/out").groupBy("topic").agg(F.count("*").alias("n"))


@register("stream_bandit", "SELECT event_type AS arm, count(*) AS pulls, round(avg(r), 6) AS mean, round(1 + sum(r), 4) AS alpha, round(1 + sum(1 - r), 4) AS beta FROM (SELECT event_type, least(1.0, value / 100.0) AS r FROM events) GROUP BY 1")
def stream_bandit(spark, sf):
    path = _folder(spark)
    f = _events(spark, sf).select(F.col("event_type").alias("arm"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("reward"))
    jobs.run_all(jobs.arms(f), path, "update")
    got = spark.read.schema("arm string, pulls long, mean double, alpha double, beta double, batch int").parquet(f"{path}/out")
    last = got.groupBy("arm").agg(F.max_by(F.struct("pulls", "mean", "alpha", "beta"), "batch").alias("s"))
    return last.select("arm", "s.pulls", F.round("s.mean", 6).alias("mean"), F.round("s.alpha", 4).alias("alpha"), F.round("s.beta", 4).alias("beta"))


@register("cdc_apply", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def cdc_apply(spark, sf):
    """The state after a change log in which errors delete."""
    from ..sources.mapping import latest_changes

    log = table(spark, sf, "events").select("user_id", F.col("event_id"), "value", F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"))
    return latest_changes(log, "user_id", ["event_id"])


@register("snapshot_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snapshot_round_trip(spark, sf):
    """A snapshot written, verified and loaded again."""
    from ..sources import snapshots

    path = _folder(spark)
    snapshots.save_snapshot({"nation": table(spark, sf, "nation"), "region": table(spark, sf, "region")}, path)
    return snapshots.load_snapshot(spark, path, {"nation": "n_nationkey int, n_name string, n_regionkey int"})["nation"]


@register("field_mapping", f"WITH {ANSWERS_SQL} SELECT c_custkey AS key, lower(c_name) AS name, c_acctbal AS _raw_c_acctbal, c_nationkey AS _raw_c_nationkey, c_mktsegment AS segment, 'crm' AS origin FROM customer")
def field_mapping(spark, sf):
    from ..sources import mapping

    return mapping.map_fields(table(spark, sf, "customer"), {"key": {"source": "c_custkey", "required": True}, "name": {"source": "c_name", "transform": "lower"}, "segment": {"source": "c_mktsegment", "default": "none"}, "origin": {"default": "crm"}})


@register("stream_memory")
def stream_memory(spark, sf):
    """Answers as memory events; an answer disturbs what is remembered of the other kinds of events before it."""
    path = _folder(spark)
    kinds = ["click", "error", "purchase", "signup", "view"]
    similar = {k: [(other, 0.8 if abs(i - j) == 1 else 0.3) for j, other in enumerate(kinds) if other != k] for i, k in enumerate(kinds)}
    e = _events(spark, sf).where("value is not null and user_id is not null")
    a = e.select(F.col("user_id").alias("learner"), F.col("event_type").alias("kp"), "ts", "event_id", (F.col("value") >= 35).alias("correct"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("difficulty"))
    with memory.keyed_state(spark):
        jobs.run_all(memory.remember(a, similar), path)
    got = spark.read.schema(memory.OUT).parquet(f"{path}/out").where("event_id is not null")
    return got.select("learner", "kp", "event_id", "grade", F.round("stability", 6).alias("stability"), F.round("difficulty", 6).alias("difficulty"), F.round("retrievability", 6).alias("retrievability"), "reps", "lapses", "moved", "long_term")
