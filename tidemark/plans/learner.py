"""Learner models: knowledge tracing, review scheduling, ability, drift, levels, and their closed forms."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import ANSWERS_SQL, answers, table
from ..operators import learner as L
from .registry import register

SEQ = f"{ANSWERS_SQL}, seq AS (SELECT *, row_number() OVER (PARTITION BY learner, kp ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY learner, kp) AS n FROM answers)"
STEP = "CASE WHEN s.correct THEN p * 0.8 / (p * 0.8 + (1 - p) * 0.1) ELSE p * 0.2 / (p * 0.2 + (1 - p) * 0.9) END"


@register("knowledge_tracing", f"WITH RECURSIVE {SEQ}, f(learner, kp, i, n, p, c) AS (SELECT learner, kp, 0::BIGINT, n, 0.5::DOUBLE, 0::BIGINT FROM seq WHERE i = 1 UNION ALL SELECT f.learner, f.kp, s.i, f.n, ({STEP}) + (1 - ({STEP})) * 0.1, c + CASE WHEN s.correct THEN 1 ELSE 0 END FROM f JOIN seq s ON s.learner = f.learner AND s.kp = f.kp AND s.i = f.i + 1) SELECT learner, kp, n AS attempts, c AS correct_count, round(p, 8) AS mastery FROM f WHERE i = n")
def knowledge_tracing(spark, sf):
    return L.knowledge_tracing(answers(spark, sf)).withColumn("mastery", F.round("mastery", 8))


@register("bkt_likelihood", f"WITH RECURSIVE {SEQ}, f(learner, kp, i, n, p, l) AS (SELECT learner, kp, 0::BIGINT, n, 0.5::DOUBLE, 0.0::DOUBLE FROM seq WHERE i = 1 UNION ALL SELECT f.learner, f.kp, s.i, f.n, ({STEP}) + (1 - ({STEP})) * 0.1, l + ln(CASE WHEN s.correct THEN p * 0.8 + (1 - p) * 0.1 ELSE 1 - (p * 0.8 + (1 - p) * 0.1) END) FROM f JOIN seq s ON s.learner = f.learner AND s.kp = f.kp AND s.i = f.i + 1) SELECT learner, kp, round(l, 7) AS log_likelihood FROM f WHERE i = n")
def bkt_likelihood(spark, sf):
    return L.bkt_likelihood(answers(spark, sf)).withColumn("log_likelihood", F.round("log_likelihood", 7))


def _reviews(spark, sf):
    grade = F.when(~F.col("correct"), 1).when(F.col("value") < 60, 2).when(F.col("value") < 120, 3).otherwise(4)
    return answers(spark, sf).select("learner", "kp", (F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6).alias("day"), "event_id", grade.alias("grade"))


_W = L.FSRS
_D4 = max(1.0, min(10.0, _W[4] - math.exp(_W[5] * 3) + 1))
_SQL_D0 = f"greatest(1.0, least(10.0, {_W[4]} - exp({_W[5]} * (g - 1)) + 1))"
_SQL_D = f"greatest(1.0, least(10.0, {_W[7]} * {_D4!r} + (1 - {_W[7]}) * (d - {_W[6]} * (q.g - 3) * (10 - d) / 9)))"
_SQL_R = f"power(1 + {L.FSRS_FACTOR!r} * (q.day - f.day) / s, {L.FSRS_DECAY})"
_SQL_SHORT = f"({_W[17]} * (power(s, {_W[18]}) - s) * (1 - {_W[19]} * s) + s)"
_SQL_S = f"""least(36500.0, greatest(0.1, CASE WHEN q.day - f.day < 1 THEN (CASE WHEN q.g >= 3 THEN greatest({_SQL_SHORT}, s) ELSE {_SQL_SHORT} END)
  WHEN q.g = 1 THEN least({_W[11]} * power({_SQL_D}, {-_W[12]}) * (power(s + 1, {_W[13]}) - 1) * exp((1 - {_SQL_R}) * {_W[14]}), s)
  ELSE s * (exp({_W[8]}) * (11 - {_SQL_D}) * power(s, {-_W[9]}) * exp(-{_W[10]} * (1 - {_SQL_R}))) * (CASE WHEN q.g = 2 THEN {_W[15]} ELSE 1 END) * (CASE WHEN q.g = 4 THEN {_W[16]} ELSE 1 END) END))"""


@register("review_schedule", f"""WITH RECURSIVE {SEQ}, q AS (SELECT learner, kp, i, n, epoch_us(ts) / 86400e6 AS day, CASE WHEN NOT correct THEN 1 WHEN value < 60 THEN 2 WHEN value < 120 THEN 3 ELSE 4 END AS g FROM seq),
  f(learner, kp, i, n, s, d, day, lapses) AS (SELECT learner, kp, i, n, [{_W[0]}, {_W[1]}, {_W[2]}, {_W[3]}][g]::DOUBLE, {_SQL_D0}::DOUBLE, day, 0::BIGINT FROM q WHERE i = 1
  UNION ALL SELECT f.learner, f.kp, q.i, f.n, {_SQL_S}, {_SQL_D}, q.day, lapses + CASE WHEN q.g = 1 THEN 1 ELSE 0 END FROM f JOIN q ON q.learner = f.learner AND q.kp = f.kp AND q.i = f.i + 1)
  SELECT learner, kp, round(s, 5) AS stability, round(d, 6) AS difficulty, n AS reps, lapses FROM f WHERE i = n""")
def review_schedule(spark, sf):
    return L.review_schedule(_reviews(spark, sf)).select("learner", "kp", F.round("stability", 5).alias("stability"), F.round("difficulty", 6).alias("difficulty"), "reps", "lapses")


@register("ema_smoothing", f"WITH RECURSIVE {ANSWERS_SQL}, seq AS (SELECT learner, value, row_number() OVER (PARTITION BY learner ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY learner) AS n FROM answers), f(learner, i, n, e) AS (SELECT learner, i, n, value FROM seq WHERE i = 1 UNION ALL SELECT f.learner, s.i, f.n, e + 0.3 * (s.value - e) FROM f JOIN seq s ON s.learner = f.learner AND s.i = f.i + 1) SELECT learner, round(e, 6) AS ema FROM f WHERE i = n")
def ema_smoothing(spark, sf):
    return L.ema(answers(spark, sf), "learner", ["ts", "event_id"], "value", 0.3).withColumn("ema", F.round("ema", 6))


_DAILY = f"{ANSWERS_SQL}, d AS (SELECT learner, row_number() OVER (PARTITION BY learner ORDER BY CAST(ts AS DATE)) AS i, count(*) OVER (PARTITION BY learner) AS n, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END)::DOUBLE AS m FROM answers GROUP BY learner, CAST(ts AS DATE))"


@register("level_hysteresis", f"""WITH RECURSIVE {_DAILY}, f(learner, i, n, lv) AS (SELECT learner, i, n, CASE WHEN (m - 0.5) * 4 < -0.5 - 1e-9 OR m < 0.4 - 1e-9 THEN 'beginner' WHEN (m - 0.5) * 4 >= 0.5 - 1e-9 AND m >= 0.7 - 1e-9 THEN 'advanced' ELSE 'intermediate' END FROM d WHERE i = 1
  UNION ALL SELECT f.learner, d.i, f.n, CASE WHEN lv = 'beginner' THEN (CASE WHEN (m - 0.5) * 4 >= -0.25 AND m >= 0.5 THEN 'intermediate' ELSE 'beginner' END) WHEN lv = 'advanced' THEN (CASE WHEN (m - 0.5) * 4 < 0.25 OR m < 0.6 THEN 'intermediate' ELSE 'advanced' END)
  WHEN (m - 0.5) * 4 >= 0.75 AND m >= 0.8 THEN 'advanced' WHEN (m - 0.5) * 4 < -0.75 OR m < 0.3 THEN 'beginner' ELSE 'intermediate' END FROM f JOIN d ON d.learner = f.learner AND d.i = f.i + 1) SELECT learner, lv AS level FROM f WHERE i = n""")
def level_hysteresis(spark, sf):
    """Levels day by day from the day's accuracy; the last one of each learner."""
    d = answers(spark, sf).groupBy("learner", F.to_date("ts").alias("day")).agg(F.avg(F.col("correct").cast("double")).alias("m"))
    h = L.ordered(d, ["learner"], ["day"], ["m"])
    theta = lambda x: (x["m"] - 0.5) * 4
    first = F.col("history")[0]
    level = F.aggregate(F.slice("history", 2, F.size("history")), L.raw_level(theta(first), first["m"]), lambda a, x: L.next_level(a, theta(x), x["m"]))
    return h.select("learner", level.alias("level"))


@register("concept_drift", f"""WITH {ANSWERS_SQL}, s AS (SELECT learner, row_number() OVER w AS i, count(*) OVER (PARTITION BY learner) AS n, sum(CASE WHEN correct THEN 1.0 ELSE 0.0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS a, sum(CASE WHEN correct THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY learner) AS t FROM answers WINDOW w AS (PARTITION BY learner ORDER BY ts, event_id)),
  g AS (SELECT learner, i, n, abs(a / i - (t - a) / (n - i))::DOUBLE AS gap FROM s WHERE i >= 5 AND n - i >= 5), b AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY gap DESC, i) AS rn FROM g)
  SELECT learner, i AS split, round(gap, 8) AS gap, gap > sqrt(ln(4 / 0.05) / (2 * least(i, n - i))) AS drift FROM b WHERE rn = 1""")
def concept_drift(spark, sf):
    a = answers(spark, sf).withColumn("c", F.col("correct").cast("double"))
    return L.drift(a, "learner", ["ts", "event_id"], "c").withColumn("gap", F.round("gap", 8))


@register("irt_ability")
def irt_ability(spark, sf):
    """Ability of each learner by online updates; items are event types with fixed parameters."""
    b = F.pmod(F.xxhash64("kp"), F.lit(5)) / 2.0 - 1.0
    items = answers(spark, sf).select("learner", "ts", "event_id", "correct", F.lit(1.2).alias("a"), b.cast("double").alias("b"), F.lit(0.1).alias("c"))
    return L.ability(items)


@register("irt_items", "SELECT p_partkey, round(0.2 + 0.8 / (1 + exp(-1.1 * (0.5 - (p_size - 25) / 10.0))), 8) AS p3, round(1 / (1 + exp(-(0.5 - (p_size - 25) / 10.0))), 8) AS p1, round(1.21 * power((0.8 / (1 + exp(-1.1 * (0.5 - (p_size - 25) / 10.0)))) / 0.8, 2) * (1 - (0.2 + 0.8 / (1 + exp(-1.1 * (0.5 - (p_size - 25) / 10.0))))) / (0.2 + 0.8 / (1 + exp(-1.1 * (0.5 - (p_size - 25) / 10.0)))), 8) AS info FROM part")
def irt_items(spark, sf):
    """Chance and information of items at ability 0.5."""
    b, th = (F.col("p_size") - 25) / 10.0, F.lit(0.5)
    return table(spark, sf, "part").select("p_partkey", F.round(L.p_correct(th, F.lit(1.1), b, 0.2), 8).alias("p3"), F.round(L.p_correct(th, F.lit(1.0), b, 0.0), 8).alias("p1"), F.round(L.information(th, F.lit(1.1), b, 0.2), 8).alias("info"))


@register("next_item", "SELECT u AS learner, p_partkey FROM (SELECT u, p_partkey, row_number() OVER (PARTITION BY u ORDER BY round(abs((u - 5) / 4.0 - (p_size - 25) / 10.0), 9), p_partkey) AS rn FROM part, (SELECT range AS u FROM range(10))) WHERE rn = 1")
def next_item(spark, sf):
    """The item nearest to each of ten abilities; first of equals."""
    p = table(spark, sf, "part").groupBy("p_size").agg(F.min("p_partkey").alias("p_partkey"))  # equal sizes are equally near
    p = p.select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("u"))
    b = F.round(F.abs((F.col("u") - 5) / 4.0 - (F.col("p_size") - 25) / 10.0), 9)
    return p.groupBy(F.col("u").cast("long").alias("learner")).agg(F.min(F.struct(b.alias("b"), "p_partkey")).alias("m")).select("learner", F.col("m.p_partkey").alias("p_partkey"))


@register("memory_decay", "SELECT event_id, round(greatest(0.3, exp(-h / (24.0 + 24 * (event_id % 5)))), 8) AS floor_decay, round(exp(-0.007 * greatest(0, h - 168) / (1 + event_id % 3)), 8) AS late_decay, round(power(1 + 0.2346 * h / 24 / (1 + event_id % 7), -0.5), 8) AS power_decay, round(power(2, -h / 72.0), 8) AS half_life FROM (SELECT event_id, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 3600.0 AS h FROM events)")
def memory_decay(spark, sf):
    """Four laws of forgetting."""
    h = (F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.unix_timestamp("ts")) / 3600.0
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.round(F.greatest(F.lit(0.3), F.exp(-h / (24.0 + 24 * (i % 5)))), 8).alias("floor_decay"), F.round(F.exp(-0.007 * F.greatest(F.lit(0), h - 168) / (1 + i % 3)), 8).alias("late_decay"), F.round(F.pow(1 + 0.2346 * h / 24 / (1 + i % 7), F.lit(-0.5)), 8).alias("power_decay"), F.round(F.pow(F.lit(2.0), -h / 72.0), 8).alias("half_life"))


@register("stability", f"WITH {ANSWERS_SQL} SELECT learner, kp, round(1 + 0.5 * count(*) + greatest(0.0, (avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) - 0.5) * 2) * 0.5 * count(*), 6) AS stability FROM answers GROUP BY 1, 2")
def stability(spark, sf):
    n, r = F.count("*"), F.avg(F.col("correct").cast("double"))
    return answers(spark, sf).groupBy("learner", "kp").agg(F.round(1 + 0.5 * n + F.greatest(F.lit(0.0), (r - 0.5) * 2) * 0.5 * n, 6).alias("stability"))


@register("optimal_interval", "SELECT p_partkey, greatest(1, CAST(round_even(greatest(0.1, p_size / 3.0) * (1 + (10 - greatest(1.0, least(10.0, p_retailprice / 150.0))) / 20), 0) AS BIGINT)) AS days FROM part")
def optimal_interval(spark, sf):
    s, d = F.greatest(F.lit(0.1), F.col("p_size") / 3.0), F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.col("p_retailprice") / 150.0))
    return table(spark, sf, "part").select("p_partkey", F.greatest(F.lit(1), F.bround(s * (1 + (10 - d) / 20)).cast("long")).alias("days"))


@register("engagement", f"WITH {ANSWERS_SQL}, a AS (SELECT learner, least(1.0, count(*) / 80.0) AS b, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS c, 1 - least(1.0, stddev_pop(value) / 100.0) AS e FROM answers GROUP BY 1) SELECT learner, round(0.4 * b + 0.35 * c + 0.25 * e, 6) AS engagement, round(greatest(0.0, least(1.0, 0.2 + 0.5 * (1 - c) + 0.3 * (1 - e))), 6) AS load FROM a")
def engagement(spark, sf):
    """Engagement and cognitive load composites."""
    a = answers(spark, sf).groupBy("learner").agg(F.least(F.lit(1.0), F.count("*") / 80.0).alias("b"), F.avg(F.col("correct").cast("double")).alias("c"), (1 - F.least(F.lit(1.0), F.stddev_pop("value") / 100.0)).alias("e"))
    return a.select("learner", F.round(0.4 * F.col("b") + 0.35 * F.col("c") + 0.25 * F.col("e"), 6).alias("engagement"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.2 + 0.5 * (1 - F.col("c")) + 0.3 * (1 - F.col("e")))), 6).alias("load"))


@register("zpd_bounds", f"WITH {ANSWERS_SQL}, t AS (SELECT learner, (avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) - 0.5) * 4 AS th FROM answers GROUP BY 1) SELECT learner, round(th - ln(0.7 / 0.3), 6) AS low, round(th - ln(0.4 / 0.6), 6) AS high, (SELECT count(*) FROM part WHERE (p_size - 25) / 10.0 BETWEEN th - ln(0.7 / 0.3) AND th - ln(0.4 / 0.6)) AS items FROM t")
def zpd_bounds(spark, sf):
    """Difficulties that give a chance of 0.4 to 0.7, and how many items lie there: a band join on a counted side."""
    t = answers(spark, sf).groupBy("learner").agg(((F.avg(F.col("correct").cast("double")) - 0.5) * 4).alias("th"))
    t = t.select("learner", (F.col("th") - math.log(0.7 / 0.3)).alias("low"), (F.col("th") - math.log(0.4 / 0.6)).alias("high"))
    sizes = table(spark, sf, "part").groupBy("p_size").agg(F.count("*").alias("n")).withColumn("b", (F.col("p_size") - 25) / 10.0)
    upto = sizes.withColumn("bin", F.floor("b"))
    bins = t.select("*", F.explode(F.sequence(F.floor("low"), F.floor("high"))).alias("bin"))
    hit = bins.join(upto, "bin").where("b between low and high").groupBy("learner").agg(F.sum("n").alias("items"))
    return t.join(hit, "learner", "left").select("learner", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.coalesce("items", F.lit(0)).alias("items"))


@register("skill_recommendation", f"WITH {ANSWERS_SQL}, m AS (SELECT learner, kp, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS p FROM answers GROUP BY 1, 2) SELECT learner, kp, rn FROM (SELECT learner, kp, row_number() OVER (PARTITION BY learner ORDER BY CASE WHEN p >= 0.5 THEN 0 ELSE 1 END, round(p, 9), kp) AS rn FROM m WHERE p < 0.8) WHERE rn <= 3")
def skill_recommendation(spark, sf):
    """Points in progress first, the weakest of them ahead; three for each learner."""
    m = answers(spark, sf).groupBy("learner", "kp").agg(F.avg(F.col("correct").cast("double")).alias("p")).where("p < 0.8")
    rn = F.row_number().over(Window.partitionBy("learner").orderBy(F.when(F.col("p") >= 0.5, 0).otherwise(1), F.round("p", 9), "kp"))
    return m.select("learner", "kp", rn.cast("long").alias("rn")).where("rn <= 3")
