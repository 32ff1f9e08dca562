"""Statistics, SLO, KPI, feedback, experiment, privacy and sequence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import ANSWERS_SQL, ENTITIES_SQL, TRIPLES_SQL, answers, entities, table, triples
from ..operators import stats
from .registry import register

END = "2024-02-01 00:00:00"


def _age_hours():
    return (F.unix_timestamp(F.lit(END)) - F.unix_timestamp("ts")) / 3600.0


AGE_SQL = "((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 3600.0)"


@register("store_stats", f"WITH {ENTITIES_SQL} SELECT entity_type, domain, count(*) AS n, round(avg(confidence), 4) AS avg_confidence, CAST(grouping(entity_type, domain) AS BIGINT) AS level FROM entities GROUP BY GROUPING SETS ((entity_type), (domain), ())")
def store_stats(spark, sf):
    """Counts by type, by domain and in all, in one pass."""
    entities(spark, sf).createOrReplaceTempView("tm_entities")
    return spark.sql("SELECT entity_type, domain, count(*) AS n, round(avg(confidence), 4) AS avg_confidence, grouping_id(entity_type, domain) AS level FROM tm_entities GROUP BY GROUPING SETS ((entity_type), (domain), ())")


@register("triple_stats", f"WITH {TRIPLES_SQL} SELECT predicate, rank, count(*) AS n, round(avg(confidence), 4) AS avg_confidence FROM triples GROUP BY 1, 2")
def triple_stats(spark, sf):
    return triples(spark, sf).groupBy("predicate", "rank").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


@register("metric_aggregate", "SELECT event_type, coalesce(round(sum(value) FILTER (value > 200), 4), 0.0) AS total, coalesce(round(avg(value) FILTER (value > 1000), 4), 0.0) AS none, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY 1")
def metric_aggregate(spark, sf):
    """An empty selection gives 0.0, not null."""
    when = lambda f, c: F.coalesce(F.round(f(F.when(c, F.col("value"))), 4), F.lit(0.0))
    return table(spark, sf, "events").groupBy("event_type").agg(when(F.sum, F.col("value") > 200).alias("total"), when(F.avg, F.col("value") > 1000).alias("none"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))


@register("group_counts", "SELECT coalesce(nullif(event_type, ''), 'unknown') AS action, CASE WHEN value >= 35 THEN 'success' ELSE 'failure' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2")
def group_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.coalesce(F.nullif("event_type", F.lit("")), F.lit("unknown")).alias("action"), F.when(F.col("value") >= 35, "success").otherwise("failure").alias("outcome")).agg(F.count("*").alias("n"))


@register("latency_p99", """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS mean FROM events WHERE value > 0 GROUP BY 1)
    SELECT event_type, n, round(mean, 6) AS mean, v[1 + greatest(0, least(n - 1, CAST(floor(n * 0.99) AS BIGINT) - 1))] AS p99_low, v[1 + greatest(0, least(n - 1, CAST(floor(n * 0.99) AS BIGINT)))] AS p99_high FROM s""")
def latency_p99(spark, sf):
    return stats.latency_p99(table(spark, sf, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@register("percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def percentiles(spark, sf):
    """Interpolated percentiles."""
    q = stats.quantiles(table(spark, sf, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return q.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@register("histogram", "SELECT event_type, count(*) FILTER (value <= 5.0) AS le_5_0, count(*) FILTER (value <= 25.0) AS le_25_0, count(*) FILTER (value <= 100.0) AS le_100_0, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def histogram(spark, sf):
    return stats.histogram(table(spark, sf, "events"), "event_type", "value", [5.0, 25.0, 100.0]).withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@register("labelled_counter", "SELECT event_type || '|' || json_extract_string(props, '$.k') AS labels, round(sum(value), 4) AS total FROM events WHERE value >= 0 GROUP BY 1")
def labelled_counter(spark, sf):
    """Increments summed by label set; negative ones are refused."""
    e = table(spark, sf, "events").where("value is not null")
    return stats.counter(e, F.concat_ws("|", "event_type", F.get_json_object("props", "$.k")), "value").withColumn("total", F.round("total", 4))


@register("slo_daily", """WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS good FROM events GROUP BY 1), b AS (SELECT *, good / n::DOUBLE AS share FROM a)
    SELECT CAST(day AS VARCHAR) AS day, n, round(share, 6) AS compliance, round((1 - share) / (1 - 0.95), 6) AS burn, CASE WHEN (1 - share) / (1 - 0.95) >= 14.4 THEN 'page' WHEN (1 - share) / (1 - 0.95) >= 6 THEN 'ticket' WHEN (1 - share) / (1 - 0.95) >= 3 THEN 'watch' ELSE 'none' END AS alert FROM b""")
def slo_daily(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    return stats.slo(e, "day", F.col("event_type") != "error", 0.95)


@register("dora", f"SELECT user_id, count(*) AS deployments, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate, round(avg(value) FILTER (event_type <> 'error'), 6) AS lead_time FROM events WHERE {AGE_SQL} <= 24 * 10 GROUP BY 1")
def dora(spark, sf):
    e = table(spark, sf, "events").where(_age_hours() <= 240)
    bad = F.col("event_type") == "error"
    return e.groupBy("user_id").agg(F.count("*").alias("deployments"), F.round(F.avg(bad.cast("double")), 6).alias("failure_rate"), F.round(F.avg(F.when(~bad, F.col("value"))), 6).alias("lead_time"))


@register("baseline", "SELECT user_id, array_to_string(list_sort(list(event_type || '=' || n)), ',') AS actions, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS mean FROM (SELECT user_id, event_type, count(*) AS n, sum(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2) GROUP BY 1")
def baseline(spark, sf):
    """Action counts and mean per learner over a trailing window."""
    a = table(spark, sf, "events").where("ts < timestamp'2024-01-20'").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return a.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "event_type", F.col("n").cast("string")))), ",").alias("actions"), F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))


@register("anomalies", """WITH w AS (SELECT user_id, ts >= TIMESTAMP '2024-01-25' AS recent, count(*) AS n, avg(value) AS lat, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS fail FROM events GROUP BY 1, 2),
    j AS (SELECT r.user_id, r.n, r.lat AS rl, b.lat AS bl, r.fail AS rf, b.fail AS bf FROM w r JOIN w b ON r.user_id = b.user_id AND r.recent AND NOT b.recent)
    SELECT user_id, n, rl > 3 * bl AS slow, (CASE WHEN bf > 0 THEN rf > 2 * bf ELSE rf > 0.3 END) AS failing FROM j WHERE n >= 3 AND (rl > 3 * bl OR (CASE WHEN bf > 0 THEN rf > 2 * bf ELSE rf > 0.3 END))""")
def anomalies(spark, sf):
    """Recent behaviour against the baseline, in one pass over the rows."""
    recent = F.col("ts") >= F.lit("2024-01-25").cast("timestamp")
    fail = (F.col("event_type") == "error").cast("double")
    a = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.when(recent, 1)).alias("n"), F.count(F.when(~recent, 1)).alias("nb"), F.avg(F.when(recent, F.col("value"))).alias("rl"), F.avg(F.when(~recent, F.col("value"))).alias("bl"), F.avg(F.when(recent, fail)).alias("rf"), F.avg(F.when(~recent, fail)).alias("bf")
    )
    slow, failing = F.col("rl") > 3 * F.col("bl"), F.when(F.col("bf") > 0, F.col("rf") > 2 * F.col("bf")).otherwise(F.col("rf") > 0.3)
    return a.where("n >= 3 and nb > 0").select("user_id", "n", slow.alias("slow"), failing.alias("failing")).where("slow or failing")


@register("kpi_status", "SELECT day, m, CASE WHEN m >= 52 THEN 'green' WHEN m >= 48 THEN 'yellow' ELSE 'red' END AS status, CASE WHEN m <= 48 THEN 'green' WHEN m <= 52 THEN 'yellow' ELSE 'red' END AS inverse FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS m FROM events GROUP BY 1)")
def kpi_status(spark, sf):
    m = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.avg("value"), 6).alias("m"))
    return m.select("day", "m", F.when(F.col("m") >= 52, "green").when(F.col("m") >= 48, "yellow").otherwise("red").alias("status"), F.when(F.col("m") <= 48, "green").when(F.col("m") <= 52, "yellow").otherwise("red").alias("inverse"))


@register("kpi_threshold", "SELECT event_type, round(least(60.0, greatest(20.0, quantile_cont(value, 0.75))), 6) AS green, round(least(300.0, greatest(100.0, quantile_cont(value, 0.95))), 6) AS red FROM events GROUP BY 1 HAVING count(*) >= 10")
def kpi_threshold(spark, sf):
    """Thresholds suggested from percentiles, changed by half at most."""
    held = lambda c, old: F.round(F.least(F.lit(old * 1.5), F.greatest(F.lit(old * 0.5), F.col(c))), 6).alias(c)
    q = stats.quantiles(table(spark, sf, "events"), "event_type", "value", {"green": 0.75, "red": 0.95})
    return q.where("n >= 10").select("event_type", held("green", 40.0), held("red", 200.0))


@register("kpi_trend", """WITH w AS (SELECT event_type, value, rn, least(n, 200) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE rn <= 200),
    h AS (SELECT event_type, avg(value) FILTER (rn > n - n // 2) AS a, avg(value) FILTER (rn <= n - n // 2) AS b, stddev_samp(value) / avg(value) AS cv, max(n) AS n FROM w GROUP BY 1)
    SELECT event_type, round(100 * (b - a) / a, 4) AS change, round(0.5 * least(1.0, log10(n) / 2) + 0.5 * greatest(0.0, 1 - cv), 6) AS confidence FROM h""")
def kpi_trend(spark, sf):
    """The last 200 samples: second half against the first, and how far to trust it. Each task keeps 200 at most."""
    last = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    w = table(spark, sf, "events").select("event_type", "ts", "event_id", "value").withColumn("rn", last).where("rn <= 200")
    w = w.withColumn("n", F.count("*").over(Window.partitionBy("event_type")))
    first = F.col("rn") > F.col("n") - F.floor(F.col("n") / 2)
    h = w.groupBy("event_type").agg(F.avg(F.when(first, F.col("value"))).alias("a"), F.avg(F.when(~first, F.col("value"))).alias("b"), (F.stddev_samp("value") / F.avg("value")).alias("cv"), F.max("n").alias("n"))
    return h.select("event_type", F.round(100 * (F.col("b") - F.col("a")) / F.col("a"), 4).alias("change"), F.round(0.5 * F.least(F.lit(1.0), F.log10("n") / 2) + 0.5 * F.greatest(F.lit(0.0), 1 - F.col("cv")), 6).alias("confidence"))


RATING = "greatest(-1.0, least(1.0, (value - 50) / 50.0))"


@register("feedback_decayed", f"SELECT event_type, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(sum({RATING} * power(2.0, -{AGE_SQL} / 72.0)) / sum(power(2.0, -{AGE_SQL} / 72.0)), 6) END AS decayed_mean FROM events GROUP BY 1")
def feedback_decayed(spark, sf):
    return stats.decayed_mean(table(spark, sf, "events"), "event_type", F.expr(RATING), _age_hours(), 72.0, 5).withColumn("decayed_mean", F.round("decayed_mean", 6))


@register("feedback_by_dimension", f"SELECT user_id, round(avg(r), 6) AS avg_rating, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(avg(CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative FROM (SELECT user_id, {RATING} AS r FROM events) GROUP BY 1")
def feedback_by_dimension(spark, sf):
    r = table(spark, sf, "events").select("user_id", F.expr(RATING).alias("r"))
    return r.groupBy("user_id").agg(F.round(F.avg("r"), 6).alias("avg_rating"), F.count("*").alias("n"), F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("positive"), F.round(F.avg((F.col("r") < 0).cast("double")), 6).alias("negative"))


@register("bayesian_estimates", f"""WITH a AS (SELECT user_id, 1 + sum(greatest({RATING}, 0.0)) AS alpha, 1 + sum(greatest(-{RATING}, 0.0)) AS beta FROM events GROUP BY 1),
    b AS (SELECT *, alpha / (alpha + beta) AS mean, alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)) AS variance FROM a)
    SELECT user_id, round(alpha, 5) AS alpha, round(beta, 5) AS beta, round(mean, 6) AS mean, round(variance, 8) AS variance, round(greatest(0.0, mean - 1.96 * sqrt(variance)), 6) AS low, round(least(1.0, mean + 1.96 * sqrt(variance)), 6) AS high FROM b""")
def bayesian_estimates(spark, sf):
    b = stats.beta_estimates(table(spark, sf, "events"), "user_id", F.expr(RATING))
    return b.select("user_id", F.round("alpha", 5).alias("alpha"), F.round("beta", 5).alias("beta"), F.round("mean", 6).alias("mean"), F.round("variance", 8).alias("variance"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@register("feedback_trend", """WITH w AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT user_id, round(regr_slope(value, -rn), 6) AS slope, round(regr_r2(value, -rn), 6) AS r2, CASE WHEN regr_slope(value, -rn) > 0.05 THEN 'up' WHEN regr_slope(value, -rn) < -0.05 THEN 'down' ELSE 'flat' END AS trend FROM w WHERE rn <= 30 GROUP BY 1""")
def feedback_trend(spark, sf):
    """Least squares over each learner's last 30 samples."""
    w = table(spark, sf, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("rn <= 30")
    slope = F.regr_slope(F.col("value"), (-F.col("rn")).cast("double"))
    return w.groupBy("user_id").agg(F.round(slope, 6).alias("slope"), F.round(F.regr_r2(F.col("value"), (-F.col("rn")).cast("double")), 6).alias("r2"), F.when(slope > 0.05, "up").when(slope < -0.05, "down").otherwise("flat").alias("trend"))


@register("experiment_stats", "SELECT o_orderpriority AS variant, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(var_pop(o_totalprice) / 1e6, 4) AS variance FROM orders GROUP BY 1")
def experiment_stats(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("variant")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.var_pop("o_totalprice") / 1e6, 4).alias("variance"))


@register("welch_t", """WITH a AS (SELECT o_orderpriority AS v, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS s FROM orders GROUP BY 1)
    SELECT a.v AS a_variant, b.v AS b_variant, round((a.m - b.m) / sqrt(a.s / a.n + b.s / b.n), 6) AS t, round(power(a.s / a.n + b.s / b.n, 2) / ((a.s / a.n) * (a.s / a.n) / (a.n - 1) + (b.s / b.n) * (b.s / b.n) / (b.n - 1)), 3) AS df, round((a.m - b.m) / sqrt((a.s + b.s) / 2), 6) AS cohen_d FROM a JOIN a b ON a.v < b.v""")
def welch_t(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("variant"), "o_totalprice")
    return stats.welch(o, "variant", "o_totalprice").withColumns({"t": F.round("t", 6), "df": F.round("df", 3), "cohen_d": F.round("cohen_d", 6)})


@register("outliers_iqr", "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1 HAVING count(*) >= 4) SELECT event_id, value FROM events JOIN q USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def outliers_iqr(spark, sf):
    e = table(spark, sf, "events")
    q = stats.quantiles(e, "event_type", "value", {"a": 0.25, "b": 0.75}).where("n >= 4")
    spread = 1.5 * (F.col("b") - F.col("a"))
    return e.join(q, "event_type").where((F.col("value") < F.col("a") - spread) | (F.col("value") > F.col("b") + spread)).select("event_id", "value")


@register("outliers_z", "SELECT event_id, round(z, 6) AS z FROM (SELECT event_id, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY event_type)) WHERE abs(z) > 3")
def outliers_z(spark, sf):
    """Statistics by aggregation and a join, so a hot type isn't sorted in one task."""
    e = table(spark, sf, "events")
    s = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("*").alias("n")).where("n >= 3 and s >= 1e-15")
    return e.join(s, "event_type").select("event_id", F.round((F.col("value") - F.col("m")) / F.col("s"), 6).alias("z")).where("abs(z) > 3")


# Two-sided 95 % points of Student's t by degrees of freedom; beyond, an expansion around the normal one.
STUDENT_95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]
NORMAL_95 = 1.959963984540054


def student_95(df):
    """The point for more than 30 degrees of freedom; off by less than 0.00001."""
    z = NORMAL_95
    terms = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return z + sum((t / F.pow(df, F.lit(k)) for k, t in enumerate(terms, 1)), F.lit(0.0))


_Z = NORMAL_95
_T_95 = f"({_Z} + {(_Z**3 + _Z) / 4} / {{0}} + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / power({{0}}, 2) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / power({{0}}, 3))"


@register("confidence_interval", f"WITH a AS (SELECT user_id, event_type, avg(value) AS m, stddev_samp(value) / sqrt(count(value)) AS se, count(value) - 1 AS df FROM events GROUP BY 1, 2 HAVING count(value) > 1) SELECT user_id, event_type, round(m - t * se, 6) AS low, round(m + t * se, 6) AS high FROM (SELECT *, coalesce({STUDENT_95}[df], {_T_95.format('df')})::DOUBLE AS t FROM a)")
def confidence_interval(spark, sf):
    """mean +- t * s / sqrt(n) of each learner and type; groups of one value have none."""
    t = F.coalesce(F.get(F.array(*map(F.lit, STUDENT_95)), (F.col("n") - 2).cast("int")), student_95(F.col("n") - 1))
    a = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n")).where("n > 1")
    half = t * F.col("s") / F.sqrt("n")
    return a.select("user_id", "event_type", F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"))


@register("domain_mastery", f"WITH {ANSWERS_SQL}, m AS (SELECT learner, kp, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS p FROM answers GROUP BY 1, 2) SELECT kp, round(avg(p) FILTER (p > 0), 6) AS mastery, count(*) FILTER (p > 0.8) AS mastered, count(*) FILTER (p >= 0.5 AND p <= 0.8) AS learning, count(*) FILTER (p > 0 AND p < 0.5) AS weak FROM m GROUP BY 1")
def domain_mastery(spark, sf):
    m = answers(spark, sf).groupBy("learner", "kp").agg(F.avg(F.col("correct").cast("double")).alias("p"))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return m.groupBy("kp").agg(F.round(F.avg(F.when(F.col("p") > 0, F.col("p"))), 6).alias("mastery"), n("p > 0.8").alias("mastered"), n("p >= 0.5 and p <= 0.8").alias("learning"), n("p > 0 and p < 0.5").alias("weak"))


@register("weighted_mastery", f"WITH {ANSWERS_SQL}, m AS (SELECT learner, kp, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS p, count(*) AS a FROM answers GROUP BY 1, 2) SELECT learner, round(coalesce(sum(p * a) / nullif(sum(a), 0), avg(p)), 6) AS mastery FROM m GROUP BY 1")
def weighted_mastery(spark, sf):
    m = answers(spark, sf).groupBy("learner", "kp").agg(F.avg(F.col("correct").cast("double")).alias("p"), F.count("*").alias("a"))
    return m.groupBy("learner").agg(F.round(F.coalesce(F.sum(F.col("p") * F.col("a")) / F.nullif(F.sum("a"), F.lit(0)), F.avg("p")), 6).alias("mastery"))


@register("quality_dashboard", """WITH q AS (SELECT doc_id, least(1.0, n_chars / 2000.0) AS completeness, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.8 END AS accuracy, 1 - least(1.0, len(regexp_extract_all(text, '[#*$%&|<>]')) * 10.0 / greatest(1, n_chars)) AS consistency FROM documents),
    s AS (SELECT *, 0.4 * completeness + 0.3 * accuracy + 0.3 * consistency AS score FROM q)
    SELECT CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.6 THEN 'C' WHEN score >= 0.4 THEN 'D' ELSE 'F' END AS grade, count(*) AS n, round(avg(completeness), 6) AS completeness, round(avg(consistency), 6) AS consistency FROM s GROUP BY 1""")
def quality_dashboard(spark, sf):
    """Dimension means by grade."""
    marks = F.size(F.regexp_extract_all("text", F.lit("[#*$%&|<>]"), F.lit(0)))
    q = table(spark, sf, "documents").select(F.least(F.lit(1.0), F.col("n_chars") / 2000.0).alias("completeness"), F.when(F.col("lang") == "en", 1.0).otherwise(0.8).alias("accuracy"), (1 - F.least(F.lit(1.0), marks * 10.0 / F.greatest(F.lit(1), "n_chars"))).alias("consistency"))
    score = 0.4 * F.col("completeness") + 0.3 * F.col("accuracy") + 0.3 * F.col("consistency")
    grade = F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.6, "C").when(score >= 0.4, "D").otherwise("F")
    return q.groupBy(grade.alias("grade")).agg(F.count("*").alias("n"), F.round(F.avg("completeness"), 6).alias("completeness"), F.round(F.avg("consistency"), 6).alias("consistency"))


@register("top_tags", f"WITH {ENTITIES_SQL} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM entities) GROUP BY 1 ORDER BY n DESC, tag LIMIT 8")
def top_tags(spark, sf):
    return entities(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(8)


@register("chain_summary", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types, round(avg(value), 6) AS mean, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS span FROM events GROUP BY 1")
def chain_summary(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types"), F.round(F.avg("value"), 6).alias("mean"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("span"))


@register("coverage", "SELECT source, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS coverage, count(DISTINCT lang) AS langs FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def coverage(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return d.groupBy("source").agg(F.round(F.count("has") / F.count("*"), 6).alias("coverage"), F.countDistinct("lang").alias("langs"))


@register("k_anonymity", "SELECT c_nationkey, count(*) AS k, count(DISTINCT coalesce(CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR), 'null')) AS l FROM customer GROUP BY 1")
def k_anonymity(spark, sf):
    return stats.k_anonymity(table(spark, sf, "customer"), "c_nationkey", F.floor(F.col("c_acctbal") / 1000))


@register("research_export", "WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS k, count(DISTINCT floor(c_acctbal / 1000)) AS l FROM customer GROUP BY 1, 2) SELECT c_custkey, c_nationkey, c_mktsegment FROM customer JOIN g USING (c_nationkey, c_mktsegment) WHERE k >= 12 AND l >= 5")
def research_export(spark, sf):
    """Groups below k rows or l sensitive values are suppressed."""
    c = table(spark, sf, "customer").withColumn("b", F.floor(F.col("c_acctbal") / 1000))
    g = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("k"), F.countDistinct("b").alias("l")).where("k >= 12 and l >= 5")
    return c.join(g, ["c_nationkey", "c_mktsegment"], "left_semi").select("c_custkey", "c_nationkey", "c_mktsegment")


@register("retrieval_quality", """WITH r AS (SELECT d.source, d.doc_id, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rn FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT source, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) FILTER (rn <= 10), 6) AS relevant_at_10, count(quality) AS judged FROM r GROUP BY 1""")
def retrieval_quality(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    top = d.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("rn <= 10")
    good = F.when(F.col("quality") == 1, 1.0).otherwise(0.0)
    top = top.groupBy(F.col("source").alias("of")).agg(F.round(F.avg(good), 6).alias("relevant_at_10"))
    judged = d.groupBy("source").agg(F.count("quality").alias("judged"))
    return judged.join(top, F.col("source").eqNullSafe(F.col("of"))).select("source", "relevant_at_10", "judged")


@register("distinct_actors", "SELECT event_type, count(DISTINCT user_id) AS actors FROM events GROUP BY 1")
def distinct_actors(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("actors"))


@register("cube_counts", "SELECT event_type, user_id % 4 AS shard, count(*) AS n, CAST(grouping(event_type, user_id % 4) AS BIGINT) AS level FROM events GROUP BY CUBE (event_type, user_id % 4)")
def cube_counts(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 4).alias("shard"))
    return e.cube("event_type", "shard").agg(F.count("*").alias("n"), F.grouping_id("event_type", "shard").alias("level"))


# sequences -----------------------------------------------------------------------------------------------------------

ORDERED_SQL = f"{ANSWERS_SQL}, seq AS (SELECT *, CASE WHEN correct THEN 1 ELSE 0 END AS c, row_number() OVER (PARTITION BY learner ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY learner) AS n FROM answers)"


def _seq(spark, sf):
    by = Window.partitionBy("learner")
    return answers(spark, sf).withColumn("c", F.col("correct").cast("int")).withColumn("i", F.row_number().over(by.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(by))


@register("sliding_accuracy", f"WITH {ORDERED_SQL} SELECT learner, i, avg(c) OVER (PARTITION BY learner ORDER BY i ROWS 4 PRECEDING) AS accuracy FROM seq QUALIFY i >= 5 OR (n < 5 AND i = n)")
def sliding_accuracy(spark, sf):
    """Accuracy over full frames of five answers; a shorter sequence gives its mean."""
    s = _seq(spark, sf).withColumn("accuracy", F.avg("c").over(Window.partitionBy("learner").orderBy("i").rowsBetween(-4, 0)))
    return s.where("i >= 5 or (n < 5 and i = n)").select("learner", F.col("i").cast("long").alias("i"), "accuracy")


@register("accuracy_trend", f"WITH {ORDERED_SQL} SELECT learner, round(regr_slope(c, i), 8) AS slope, CASE WHEN regr_slope(c, i) > 0.001 THEN 'improving' WHEN regr_slope(c, i) < -0.001 THEN 'declining' ELSE 'stable' END AS trend FROM seq GROUP BY 1")
def accuracy_trend(spark, sf):
    slope = F.regr_slope(F.col("c").cast("double"), F.col("i").cast("double"))
    return _seq(spark, sf).groupBy("learner").agg(F.round(slope, 8).alias("slope"), F.when(slope > 0.001, "improving").when(slope < -0.001, "declining").otherwise("stable").alias("trend"))


@register("streaks", f"WITH {ORDERED_SQL}, g AS (SELECT *, i - row_number() OVER (PARTITION BY learner, c ORDER BY i) AS run FROM seq), r AS (SELECT learner, c, run, count(*) AS len, max(i) AS last, max(n) AS n FROM g GROUP BY 1, 2, 3) SELECT learner, max(CASE WHEN last = n AND c = 1 THEN len ELSE 0 END) AS current, max(CASE WHEN c = 1 THEN len ELSE 0 END) AS best, max(CASE WHEN c = 0 THEN len ELSE 0 END) AS worst FROM r GROUP BY 1")
def streaks(spark, sf):
    """Current run of correct answers, longest runs of correct and of wrong ones."""
    g = _seq(spark, sf).withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("learner", "c").orderBy("i")))
    r = g.groupBy("learner", "c", "run").agg(F.count("*").alias("len"), F.max("i").alias("last"), F.max("n").alias("n"))
    top = lambda c: F.max(F.when(F.expr(c), F.col("len")).otherwise(0))
    return r.groupBy("learner").agg(top("last = n and c = 1").alias("current"), top("c = 1").alias("best"), top("c = 0").alias("worst"))


@register("mastery_velocity", f"WITH {ORDERED_SQL} SELECT learner, round(avg(c) FILTER (i > n // 2) - avg(c) FILTER (i <= n // 2), 8) AS velocity FROM seq GROUP BY 1 HAVING max(n) >= 2")
def mastery_velocity(spark, sf):
    first = F.col("i") <= F.floor(F.col("n") / 2)
    s = _seq(spark, sf).where("n >= 2")
    return s.groupBy("learner").agg(F.round(F.avg(F.when(~first, F.col("c"))) - F.avg(F.when(first, F.col("c"))), 8).alias("velocity"))


@register("temporal_pattern", f"""WITH {ORDERED_SQL}, a AS (SELECT learner, avg(c) FILTER (i <= n // 2) AS f, avg(c) FILTER (i > n // 2) AS s, stddev_pop(c) AS sd, regr_slope(c, i) AS k, max(n) AS n FROM seq GROUP BY 1)
    SELECT learner, CASE WHEN n < 2 THEN 'stable' WHEN f > 0.55 AND s < 0.5 THEN 'early_decay' WHEN f < 0.45 AND s > 0.5 THEN 'late_bloom' WHEN k > 0.002 THEN 'steady_bloom' WHEN sd > 0.4999 THEN 'oscillating' ELSE 'stable' END AS pattern FROM a""")
def temporal_pattern(spark, sf):
    """The first rule that holds: early decay, late bloom, steady bloom, oscillation, else stable."""
    first = F.col("i") <= F.floor(F.col("n") / 2)
    a = _seq(spark, sf).groupBy("learner").agg(F.avg(F.when(first, F.col("c"))).alias("f"), F.avg(F.when(~first, F.col("c"))).alias("s"), F.stddev_pop("c").alias("sd"), F.regr_slope(F.col("c").cast("double"), F.col("i").cast("double")).alias("k"), F.max("n").alias("n"))
    rule = F.when(F.col("n") < 2, "stable").when(F.expr("f > 0.55 and s < 0.5"), "early_decay").when(F.expr("f < 0.45 and s > 0.5"), "late_bloom").when(F.col("k") > 0.002, "steady_bloom").when(F.col("sd") > 0.4999, "oscillating").otherwise("stable")
    return a.select("learner", rule.alias("pattern"))


@register("response_time", f"WITH {ORDERED_SQL} SELECT learner, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, CASE WHEN regr_slope(value, i) / avg(value) > 0.002 THEN 'slower' WHEN regr_slope(value, i) / avg(value) < -0.002 THEN 'faster' ELSE 'steady' END AS trend FROM seq GROUP BY 1")
def response_time(spark, sf):
    k = F.regr_slope(F.col("value"), F.col("i").cast("double")) / F.avg("value")
    return _seq(spark, sf).groupBy("learner").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.when(k > 0.002, "slower").when(k < -0.002, "faster").otherwise("steady").alias("trend"))


@register("trajectory_trend", f"WITH {ANSWERS_SQL}, d AS (SELECT learner, CAST(ts AS DATE) AS day, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS p FROM answers GROUP BY 1, 2), l AS (SELECT *, lag(p) OVER (PARTITION BY learner ORDER BY day) AS q FROM d) SELECT learner, CAST(day AS VARCHAR) AS day, CASE WHEN q IS NULL THEN 'new' WHEN p - q > 0.05 THEN 'up' WHEN p - q < -0.05 THEN 'down' ELSE 'flat' END AS trend FROM l")
def trajectory_trend(spark, sf):
    d = answers(spark, sf).groupBy("learner", F.to_date("ts").alias("day")).agg(F.avg(F.col("correct").cast("double")).alias("p"))
    diff = F.col("p") - F.lag("p").over(Window.partitionBy("learner").orderBy("day"))
    return d.select("learner", F.col("day").cast("string").alias("day"), F.when(diff.isNull(), "new").when(diff > 0.05, "up").when(diff < -0.05, "down").otherwise("flat").alias("trend"))


@register("temporal_conflict", "SELECT l_partkey, l_shipdate_s, ratio FROM (SELECT l_partkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate_s, round(abs(l_quantity - p) / abs(p), 6) AS ratio FROM (SELECT *, lag(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) AS p FROM lineitem)) WHERE ratio > 0.5")
def temporal_conflict(spark, sf):
    """Values that differ from the one before by more than half of it."""
    p = F.lag("l_quantity").over(Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"))
    l = table(spark, sf, "lineitem").withColumn("p", p)  # noqa: E741
    return l.select("l_partkey", F.to_date("l_shipdate").cast("string").alias("l_shipdate_s"), F.round(F.abs(F.col("l_quantity") - F.col("p")) / F.abs("p"), 6).alias("ratio")).where("ratio > 0.5")


@register("keep_last_n", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20 THEN 'kept' ELSE 'archived' END AS state FROM events")
def keep_last_n(spark, sf):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf, "events").select("event_id", F.when(rn <= 20, "kept").otherwise("archived").alias("state"))


@register("order_integrity", "SELECT user_id, count(*) - count(DISTINCT event_id) AS repeats, sum(CASE WHEN ts < p THEN 1 ELSE 0 END)::BIGINT AS disorder FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1")
def order_integrity(spark, sf):
    """Repeated ids, and times that fall in the order of ids."""
    e = table(spark, sf, "events").withColumn("p", F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.groupBy("user_id").agg((F.count("*") - F.countDistinct("event_id")).alias("repeats"), F.sum(F.coalesce((F.col("ts") < F.col("p")).cast("long"), F.lit(0))).alias("disorder"))


@register("ntile_levels", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quartile, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS last4, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS seg_rank FROM customer")
def ntile_levels(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.ntile(4).over(w).cast("long").alias("quartile"), F.round(F.sum("c_acctbal").over(w.rowsBetween(-3, 0)), 4).alias("last4"), F.rank().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment")).cast("long").alias("seg_rank"))
