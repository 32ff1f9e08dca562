"""Fitted learner models, item selection and differences between versions of records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import CORRECT_FROM, answers, table
from ..operators import estimation as E
from ..operators import governance as V
from ..operators import selection as S
from ..operators import tracing_fit
from ..operators.iterate import cut
from .registry import register


def bank(spark, sf):
    """item, a, b, c, area: every part is an item."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("item"), (0.6 + k % 7 * 0.2).alias("a"), ((F.col("p_size") - 25) / 10.0).alias("b"), (k % 3 * 0.1).alias("c"), F.col("p_brand").alias("area"))


def responses(spark, sf):
    """learner, item, correct, a, b, c, area: every line answers its part for the customer of its order."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), (F.col("l_quantity") >= CORRECT_FROM).alias("correct"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("learner"))
    return lines.join(orders, "l_orderkey").join(bank(spark, sf), "item").drop("l_orderkey")


_X, _W = E.hermite()
_MODEL = f"""
bank AS (SELECT *, row_number() OVER (ORDER BY a, item) AS place, count(*) OVER () AS items FROM (SELECT p_partkey AS item, 0.6::DOUBLE + (p_partkey % 7) * 0.2::DOUBLE AS a, (p_size - 25) / 10.0::DOUBLE AS b, (p_partkey % 3) * 0.1::DOUBLE AS c, p_brand AS area FROM part)),
resp AS (SELECT o_custkey AS learner, bank.item, l_quantity >= {CORRECT_FROM} AS correct, a, b, c, area FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN bank ON l_partkey = bank.item),
pts AS (SELECT unnest({[float(x) for x in _X]}::DOUBLE[]) AS x, unnest({[float(w) for w in _W]}::DOUBLE[]) AS w),
logs AS (SELECT learner, x, sum(ln(CASE WHEN correct THEN p ELSE 1 - p END)) + ln(any_value(w)) AS l, count(*) AS n FROM (SELECT learner, correct, x, w, greatest(1e-9, least(1 - 1e-9, c + (1 - c) / (1 + exp(a * (b - x))))) AS p FROM resp, pts) GROUP BY 1, 2),
post AS (SELECT learner, x, n, exp(l - max(l) OVER (PARTITION BY learner)) AS e FROM logs),
mean AS (SELECT learner, any_value(n) AS n, sum(e * x) / sum(e) AS m FROM post GROUP BY 1),
abil AS (SELECT learner, any_value(mean.n) AS n, round(any_value(m), 6) AS theta, round(sqrt(sum(e * (x - m) * (x - m)) / sum(e)), 6) AS se FROM post JOIN mean USING (learner) GROUP BY 1)
"""


def abilities(spark, sf):
    return E.ability_quadrature(responses(spark, sf)).select("learner", F.round("theta", 6).alias("theta"), F.round("se", 6).alias("se"), "n")


@register("irt_quadrature", f"WITH {_MODEL} SELECT learner, theta, se, n FROM abil")
def irt_quadrature(spark, sf):
    """Posterior mean and deviation of every customer's ability over the parts answered."""
    return abilities(spark, sf)


@register("irt_mode")
def irt_mode(spark, sf):
    """Mode of the posterior of every customer's ability."""
    return E.ability_likelihood(responses(spark, sf), prior_sd=1.0)


@register("irt_calibration")
def irt_calibration(spark, sf):
    """Discrimination and difficulty of all parts by marginal maximum likelihood."""
    return E.calibrate_items(responses(spark, sf), tolerance=1e-2)


@register("tracing_fit")
def tracing_parameters(spark, sf):
    """Prior, transit, guess and slip of every point with at least 30 answers."""
    return tracing_fit.fit_tracing(answers(spark, sf), least=30)


_DRAW = "(('0x' || md5({})[1:8])::BIGINT / 4294967296.0::DOUBLE)"
_LEFT = f"""{_MODEL},
taken AS (SELECT DISTINCT learner, item FROM resp), turns AS (SELECT learner, count(*) AS turns FROM taken GROUP BY 1),
pool AS (SELECT learner, theta, turns, least(turns, {S.LENGTH}) AS turn, item, a, b, c, area, CASE WHEN place <= greatest(items // 3, 1) THEN 0 WHEN place <= greatest(2 * items // 3, greatest(items // 3, 1) + 1) THEN 1 ELSE 2 END AS layer, c + (1 - c) / (1 + exp(-a * (theta - b))) AS p, c + (1 - c) / (1 + exp(-a * (theta + {S.DELTA} - b))) AS q FROM abil JOIN turns USING (learner), bank WHERE (learner, item) NOT IN (SELECT (learner, item) FROM taken)),
scored AS (SELECT *, a * a * power((p - c) / (1 - c), 2) * (1 - p) / p AS info, -abs(b - theta) AS near, least(1.0, greatest(CASE WHEN turn > 0 THEN turn ELSE 1 END * {S.ERROR * S.ERROR}, turn / {S.LENGTH - 1}.0))::DOUBLE AS w FROM pool)
"""


@register("item_selection", f"""WITH {_LEFT}, mast AS (SELECT learner, area, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS m FROM resp GROUP BY 1, 2),
  s AS (SELECT learner, turns, item, 'fisher_info' AS strategy, 0 AS tier, info AS score FROM scored
  UNION ALL SELECT learner, turns, item, 'b_match', 0, near FROM scored
  UNION ALL SELECT learner, turns, item, 'kl_info', 0, p * ln(p / q) + (1 - p) * ln((1 - p) / (1 - q)) FROM scored
  UNION ALL SELECT learner, turns, item, 'zpd_aware', CASE WHEN p > {S.HARD} AND p < {S.EASY} THEN 0 WHEN p > {S.HARD} THEN 1 ELSE 2 END, CASE WHEN p > {S.HARD} AND p < {S.EASY} THEN info ELSE near END FROM scored
  UNION ALL SELECT learner, turns, item, 'progressive', 0, (1 - w) * {_DRAW.format("item || '|' || turn")} + w * info FROM scored
  UNION ALL SELECT learner, turns, item, 'a_stratified', CASE WHEN layer = CASE WHEN turn / {S.LENGTH}.0 < 0.33 THEN 0 WHEN turn / {S.LENGTH}.0 < 0.67 THEN 1 ELSE 2 END THEN 0 ELSE 1 END, info FROM scored
  UNION ALL SELECT learner, turns, item, 'bkt_irt_fusion', CASE WHEN coalesce(m, 0.5) BETWEEN {S.MASTERY_LOW} AND {S.MASTERY_HIGH} THEN 0 ELSE 1 END, info FROM scored LEFT JOIN mast USING (learner, area)),
  r AS (SELECT learner, turns, strategy, item, row_number() OVER (PARTITION BY learner, strategy ORDER BY tier, round(score, {S.DIGITS}) DESC, item) AS rn FROM s),
  d AS (SELECT learner, list(item ORDER BY rn) AS best, any_value(turns) AS turns FROM r WHERE strategy = 'fisher_info' AND rn <= {S.DRAWN} GROUP BY 1)
  SELECT learner, strategy, item FROM r WHERE rn = 1 UNION ALL SELECT learner, 'randomesque', best[1 + floor({_DRAW.format("learner || '|' || turns")} * len(best))::BIGINT] FROM d""")
def item_selection(spark, sf):
    """Every customer's next part by each of the eight strategies."""
    r = responses(spark, sf)
    mastery = r.groupBy("learner", "area").agg(F.avg(F.col("correct").cast("double")).alias("p"))
    return S.select_each(abilities(spark, sf).select("learner", "theta"), bank(spark, sf), r.select("learner", "item"), S.STRATEGIES, mastery).select("learner", "strategy", "item")


@register("cat_stop_rules", f"""WITH {_LEFT}, g AS (SELECT learner, max(info) AS info FROM scored GROUP BY 1), x AS (SELECT abil.learner, theta, se, n, se - 1 / sqrt(1 / (se * se) + round(info, {S.DIGITS})) AS gain FROM abil LEFT JOIN g USING (learner))
  SELECT learner, theta, se, n, round(gain, 6) AS gain, n >= 20 AS by_length, n >= 20 OR n >= 5 AND se < 0.3 AS by_error, n >= 20 OR n >= 5 AND 2 * 1.959963984540054 * se < 0.5 AS by_width, abs(theta) > 1.6448536269514722 * se AS by_class, n >= 20 OR n >= 5 AND (gain IS NULL OR CASE WHEN se < 0.3 THEN gain <= 0.05 ELSE gain < 0.01 END) AS by_gain FROM x""")
def cat_stop_rules(spark, sf):
    """Whether a customer's test may end: by its length, its error, the width of the interval, the side of the cut score
    and by what the best item left would gain, all at the customer's own ability."""
    taken = responses(spark, sf).select("learner", "item").distinct()
    return S.stop_rules(cut(abilities(spark, sf)), cut(bank(spark, sf)), cut(taken)).withColumn("gain", F.round("gain", 6))


_FIELDS = {"status": "o_orderstatus", "priority": "o_orderpriority", "day": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", "urgent": "CASE WHEN o_orderpriority LIKE '1%' THEN 'yes' END"}


@register("record_diffs", "WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), e AS ("
    + " UNION ALL ".join(f"SELECT o_custkey, v, n, '{k}' AS field, {x} AS value FROM v WHERE {x} IS NOT NULL" for k, x in _FIELDS.items())
    + "), d AS (SELECT coalesce(a.o_custkey, b.o_custkey) || '#' || coalesce(a.v, b.v - 1) AS record, coalesce(a.field, b.field) AS field, a.value AS before, b.value AS after FROM (SELECT * FROM e WHERE v < n) a FULL JOIN (SELECT * FROM e WHERE v > 1) b ON a.o_custkey = b.o_custkey AND a.v + 1 = b.v AND a.field = b.field) SELECT record, field, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'modified' END AS change, before, after FROM d WHERE before IS DISTINCT FROM after")
def record_diffs(spark, sf):
    """What each version of a customer's record adds, removes and modifies; a record is named by its older version."""
    w = Window.partitionBy("o_custkey")
    o = V.versions(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).withColumn("n", F.count("*").over(w))
    values = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "day": F.to_date("o_orderdate").cast("string"), "urgent": F.when(F.col("o_orderpriority").startswith("1"), "yes")}
    every = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))
    o = o.select("o_custkey", "version", "n", F.map_filter(every, lambda k, v: v.isNotNull()).alias("fields"))
    named = lambda rows, less: rows.select(F.concat_ws("#", F.col("o_custkey").cast("string"), (F.col("version") - less).cast("string")).alias("record"), "fields")
    return V.map_diff(named(o.where("version < n"), 0), named(o.where("version > 1"), 1), "record", "fields")
