"""Aggregations over metric samples, feedback, experiments and privacy groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(values: Column, n: Column, q: float, shift: int) -> Column:
    """Element int(n * q) + shift of the sorted values, clamped to them; null without values."""
    at = F.greatest(F.lit(0), F.least(n.cast("int") - 1, F.floor(n * q).cast("int") + shift))
    return F.when(n > 0, F.get(F.sort_array(values), at))


def order_statistics(df: DataFrame, key: str, value: str, at: dict, accuracy: int = 10_000) -> DataFrame:
    """(key, n, total, one column per name of at): exact values at given ranks of each key's sorted non-null values; null without any.

    `at` maps a name to (q, rank): rank is a function of n that gives a place from 0, at most one away from the q * n th
    value. A bounded sketch brackets each q; values below the bracket are only counted, and those inside it, about
    4 / accuracy of a key's values, are sorted by (value, count). A bracket that misses its rank raises.
    """
    qs = sorted({q for q, _ in at.values()})
    v = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    edge = lambda d: F.percentile_approx("v", [min(1.0, max(0.0, q + d)) for q in qs], accuracy)
    bounds = v.groupBy(F.col("k").alias("key")).agg(F.count("v").alias("n"), F.sum("v").alias("total"), edge(-2 / accuracy).alias("low"), edge(2 / accuracy).alias("high"))
    j = v.where("v is not null").join(bounds, F.col("k").eqNullSafe(F.col("key")))
    low, high, x = (lambda i: F.col("low")[i]), (lambda i: F.col("high")[i]), F.col("v")
    around = j.groupBy("key").agg(
        F.max("n").alias("n"),
        *(f for i in range(len(qs)) for f in (F.count(F.when(x < low(i), 1)).alias(f"below{i}"), F.max(F.when(x < low(i), x)).alias(f"before{i}"), F.count(F.when(x <= high(i), 1)).alias(f"upto{i}"), F.min(F.when(x > high(i), x)).alias(f"after{i}"))),
    )
    inside = j.select("key", "v", F.explode(F.array_compact(F.array(*(F.when((x >= low(i)) & (x <= high(i)), i) for i in range(len(qs)))))).alias("i"))
    c = inside.groupBy("key", "i", "v").agg(F.count("*").alias("c"))
    c = c.withColumn("end", F.sum("c").over(Window.partitionBy("key", "i").orderBy("v"))).withColumnRenamed("key", "own")
    c = c.join(around, F.col("own").eqNullSafe(F.col("key")))

    def pick(q, rank):
        i = qs.index(q)
        r, end = rank(F.col("n")), F.col(f"below{i}") + F.col("end")
        found = F.min(F.when((F.col("i") == i) & (r < end) & (r >= end - F.col("c")), x))
        edge_value = F.max(F.when(r == F.col(f"below{i}") - 1, F.col(f"before{i}")).when(r == F.col(f"upto{i}"), F.col(f"after{i}")))
        return F.coalesce(found, edge_value, F.raise_error(F.lit("a bracket misses its rank")).cast("double"))

    found = c.groupBy(F.col("key").alias("own")).agg(*(pick(*spec).alias(name) for name, spec in at.items()))
    return bounds.join(found, F.col("own").eqNullSafe(F.col("key")), "left").select(F.col("key").alias(key), "n", "total", *at)


def quantiles(df: DataFrame, key: str, value: str, qs: dict[str, float]) -> DataFrame:
    """(key, n, one column per name): exact percentiles, interpolated between the two values around (n - 1) * q."""
    place = lambda q, n: F.floor((n - 1) * q)
    at = {f"{name}_{side}": (q, lambda n, q=q, add=add: F.least(n - 1, place(q, n) + add)) for name, q in qs.items() for side, add in (("lo", 0), ("hi", 1))}
    o = order_statistics(df, key, value, at)
    part = lambda q: (F.col("n") - 1) * q - place(q, F.col("n"))
    return o.select(key, "n", *((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * part(q)).alias(name) for name, q in qs.items()))


def latency_p99(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: count and mean of positive values, and both nearest-rank variants of the 99th percentile."""
    held = lambda shift: lambda n: F.greatest(F.lit(0), F.least(n - 1, F.floor(n * 0.99) + shift))
    o = order_statistics(df.where(F.col(value) > 0), key, value, {"p99_low": (0.99, held(-1)), "p99_high": (0.99, held(0))})
    return o.select(key, "n", (F.col("total") / F.col("n")).alias("mean"), "p99_low", "p99_high")


def histogram(df: DataFrame, key: str, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts at or below each bound, the count, sum and mean."""
    le = [F.sum((F.col(value) <= b).cast("long")).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return df.groupBy(key).agg(*le, F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def slo(df: DataFrame, key: str, good: Column, target: float) -> DataFrame:
    """Compliance, used part of the error budget, burn rate and the first alert threshold that it crosses."""
    a = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(good.cast("long")).alias("good"))
    share = F.when(F.col("n") > 0, F.col("good") / F.col("n")).otherwise(1.0)
    burn = (1 - share) / (1 - target)
    alert = F.when(burn >= 14.4, "page").when(burn >= 6, "ticket").when(burn >= 3, "watch").otherwise("none")
    return a.select(key, "n", F.round(share, 6).alias("compliance"), F.round(burn, 6).alias("burn"), alert.alias("alert"))


def decayed_mean(df: DataFrame, key: str, rating: Column, age_hours: Column, half_life: float, least: int) -> DataFrame:
    """Mean with weights 2^(-age / half-life); null below the least number of signals."""
    w = F.pow(F.lit(2.0), -age_hours / half_life)
    a = df.select(key, rating.alias("r"), w.alias("w")).groupBy(key).agg(F.count("*").alias("n"), (F.sum(F.col("r") * F.col("w")) / F.sum("w")).alias("m"))
    return a.select(key, "n", F.when(F.col("n") >= least, F.col("m")).alias("decayed_mean"))


def beta_estimates(df: DataFrame, key: str, rating: Column) -> DataFrame:
    """Beta posterior of ratings in [-1, 1] from (1, 1): mean, variance and a 95 % interval."""
    a = df.select(key, rating.alias("r")).groupBy(key).agg((1 + F.sum(F.greatest("r", F.lit(0.0)))).alias("alpha"), (1 + F.sum(F.greatest(-F.col("r"), F.lit(0.0)))).alias("beta"))
    s = F.col("alpha") + F.col("beta")
    mean, var = F.col("alpha") / s, F.col("alpha") * F.col("beta") / (s * s * (s + 1))
    return a.select(key, "alpha", "beta", mean.alias("mean"), var.alias("variance"), F.greatest(F.lit(0.0), mean - 1.96 * F.sqrt(var)).alias("low"), F.least(F.lit(1.0), mean + 1.96 * F.sqrt(var)).alias("high"))


def k_anonymity(df: DataFrame, quasi: str, sensitive: Column) -> DataFrame:
    """Per quasi-identifier value: rows and distinct sensitive values (null counts as one)."""
    d = df.select(quasi, F.coalesce(sensitive.cast("string"), F.lit("\0null")).alias("s"))
    return d.groupBy(quasi, "s").agg(F.count("*").alias("c")).groupBy(quasi).agg(F.sum("c").alias("k"), F.count("*").alias("l"))


def welch(df: DataFrame, variant: str, value: str) -> DataFrame:
    """Pairs of variants: t, degrees of freedom and Cohen's d, with population variances."""
    a = df.groupBy(variant).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    side = lambda p: a.select(*(F.col(c).alias(f"{p}_{c}") for c in a.columns))
    # as many rows as there are variants, on both sides
    p = side("a").join(side("b"), F.col(f"a_{variant}") < F.col(f"b_{variant}"))
    qa, qb = F.col("a_var") / F.col("a_n"), F.col("b_var") / F.col("b_n")
    t = (F.col("a_mean") - F.col("b_mean")) / F.sqrt(qa + qb)
    df_ = F.pow(qa + qb, F.lit(2)) / (qa * qa / (F.col("a_n") - 1) + qb * qb / (F.col("b_n") - 1))
    d = (F.col("a_mean") - F.col("b_mean")) / F.sqrt((F.col("a_var") + F.col("b_var")) / 2)
    return p.select(f"a_{variant}", f"b_{variant}", t.alias("t"), df_.alias("df"), d.alias("cohen_d"))


def counter(rows: DataFrame, labels: Column, increment: str) -> DataFrame:
    """(labels, total) of a counter. A negative increment raises, as counters only grow."""
    grown = F.when(F.col(increment) < 0, F.raise_error(F.lit("a counter can't fall")).cast("double")).otherwise(F.col(increment))
    return rows.groupBy(labels.alias("labels")).agg(F.sum(grown).alias("total"))
