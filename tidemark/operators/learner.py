"""Ordered folds of learner histories, and the closed forms of learner models."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import fold_segments, fold_stream

# Parameters of knowledge tracing and weights of the review scheduler.
BKT = {"p_l0": 0.5, "p_t": 0.1, "p_s": 0.2, "p_g": 0.1}
FSRS = [0.40255, 1.18385, 3.173, 15.69105, 7.1949, 0.5345, 1.4604, 0.0046, 1.54575, 0.1192, 1.01925, 1.9395, 0.11, 0.29605, 2.2698, 0.2315, 2.9898, 0.51655, 0.6621, 0.8285, 0.12]
FSRS_DECAY = -FSRS[20]
FSRS_FACTOR = 0.9 ** (1 / FSRS_DECAY) - 1


def ordered(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row per key with the array of its rows in order. A key's rows are one learner's history."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *values))).alias("history"))


def traced(answers: DataFrame, keys: list[str], t=BKT["p_t"]) -> DataFrame:
    """(keys, attempts, correct_count, mastery, log_likelihood) of answers in order, merged from the days of each key.

    Tracing is a hidden chain of two states, so an answer is the matrix ((a, b), (0, d)) on the chances of having mastered
    the point or not, and days are products of them. Each is held with its largest entry at 1 and the logarithm of the
    rest. Slip and guess lie strictly between 0 and 1. `t` may be a column of keys.
    """
    s, g, p0 = BKT["p_s"], BKT["p_g"], BKT["p_l0"]
    t = t if isinstance(t, Column) else F.lit(t)

    def scaled(a, b, d, log, n, right):
        top = F.greatest(a, b, d)
        return F.struct((a / top).alias("a"), (b / top).alias("b"), (d / top).alias("d"), (log + F.log(top)).alias("log"), n.alias("n"), right.alias("right"))

    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("d"), F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("right"))

    def step(m, x):
        knows, lacks = F.when(x["correct"], 1 - s).otherwise(s), F.when(x["correct"], g).otherwise(1 - g)
        return scaled(knows * m["a"], knows * m["b"] + t * lacks * m["d"], (1 - t) * lacks * m["d"], m["log"], m["n"] + 1, m["right"] + F.when(x["correct"], 1).otherwise(0))

    def merge(m, x):
        p = x["part"]
        return scaled(p["a"] * m["a"], p["a"] * m["b"] + p["b"] * m["d"], p["d"] * m["d"], m["log"] + p["log"], m["n"] + p["n"], m["right"] + p["right"])

    days = fold_segments(answers, keys, ["ts", "event_id"], ["correct"], lambda rows: F.aggregate(rows, one, step))
    m = days.select(*keys, F.aggregate("parts", one, merge).alias("m"))
    known, unknown = F.col("m.a") * p0 + F.col("m.b") * (1 - p0), F.col("m.d") * (1 - p0)
    return m.select(*keys, F.col("m.n").alias("attempts"), F.col("m.right").alias("correct_count"), (known / (known + unknown)).alias("mastery"), (F.col("m.log") + F.log(known + unknown)).alias("log_likelihood"))


def knowledge_tracing(answers: DataFrame) -> DataFrame:
    """(learner, kp, attempts, correct_count, mastery) after all answers."""
    return traced(answers, ["learner", "kp"]).drop("log_likelihood")


def bkt_likelihood(answers: DataFrame) -> DataFrame:
    """(learner, kp, log_likelihood): of the answers, given the chances before each."""
    return traced(answers, ["learner", "kp"]).select("learner", "kp", "log_likelihood")


def first_difficulty(grade) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), FSRS[4] - F.exp(FSRS[5] * (grade - 1)) + 1))


def review_schedule(reviews: DataFrame) -> DataFrame:
    """(learner, kp, stability, difficulty, reps, lapses, interval) after reviews (learner, kp, day, event_id, grade).

    Stability stays below the longest interval (36500 days): same-day reviews would otherwise square it.
    """
    w = FSRS
    h = ordered(reviews, ["learner", "kp"], ["day", "event_id"], ["grade"])
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("d"), F.lit(0.0).alias("day"), F.lit(0).alias("reps"), F.lit(0).alias("lapses"))

    def step(a, x):
        grade, new = x["grade"], a["reps"] == 0
        elapsed = F.greatest(F.lit(0.0), x["day"] - a["day"])
        s = F.greatest(a["s"], F.lit(0.1))
        r = F.pow(1 + FSRS_FACTOR * elapsed / s, F.lit(FSRS_DECAY))
        d = a["d"] - w[6] * (grade - 3) * (10 - a["d"]) / 9
        d = F.greatest(F.lit(1.0), F.least(F.lit(10.0), w[7] * first_difficulty(F.lit(4)) + (1 - w[7]) * d))
        short = w[17] * (F.pow(s, F.lit(w[18])) - s) * (1 - w[19] * s) + s
        short = F.when(grade >= 3, F.greatest(short, s)).otherwise(short)
        lapse = F.least(w[11] * F.pow(d, F.lit(-w[12])) * (F.pow(s + 1, F.lit(w[13])) - 1) * F.exp((1 - r) * w[14]), s)
        recall = s * (1 + math.exp(w[8]) * (11 - d) * F.pow(s, F.lit(-w[9])) * F.exp(-w[10] * (1 - r)) - 1) * F.when(grade == 2, w[15]).otherwise(1.0) * F.when(grade == 4, w[16]).otherwise(1.0)
        later = F.when(elapsed < 1, short).when(grade == 1, lapse).otherwise(recall)
        first = F.element_at(F.array(*map(F.lit, w[:4])), grade)
        return F.struct(
            F.least(F.lit(36500.0), F.greatest(F.lit(0.1), F.when(new, first).otherwise(later))).alias("s"), F.when(new, first_difficulty(grade)).otherwise(d).alias("d"), x["day"].alias("day"), (a["reps"] + 1).alias("reps"), (a["lapses"] + F.when(~new & (grade == 1), 1).otherwise(0)).alias("lapses")
        )

    f = h.select("learner", "kp", F.aggregate("history", start, step).alias("f"))
    interval = F.least(F.lit(36500), F.greatest(F.lit(1), F.bround(F.col("f.s") * ((0.9 ** (1 / FSRS_DECAY) - 1) / FSRS_FACTOR)).cast("int")))
    return f.select("learner", "kp", F.col("f.s").alias("stability"), F.col("f.d").alias("difficulty"), F.col("f.reps").cast("long").alias("reps"), F.col("f.lapses").cast("long").alias("lapses"), interval.cast("long").alias("interval"))


def ema(df: DataFrame, key: str, order: list[str], value: str, rate: float) -> DataFrame:
    """(key, ema): previous + rate * (value - previous), from the first value on. A day is the map x -> keep * x + add."""
    none = F.struct(F.lit(1.0).alias("keep"), F.lit(0.0).alias("add"))

    def day(rows):
        m = F.aggregate(rows, none, lambda m, x: F.struct((m["keep"] * (1 - rate)).alias("keep"), (m["add"] * (1 - rate) + rate * x[value]).alias("add")))
        return F.struct(rows[0][value].cast("double").alias("first"), m.alias("m"))

    parts = fold_segments(df, [key], order, [value], day)
    out = F.aggregate("parts", F.col("parts")[0]["part"]["first"], lambda e, x: x["part"]["m"]["keep"] * e + x["part"]["m"]["add"])
    return parts.select(key, out.alias("ema"))


def raw_level(theta: Column, mastery: Column) -> Column:
    return F.when((theta < -0.5 - 1e-9) | (mastery < 0.4 - 1e-9), "beginner").when((theta >= 0.5 - 1e-9) & (mastery >= 0.7 - 1e-9), "advanced").otherwise("intermediate")


def next_level(previous: Column, theta: Column, mastery: Column) -> Column:
    """A level with a dead band of 0.25 in ability and 0.10 in mastery around each boundary."""
    up = F.when((theta >= -0.25) & (mastery >= 0.5), "intermediate").otherwise("beginner")
    down = F.when((theta < 0.25) | (mastery < 0.6), "intermediate").otherwise("advanced")
    middle = F.when((theta >= 0.75) & (mastery >= 0.8), "advanced").when((theta < -0.75) | (mastery < 0.3), "beginner").otherwise("intermediate")
    return F.when(previous == "beginner", up).when(previous == "advanced", down).otherwise(middle)


def drift(df: DataFrame, key: str, order: list[str], value: str, least: int = 5, delta: float = 0.05) -> DataFrame:
    """Per key the split of the sequence with the largest gap between both means, and whether it exceeds its bound."""
    by = Window.partitionBy(key)
    s = df.withColumn("i", F.row_number().over(by.orderBy(*order))).withColumn("n", F.count("*").over(by)).withColumn("sum", F.sum(value).over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum(value).over(by))
    s = s.where((F.col("i") >= least) & (F.col("n") - F.col("i") >= least))
    gap = F.abs(F.col("sum") / F.col("i") - (F.col("all") - F.col("sum")) / (F.col("n") - F.col("i")))
    best = s.groupBy(key).agg(F.max(F.struct(gap.alias("gap"), (-F.col("i")).alias("i"), F.col("n").alias("n"))).alias("b"))
    split = -F.col("b.i")
    bound = F.sqrt(F.log(F.lit(4.0 / delta)) / (2 * F.least(split, F.col("b.n") - split)))
    return best.select(key, split.cast("long").alias("split"), F.col("b.gap").alias("gap"), (F.col("b.gap") > bound).alias("drift"))


GRID = np.linspace(-3.0, 3.0, 61)


def eap_step(theta: float, se: float, a: float, b: float, c: float, correct: bool) -> tuple[float, float]:
    """Posterior mean and deviation of ability on the grid, from a normal prior and one answer."""
    prior = np.exp(-0.5 * ((GRID - theta) / max(se, 1e-9)) ** 2)
    p = np.clip(c + (1 - c) / (1 + np.exp(-a * (GRID - b))), 1e-9, 1 - 1e-9)
    post = prior * (p if correct else 1 - p)
    total = post.sum()
    if total <= 0:
        return theta, se
    post = post / total
    mean = float((GRID * post).sum())
    return min(3.0, max(-3.0, mean)), float(np.sqrt(max(0.0, ((GRID - mean) ** 2 * post).sum())))


def ability(answers: DataFrame) -> DataFrame:
    """(learner, theta, se, n): online ability of each learner; answers have learner, ts, event_id, a, b, c, correct."""

    def step(state, a, b, c, correct):
        theta, se, n = state
        return (*eap_step(theta, se, a, b, c, bool(correct)), n + 1)

    kinds = {"theta": ("double", pa.float64()), "se": ("double", pa.float64()), "n": ("long", pa.int64())}
    return fold_stream(answers, "learner", ["ts", "event_id"], ["a", "b", "c", "correct"], (0.0, 1.0, 0), step, kinds)


def p_correct(theta: Column, a: Column, b: Column, c, d=1.0) -> Column:
    return c + (d - c) / (1 + F.exp(-a * (theta - b)))


def information(theta: Column, a: Column, b: Column, c) -> Column:
    """Fisher information of a three-parameter item."""
    p = p_correct(theta, a, b, c)
    return a * a * F.pow((p - c) / (1 - c), F.lit(2.0)) * (1 - p) / p
