"""Structured Streaming jobs: learner state, windows, sessions, change logs, fan-out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.learner import BKT

TRACED = "learner long, kp string, attempts long, correct_count long, mastery double, rejected long"
_STATE = "learner array<long>, kp array<string>, attempts array<long>, correct_count array<long>, mastery array<double>, last_ts array<long>, rejected array<long>"
#: Groups that keys are dealt to by a hash; a group's keys are traced, and their states kept, together.
GROUPS = 512
#: From so few keys on with further answers each goes through the rest of its own.
_FEW = 16
_NONE = np.iinfo("int64").min  # no time


def bkt_update(p: float, correct: bool) -> float:
    """One answer: posterior of mastery, then the chance to learn."""
    s, g, t = BKT["p_s"], BKT["p_g"], BKT["p_t"]
    num = p * (1 - s) if correct else p * s
    den = num + (1 - p) * (g if correct else 1 - g)
    post = p if den <= 1e-12 else num / den
    return min(1.0, max(0.0, post + (1 - post) * t))


def _fold(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, correct: np.ndarray) -> np.ndarray:
    """p after the answers from starts to ends of each key, an answer of all keys at a time."""
    s, g, t = BKT["p_s"], BKT["p_g"], BKT["p_t"]
    p, at, on = p.copy(), starts.copy(), np.flatnonzero(starts < ends)
    while len(on) > _FEW:
        q, c = p[on], correct[at[on]]
        num = np.where(c, q * (1 - s), q * s)
        den = num + (1 - q) * np.where(c, g, 1 - g)
        post = np.where(den <= 1e-12, q, num / np.maximum(den, 1e-12))
        p[on] = np.clip(post + (1 - post) * t, 0.0, 1.0)
        at[on] += 1
        on = on[at[on] < ends[on]]
    for k in on.tolist():
        x = float(p[k])
        for c in correct[at[k] : ends[k]].tolist():
            x = bkt_update(x, c)
        p[k] = x
    return p


def trace(answers: DataFrame) -> DataFrame:
    """Mastery of each (learner, kp) after every micro-batch, in update mode.

    Within a batch answers are taken in the order of (ts, event_id). An answer older than the last one of its key is
    rejected and counted; one of equal time is accepted. Answers need learner, kp, ts, event_id and correct. The states
    of a group's keys (one of GROUPS) are arrays, so a batch costs a call a group and not a call a key.
    """
    names = ["learner", "kp", "attempts", "correct_count", "mastery", "last_ts", "rejected"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        us = rows.ts.astype("datetime64[us]")
        rows["at"] = np.where(us.isna(), _NONE, us.astype("int64"))
        rows["right"] = [c is not None and bool(c) for c in rows.correct.tolist()]
        rows["no_time"] = us.isna()
        old = pd.DataFrame(dict(zip(names, state.get, strict=True))) if state.exists else pd.DataFrame({n: pd.Series(dtype="object" if n in ("learner", "kp") else "int64") for n in names})
        both = pd.concat([old[["learner", "kp"]], rows[["learner", "kp"]]])
        code, kept = pd.MultiIndex.from_frame(both.astype("object")).factorize()
        keys, before = len(kept), len(old)

        def full(name, start, kind):
            out = np.full(keys, start, kind)
            out[:before] = old[name].to_numpy(kind)
            return out

        attempts, right, rejected = (full(c, 0, "int64") for c in ("attempts", "correct_count", "rejected"))
        p, last = full("mastery", BKT["p_l0"], "float64"), full("last_ts", _NONE, "int64")
        rows["code"] = code[before:]
        rows = rows.sort_values(["code", "no_time", "at", "event_id"])
        of, at, correct = rows.code.to_numpy(), rows["at"].to_numpy(), rows.right.to_numpy(bool)
        touched = np.unique(of)
        late = (at < last[of]) & ~rows.no_time.to_numpy()
        rejected += np.bincount(of[late], minlength=keys)
        of, at, correct = of[~late], at[~late], correct[~late]
        ends = np.cumsum(np.bincount(of, minlength=keys))
        starts = np.concatenate([[0], ends[:-1]])
        p = _fold(p, starts, ends, correct)
        attempts, right = attempts + ends - starts, right + np.bincount(of[correct], minlength=keys)
        new = ends > starts
        last[new] = at[ends[new] - 1]
        learner, kp = (kept.get_level_values(k).tolist() for k in (0, 1))
        learner = [None if x is None or x != x else int(x) for x in learner]
        kp = [None if x is None or x != x else x for x in kp]
        state.update((learner, kp, attempts.tolist(), right.tolist(), p.tolist(), last.tolist(), rejected.tolist()))
        out = pd.DataFrame({"learner": pd.array(learner, "Int64"), "kp": kp, "attempts": attempts, "correct_count": right, "mastery": p, "rejected": rejected})
        yield out.iloc[touched]

    typed = answers.select("learner", "kp", F.col("ts").cast("timestamp").alias("ts"), "event_id", "correct", F.pmod(F.hash("learner", "kp"), F.lit(GROUPS)).alias("group"))
    return typed.groupBy("group").applyInPandasWithState(step, TRACED, _STATE, "update", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, good: Column, size: str = "1 day", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, n, good) of event-time windows; each is emitted once the watermark passes its end."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum(good.cast("long")).alias("good")).select(F.col("w.start").alias("start"), "n", "good")


def sessions(events: DataFrame, key: str, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of sessions that end after an idle gap."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = e.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of each key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def topics(events: DataFrame, routes: dict[str, Column]) -> DataFrame:
    """Fan-out: a copy of each event for every route whose predicate holds, with its name in topic."""
    names = F.array_compact(F.array(*(F.when(p, F.lit(name)) for name, p in routes.items())))
    return events.select("*", F.explode(names).alias("topic"))


def arms(feedback: DataFrame) -> DataFrame:
    """Bandit state: per arm pulls, mean reward and the Beta parameters of rewards in [0, 1]; complete or update mode."""
    return feedback.groupBy("arm").agg(F.count("*").alias("pulls"), F.avg("reward").alias("mean"), (1 + F.sum("reward")).alias("alpha"), (1 + F.sum(1 - F.col("reward"))).alias("beta"))


def run_all(df: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Drains what is there into Parquet under path; update-mode batches are kept with their number (batch)."""

    def write(batch: DataFrame, number: int) -> None:
        (each(batch, number) if each else batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/run={number}")

    w = df.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    w = w.format("parquet").option("path", f"{path}/out").outputMode("append") if mode == "append" else w.outputMode(mode).foreachBatch(write)
    q = w.start()
    q.awaitTermination()
