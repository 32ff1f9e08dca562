"""Memory of learners as keyed state: points with stability, a bounded working memory, interference between points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# First stability and difficulty by grade 1 to 4, and the constants of later reviews.
FIRST_STABILITY = {1: 0.4, 2: 1.2, 3: 3.0, 4: 7.0}
FIRST_DIFFICULTY = {1: 8.5, 2: 7.0, 3: 5.5, 4: 4.0}
MEAN_DIFFICULTY, REVERT = 5.5, 0.1
LAPSE, HARD, EASY = 0.3, 0.8, 1.3
DECAY = 0.5
FACTOR = 0.9 ** (-1 / DECAY) - 1
MAX_REDUCTION, TIME_SCALE = 0.2, 30.0
IMPORTANT, REPEATED = 0.7, 3
CAPACITY = 7
DAY = 86400.0

POINT = "stability double, difficulty double, reps int, lapses int, right int, last double"
OUT = "learner string, kp string, event_id long, grade int, stability double, difficulty double, retrievability double, reps int, lapses int, moved int, long_term boolean"


def grade_of(correct: bool, difficulty: float) -> int:
    """4 easy, 3 good, 2 hard, 1 again."""
    return (4 if difficulty < 0.3 else 3) if correct else (2 if difficulty < 0.7 else 1)


def retrievability(days: float, stability: float) -> float:
    return 1.0 if days <= 0 or stability <= 0 else min(1.0, max(0.0, (1 + FACTOR * days / stability) ** -DECAY))


def reviewed(point: tuple | None, grade: int, correct: bool, ts: float) -> tuple[tuple, float]:
    """The point after a review, and how retrievable it was before."""
    if point is None:
        return (FIRST_STABILITY[grade], FIRST_DIFFICULTY[grade], 1, 0, int(correct), ts), 1.0
    s, d, reps, lapses, right, last = point
    r, s = retrievability(max(0.0, ts - last) / DAY, s), max(s, 0.1)
    d = min(10.0, max(1.0, REVERT * MEAN_DIFFICULTY + (1 - REVERT) * (d - (grade - 3) * (10 - d) / 9)))
    s = s * LAPSE if grade == 1 else s * (1 + (11 - d) / 10 * r) * {2: HARD, 4: EASY}.get(grade, 1.0)
    return (max(0.1, s), d, reps + 1, lapses + (grade == 1), right + int(correct), ts), r


def interfered(point: tuple, similarity: float, ts: float) -> tuple:
    """The point after another, similar one was learned: the less stable, the more similar and the more recent it is."""
    lost = similarity * math.exp(-max(0.0, ts - point[5]) / DAY / TIME_SCALE) * MAX_REDUCTION
    return (max(0.1, point[0] * (1 - lost)), *point[1:]) if lost > 0 else point


class Memory(StatefulProcessor):
    """Per learner a map of points, a list of what the working memory holds, and the time of the last event.

    Answers of a batch are taken in the order of (ts, event_id). The working memory holds capacity answers; the oldest
    moves to the short-term memory when another comes, and all do once the learner was idle: at the next answer or, by
    an event-time timer, when the watermark has passed. Points that aren't touched for ttl_ms (if any) are forgotten.
    """

    def __init__(self, similar: dict[str, list[tuple[str, float]]], capacity: int = CAPACITY, idle: float = DAY / 4, ttl_ms: int | None = None):
        self.similar, self.capacity, self.idle, self.ttl_ms = similar, capacity, idle, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getMapState("points", "kp string", POINT, self.ttl_ms)
        self.working = handle.getListState("working", "event_id long")
        self.last = handle.getValueState("last", "ts double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        seen: dict[str, tuple | None] = {}

        def point(kp: str) -> tuple | None:
            if kp not in seen:
                seen[kp] = tuple(self.points.getValue((kp,))) if self.points.containsKey((kp,)) else None
            return seen[kp]

        working = [r[0] for r in self.working.get()] if self.working.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for ts, event_id, kp, correct, difficulty in zip(batch.ts.astype("int64") / 1e9 if batch.ts.dtype.kind == "M" else batch.ts, batch.event_id, batch.kp, batch.correct, batch.difficulty, strict=True):
            moved = len(working) if last is not None and ts - last > self.idle else 0
            working = working[moved:] + [int(event_id)]
            moved += max(0, len(working) - self.capacity)
            working, last = working[-self.capacity :], max(ts, last or ts)
            difficulty = min(1.0, max(0.0, difficulty))
            grade = grade_of(bool(correct), difficulty)
            seen[kp], r = reviewed(point(kp), grade, bool(correct), ts)
            for other, similarity in self.similar.get(kp, ()):
                if point(other) is not None:
                    seen[other] = interfered(seen[other], similarity, ts)
            p = seen[kp]
            out.append((key[0], kp, int(event_id), grade, p[0], p[1], r, p[2], p[3], moved, difficulty >= IMPORTANT or p[2] >= REPEATED))
        for kp, p in seen.items():
            if p is not None:
                self.points.updateValue((kp,), p)
        self.working.put([(x,) for x in working])
        self.last.update((last,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((last + self.idle) * 1000))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = len(list(self.working.get())) if self.working.exists() else 0
        self.working.clear()
        row = (key[0], None, None, None, None, None, None, None, None, held, None)
        frame = pd.DataFrame([row] if held else [], columns=[f.split()[0] for f in OUT.split(", ")])
        yield frame.astype({c: "Int64" for c in ("event_id",)} | {c: "Int32" for c in ("grade", "reps", "lapses", "moved")} | {c: "float64" for c in ("stability", "difficulty", "retrievability")} | {"long_term": "boolean"})

    def close(self) -> None:
        pass


def remember(answers: DataFrame, similar: dict[str, list[tuple[str, float]]], capacity: int = CAPACITY, idle: float = DAY / 4, ttl_ms: int | None = None, late: str = "10 minutes") -> DataFrame:
    """A stream of memory events from answers (learner, kp, ts, event_id, correct, difficulty), in append mode.

    One row per answer; and one without an answer for each learner whose working memory was emptied by its timer.
    similar: for each point those that learning it disturbs, with a similarity; a rule list that goes to every task.
    Needs the RocksDB state store, see keyed_state().
    """
    a = answers.select(F.col("learner").cast("string").alias("learner"), "kp", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.col("correct").cast("boolean").alias("correct"), F.col("difficulty").cast("double").alias("difficulty"))
    a = a.withWatermark("ts", late)
    return a.groupBy("learner").transformWithStateInPandas(Memory(similar, capacity, idle, ttl_ms), OUT, "append", "EventTime")


class keyed_state:  # noqa: N801
    """With this, streams that are started keep their state in RocksDB, which maps, lists and timers need."""

    NAME = "spark.sql.streaming.stateStore.providerClass"
    ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.NAME, None)
        self.spark.conf.set(self.NAME, self.ROCKS)

    def __exit__(self, *_):
        self.spark.conf.set(self.NAME, self.before) if self.before else self.spark.conf.unset(self.NAME)
