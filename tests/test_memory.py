"""Memory events of a stream against a plain replay."""

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import jobs, memory

T0 = 1_700_000_000


def streamed(spark, tmp_path, parts, similar, **k):
    schema = "learner string, kp string, ts timestamp, event_id long, correct boolean, difficulty double"
    at = f"{tmp_path}/{uuid.uuid4().hex}"
    for i, rows in enumerate(parts):
        df = spark.createDataFrame([(a, b, float(t), e, c, d) for a, b, t, e, c, d in rows], schema.replace("timestamp", "double"))
        df.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    with memory.keyed_state(spark):
        jobs.run_all(memory.remember(stream, similar, **k), at)
    return spark.read.schema(memory.OUT).parquet(f"{at}/out").toPandas()


def replay(rows, similar, capacity=7, idle=21600.0):
    """Each learner's answers in order, with dictionaries."""
    points, working, last, out = {}, {}, {}, {}
    for who, kp, ts, event_id, correct, difficulty in sorted(rows, key=lambda r: (r[2], r[3])):
        moved = 0
        held = working.setdefault(who, [])
        if who in last and ts - last[who] > idle:
            moved, held[:] = len(held), []
        held.append(event_id)
        while len(held) > capacity:
            held.pop(0)
            moved += 1
        last[who] = ts
        grade = (4 if difficulty < 0.3 else 3) if correct else (2 if difficulty < 0.7 else 1)
        p, r = points.get((who, kp)), 1.0
        if p is None:
            p = {"s": {1: 0.4, 2: 1.2, 3: 3.0, 4: 7.0}[grade], "d": {1: 8.5, 2: 7.0, 3: 5.5, 4: 4.0}[grade], "n": 0, "l": 0}
        else:
            days = (ts - p["at"]) / 86400
            r = (1 + (0.9**-2 - 1) * days / p["s"]) ** -0.5 if days > 0 else 1.0
            d = min(10, max(1, 0.55 + 0.9 * (p["d"] - (grade - 3) * (10 - p["d"]) / 9)))
            s = 0.3 * p["s"] if grade == 1 else p["s"] * (1 + (11 - d) / 10 * r) * {2: 0.8, 3: 1, 4: 1.3}[grade]
            p = {"s": max(0.1, s), "d": d, "n": p["n"], "l": p["l"] + (grade == 1)}
        p |= {"n": p["n"] + 1, "at": ts}
        points[who, kp] = p
        for other, x in similar.get(kp, ()):
            q = points.get((who, other))
            if q:
                q["s"] = max(0.1, q["s"] * (1 - 0.2 * x * math.exp(-(ts - q["at"]) / 86400 / 30)))
        out[event_id] = (who, kp, grade, p["s"], p["d"], r, p["n"], p["l"], moved, difficulty >= 0.7 or p["n"] >= 3)
    return out


def test_stream_equals_replay(spark, tmp_path):
    r = random.Random(5)
    rows = sorted((f"u{r.randrange(4)}", r.choice("abcd"), T0 + r.randrange(40 * 86400), i, r.random() < 0.6, r.random()) for i in range(240))
    rows.sort(key=lambda x: x[2])
    similar = {"a": [("b", 0.8), ("c", 0.2)], "b": [("a", 0.5)], "d": [("d", 0.0)]}
    want = replay(rows, similar, capacity=3)
    for parts in ([rows], [rows[:100], rows[100:]]):
        got = streamed(spark, tmp_path, parts, similar, capacity=3, idle=6 * 3600.0, late="100 days")
        got = got[got.event_id.notna()]
        assert len(got) == len(want)
        for x in got.itertuples(index=False):
            w = want[x.event_id]
            assert (x.learner, x.kp, x.grade, x.reps, x.lapses, x.moved, x.long_term) == (w[0], w[1], w[2], w[6], w[7], w[8], w[9])
            assert (x.stability, x.difficulty, x.retrievability) == pytest.approx((w[3], w[4], w[5]))


def test_idle_learners_are_emptied_by_a_timer(spark, tmp_path):
    rows = [[("u", "a", T0 + i, i, True, 0.5) for i in range(4)], [("v", "a", T0 + 10 * 86400, 10, True, 0.5)], [("v", "a", T0 + 20 * 86400, 11, True, 0.5)]]
    got = streamed(spark, tmp_path, rows, {}, idle=3600.0, late="1 second")
    emptied = got[got.event_id.isna()]
    assert ("u", 4) in set(zip(emptied.learner, emptied.moved, strict=True))


def test_interference():
    """None without similarity; the stronger, the more similar and the closer in time."""
    point, _ = memory.reviewed(None, 3, True, 0.0)
    s = lambda x, days: memory.interfered(point, x, days * 86400)[0]
    assert s(0.0, 1) == point[0]
    assert s(0.9, 0) < s(0.9, 30) < point[0]
    assert s(0.9, 1) < s(0.2, 1) < point[0]
    assert memory.interfered((0.1, *point[1:]), 1.0, 0.0)[0] == 0.1


def test_grades():
    assert [memory.grade_of(c, d) for c, d in ((True, 0.2), (True, 0.3), (False, 0.69), (False, 0.7))] == [4, 3, 2, 1]
