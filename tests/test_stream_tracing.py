"""Traced keys are those of a fold of each key, over batches with late answers and answers without time or result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import jobs

SCHEMA = "learner long, kp string, ts timestamp, event_id long, correct boolean"


def test_groups_equal_single_keys(spark, tmp_path):
    r = random.Random(3)
    day = lambda n, k: dt.datetime(2024, 1, 1 + n, 1) + dt.timedelta(minutes=k)
    want, seen = {}, {}
    for n in range(2):
        rows = [(r.randint(1, 30), r.choice("ab"), day(r.choice([n, n, 0]), r.randint(0, 50)), 1000 * n + k, r.choice([True, False, None])) for k in range(400)]
        rows += [(99, "a", day(n, k // 2), 5000 + 1000 * n + k, k % 3 == 0) for k in range(300)]  # one key with many answers
        rows += [(None, "a", day(n, 1), 9000 + n, True), (7, None, day(n, 2), 9100 + n, True), (7, "a", None, 9200 + n, True)]
        # a last answer without time lets all later ones in
        for k in sorted({x[:2] for x in rows}, key=str):
            a, c, p, last, late = seen.get(k, (0, 0, jobs.BKT["p_l0"], None, 0))
            for _, _, ts, _, ok in sorted((x for x in rows if x[:2] == k), key=lambda x: (x[2] is None, x[2] or dt.datetime.min, x[3])):
                if last is not None and ts is not None and ts < last:
                    late += 1
                    continue
                a, c, p, last = a + 1, c + bool(ok), jobs.bkt_update(p, bool(ok)), ts
            seen[k] = (a, c, p, last, late)
            want[(n, *k)] = (a, c, p, late)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={n}"))
        s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "b=*"))
        jobs.run_all(jobs.trace(s), str(tmp_path / "w"), "update")
    got = spark.read.schema(f"{jobs.TRACED}, batch int").parquet(str(tmp_path / "w" / "out")).collect()
    assert len(got) == len(want)
    for x in got:
        a, c, p, late = want[(x.batch, x.learner, x.kp)]
        assert (x.attempts, x.correct_count, x.rejected) == (a, c, late) and x.mastery == pytest.approx(p, abs=1e-12)


def test_calls_do_not_grow_with_keys(spark):
    rows = spark.range(5000).select(F.col("id").alias("learner"), F.lit("a").alias("kp"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), F.lit(True).alias("correct"))
    plan = jobs.trace(rows)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "AS group" in plan and jobs.GROUPS <= 1024
