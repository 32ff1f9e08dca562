"""Estimators of item response models against numpy."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import estimation as E


def drawn(seed, learners, items, c=0.0):
    r = random.Random(seed)
    theta = {f"u{i:02}": r.gauss(0, 1) for i in range(learners)}
    item = {f"i{j:02}": (r.uniform(0.7, 1.8), r.gauss(0, 1), c) for j in range(items)}
    return theta, item, [(u, i, *item[i], r.random() < item[i][2] + (1 - item[i][2]) / (1 + math.exp(-item[i][0] * (t - item[i][1])))) for u, t in theta.items() for i in item]


def log_likelihood(theta, rows):
    p = np.clip([c + (1 - c) / (1 + math.exp(-a * (theta - b))) for _, _, a, b, c, _ in rows], 1e-9, 1 - 1e-9)
    return float(np.log(np.where([x[-1] for x in rows], p, 1 - p)).sum())


def frame(spark, rows):
    return spark.createDataFrame(rows, "learner string, item string, a double, b double, c double, correct boolean")


@pytest.mark.parametrize("sd", [None, 1.0])
def test_most_likely_ability(spark, sd):
    theta, _, rows = drawn(1, 12, 15, 0.1)
    rows += [("all", f"i{k}", 1.2, 0.1 * k, 0.0, True) for k in range(5)] + [("none", f"i{k}", 1.2, 0.1 * k, 0.0, False) for k in range(5)]
    got = {r.learner: r for r in E.ability_likelihood(frame(spark, rows), sd).collect()}
    grid = np.linspace(-3, 3, 6001)
    for u in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == u]
        best = max(log_likelihood(x, own) - (0 if sd is None else x * x / 2) for x in grid[::10])
        here = log_likelihood(got[u].theta, own) - (0 if sd is None else got[u].theta ** 2 / 2)
        assert here >= best - 1e-4, (u, got[u].theta)
        assert got[u].n == len(own) and got[u].se > 0
    if sd is None:
        assert got["all"].theta == 3.0 and got["none"].theta == -3.0
    else:
        assert abs(got["all"].theta) < 2


def test_quadrature(spark):
    _, _, rows = drawn(2, 6, 8, 0.2)
    x, w = np.polynomial.hermite_e.hermegauss(21)
    for r in E.ability_quadrature(frame(spark, rows)).collect():
        own = [y for y in rows if y[0] == r.learner]
        post = np.array([math.exp(log_likelihood(t, own)) for t in x]) * w
        post /= post.sum()
        mean = (post * x).sum()
        assert (r.theta, r.se) == pytest.approx((mean, math.sqrt((post * (x - mean) ** 2).sum())))


def plain_items(rows, rounds, tolerance=1e-4):
    """Alternating maximisation on one machine, items by a search of their own."""
    users, names = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    y = np.zeros((len(users), len(names)))
    for r in rows:
        y[users.index(r[0]), names.index(r[1])] = r[-1]
    x, w = np.polynomial.hermite_e.hermegauss(21)
    w = w / w.sum()
    share = y.mean(0)
    a, b = np.ones(len(names)), np.clip(-np.log(np.maximum(share, 0.01) / np.maximum(1 - share, 0.01)), -4, 4)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a[:, None] * (x - b[:, None])))
        log = y @ np.log(p) + (1 - y) @ np.log(1 - p) + np.log(w)
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        r, m = y.T @ post, np.ones_like(y).T @ post
        old = a.copy(), b.copy()
        for j in range(len(names)):
            s, c = a[j], -a[j] * b[j]
            for _ in range(200):  # gradient of the logit's slope and intercept, by its Hessian
                q = 1 / (1 + np.exp(-(s * x + c)))
                g = np.array([((r[j] - m[j] * q) * x).sum(), (r[j] - m[j] * q).sum()])
                h = m[j] * q * (1 - q)
                step = np.linalg.solve([[(h * x * x).sum() + 1e-12, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-12]], g)
                step /= max(1, np.abs(step).max())
                s, c = float(np.clip(s + step[0], 0.2, 3)), c + step[1]
            a[j], b[j] = s, np.clip(-c / s, -4, 4)
        if max(np.abs(a - old[0]).max(), np.abs(b - old[1]).max()) <= tolerance:
            break
    return {n: (a[j], b[j]) for j, n in enumerate(names)}


def test_items_by_marginal_likelihood(spark):
    _, item, rows = drawn(3, 300, 6)
    want = plain_items(rows, 12)
    got = {r.item: (r.a, r.b) for r in E.calibrate_items(frame(spark, rows), rounds=12).collect()}
    assert set(got) == set(want)
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-4)
    truth = [item[i][1] for i in sorted(item)]
    assert np.abs(np.array([got[i][1] for i in sorted(item)]) - truth).mean() < 0.5


def test_nothing(spark):
    empty = frame(spark, [])
    assert E.ability_likelihood(empty).count() == E.ability_quadrature(empty).count() == E.calibrate_items(empty).count() == 0


def test_abilities_in_tasks_are_those_of_rounds(spark):
    _, _, rows = drawn(7, 9, 40, 0.2)
    rows = [r for r in rows if r[0] != "u03" or r[1] < "i12"] + [("none", f"i{k:02}", 1.0, 0.1 * k, 0.0, False) for k in range(30)]
    df = frame(spark, rows)
    by = {held: {r.learner: tuple(r)[1:] for r in E.ability_likelihood(df, 1.0, held=held).collect()} for held in (100, 20, 0)}
    assert set(by[100]) == {r[0] for r in rows}
    for u, want in by[0].items():  # all by rounds
        assert by[100][u] == pytest.approx(want, abs=1e-9)
        assert by[20][u] == pytest.approx(want, abs=1e-9)  # only u03 in a task
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a learner's answers in several batches
    try:
        for held in (100, 20):
            again = {r.learner: tuple(r)[1:] for r in E.ability_likelihood(df, 1.0, held=held).collect()}
            assert all(again[u] == pytest.approx(want, abs=1e-9) for u, want in by[0].items()) and len(again) == len(by[0])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_abilities_need_few_jobs(spark):
    _, _, rows = drawn(8, 6, 12, 0.1)
    df = frame(spark, rows)
    spark.sparkContext.setJobGroup("few-jobs", "")
    try:
        E.ability_likelihood(df, 1.0).count()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 12
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_items_of_learners_with_many_answers(spark):
    _, _, rows = drawn(9, 40, 12)
    rows = [r for r in rows if r[0] < "u30" or r[1] < "i06"] + [(None, "i00", 1.0, 0.0, 0.0, True), ("u00", None, 1.0, 0.0, 0.0, True), ("u01", "i01", 1.0, 0.0, 0.0, None)]
    df = frame(spark, rows)
    by = {held: {r.item: tuple(r)[1:] for r in E.calibrate_items(df, rounds=4, held=held).collect()} for held in (100, 8, 0)}
    assert set(by[100]) == {f"i{k:02}" for k in range(12)} and by[100]["i00"][2] == 41
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # a learner's and an item's answers in several batches
    try:
        by[1] = {r.item: tuple(r)[1:] for r in E.calibrate_items(df, rounds=4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for other in (8, 0, 1):
        assert set(by[other]) == set(by[100])
        assert all(by[other][i] == pytest.approx(want, abs=1e-5) for i, want in by[100].items())


def test_rounds_leave_no_shuffle_files(spark):
    _, _, rows = drawn(10, 30, 8)
    df = frame(spark, rows)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk, before = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.get(key, None)
    left = []
    for rounds in (1, 4):
        n = disk.getAllFiles().size()
        E.calibrate_items(df, rounds=rounds, tolerance=0.0)
        left.append(disk.getAllFiles().size() - n)
    assert left[1] <= max(left[0], 0)
    assert spark.conf.get(key, None) == before


def test_items_by_blocks_are_those_of_one_block(spark):
    """A round sends each block of items what it needs of a block of learners once, and the messages of the last round go."""
    from pathlib import Path

    from tidemark.operators.iterate import work_folder

    _, _, rows = drawn(11, 60, 40)
    rows += rows[:30]  # answers given twice
    rows += [(None, "i00", 1.0, 0.0, 0.0, True), ("u00", None, 1.0, 0.0, 0.0, True), ("u01", "i01", 1.0, 0.0, 0.0, None)]
    df = frame(spark, rows)
    one = {r.item: tuple(r)[1:] for r in E.calibrate_items(df, rounds=3, tolerance=0.0, each=10**6).collect()}
    before = set(Path(work_folder(spark)).glob("items-*"))
    many = {r.item: tuple(r)[1:] for r in E.calibrate_items(df, rounds=3, tolerance=0.0, each=300, held=7).collect()}
    assert set(many) == set(one) and None not in one
    assert all(many[i] == pytest.approx(want, abs=1e-6) for i, want in one.items())
    (folder,) = set(Path(work_folder(spark)).glob("items-*")) - before
    assert sorted(p.name for p in folder.glob("items-*")) == ["items-3"]
    senders = {(r.to, r.sender) for r in spark.read.parquet(f"{folder}/items-3").where("kind = 0").collect()}
    assert len(senders) == spark.read.parquet(f"{folder}/items-3").where("kind = 0").count() <= 16 * 16
