"""Fitted tracing parameters against a plain run of the same ascent, and against parameters that answers were drawn from."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import tracing_fit as T

SCHEMA = "learner string, kp string, ts timestamp, event_id long, correct boolean"


def plain_likelihood(chain, l0, t, g, s):
    known, log = l0, 0.0
    for right in chain:
        chance = known * (1 - s) + (1 - known) * g
        log += math.log(chance if right else 1 - chance)
        after = known * (1 - s) / chance if right else known * s / (1 - chance)
        known = after + (1 - after) * t
    return log


def drawn(seed, learners, length, l0, t, g, s):
    r, out = random.Random(seed), []
    for _ in range(learners):
        known, chain = r.random() < l0, []
        for _ in range(length):
            chain.append(r.random() < (1 - s if known else g))
            known = known or r.random() < t
        out.append(chain)
    return out


def frame(spark, points):
    from datetime import datetime, timedelta

    first, rows, i = datetime(2024, 1, 1), [], 0
    for kp, chains in points.items():
        for u, chain in enumerate(chains):
            for j, right in enumerate(chain):
                rows.append((f"u{u}", kp, first + timedelta(hours=9 * j), i, right))
                i += 1
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_chain_likelihood():
    chains = drawn(1, 7, 9, 0.4, 0.2, 0.2, 0.1)
    chains = [c[: i + 1] for i, c in enumerate(chains)] + [[]]
    p = np.random.default_rng(2).uniform(0.05, 0.45, (len(chains), 3, 4))
    got = T.chain_likelihood(["".join("01"[x] for x in c) for c in chains], p)
    for i, c in enumerate(chains):
        assert got[i] == pytest.approx([plain_likelihood(c, *p[i, k]) for k in range(3)])


def test_project():
    p = T.project(np.array([[2.0, -1.0, 0.6, 0.9], [0.5, 0.1, 0.2, 0.1]]))
    assert p[0, 2] + p[0, 3] == pytest.approx(0.99) and p[0, 0] == 0.999 and p[0, 1] == 0.001
    assert p[1].tolist() == [0.5, 0.1, 0.2, 0.1]


def test_fit(spark):
    truth = {"a": (0.2, 0.15, 0.15, 0.08), "b": (0.6, 0.05, 0.3, 0.2)}
    points = {k: drawn(i, 400, 12, *v) for i, (k, v) in enumerate(truth.items())}
    got = {r.kp: r for r in T.fit_tracing(frame(spark, points)).collect()}
    for kp, chains in points.items():
        r = got[kp]
        fitted, n = (r.p_l0, r.p_t, r.p_g, r.p_s), sum(map(len, chains))
        assert r.chains == 400 and r.answers == n and r.p_g + r.p_s < 1
        total = lambda p: sum(plain_likelihood(c, *p) for c in chains)  # noqa: B023, E731
        assert r.log_likelihood == pytest.approx(total(fitted), rel=1e-9)
        # as likely as what the answers were drawn from, and no neighbour is better by more than the tolerance allows
        assert r.log_likelihood >= total(truth[kp]) - 1e-3 * n
        for i in range(4):
            for d in (0.02, -0.02):
                near = list(fitted)
                near[i] = min(0.999, max(0.001, near[i] + d))
                assert near[2] + near[3] >= 1 or total(near) <= r.log_likelihood + 1e-4 * n, (kp, i, d)


def test_edges(spark):
    one = frame(spark, {"right": [[True] * 5], "wrong": [[False] * 4] * 3})
    lost = spark.createDataFrame([("u", "right", None, 1, None), (None, "right", None, 2, True), ("u", None, None, 3, True)], SCHEMA)
    got = {r.kp: r for r in T.fit_tracing(one.unionByName(lost)).collect()}
    assert set(got) == {"right", "wrong"} and got["right"].answers == 5 and got["wrong"].chains == 3
    assert got["right"].log_likelihood > -0.5 and all(0 < x < 1 for r in got.values() for x in (r.p_l0, r.p_t, r.p_g, r.p_s))
    assert T.fit_tracing(one, least=10).collect()[0].kp == "wrong" and T.fit_tracing(one.limit(0)).count() == 0
