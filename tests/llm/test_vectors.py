import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.vectors import near_vectors, quantise

SCHEMA = "vec_id long, label int, embedding array<double>, n_links string, x int"


def brute(rows, t):
    ok = [r for r in rows if r[1] is not None and r[2] and all(v is not None and math.isfinite(v) for v in r[2]) and any(r[2])]
    links = {r[0]: set() for r in rows}
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2]), np.array(b[2])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= t:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def test_against_all_pairs(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 16))
    rows = []
    for i in range(300):
        c = centres[i % 6] + r.normal(size=16) * 0.1 * (i % 4)
        rows.append((i, i % 3 if i % 17 else None, [float(v) for v in c], "a", 1))
    rows[40] = (40, rows[41][1], list(rows[41][2]), "a", 1)
    rows += [(900, 1, None, "b", 1), (901, 1, [], "b", 1), (902, 1, [0.0] * 16, "b", 1), (903, 1, [float("nan")] * 16, "b", 1), (904, 1, [None] * 16, "b", 1), (905, 1, [1.0], "b", 1), (906, 1, [float("inf")] * 16, "", 1), (907, 2, [1e-300] * 16, "", 1), (908, 2, [1e300] * 16, "", 1)]
    random.Random(1).shuffle(rows)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_vectors(spark.createDataFrame(rows, SCHEMA), tile=32).collect()}
    want = brute([r for r in rows if r[0] < 907], 0.98)
    assert {k: v for k, v in got.items() if k < 907} == want
    assert got[908] == (1, 907, False)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bound_is_rigorous():
    x = np.random.default_rng(5).normal(size=(200, 64))
    q, s, k, e = quantise(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    err = np.abs(u @ u.T - (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :])
    assert (err <= k[:, None] * e[None, :] + e[:, None] * (k + e)[None, :] + 1e-12).all()


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0], "", 1)] * 3, SCHEMA)
    assert [tuple(r) for r in near_vectors(df).orderBy("vec_id").collect()] == [(1, 2, 1, True)] * 3
    assert near_vectors(df).where(F.col("n_links") == 2).count() == 3


def test_repeated_and_missing_ids(spark):
    """Vectors that share an id count by themselves; rows without an id link with nothing."""
    rows = [(1, 1, [1.0, 0.0], "", 1), (1, 1, [0.0, 1.0], "", 1), (2, 1, [0.01, 1.0], "", 1), (None, 1, [1.0, 0.0], "", 1)]
    got = sorted(((x.vec_id, x.n_links, x.component_id) for x in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (1, 1, 1), (2, 1, 1), (None, 0, None)], key=str)


def test_no_float_vectors_for_far_tiles(spark):
    """Tiles travel as codes; orthogonal vectors flag nothing."""
    df = spark.createDataFrame([(i, 1, [float(i == k) for k in range(40)], "", 1) for i in range(40)], SCHEMA)
    assert near_vectors(df, tile=8).where("n_links > 0 or not kept").count() == 0
