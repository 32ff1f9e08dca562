import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.negatives import _product, mine_negatives

SCHEMA = "vec_id long, label string, embedding array<double>, rank int, score string"


def brute(rows, positives=5, negatives=10):
    ok = [(k, i, g, [math.floor(256 * x) for x in v]) for k, (i, g, v) in enumerate(rows) if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, g, q in ok:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j, h) for m, j, h, p in ok if m != k and len(p) == len(q))
        for s, j, _ in [x for x in scored if x[2] == g][:positives]:
            some = [x for x in scored if x[2] != g and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(some)]
    return sorted(out)


def mined(spark, rows, **k):
    df = spark.createDataFrame([(i, g, v, 1, "s") for i, g, v in rows], SCHEMA)
    return sorted(tuple(r) for r in mine_negatives(df, F.col("vec_id") % 10 == 0, **k).collect())


def cases():
    r = np.random.default_rng(7)
    rows = [(i, "ab"[i % 2] if i % 3 else "c", [float(x) for x in r.normal(size=10)]) for i in range(150)]
    rows += [(200 + i, "a", rows[10][2]) for i in range(12)]  # ties
    rows += [(10, "a", rows[3][2]), (10, "a", rows[3][2])]  # repeated ids
    rows += [(300, None, rows[0][2]), (310, "a", None), (320, "a", [float("nan")] * 10), (330, "a", [None] * 10), (340, "a", [float("inf")] * 10), (None, "a", rows[0][2])]
    rows += [(350, "lone", rows[0][2]), (360, "a", [1.0]), (361, "a", [2.0]), (362, "b", [1.5]), (370, "a", [0.0] * 10)]
    return rows


@pytest.mark.parametrize("tiles", [{}, {"anchor_tile": 3, "row_tile": 16, "dims": 4}])
def test_against_all_pairs(spark, tiles):
    rows = cases()
    want = brute(rows)
    assert len(want) > 300
    assert mined(spark, rows, **tiles) == want


def test_few(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, "a", [1.0]), (2, "b", [1.0])]) == []
    assert mined(spark, [(10, "a", []), (11, "a", []), (12, "b", [])]) == brute([(10, "a", []), (11, "a", []), (12, "b", [])])


def test_scores_beyond_64_bits(spark):
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(10, "a", [1e8]), (11, "a", [1e8])])


def test_products_are_exact():
    r = np.random.default_rng(1)
    for top in (100, 2**20, 2**28):
        a, b = r.integers(-top, top, (5, 9)), r.integers(-top, top, (7, 9))
        assert _product(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
