import random

import numpy as np

from tidemark.llm import darts
from tidemark.llm.minhash import near_classes, one_of_each

SCHEMA = "doc_id long, text string, rep int, class_id string, key int"


def shingles(text):
    words = (text or "").lower().split()
    out = {}
    for i in range(max(1, len(words) - 4)):
        s = tuple(words[i : i + 5])
        out[s] = out.get(s, 0) + 1
    return out if words else {}


def jaccard(a, b):
    return sum(min(v, b.get(k, 0)) for k, v in a.items()) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {**a, **b})


def brute(rows, t=0.8):
    ok = [(i, shingles(x)) for i, x, *_ in rows if i is not None and shingles(x)]
    root = {i: i for i, *_ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(ok):
        for j, b in ok[:n]:
            if jaccard(a, b) >= t:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, None if i is None else find(i)) for i, *_ in rows), key=str)


def weights(text):
    return darts.shingles(text.lower().encode().split())


def test_signature_estimates_weighted_similarity():
    r = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    for cut in (0.02, 0.1, 0.3):
        errors = []
        for _ in range(20):
            a = [r.choice(words[:40]) if r.random() < 0.3 else r.choice(words) for _ in range(400)]
            b = [w if r.random() > cut / 5 else r.choice(words) for w in a]
            x, y = weights(" ".join(a)), weights(" ".join(b))
            errors.append(np.mean(darts.signature(*x) == darts.signature(*y)) - darts.similarities(x, [y])[0])
        assert abs(np.mean(errors)) < 0.04


def test_signature_of_heavy_weights():
    """Weights far apart: one shingle repeated often, among others; the estimate is of the weighted similarity."""
    r = np.random.default_rng(3)
    errors = []
    for _ in range(150):
        keys = np.sort(darts.mix(r.integers(0, 2**60, 90).astype(np.uint64)))
        a, b = r.integers(1, 9, 90) ** 3, r.integers(1, 9, 90) ** 3
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs(darts.similarities((keys, a), [(keys, b)])[0] - want) < 1e-12
        errors.append(np.mean(darts.signature(keys, a) == darts.signature(keys, b)) - want)
    assert abs(np.mean(errors)) < 0.015


def test_similarities():
    a, b, c = "a b c d e " * 5, "a b c d e " * 3, "x y z u v w"
    got = darts.similarities(weights(a), [weights(b), weights(c), weights(a)])
    assert np.allclose(got, [jaccard(shingles(a), shingles(x)) for x in (b, c, a)], atol=1e-12)
    assert all((x == y).all() for x, y in zip(darts.unpacked(darts.packed(*weights(a))), weights(a)))


def test_against_brute_force(spark):
    r = random.Random(2)
    words = [f"v{i}" for i in range(500)]
    rows, n = [], 0
    for g in range(25):
        base = [r.choice(words) for _ in range(r.randint(4, 120))]
        for _ in range(r.choice([1, 2, 3, 40 if g < 3 else 4])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((n, (" " if r.random() < 0.5 else "\n ").join(copy).title() if r.random() < 0.3 else " ".join(copy)))
            n += 1
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (None, "one"), (5006, "x " * 20000), (5007, "x " * 19000), (5003, "one")]
    r.shuffle(rows)
    got = near_classes(spark.createDataFrame([(*x, 1, "c", 2) for x in rows], SCHEMA))
    assert sorted(((g.doc_id, g.class_id) for g in got.collect()), key=str) == brute(rows)
    assert got.where("kept != (doc_id = class_id)").count() == 0


def test_empty(spark):
    assert near_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_groups_in_small_blocks(spark):
    """Groups far above a block, of copies that are no neighbours of most others; and hosts with members from outside."""
    r = random.Random(5)
    words = [f"v{i}" for i in range(900)]
    rows = []
    for g in range(3):
        base = [r.choice(words) for _ in range(90)]
        for _ in range(150):
            copy = list(base)
            for k in r.sample(range(90), r.randint(0, 2)):
                copy[k] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    r.shuffle(rows)
    got = near_classes(spark.createDataFrame([(*x, 1, "c", 2) for x in rows], SCHEMA), block=16)
    assert sorted(((g.doc_id, g.class_id) for g in got.collect()), key=str) == brute(rows)


def test_repeated_ids(spark):
    """Rows that share an id are judged by their texts; one row stands for a group, and copies of it go."""
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(2, text), (5, text), (5, "quite another text stands here and stays"), (2, text), (2, text.upper()), (7, None), (7, None), (8, ""), (None, text), (None, text)]
    df = spark.createDataFrame([(*x, 1, "c", 2) for x in rows], SCHEMA)
    got = sorted(((g.doc_id, g.text) for g in one_of_each(df).collect()), key=str)
    assert len([g for g in got if g[0] == 2]) == 1
    assert sorted((g for g in got if g[0] != 2), key=str) == sorted([(5, rows[2][1]), (7, None), (7, None), (8, ""), (None, text), (None, text)], key=str)
    assert near_classes(df).where("doc_id = 5").select("class_id").distinct().count() == 2
    assert one_of_each(df).columns == df.columns and one_of_each(df.limit(0)).count() == 0
