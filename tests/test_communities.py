"""Communities against a plain single-machine version, and the properties that hold for any graph."""

import random
from collections import namedtuple

import numpy as np

from tidemark.operators import communities as C


Row = namedtuple("Row", "node level community")


def plain_modularity(edges, of, gamma=1.0):
    m = sum(w for *_, w in edges)
    inside = sum(w for a, b, w in edges if of[a] == of[b])
    total = {}
    for a, b, w in edges:
        for x in (a, b):
            total[of[x]] = total.get(of[x], 0) + w
    return inside / m - gamma * sum((t / (2 * m)) ** 2 for t in total.values())


def greedy(edges, seed=0):
    """One node after the other goes where modularity grows most; communities then become nodes."""
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {n: i for i, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b, x in edges:
        w[at[a], at[b]] += x
        w[at[b], at[a]] += x
    whole, of = w, np.arange(len(names))
    rng = np.random.default_rng(seed)
    while True:
        degree, m2 = whole.sum(1), whole.sum()
        label, changed, moving = np.arange(len(whole)), False, True
        while moving:
            moving = False
            for i in rng.permutation(len(whole)):
                link = np.bincount(label, whole[i] * (np.arange(len(whole)) != i), len(whole))
                total = np.bincount(label, degree * (np.arange(len(whole)) != i), len(whole))
                gain = link - degree[i] * total / m2
                best = int(gain.argmax())
                if gain[best] > gain[label[i]] + 1e-12:
                    label[i], moving, changed = best, True, True
        if not changed:
            return {n: int(of[i]) for n, i in at.items()}
        keep, new = np.unique(label, return_inverse=True)
        of = new[of]
        one = np.eye(len(keep))[new]
        whole = one.T @ whole @ one


def planted(r, groups, size, p_in, p_out):
    n = groups * size
    return [(f"n{i:04d}", f"n{j:04d}", 1.0) for i in range(n) for j in range(i) if r.random() < (p_in if i // size == j // size else p_out)]


def solved(spark, edges, **k):
    levels = C.leiden(spark.createDataFrame(edges, "source string, target string, weight double"), **k)
    return levels.collect()


def check_levels(edges, rows):
    levels = {}
    for r in rows:
        levels.setdefault(r.level, {})[r.node] = r.community
    nodes = {x for a, b, _ in edges for x in (a, b)}
    for n, of in levels.items():
        assert n or set(of) == nodes
        below = levels.get(n - 1)
        if below:  # communities lie inside those above
            assert len({(below[x], of[x]) for x in of}) == len({below[x] for x in of})
        near = {x: set() for x in nodes}
        for a, b, _ in edges:
            if a in of and of[a] == of[b]:
                near[a].add(b)
                near[b].add(a)
        for name in set(of.values()):  # connected, and named by the smallest
            own = {x for x in of if of[x] == name}
            assert name == min(own)
            seen, todo = {name}, [name]
            while todo:
                for x in near[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            assert seen == own
    return levels


def test_one_task_near_the_plain_optimum():
    for seed, args in ((1, (8, 20, 0.5, 0.02)), (2, (5, 24, 0.3, 0.05))):
        edges = planted(random.Random(seed), *args)
        both = edges + [(b, a, w) for a, b, w in edges]
        found = C.small_levels(both, 2.0 * len(edges), 1.0, 10)
        levels = check_levels(edges, [Row(n, k, c) for k, of in enumerate(found) for n, c in of.items()])
        assert plain_modularity(edges, levels[max(levels)]) >= 0.98 * plain_modularity(edges, greedy(edges))


def test_a_long_chain_in_one_task():
    """3,000 nodes in one component."""
    edges = [(f"n{i:05d}", f"n{i + 1:05d}", 1.0) for i in range(3000)]
    found = C.small_levels(edges + [(b, a, w) for a, b, w in edges], 6000.0, 1.0, 10)
    levels = check_levels(edges, [Row(n, k, c) for k, of in enumerate(found) for n, c in of.items()])
    assert plain_modularity(edges, levels[max(levels)]) > 0.93


def test_rounds(spark):
    """Parallel rounds, beside a small component that a task solves: connected communities, better than none."""
    edges = planted(random.Random(1), 3, 8, 0.8, 0.02)
    levels = check_levels(edges + [("x", "y", 1.0)], solved(spark, edges + [("x", "y", 1.0)], small=10, rounds=4, max_levels=1))
    top = dict(levels[0])
    assert top.pop("y") == top.pop("x") == "x"
    assert plain_modularity(edges, top) > 0.2 > plain_modularity(edges, {n: n for n in top})


def test_small_graphs(spark):
    assert solved(spark, []) == []
    assert solved(spark, [("a", "a", 1.0), ("a", "b", 0.0)]) == []
    rows = solved(spark, [("a", "b", 1.0), ("b", "a", 2.0), ("c", "d", 1.0), ("a", "b", 1.0)])
    assert {(r.node, r.level) for r in rows} == {(x, 0) for x in "abcd"}
    assert {(r.node, r.community) for r in rows} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}
