"""Components solved in tasks against plain versions and against the loops of joins."""

import random
from itertools import product

import pytest

from tidemark.operators import communities as C
from tidemark.operators import graph as G
from tidemark.operators import inference as I
from tidemark.operators import parts as P


def plain_closure(edges):
    known = set(edges)
    while True:
        new = {(a, d) for (a, b), (c, d) in product(known, edges) if b == c} - known
        if not new:
            return known
        known |= new


def drawn(seed, cycles):
    """Some ten components, with repeats, loops and (if asked) cycles."""
    rng = random.Random(seed)
    edges = [(f"a{i}", f"a{i + 1}") for i in range(9)] + [("z", "z"), ("a0", "a1")] * cycles
    for c in range(8):
        for _ in range(rng.randint(1, 9)):
            a, b = rng.sample(range(7), 2)
            edges.append((f"n{c}{a}", f"n{c}{b}") if cycles or a < b else (f"n{c}{b}", f"n{c}{a}"))
    return edges


def frame(spark, edges):
    return spark.createDataFrame(edges, "source string, target string").repartition(3)


@pytest.mark.parametrize("cycles", [True, False])
@pytest.mark.parametrize("small", [1000, 6, 0])
def test_closure_descendants_and_layers(spark, cycles, small):
    edges = drawn(3, cycles)
    want, df = plain_closure(edges), frame(spark, edges)
    assert sorted(map(tuple, G.closure(df, small).collect())) == sorted(want)
    n = {a: sum(x == a for x, _ in want) for a, _ in want}
    assert {r.node: (r.n, r.cyclic) for r in G.descendants(df, small).collect()} == {a: (k, (a, a) in want) for a, k in n.items()}
    nodes = sorted({x for e in edges for x in e} - {"a3"}) + ["alone"]  # what isn't among the nodes holds nothing back
    held = [(a, b) for a, b in edges if a != "a3"]
    behind = plain_closure(held)
    bad = {b for a, b in behind if (a, a) in behind} | {a for a, b in behind if a == b}
    layer = {x: 0 for x in nodes if x not in bad}
    for _ in nodes:
        for a, b in held:
            if a in layer and b in layer:
                layer[b] = max(layer[b], layer[a] + 1)
    got = G.layers(df, spark.createDataFrame([(x,) for x in nodes], "node string"), small).collect()
    assert {r.node: r.layer for r in got} == layer and len(got) == len(layer)


def test_a_part_is_a_component_and_rounds_are_few(spark, monkeypatch):
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(1500)]  # in order: smallest neighbours alone would go one by one
    star = [("s", f"t{i}") for i in range(300)]
    count, real = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: count.append(1) or real(df))
    near, far = P.dealt(frame(spark, chain + star), 10_000)
    got = {}
    for r in near.collect():
        got.setdefault(r.part, set()).add(r.source[0])
    assert far is None and sorted(map(sorted, got.values())) == [["c"], ["s"]]
    assert len(count) <= 2 * 20 + 2


def test_batches_that_split_a_part(spark):
    edges = [(f"x{i}", f"x{i + 1}") for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert G.closure(frame(spark, edges)).count() == 60 * 61 // 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rounds", [2, 10])
def test_chained_in_tasks_as_by_joins(spark, rounds):
    rows = [(a, "p", b) for a, b in drawn(5, True)] + [("a2", "q", "a7"), ("n01", "r", "n02")]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string")
    rules = dict(transitive=["p", "q"], inverse={"p": "back", "back": "q"}, rename={"r": "p"}, rounds=rounds)
    got, want = ([tuple(r) for r in I.forward_chain(df, small=s, **rules).collect()] for s in (1000, 0))
    assert sorted(got) == sorted(want) and got


def test_two_components_in_one_part(spark, monkeypatch):
    """Equal hashes may bring them together: levels are those of each alone."""
    edges = [(f"{c}{i}", f"{c}{i + 1}", 1.0) for c, n in (("a", 2), ("b", 30)) for i in range(n)]
    df = spark.createDataFrame(edges, "source string, target string, weight double")
    want = sorted(map(tuple, C.leiden(df).collect()))
    one = lambda e, small: (e.selectExpr("0L as part", "*"), None)
    monkeypatch.setattr(C, "dealt", one)
    assert sorted(map(tuple, C.leiden(df).collect())) == want
