"""Goals against the plain fixpoint of all rules."""

import random

import pytest

from tidemark.operators.rules import Rule, prove

RULES = [Rule("needs", ("requires",)), Rule("needs", ("requires", "leads")), Rule("leads", ("needs", "requires")), Rule("kin", ("needs", "likes")), Rule("other", ("likes", "likes"))]


def fixpoint(facts, rules):
    known = set(facts)
    while True:
        new = {(r.head, s, o) for r in rules for p, s, o in known if p == r.body[0] and len(r.body) == 1}
        new |= {(r.head, s, o2) for r in rules if len(r.body) == 2 for p, s, o in known if p == r.body[0] for q, s2, o2 in known if q == r.body[1] and s2 == o}
        if new <= known:
            return known
        known |= new


@pytest.fixture(scope="module")
def facts():
    r = random.Random(6)
    return {(r.choice(["requires", "requires", "likes"]), f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(26)}


@pytest.mark.parametrize("goal, s, o", [("needs", ["n1", "n3"], None), ("needs", None, ["n2"]), ("kin", None, None), ("needs", ["n1"], ["n2", "n5"])])
def test_goals(spark, facts, goal, s, o):
    df = spark.createDataFrame([(a, p, b, 0.5) for p, a, b in facts], "subject string, predicate string, object string, confidence double")
    want = {(a, b) for p, a, b in fixpoint(facts, RULES) if p == goal and (s is None or a in s) and (o is None or b in o)}
    bind = lambda x, name: None if x is None else spark.createDataFrame([(v,) for v in x], f"{name} string")
    got = prove(df, RULES, goal, bind(s, "subject"), bind(o, "object")).collect()
    assert {(r.subject, r.object) for r in got} == want and len(got) == len(want)
    assert all(r.confidence == pytest.approx(0.5) for r in got)


def test_confidence_is_the_mean_of_the_first_proof(spark):
    df = spark.createDataFrame([("a", "requires", "b", 0.9), ("b", "requires", "c", 0.3)], "subject string, predicate string, object string, confidence double")
    rules = [Rule("two", ("requires", "requires"))]
    got = prove(df, rules, "two", spark.createDataFrame([("a",)], "subject string")).collect()
    assert [(r.subject, r.object, round(r.confidence, 9)) for r in got] == [("a", "c", 0.6)]
    assert prove(df, [], "two").count() == 0
