"""Eight ways to choose the next item, against a plain search of the whole bank for every learner."""

import hashlib
import math
import random

import pytest

from tidemark.operators import selection as S


def chance(th, a, b, c):
    return c + (1 - c) / (1 + math.exp(-a * (th - b)))


def info(th, a, b, c):
    p = chance(th, a, b, c)
    return a * a * ((p - c) / (1 - c)) ** 2 * (1 - p) / p


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def kl(p, q):
    p, q = (max(1e-12, min(1 - 1e-12, x)) for x in (p, q))
    return p * math.log(p / q) + (1 - p) * math.log((1 - p) / (1 - q))


def plain(strategy, th, bank, gone, mastery, u):
    turn = len(gone & set(bank))
    left = {i: x for i, x in bank.items() if i not in gone}
    capped = min(turn, S.LENGTH)
    best = lambda pool, f: min(pool, key=lambda i: (-round(f(i), 9), i)) if pool else None
    fisher = lambda i: info(th, *bank[i][:3])
    near = lambda i: -abs(bank[i][1] - th)
    if not left:
        return None
    if strategy == "fisher_info":
        return best(left, fisher)
    if strategy == "b_match":
        return best(left, near)
    if strategy == "kl_info":
        return best(left, lambda i: kl(chance(th, *bank[i][:3]), chance(th + 1.0, *bank[i][:3])))
    if strategy == "randomesque":
        top = sorted(left, key=lambda i: (-round(fisher(i), 9), i))[:5]
        return top[math.floor(draw(u, turn) * len(top))]
    if strategy == "zpd_aware":
        p = {i: chance(th, *bank[i][:3]) for i in left}
        zone, able = [i for i in left if 0.4 < p[i] < 0.7], [i for i in left if p[i] > 0.4]
        return best(zone, fisher) if zone else best(able or left, near)
    if strategy == "progressive":
        w = min(1.0, max((capped if capped else 1) * 0.09, capped / 19))
        return best(left, lambda i: (1 - w) * draw(i, capped) + w * fisher(i))
    if strategy == "a_stratified":
        rank = sorted(bank, key=lambda i: (bank[i][0], i))
        low = max(len(rank) // 3, 1)
        mid = max(2 * len(rank) // 3, low + 1)
        layers = [rank[:low], rank[low:mid], rank[mid:]]
        done = min(capped / 20, 1)
        pool = [i for i in layers[0 if done < 0.33 else 1 if done < 0.67 else 2] if i in left]
        return best(pool or left, fisher)
    middle = [i for i in left if 0.3 <= mastery.get((u, bank[i][3]), 0.5) <= 0.7]
    return best(middle or left, fisher)


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(4)
    bank = {i: (r.choice([0.6, 0.9, 0.9, 1.4, r.uniform(0.5, 2)]), round(r.gauss(0, 1.2), 1), r.choice([0.0, 0.2, 0.25]), f"area{r.randrange(4)}") for i in range(90)}
    theta = {u: max(-3.0, min(3.0, r.gauss(0, 1.5))) for u in range(40)} | {40: 3.0, 41: -3.0, 42: 0.0}
    gone = {u: set(r.sample(sorted(bank), r.choice([0, 0, 3, 8, 21, 60]))) for u in theta}
    gone[40], gone[41] = set(bank), set(bank) - {7}
    mastery = {(u, f"area{k}"): r.random() for u in theta for k in range(3)} | {(42, f"area{k}"): 0.9 for k in range(4)}
    frames = (
        spark.createDataFrame([(u, t) for u, t in theta.items()] + [(99, None)], "learner long, theta double"),
        spark.createDataFrame([(i, *x) for i, x in bank.items()], "item long, a double, b double, c double, area string"),
        spark.createDataFrame([(u, i) for u in gone for i in gone[u]] + [(1, 12345), (0, 3), (0, 3)], "learner long, item long"),
        spark.createDataFrame([(u, k, p) for (u, k), p in mastery.items()], "learner long, area string, p double"),
    )
    gone[0].add(3)
    return bank, theta, gone, mastery, frames


@pytest.mark.parametrize("strategy", S.STRATEGIES)
def test_strategies(world, strategy):
    bank, theta, gone, mastery, (learners, items, taken, known) = world
    got = {r.learner: r.item for r in S.select_next(learners, items, taken, strategy, known).collect()}
    want = {u: plain(strategy, th, bank, gone[u], mastery, u) for u, th in theta.items()}
    assert got == {u: i for u, i in want.items() if i is not None}


def test_ranks_and_equal_items(spark, world):
    _, theta, _, _, (learners, _, taken, _) = world
    same = spark.createDataFrame([(i, 1.0, 0.5, 0.1, "x") for i in range(300)], "item long, a double, b double, c double, area string")
    got = S.best_items(learners, same, taken.where("false"), "fisher_info", 3).select("learner", "item", "rank").collect()
    assert {(r.learner, r.item, r["rank"]) for r in got} == {(u, k, k + 1) for u in theta for k in range(3)}
    assert S.best_items(learners.where("false"), same, taken, "b_match").count() == 0 and S.best_items(learners, same.where("false"), taken, "b_match").count() == 0
    with pytest.raises(ValueError):
        S.select_next(learners, same, taken, "first")


def test_limits(spark, world):
    bank, _, _, _, (_, items, _, _) = world
    areas = {k: [i for i in bank if bank[i][3] == k] for k in ("area0", "area1")}
    taken = spark.createDataFrame([(u, areas["area0"][0]) for u in range(6)] + [(u, areas["area1"][u]) for u in range(2)], "learner long, item long")
    ids = lambda *args: {r.item for r in S.allowed(items, taken, *args).collect()}
    assert ids({"area0": 0.5, "area1": 0.5}) == set(bank) - set(areas["area0"])
    assert ids(None, 0.7) == set(bank) - {areas["area0"][0]} and ids(None, 0.8) == set(bank)
    assert {r.item for r in S.allowed(items, taken.where("false"), {"area0": 0.1}, 0.1).collect()} == set(bank)


def test_stop_rules(spark, world):
    bank, theta, gone, _, (learners, items, taken, _) = world
    from pyspark.sql import functions as F

    d = learners.where("theta is not null").withColumn("se", F.lit(0.2) + F.col("learner") % 7 * 0.1).withColumn("n", F.col("learner") % 25)
    for r in S.stop_rules(d, items, taken).collect():
        left = [i for i in bank if i not in gone[r.learner]]
        end, enough = r.n >= 20, r.n >= 5
        gain = max((r.se - 1 / math.sqrt(1 / r.se**2 + info(theta[r.learner], *bank[i][:3])) for i in left), default=None)
        assert r.gain == (None if gain is None else pytest.approx(gain, abs=1e-8))
        assert (r.by_length, r.by_error, r.by_width) == (end, end or enough and r.se < 0.3, end or enough and 2 * 1.959963984540054 * r.se < 0.5)
        assert r.by_class == (abs(theta[r.learner]) > 1.6448536269514722 * r.se)
        assert r.by_gain == (end or enough and (gain is None or (gain <= 0.05 if r.se < 0.3 else gain < 0.01)))


@pytest.mark.parametrize("strategy", ["fisher_info", "b_match", "a_stratified"])
def test_those_who_have_taken_the_first_candidates_ask_again(spark, strategy):
    bank = {i: (1.0 + i % 2, (i // 14 - 5) / 5, 0.1, f"area{i % 3}") for i in range(140)}
    theta = {u: -1 + 0.21 * u for u in range(12)}
    order = lambda u: sorted(bank, key=lambda i: (-round(info(theta[u], *bank[i][:3]), 9), i))
    gone = {u: set(order(u)[: (0, 3, 6, 7, 20, 45)[u % 6]]) for u in theta}  # the best, all of some that are alike
    learners = spark.createDataFrame(list(theta.items()), "learner long, theta double")
    items = spark.createDataFrame([(i, *x) for i, x in bank.items()], "item long, a double, b double, c double, area string")
    taken = spark.createDataFrame([(u, i) for u in gone for i in gone[u]], "learner long, item long")
    got = {r.learner: r.item for r in S.select_next(learners, items, taken, strategy).collect()}
    assert got == {u: plain(strategy, th, bank, gone[u], {}, u) for u, th in theta.items()}


def test_all_strategies_at_once(world, monkeypatch):
    """Learners of a cell that are dealt to parts all meet its candidates; whoever isn't sure asks again with the others."""
    bank, theta, gone, mastery, (learners, items, taken, known) = world
    monkeypatch.setattr(S, "_SHARE", 2)
    got = {(r.learner, r.strategy): r.item for r in S.select_each(learners, items, taken, S.STRATEGIES, known).collect()}
    want = {(u, k): plain(k, theta[u], bank, gone[u], mastery, u) for u in theta for k in S.STRATEGIES}
    assert got == {k: v for k, v in want.items() if v is not None}
