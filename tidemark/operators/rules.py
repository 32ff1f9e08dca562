"""Goals proved over triples by rules, deriving only what a goal asks for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut

KEY = ["predicate", "subject", "object"]


@dataclass(frozen=True)
class Rule:
    """head(x, y) if body[0](x, y), or head(x, z) if body[0](x, y) and body[1](y, z)."""

    head: str
    body: tuple[str, ...]


def prove(triples: DataFrame, rules: list[Rule], predicate: str, subjects: DataFrame | None = None, objects: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """(subject, object, confidence, rounds) of the answers to a goal predicate(x, y).

    subjects (subject) binds x and objects (object) binds y; without either both are variables. Triples have subject,
    predicate, object and confidence. Rules may call themselves and each other. An answer's confidence is the mean of
    the confidences that its first proof rests on, the best of those found in that round; rounds tells which it was.

    A table of demands (predicate, subject) goes along with the facts: a goal demands its own subjects, a rule what its
    first condition needs, and what that yields is demanded of the second. Facts that nothing demands are never read
    beyond the first join. A goal that binds objects alone is turned round, and so are the rules and triples.
    """
    spark = triples.sparkSession
    if subjects is None and objects is not None:
        back = [Rule(r.head, r.body[::-1]) for r in rules]
        turned = triples.select(F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"), "confidence")
        found = prove(turned, back, predicate, objects.select(F.col("object").alias("subject")), None, rounds)
        return found.select(F.col("object").alias("subject"), F.col("subject").alias("object"), "confidence", "rounds")
    known = cut(triples.groupBy(*KEY).agg(F.max("confidence").alias("confidence")))
    of = spark.createDataFrame([(r.head, r.body[0], r.body[1] if len(r.body) > 1 else None) for r in rules] or [("", "", "")], "head string, first string, second string").where("head <> ''")
    wanted = subjects.select("subject").distinct() if subjects is not None else None

    # demands of every predicate that the goal may call; with a free subject they are all that occur
    reached, todo = set(), [predicate]
    while todo:
        p = todo.pop()
        if p not in reached:
            reached.add(p)
            todo += [b for r in rules if r.head == p for b in r.body]
    known = known.where(F.col("predicate").isin(sorted(reached)))
    if wanted is None:
        wanted = known.select("subject").distinct()
    demand = cut(wanted.select(F.lit(predicate).alias("predicate"), "subject"))
    fresh, facts = demand, None
    for turn in range(rounds):
        # facts at hand for new demands, then what rules make of all facts
        given = known.join(fresh, ["predicate", "subject"]).select(*KEY, "confidence", F.lit(1).alias("leaves"))
        steps = [given]
        if facts is not None:
            called = demand.join(F.broadcast(of), F.col("predicate") == F.col("head")).select("head", F.col("subject").alias("x"), "first", "second")  # rules are a stated list
            first = facts.select(F.col("predicate").alias("first"), F.col("subject").alias("x"), F.col("object").alias("y"), F.col("confidence").alias("c1"), F.col("leaves").alias("n1"))
            met = called.join(first, ["first", "x"])
            steps.append(met.where("second is null").select(F.col("head").alias("predicate"), F.col("x").alias("subject"), F.col("y").alias("object"), F.col("c1").alias("confidence"), F.col("n1").alias("leaves")))
            second = facts.select(F.col("predicate").alias("second"), F.col("subject").alias("y"), F.col("object").alias("z"), F.col("confidence").alias("c2"), F.col("leaves").alias("n2"))
            mean = (F.col("c1") * F.col("n1") + F.col("c2") * F.col("n2")) / (F.col("n1") + F.col("n2"))
            steps.append(met.join(second, ["second", "y"]).select(F.col("head").alias("predicate"), F.col("x").alias("subject"), F.col("z").alias("object"), mean.alias("confidence"), (F.col("n1") + F.col("n2")).alias("leaves")))
        made = steps[0]
        for s in steps[1:]:
            made = made.unionByName(s)
        made = made.groupBy(*KEY).agg(F.max(F.struct("confidence", (-F.col("leaves")).alias("leaves"))).alias("best")).select(*KEY, "best.confidence", (-F.col("best.leaves")).alias("leaves"), F.lit(turn).alias("rounds"))
        new = cut(made if facts is None else made.join(facts.select(*KEY), KEY, "left_anti"))
        grown = new if facts is None else cut(facts.unionByName(new))
        # what the demands need now: the first condition of their rules, and the second at what the first has yielded
        calls = demand.join(F.broadcast(of), F.col("predicate") == F.col("head")).select(F.col("subject").alias("x"), "first", "second")
        asked = calls.select(F.col("first").alias("predicate"), F.col("x").alias("subject"))
        yielded = grown.select(F.col("predicate").alias("first"), F.col("subject").alias("x"), F.col("object").alias("y"))
        asked = asked.unionByName(calls.where("second is not null").join(yielded, ["first", "x"]).select(F.col("second").alias("predicate"), F.col("y").alias("subject")))
        fresh = cut(asked.distinct().join(demand, ["predicate", "subject"], "left_anti"))
        quiet = new.isEmpty() and facts is not None and fresh.isEmpty()
        facts, demand = grown, cut(demand.unionByName(fresh))
        if quiet:
            break
    answers = facts.where(F.col("predicate") == predicate).join(wanted, "subject", "left_semi")  # rules may have asked for more
    if objects is not None:
        answers = answers.join(objects.select("object").distinct(), "object", "left_semi")
    return answers.select("subject", "object", "confidence", "rounds")

