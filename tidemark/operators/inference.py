"""Rule inference, path enumeration and translation embeddings over triples."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parts as P
from .iterate import cut

KEY = ["subject", "predicate", "object"]
#: Triples of the largest component that one task chains; what they add grows with the square.
CHAINED = 1_000


def forward_chain(triples: DataFrame, transitive: list[str] = (), inverse: dict[str, str] | None = None, rename: dict[str, str] | None = None, rounds: int = 10, small: int = CHAINED) -> DataFrame:
    """(subject, predicate, object, iteration) that the rules add to the triples, to the fixpoint or the last round.

    Rules of a round see what earlier rounds added; a transitive rule adds no (a, a). No rule leaves a component of the
    graph of subjects and objects, so components of at most `small` triples are chained in a task each, the others by joins.
    """
    transitive, inverse, rename = list(transitive), inverse or {}, rename or {}
    known = cut(triples.select(F.col("subject").alias("source"), "predicate", F.col("object").alias("target")).distinct())
    near, far = P.dealt(known, small)
    solve = lambda *columns: chained(list(zip(*columns, strict=True)), transitive, inverse, rename, rounds)
    out = P.solved(near, ["source", "predicate", "target"], solve, "subject string, predicate string, object string, iteration int")
    if far is not None:
        rest = far.select(F.col("source").alias("subject"), "predicate", F.col("target").alias("object"))
        out = out.unionByName(_chain_by_rounds(rest, transitive, inverse, rename, rounds))
    return out


def chained(facts: list[tuple[str, str, str]], transitive: list[str], inverse: dict[str, str], rename: dict[str, str], rounds: int):
    """Columns of what the rules add to the facts of one component, a round at a time."""
    known, new = set(facts), set(facts)
    ahead, back = ({p: defaultdict(set) for p in transitive} for _ in range(2))
    for i in range(1, rounds + 1):
        for s, p, o in new:
            if p in ahead:
                ahead[p][s].add(o)
                back[p][o].add(s)
        found = set()
        for s, p, o in new:
            if p in ahead:
                found.update((s, p, x) for x in ahead[p].get(o, ()) if x != s)
                found.update((x, p, o) for x in back[p].get(s, ()) if x != o)
            if p in inverse:
                found.add((o, inverse[p], s))
            if p in rename:
                found.add((s, rename[p], o))
        new = found - known
        if not new:
            break
        known |= new
        yield *zip(*new, strict=True), [i] * len(new)


def _chain_by_rounds(triples: DataFrame, transitive: list[str], inverse: dict[str, str], rename: dict[str, str], rounds: int) -> DataFrame:
    """The same for components of any size, a round of joins at a time."""
    known = cut(triples.select(*KEY).distinct())
    new, out = known, None
    for i in range(1, rounds + 1):
        steps = []
        for p in transitive:
            a, b = (t.where(F.col("predicate") == p) for t in (new, known))
            for x, y in ((a, b), (b, a)):
                steps.append(x.select("subject", F.col("object").alias("via")).join(y.select(F.col("subject").alias("via"), "object"), "via").where("subject <> object").select("subject", F.lit(p).alias("predicate"), "object"))
        for p, q in (inverse or {}).items():
            steps.append(new.where(F.col("predicate") == p).select(F.col("object").alias("subject"), F.lit(q).alias("predicate"), F.col("subject").alias("object")))
        for p, q in (rename or {}).items():
            steps.append(new.where(F.col("predicate") == p).select("subject", F.lit(q).alias("predicate"), "object"))
        if not steps:
            break
        found = steps[0]
        for s in steps[1:]:
            found = found.unionByName(s)
        new = cut(found.distinct().join(known, KEY, "left_anti"))
        if new.isEmpty():
            break
        out = new.withColumn("iteration", F.lit(i)) if out is None else out.unionByName(new.withColumn("iteration", F.lit(i)))
        known = cut(known.unionByName(new))
    return out if out is not None else known.where("false").withColumn("iteration", F.lit(0))


def k_paths(edges: DataFrame, start: str, end: str, k: int, max_hops: int) -> DataFrame:
    """(rank, path, cost) of the k cheapest simple paths over edges (source, target, cost) within max_hops.

    All simple paths up to the hop limit are enumerated, so these are the true k best; ties by the path itself.
    """
    at = edges.sparkSession.createDataFrame([(start, [start], 0.0)], "node string, path array<string>, cost double")
    done = at.where("false")
    for _ in range(max_hops):
        at = cut(at.withColumnRenamed("cost", "so_far").join(edges, F.col("node") == F.col("source")).where(~F.array_contains("path", F.col("target"))).select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"), (F.col("so_far") + F.col("cost")).alias("cost")))
        done = done.unionByName(at.where(F.col("node") == end))
        at = at.where(F.col("node") != end)
    best = done.select(F.round("cost", 9).alias("cost"), F.array_join("path", ">").alias("path")).orderBy("cost", "path").limit(k)
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.orderBy("cost", "path")))


def translate(triples: DataFrame, dim: int = 16, epochs: int = 30, sample: int = 20_000, rate: float = 0.05, margin: float = 1.0, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """Translation embeddings ((entity, vector), (predicate, vector)) of all entities and predicates of the triples.

    Vectors of predicates and tails are fitted on at most sample triples (margin ranking with seeded negative tails,
    entity rows of length 1): first one of each predicate, then one of each tail, then the rest by hash order. All
    other entities get theirs in Spark from all their triples, see fold_in().
    """
    spark = triples.sparkSession
    known = triples.select(*KEY)
    least = lambda: F.min(F.struct(F.xxhash64(*KEY).alias("hash"), *KEY)).alias("first")
    first = known.groupBy("predicate").agg(least()).select("first.*", F.lit(0).alias("turn"))
    first = first.unionByName(known.groupBy("predicate", "object").agg(least()).select("first.*", F.lit(1).alias("turn")))
    first = first.unionByName(known.select(F.xxhash64(*KEY).alias("hash"), *KEY, F.lit(2).alias("turn")))
    drawn = first.orderBy("turn", "hash", *KEY).limit(3 * sample).collect()  # a triple stands here up to three times
    rows = list(dict.fromkeys((r.subject, r.predicate, r.object) for r in drawn))[:sample]
    names = sorted({r[0] for r in rows} | {r[2] for r in rows})
    kinds = sorted({r[1] for r in rows})
    e, p = {n: i for i, n in enumerate(names)}, {n: i for i, n in enumerate(kinds)}
    h, r, t = (np.array([m[x[k]] for x in rows], dtype=int) for k, m in ((0, e), (1, p), (2, e)))
    rng = np.random.default_rng(seed)
    ev, pv = rng.normal(size=(len(names), dim)), rng.normal(size=(max(1, len(kinds)), dim)) * 0.1
    ev /= np.linalg.norm(ev, axis=1, keepdims=True) + 1e-12
    for _ in range(epochs if len(rows) else 0):
        for k in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 512)):
            bad = rng.integers(0, len(names), len(k))
            good_d, bad_d = ev[h[k]] + pv[r[k]] - ev[t[k]], ev[h[k]] + pv[r[k]] - ev[bad]
            g, b = np.linalg.norm(good_d, axis=1), np.linalg.norm(bad_d, axis=1)
            on = (margin + g - b > 0)[:, None]
            gu, bu = on * good_d / (g[:, None] + 1e-9), on * bad_d / (b[:, None] + 1e-9)
            for target, at, step in ((ev, h[k], bu - gu), (pv, r[k], bu - gu), (ev, t[k], gu), (ev, bad, -bu)):
                np.add.at(target, at, rate * step)
        ev /= np.linalg.norm(ev, axis=1, keepdims=True) + 1e-12
    frame = lambda keys, m, name: spark.createDataFrame([(x, v.tolist()) for x, v in zip(keys, m)], f"{name} string, vector array<double>")
    tails = {r[2] for r in rows}
    at = [i for i, n in enumerate(names) if n in tails]
    p = frame(kinds, pv, "predicate")
    return fold_in(known, frame([names[i] for i in at], ev[at], "entity"), p, dim), p


def fold_in(triples: DataFrame, fitted: DataFrame, predicates: DataFrame, dim: int) -> DataFrame:
    """fitted (entity, vector) and a vector for every other entity of the triples.

    In rounds, an entity next to known ones gets the mean of tail - predicate over its triples with a known tail and of
    head + predicate over those with a known head, of length 1. Tails that no known entity reaches start by a hash.
    """
    edges = cut(triples.join(F.broadcast(predicates.withColumnRenamed("vector", "p")), "predicate").select("subject", "object", "p"))
    known = cut(fitted)
    add = lambda sign: F.zip_with("vector", "p", lambda v, p: v + sign * p)
    while True:
        near = edges.join(known.withColumnRenamed("entity", "object"), "object").select(F.col("subject").alias("entity"), add(-1).alias("v"))
        near = near.unionByName(edges.join(known.withColumnRenamed("entity", "subject"), "subject").select(F.col("object").alias("entity"), add(1).alias("v")))
        new = near.join(known.select("entity"), "entity", "left_anti").groupBy("entity").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(dim)]).alias("v"))
        new = cut(_unit(new))
        if new.isEmpty():
            lost = edges.select(F.col("object").alias("entity")).distinct().join(known.select("entity"), "entity", "left_anti")
            new = cut(_unit(lost.withColumn("v", F.array(*[F.xxhash64("entity", F.lit(i)).cast("double") / 2.0**63 for i in range(dim)]))))
            if new.isEmpty():
                return known
        known = cut(known.unionByName(new))


def _unit(vectors: DataFrame) -> DataFrame:
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)) + 1e-12
    return vectors.withColumn("size", size).select("entity", F.transform("v", lambda x: x / F.col("size")).alias("vector"))
