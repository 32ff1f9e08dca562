"""Communities by local moves, refinement and contraction, in levels.

A large component moves in rounds of joins and aggregations; components of a bounded size are solved in one task each.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import iterate
from .graph import components
from .parts import dealt, solved

#: Edges, each way, of the largest component that one task solves.
SMALL = 20_000
LEVELS = "node string, level int, community string"


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in as many partitions as a shuffle has: without that, unions would add some in every round."""
    return iterate.cut(df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _undirected(edges: DataFrame) -> DataFrame:
    """Weights of the edges between two different nodes, summed, once each way."""
    e = edges.select("source", "target", F.col("weight").cast("double").alias("weight")).where("source <> target and weight > 0")
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    return e.unionByName(back).groupBy("source", "target").agg(F.sum("weight").alias("weight"))


#: Local moves end where both halves together moved at most this share of the nodes.
FEW = 0.005


def moved(nodes: DataFrame, edges: DataFrame, mass: float, gamma: float, rounds: int) -> DataFrame:
    """(node, community) after local moves of nodes (node, degree) along edges (source, target, weight; both ways).

    In a round half of the nodes, by a hash that changes every other round, go to the community next to them with the
    largest gain, if it is above that of staying; so neighbours seldom swap places. It ends when few of both halves move.
    """
    label = nodes.select("node", "degree", F.col("node").alias("community"))
    last, few = None, FEW * nodes.count()
    for r in range(rounds):
        totals = label.groupBy("community").agg(F.sum("degree").alias("total"))
        to = label.select(F.col("node").alias("target"), "community")
        near = edges.join(to, "target").groupBy(F.col("source").alias("node"), "community").agg(F.sum("weight").alias("link"))
        own = label.join(totals, "community").select("node", "degree", F.col("community").alias("own"), F.col("total").alias("own_total"))
        choice = near.join(own, "node", "right").join(totals, "community", "left")
        gain = F.col("link") - gamma * F.col("degree") * (F.col("total") - F.when(F.col("community") == F.col("own"), F.col("degree")).otherwise(0.0)) / mass
        choice = choice.select("node", "degree", "own", "own_total", "community", gain.alias("gain")).groupBy("node", "degree", "own", "own_total")
        choice = choice.agg(F.min(F.when(F.col("gain").isNotNull(), F.struct((-F.col("gain")).alias("loss"), "community"))).alias("best"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("linked"))
        # without a link to its own community a node only pays for being in it
        stay = F.coalesce("linked", -gamma * F.col("degree") * (F.col("own_total") - F.col("degree")) / mass)
        turn = F.pmod(F.xxhash64("node", F.lit(r // 2)) + r, F.lit(2)) == 0
        goes = F.coalesce(turn & (-F.col("best.loss") > stay + 1e-12) & (F.col("best.community") != F.col("own")), F.lit(False))
        label = cut(choice.select("node", "degree", F.when(goes, F.col("best.community")).otherwise(F.col("own")).alias("community"), goes.alias("moved")))
        now = label.where("moved").count()
        label = label.drop("moved")
        if last is not None and now + last <= few:
            break
        last = now
    return label.select("node", "community")


def connected(label: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community) with every community cut into its connected parts, named by their smallest nodes."""
    a, b = (label.select(F.col("node").alias(side), F.col("community").alias(f"of_{side}")) for side in ("source", "target"))
    inside = cut(edges.join(a, "source").join(b, "target").where("of_source = of_target and source < target").select("source", "target"))
    part = components(inside)
    return label.join(part, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame, gamma: float = 1.0) -> float:
    """Of a partition (node, community) of edges (source, target, weight), taken undirected; 0 without edges."""
    e = _undirected(edges)
    a, b = (communities.select(F.col("node").alias(side), F.col("community").alias(f"of_{side}")) for side in ("source", "target"))
    c = e.join(a, "source").join(b, "target").groupBy("of_source").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("of_source") == F.col("of_target"), F.col("weight")).otherwise(0.0)).alias("inside"))
    m, inside, square = c.agg(F.sum("total"), F.sum("inside"), F.sum(F.col("total") * F.col("total"))).first()
    return (inside / m - gamma * square / (m * m)) if m else 0.0


def _connected_parts(near: list[dict[int, float]], label: list[int]) -> list[int]:
    part = [-1] * len(near)
    for i in range(len(near)):
        todo = [i] if part[i] < 0 else []
        while todo:
            x = todo.pop()
            if part[x] < 0:
                part[x] = i
                todo += [y for y in near[x] if part[y] < 0 and label[y] == label[i]]
    return part


def _separate(edges: list[tuple[str, str, float]]) -> list[list[tuple[str, str, float]]]:
    """The edges (both ways) of each component; nearly always of the one that there is."""
    near = defaultdict(list)
    for edge in edges:
        near[edge[0]].append(edge)
    out, seen = [], set()
    for start in near:
        if start not in seen:
            seen.add(start)
            todo, part = [start], []
            while todo:
                for edge in near[todo.pop()]:
                    part.append(edge)
                    if edge[1] not in seen:
                        seen.add(edge[1])
                        todo.append(edge[1])
            out.append(part)
    return out


def small_levels(edges: list[tuple[str, str, float]], mass: float, gamma: float, max_levels: int) -> list[dict[str, str]]:
    """Levels of one component (edges both ways): node -> community. Nodes move one after the other, in their order."""
    names = sorted({a for a, *_ in edges})
    place = {n: i for i, n in enumerate(names)}
    near: list[dict[int, float]] = [defaultdict(float) for _ in names]
    for a, b, x in edges:
        near[place[a]][place[b]] += x
    degree = [sum(x.values()) for x in near]
    member, out = list(range(len(names))), []
    for _ in range(max_levels):
        label, total, moving = list(range(len(near))), list(degree), True
        while moving:
            moving = False
            for i, links in enumerate(near):
                to = defaultdict(float)
                for j, x in links.items():
                    if j != i:
                        to[label[j]] += x
                own = best = label[i]
                total[own] -= degree[i]
                gain = to[own] - gamma * degree[i] * total[own] / mass
                for c in sorted(to):
                    here = to[c] - gamma * degree[i] * total[c] / mass
                    if here > gain + 1e-12:
                        best, gain = c, here
                total[best] += degree[i]
                label[i], moving = best, moving or best != own
        part = _connected_parts(near, label)
        keep = sorted(set(part))
        if len(keep) == len(near):
            break
        new = {c: k for k, c in enumerate(keep)}
        joined: list[dict[int, float]] = [defaultdict(float) for _ in keep]
        sums = [0.0] * len(keep)
        for i, links in enumerate(near):
            sums[new[part[i]]] += degree[i]
            for j, x in links.items():
                joined[new[part[i]]][new[part[j]]] += x
        near, degree, member = joined, sums, [new[part[m]] for m in member]
        first = {}
        for i, m in enumerate(member):
            first.setdefault(m, names[i])
        out.append({names[i]: first[m] for i, m in enumerate(member)})
    return out or [{n: n for n in names}]


def leiden(edges: DataFrame, gamma: float = 1.0, max_levels: int = 10, rounds: int = 10, small: int = SMALL) -> DataFrame:
    """(node, level, community): level 0 is the finest; communities of a level are connected and lie inside those above.

    edges (source, target, weight) count both ways, repeats add up; loops and weights of zero or below are left out. A
    level moves nodes to where modularity (of the whole graph) grows most, cuts communities into connected parts and
    makes each a node of the next level, until nothing merges. Communities bear the name of their smallest node, and a
    component's levels end with its last merge. Components of at most `small` edges (each way) are solved in a task
    each; larger ones move in parallel rounds, and none passes through one task.
    """
    e = cut(_undirected(edges))
    mass = e.agg(F.sum("weight")).first()[0]
    if not mass:
        return e.select(F.col("source").alias("node"), F.lit(0).alias("level"), F.col("target").alias("community")).where("false")
    near, far = dealt(e, small)

    def solve(source, target, weight):
        for part in _separate(list(zip(source, target, weight, strict=True))):
            for k, level in enumerate(small_levels(sorted(part), mass, gamma, max_levels)):
                yield list(level), [k] * len(level), list(level.values())

    out = solved(near, ["source", "target", "weight"], solve, LEVELS)
    if far is not None:
        out = out.unionByName(_rounds(far, mass, gamma, max_levels, rounds))
    return cut(out)


def _rounds(e: DataFrame, mass: float, gamma: float, max_levels: int, rounds: int) -> DataFrame:
    """Levels of edges (source, target, weight; both ways) of a graph of that mass, in parallel."""
    nodes = cut(e.groupBy(F.col("source").alias("node")).agg(F.sum("weight").alias("degree")))
    size = nodes.count()
    member = nodes.select("node", F.col("node").alias("community"))
    out, best = None, None
    for level in range(max_levels):
        label = cut(connected(moved(nodes, e, mass, gamma, rounds), e))
        merged = label.select("community").distinct().count()
        if merged == size:
            break
        a, b = (label.select(F.col("node").alias(side), F.col("community").alias(f"of_{side}")) for side in ("source", "target"))
        joined = e.join(a, "source").join(b, "target").groupBy(F.col("of_source").alias("source"), F.col("of_target").alias("target")).agg(F.sum("weight").alias("weight"))
        joined = cut(joined)
        before = nodes
        nodes = cut(nodes.join(label, "node").groupBy(F.col("community").alias("node")).agg(F.sum("degree").alias("degree")))
        # of the mass between nodes, what has come inside; loops of earlier levels stay inside
        inside = joined.agg(F.sum(F.when(F.col("source") == F.col("target"), F.col("weight")))).first()[0] or 0.0
        square = lambda df: df.agg(F.sum(F.col("degree") * F.col("degree"))).first()[0]
        gain = inside / mass - gamma * (square(nodes) - square(before)) / (mass * mass)
        if gain <= 1e-9:
            break
        best, size, e = gain, merged, joined.where("source <> target")
        member = cut(member.join(label.withColumnRenamed("node", "below").withColumnRenamed("community", "above"), F.col("community") == F.col("below")).select("node", F.col("above").alias("community")))
        now = member.select("node", F.lit(level).alias("level"), "community")
        out = now if out is None else out.unionByName(now)
    return out if best is not None else member.select("node", F.lit(0).alias("level"), "community")


def ancestry(levels: DataFrame) -> DataFrame:
    """(node, path) of communities from the finest level to the coarsest."""
    return levels.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("level", "community"))).alias("p")).select("node", F.col("p.community").alias("path"))


def top_level(levels: DataFrame) -> DataFrame:
    """(node, community) of each node's coarsest level."""
    return levels.groupBy("node").agg(F.max_by("community", "level").alias("community"))
