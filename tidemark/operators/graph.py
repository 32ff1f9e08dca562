"""Graph operators as relational loops: edges are DataFrames, each round is a join and an aggregation."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import parts as P
from .iterate import cut


def both_ways(edges: DataFrame, *values: str) -> DataFrame:
    """edges (source, target, values) and their reverses, without repeats."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *values)
    return edges.select("source", "target", *values).unionByName(back).distinct()


def dealt_pairs(a: DataFrame, b: DataFrame, keys: list[str], by: str, rows: int = 1000, held: int = 100_000) -> DataFrame:
    """The inner join of a and b on keys, for keys that make many more pairs than rows; `by` is a column of a.

    A key's pairs are dealt to fields, by a hash of `by` and one of b's row: as many as its share of four fields a task, but
    not more than one for rows * rows pairs. Sides are cut in proportion, so a row is copied some times whatever the size;
    only where b has more than `held` rows of a key in a field, as a task holds these, there are more copies of a.
    Both sides are read twice. The number of tasks is given, as small sides that make many pairs would else be read by one.
    """
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    of_a, of_b = (x.groupBy(*keys).agg(F.count("*").cast("double").alias(n)) for x, n in ((a, "of_a"), (b, "of_b")))
    sizes = of_a.join(of_b, keys).withColumn("dealt_pairs", F.col("of_a") * F.col("of_b"))
    total = F.broadcast(sizes.agg(F.sum("dealt_pairs").alias("dealt_total")))  # one row
    fields = F.least(F.ceil(F.col("dealt_pairs") * (4.0 * tasks) / F.col("dealt_total")), F.ceil(F.col("dealt_pairs") / float(rows * rows)))
    down = F.least(fields, F.greatest(F.lit(1), F.round(F.sqrt(fields * F.col("of_a") / F.col("of_b"))))).cast("int")
    across = F.greatest(F.ceil(fields / F.col("down")), F.ceil(F.col("of_b") / float(held))).cast("int")
    parts = sizes.crossJoin(total).withColumn("down", down).withColumn("across", across).select(*keys, F.col("down").alias("dealt_down"), F.col("across").alias("dealt_across"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = F.xxhash64(*(c for c in b.columns if c not in keys)) if set(b.columns) - set(keys) else F.monotonically_increasing_id()
    left = a.join(parts, keys).withColumn("dealt_x", F.pmod(F.xxhash64(by), F.col("dealt_down")).cast("int")).withColumn("dealt_y", every("dealt_across"))
    right = b.join(parts, keys).withColumn("dealt_y", F.pmod(own, F.col("dealt_across")).cast("int")).withColumn("dealt_x", every("dealt_down"))
    on = [*keys, "dealt_x", "dealt_y"]
    left, right = (x.drop("dealt_down", "dealt_across").repartition(tasks, *on) for x in (left, right))
    return left.hint("shuffle_merge").join(right, on).drop("dealt_x", "dealt_y")


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, node, distance) within max_depth hops along edges (source, target); starts has (start)."""
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
        frontier = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int) -> DataFrame:
    """The shortest path as an array; of equally long ones the lexicographically smallest. No row if there is none."""
    paths = edges.sparkSession.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = paths.select("node")
    for _ in range(max_depth):
        hit = paths.where(F.col("node") == end)
        if not hit.isEmpty():
            return hit.select("path")
        step = paths.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        paths = cut(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        seen = seen.unionByName(paths.select("node"))
    return paths.where(F.col("node") == end).select("path")


def cheapest(edges: DataFrame, start: str, max_hops: int) -> DataFrame:
    """(node, cost) of the cheapest walks of at most max_hops edges (source, target, cost) from start."""
    best = edges.sparkSession.createDataFrame([(start, 0.0)], "node string, cost double")
    known = None
    for _ in range(max_hops):
        step = best.withColumnRenamed("cost", "so_far").join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node"), (F.col("so_far") + F.col("cost")).alias("cost"))
        best = cut(best.unionByName(step).groupBy("node").agg(F.min("cost").alias("cost")))
        now = best.agg(F.count("*"), F.sum("cost")).first()
        if now == known:
            break
        known = now
    return best


def closure(edges: DataFrame, small: int = P.SMALL) -> DataFrame:
    """Transitive closure (source, target), with (a, a) on cycles.

    Components of at most `small` edges are closed in a task each, the others by rounds of joins.
    """

    def pairs(source, target):
        names, ahead = P.indexed(source, target)
        for name, bits in zip(names, P.reached(ahead), strict=True):
            found = P.places(bits, len(names))
            yield [name] * len(found), [names[j] for j in found]

    near, far = P.dealt(cut(edges.select("source", "target")), small)
    out = P.solved(near, ["source", "target"], pairs, "source string, target string")
    return out if far is None else out.unionByName(_closure_by_rounds(far))


def descendants(edges: DataFrame, small: int = P.SMALL) -> DataFrame:
    """(node, n, cyclic): how many nodes a node leads to, for those with edges, and whether it is one of them."""

    def counted(source, target):
        names, ahead = P.indexed(source, target)
        found = [(n, bits.bit_count(), bits >> i & 1) for i, (n, bits) in enumerate(zip(names, P.reached(ahead), strict=True)) if bits]
        yield tuple(zip(*found, strict=True))

    near, far = P.dealt(cut(edges.select("source", "target")), small)
    out = P.solved(near, ["source", "target"], counted, "node string, n long, cyclic int")
    if far is not None:
        rest = _closure_by_rounds(far).groupBy(F.col("source").alias("node"))
        out = out.unionByName(rest.agg(F.count("*").alias("n"), F.max((F.col("source") == F.col("target")).cast("int")).alias("cyclic")))
    return out.withColumn("cyclic", F.col("cyclic") == 1)


def _closure_by_rounds(edges: DataFrame) -> DataFrame:
    """The same for a graph of any size.

    Each round doubles the length of the paths that are known: a pair at a distance of up to twice that is a pair that
    the last round found and a known one.
    """
    known = cut(edges.select("source", "target").distinct())
    new = known
    while True:
        step = new.select("source", F.col("target").alias("via")).join(known.select(F.col("source").alias("via"), "target"), "via").select("source", "target").distinct()
        new = cut(step.join(known, ["source", "target"], "left_anti"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each reaches, by minimum labels with shortcuts."""
    e = cut(both_ways(edges))
    label = e.groupBy("source").agg(F.least(F.col("source"), F.min("target")).alias("component")).withColumnRenamed("source", "node")
    known = None
    while True:
        near = e.join(label, F.col("target") == F.col("node")).select(F.col("source").alias("node"), "component")
        low = near.unionByName(label).groupBy("node").agg(F.min("component").alias("component"))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("next"))
        label = cut(low.join(jump, "component", "left").select("node", F.least(F.col("component"), F.coalesce("next", "component")).alias("component")))
        now = label.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]
        if now == known:
            return label
        known = now


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 50, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): weights of edges (source, target, weight) share a node's rank; dangling mass goes to all."""
    n = nodes.count()
    out = edges.groupBy("source").agg(F.sum("weight").alias("total"))
    shares = cut(edges.join(out, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")))
    sinks = nodes.join(out.select(F.col("source").alias("node")), "node", "left_anti").withColumn("sink", F.lit(1))
    base = cut(nodes.join(sinks, "node", "left").select("node", F.coalesce("sink", F.lit(0)).alias("sink")))
    rank = base.select("node", "sink", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        got = rank.join(shares, F.col("node") == F.col("source")).groupBy("target").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = rank.agg(F.sum(F.col("rank") * F.col("sink")).alias("lost"))  # one row
        new = rank.join(got, F.col("node") == F.col("target"), "left").join(F.broadcast(lost))
        new = cut(new.select("node", "sink", F.col("rank").alias("old"), ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = new.drop("old")
        if change < tolerance:
            break
    total = rank.agg(F.sum("rank").alias("all"))
    return rank.join(F.broadcast(total)).select("node", (F.col("rank") / F.col("all")).alias("rank"))


def in_parts(rows: int, *frames: tuple[DataFrame, list[str]], each: int = 250_000) -> list[DataFrame]:
    """The frames, each dealt by its keys to as many tasks as hold about `each` of so many rows; so a task's share, and
    the memory that its sort takes, stays the same at every size."""
    spark = frames[0][0].sparkSession
    n = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), -(-rows // each))
    return [df.repartition(n, *keys) for df, keys in frames]


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label): synchronous rounds; each node takes the most frequent label around it, ties the smallest."""
    e = cut(both_ways(edges))
    size = e.count()
    label = e.select(F.col("source").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        near, to = in_parts(size, (e, ["target"]), (label.withColumnRenamed("node", "target"), ["target"]))
        (around,) = in_parts(size, (near.join(to, "target").select("source", "label"), ["source"]))
        votes = around.groupBy("source", "label").agg(F.count("*").alias("n"))
        best = F.min(F.struct((-F.col("n")).alias("few"), "label"))["label"]
        label = cut(votes.groupBy(F.col("source").alias("node")).agg(best.alias("label")))
    return label


def modularity(edges: DataFrame, communities: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: sum over communities of (inside - gamma * total^2 / 4m) / m, for undirected edges of weight 1."""
    e = cut(edges.select("source", "target"))
    size = e.count()
    for node, name in (("source", "a"), ("target", "b")):
        left, right = in_parts(size, (e, [node]), (communities.select(F.col("node").alias(node), F.col("label").alias(name)), [node]))
        e = left.join(right, node)
    e = cut(e.select("a", "b"))
    inside = e.where("a = b").groupBy(F.col("a").alias("label")).agg(F.count("*").alias("inside"))
    total = e.select(F.explode(F.array("a", "b")).alias("label")).groupBy("label").agg(F.count("*").alias("total"))
    m = e.agg(F.count("*").alias("m"))
    q = total.join(inside, "label", "left").join(F.broadcast(m))
    part = (F.coalesce("inside", F.lit(0)) - gamma * F.col("total") * F.col("total") / (4 * F.col("m"))) / F.col("m")
    return q.agg(F.greatest(F.lit(-0.5), F.least(F.lit(1.0), F.sum(part))).alias("modularity"))


def layers(edges: DataFrame, nodes: DataFrame, small: int = P.SMALL) -> DataFrame:
    """(node, layer): a node stands one layer after the last that it needs. Nodes on or behind a cycle have none.

    Components of at most `small` edges are solved in a task each, the others layer by layer.
    """

    def deep(source, target):
        names, ahead = P.indexed(source, target)
        yield names, P.depths(ahead)

    nodes = cut(nodes.select("node"))
    e = cut(edges.select("source", "target").join(nodes.withColumnRenamed("node", "source"), "source", "left_semi"))
    near, far = P.dealt(e, small)
    found = P.solved(near, ["source", "target"], deep, "node string, layer int")
    if far is not None:
        ends = cut(far.select(F.explode(F.array("source", "target")).alias("node")).distinct())
        slow = ends.join(_layers_by_rounds(far, ends), "node", "left").select("node", F.coalesce("layer", F.lit(-1)).alias("layer"))
        found = found.unionByName(slow)
    return nodes.join(found, "node", "left").select("node", F.coalesce("layer", F.lit(0)).alias("layer")).where("layer >= 0")


def _layers_by_rounds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, layer) of a graph of any size, layer by layer."""
    left, out, depth = cut(nodes.select("node")), None, 0
    while True:
        waiting = edges.join(left.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node"))
        ready = cut(left.join(waiting, "node", "left_anti").withColumn("layer", F.lit(depth)))
        if ready.isEmpty():
            return out if out is not None else ready
        out = ready if out is None else out.unionByName(ready)
        left = cut(left.join(ready, "node", "left_anti"))
        depth += 1


def spread(edges: DataFrame, seeds: DataFrame, depth: int, factor: Column | list[Column], least: float = 0.0, combine=F.max) -> DataFrame:
    """(node, score): scores of seeds (node, score) passed on along edges with factor(s); the best (or sum) per node.

    A node's score comes from the first round that reaches it; below least nothing is passed on. Several factors are
    multiplied one after another, from the left, so that the last bit of a score is that of the same chain elsewhere.
    """
    factors = factor if isinstance(factor, list) else [factor]
    seen = cut(seeds.select("node", "score"))
    frontier = seen
    for _ in range(depth):
        step = frontier.where(F.col("score") > least).join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node"), reduce(mul, factors, F.col("score")).alias("score"))
        frontier = cut(step.join(seen, "node", "left_anti").groupBy("node").agg(combine("score").alias("score")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, common, jaccard) of unlinked pairs that share a neighbour."""
    e = cut(both_ways(edges))
    degree = e.groupBy("source").agg(F.count("*").alias("degree"))
    half = e.select(F.col("target").alias("via"), F.col("source").alias("a"))
    pairs = half.join(half.withColumnRenamed("a", "b"), "via").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    pairs = pairs.join(e.select(F.col("source").alias("a"), F.col("target").alias("b")), ["a", "b"], "left_anti")
    d = lambda x: degree.select(F.col("source").alias(x), F.col("degree").alias(f"degree_{x}"))
    pairs = pairs.join(d("a"), "a").join(d("b"), "b")
    return pairs.select("a", "b", "common", (F.col("common") / (F.col("degree_a") + F.col("degree_b") - F.col("common"))).alias("jaccard"))


def best_neighbour(edges: DataFrame) -> DataFrame:
    """Per source and target the most confident edge; outgoing ones win ties, then the smaller predicate."""
    edges = cut(edges.select("source", "target", "predicate", "confidence"))
    out = edges.withColumn("way", F.lit(0))
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "predicate", "confidence", F.lit(1).alias("way"))
    order = Window.partitionBy("source", "target").orderBy(F.desc("confidence"), "way", "predicate")
    (both,) = in_parts(2 * edges.count(), (out.unionByName(back), ["source", "target"]))
    return both.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "way")
