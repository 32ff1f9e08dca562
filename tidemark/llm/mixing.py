"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: Distinct membership patterns (and sources) that the flow is solved for on the driver.
MAX_PATTERNS = 100_000
#: Buckets of the seeded order, for prefix sums without one task a pattern.
BUCKETS = 4096


def targets(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """Shares of total by weight; none above cap times its size, the excess reshared by weight until none is above."""
    out, open_, left = {}, set(sizes), total
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * weights[s] for s in open_}
        for s in full:
            out[s] = cap * float(sizes[s])
            left -= out[s]
        open_ -= full
    return out


class Flow:
    """Min-cost flow in a network with few distinct costs: arc e and its reverse e ^ 1 stand side by side."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.room, self.cost = [], [], []
        self.potential = [0] * nodes

    def arc(self, u: int, v: int, capacity: int, price: int) -> int:
        for a, b, c, w in ((u, v, capacity, price), (v, u, 0, -price)):
            self.arcs[a].append(len(self.to))
            self.to.append(b)
            self.room.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def _cheapest(self, source: int, sink: int) -> bool:
        """Lets potentials be the costs of the cheapest ways from source; whether sink can be reached."""
        best, done, heap = {source: 0}, set(), [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for e in self.arcs[u]:
                if self.room[e]:
                    v = self.to[e]
                    n = d + self.cost[e] + self.potential[u] - self.potential[v]
                    if n < best.get(v, n + 1):
                        best[v] = n
                        heapq.heappush(heap, (n, v))
        if sink in best:
            for v in range(len(self.potential)):
                self.potential[v] += min(best.get(v, best[sink]), best[sink])
        return sink in best

    def _free(self, u: int, e: int) -> bool:
        return self.room[e] > 0 and self.cost[e] + self.potential[u] == self.potential[self.to[e]]

    def _levels(self, source: int) -> list[int]:
        level = [-1] * len(self.arcs)
        level[source], row = 0, [source]
        while row:
            below = []
            for u in row:
                for e in self.arcs[u]:
                    v = self.to[e]
                    if level[v] < 0 and self._free(u, e):
                        level[v] = level[u] + 1
                        below.append(v)
            row = below
        return level

    def _block(self, source: int, sink: int, level: list[int]) -> None:
        """Fills cheapest ways of fewest arcs until each is full somewhere; every arc is given up once at most."""
        turn, path, u = [0] * len(self.arcs), [], source
        while True:
            if u == sink:
                push = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
                cut = next(k for k, e in enumerate(path) if not self.room[e])
                u = self.to[path[cut] ^ 1]
                del path[cut:]
            elif turn[u] < len(self.arcs[u]):
                e = self.arcs[u][turn[u]]
                if level[self.to[e]] == level[u] + 1 and self._free(u, e):
                    path.append(e)
                    u = self.to[e]
                else:
                    turn[u] += 1
            elif path:
                u = self.to[path.pop() ^ 1]
                turn[u] += 1
            else:
                return

    def run(self, source: int, sink: int) -> None:
        """All flow that fits, at the least cost: for each cost of a cheapest way, all ways of that cost at once."""
        while self._cheapest(source, sink):
            while (level := self._levels(source))[sink] >= 0:
                self._block(source, sink, level)


def route(quotas: dict, patterns: dict, repeats: int) -> dict:
    """Tokens (source, pattern) by min-cost flow: quotas out of sources, through patterns that hold them.

    patterns: {pattern: tokens of its documents}. The k-th pass over a pattern costs k * k a token, so the cost is
    convex and repetition is spread over what may serve a source. Capacities are whole tokens.
    """
    if not quotas or not patterns:
        return {}
    names = sorted(quotas)
    number = {s: 2 + k for k, s in enumerate(names)}
    flow = Flow(2 + len(names) + len(patterns))
    for s in names:
        flow.arc(0, number[s], quotas[s], 0)
    through = {}
    for k, (p, size) in enumerate(sorted(patterns.items())):
        own = 2 + len(names) + k
        for s in sorted(set(p)):
            through[s, p] = flow.arc(number[s], own, size * repeats, 0)
        for turn in range(1, repeats + 1):
            flow.arc(own, 1, size, turn * turn)
    flow.run(0, 1)
    return {k: flow.room[e ^ 1] for k, e in through.items() if flow.room[e ^ 1]}


def mix_sources(docs: DataFrame, id_col: str, size, sources, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, and the columns of keep.

    size: tokens of a document (column); sources: array of the sources that hold it (a null element is a source of its
    own, last). Sources, by code point, weigh as weights has it, repeating. They share the given part of all tokens;
    targets stop at repeats times a source's size. Documents are summed by membership pattern, the flow decides how
    many tokens each pattern gives, and whole documents fill that in a seeded order: all of them once for each full
    pass, then those up to the rest, then the one whose size comes nearest to what is missing. No document is
    taken more than repeats times. source_size and target are those of a document's first source.

    Only sums by pattern reach the driver; more than MAX_PATTERNS of them raise. The seeded order is cut into BUCKETS
    of hashes, and equal rows are told apart by number, so no task holds a pattern or a group of equal rows, and one of
    equal rows can be taken without the others. Null sizes count as 0; documents of size 0, or without a source, give 0.
    """
    order = F.xxhash64(F.lit(seed), F.col(id_col), size)
    d = docs.select(*keep, F.col(id_col).alias("_id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), sources.alias("sources"), order.alias("h"), F.monotonically_increasing_id().alias("row"))
    key = lambda x: F.when(x.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), x.cast("string")))
    d = d.withColumn("pattern", F.array_sort(F.array_distinct(F.transform(F.coalesce("sources", F.array().cast("array<string>")), key)))).drop("sources")
    d = stored(d, "mix")
    found = d.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r.pattern): r.size for r in found if r.pattern}
    sizes: dict[str, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    ordered = sorted(sizes)
    wanted = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(ordered)}, share * sum(patterns.values()), repeats) if sizes else {}
    flow: dict[tuple, int] = {}
    for (_, p), n in route({s: round(t) for s, t in wanted.items()}, {p: n for p, n in patterns.items() if n}, repeats).items():
        flow[p] = flow.get(p, 0) + n
    rows = [(list(p), sizes[p[0]], float(wanted[p[0]]), *(divmod(flow.get(p, 0), n) if n else (0, 0))) for p, n in patterns.items()]
    plan = d.sparkSession.createDataFrame(rows, "pattern array<string>, source_size long, target double, passes long, rest long")
    d = d.join(F.broadcast(plan), "pattern", "left")
    part = d.where("rest > 0 and size > 0").select("pattern", "size", "row", "h", "rest", F.shiftrightunsigned("h", 64 - (BUCKETS.bit_length() - 1)).alias("bucket"), F.struct("h", F.shiftright("row", 33).alias("task")).alias("place"))
    # by buckets of the order, in the bucket where the rest ends by place (equal rows of a task share one), there by row
    chosen, edge = _upto(part, "bucket")
    more, edge = _upto(edge, "place")
    last, _ = _upto(edge, "row")
    chosen = stored(chosen.unionAll(more).unionAll(last), "chosen")
    # what whole documents leave of a pattern's rest is filled by the nearest single one
    got = chosen.groupBy("pattern").agg(F.sum("size").alias("got"))
    short = F.broadcast(plan.where("rest > 0").join(got, "pattern", "left").select("pattern", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("short")).where("short > 0"))
    d = stored(d.join(chosen.select("row", F.lit(1).alias("extra")), "row", "left").withColumn("extra", F.coalesce("extra", F.lit(0))), "mix")
    free = d.where("extra = 0 and size > 0").join(short, "pattern").where("abs(size - short) < short")
    filler = free.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("short")).alias("miss"), "h", F.col("_id").alias("id"), "row")).alias("fill")).select("pattern", F.col("fill.row").alias("fill_row"))
    d = d.join(F.broadcast(filler), "pattern", "left")
    extra = F.when((F.col("extra") == 1) | F.coalesce(F.col("fill_row") == F.col("row"), F.lit(False)), 1).otherwise(0)
    taken = F.coalesce(F.col("size") * (F.col("passes") + extra), F.lit(0))
    return d.select(*keep, F.col("_id").alias(id_col), "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), taken.cast("long").alias("taken"))


def _upto(part: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows of each pattern in the order of a column, up to its rest: (pattern, row, size) of those whose whole group
    fits, and the rows of the group in which the rest ends, with what is left of it."""
    sums = part.groupBy("pattern", by).agg(F.sum("size").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("pattern").orderBy(by))).select("pattern", by, (F.col("upto") - F.col("n")).alias("before"), "upto")
    part = part.join(sums, ["pattern", by])
    edge = part.where("upto > rest and before < rest").withColumn("rest", F.col("rest") - F.col("before"))
    return part.where("upto <= rest").select("pattern", "row", "size"), edge.drop("before", "upto")


def n_words(text):
    """Runs of other characters than space and \\t..\\r; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def op4_min_cost_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs, "doc_id", n_words(F.col("text")), F.array("source"))
