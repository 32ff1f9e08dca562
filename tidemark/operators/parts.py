"""Whole components of a graph, dealt to tasks: what a component alone decides is solved where its edges are.

Components are found by contraction, so later rounds are small, and only those of a bounded size go to a task; larger
ones are left to loops of joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut

#: Edges of the largest component that one task solves.
SMALL = 5_000
#: Rows of a batch that a task gives back.
BATCH = 50_000


def parts(edges: DataFrame) -> DataFrame:
    """(id, part): id is xxhash64 of a node of edges (source, target) that are no loops; a component is in one part.

    In a round every node joins the first of itself and those next to it, in an order by a hash of its own; edges between
    what is left go on. So at least a share of the nodes goes in every round, whatever the graph. Two components share a
    part only where two hashes of 64 bits are equal.
    """
    e = edges.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b")).where("a <> b")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    maps: list[DataFrame] = []
    while True:
        first = lambda c: F.xxhash64(c, F.lit(len(maps)))  # noqa: B023, E731
        ways = e.select(F.col("a").alias("id"), first("b").alias("other")).unionByName(e.select(F.col("b").alias("id"), first("a").alias("other")))
        to = cut(ways.groupBy("id").agg(F.min("other").alias("to")).select("id", F.least("to", first("id")).alias("to")))
        maps.append(to)
        a, b = (to.select(F.col("id").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        e = e.join(a, "a").join(b, "b").where("to_a <> to_b")
        e = cut(e.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if e.isEmpty():
            break
    out = maps[-1].withColumnRenamed("to", "part")
    for m in reversed(maps[:-1]):
        out = m.join(out.select(F.col("id").alias("to"), F.col("part").alias("last")), "to", "left").select("id", F.coalesce("last", "to").alias("part"))
    return out


def dealt(edges: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """(part, the columns of edges) of components of at most `small` edges, and the edges of the others, if there are any."""
    of = parts(edges)
    tagged = edges.withColumn("id", F.xxhash64("source")).join(of, "id", "left").select(F.coalesce("part", "id").alias("part"), *edges.columns)
    tagged = cut(tagged.repartition("part"))
    large = cut(tagged.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > small).select("part"))
    if large.isEmpty():
        return tagged, None
    return tagged.join(large, "part", "left_anti"), cut(tagged.join(large, "part", "left_semi").drop("part"))


def solved(near: DataFrame, columns: list[str], solve: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that `solve` makes of each part; it takes a list for each of the columns and yields a list for each of schema."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        rows: list[list] = [[] for _ in names]
        for group in _groups(batches):
            for found in solve(*group):
                for r, f in zip(rows, found, strict=True):
                    r.extend(f)
                if len(rows[0]) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)
                    rows = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)

    return near.select("part", *columns).repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def _groups(batches) -> Iterable[list[list]]:
    """The columns of each part, whose rows follow one another in one batch or more."""
    held, last = None, None
    for batch in batches:
        part = batch.column(0).to_numpy()
        columns = [c.to_pylist() for c in batch.columns[1:]]
        cuts = [0, *(1 + np.flatnonzero(part[1:] != part[:-1])).tolist(), len(part)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            rows = [c[low:high] for c in columns]
            if held is not None and part[low] == last:
                held = [h + r for h, r in zip(held, rows, strict=True)]
                continue
            if held is not None:
                yield held
            held, last = rows, part[low]
    if held is not None:
        yield held


def indexed(source: list, target: list) -> tuple[list, list[set[int]]]:
    """Names of the nodes, and for each the places of those that its edges lead to."""
    place = {n: i for i, n in enumerate(dict.fromkeys([*source, *target]))}
    ahead: list[set[int]] = [set() for _ in place]
    for a, b in zip(source, target, strict=True):
        ahead[place[a]].add(place[b])
    return list(place), ahead


def depths(ahead: list[set[int]]) -> list[int]:
    """Edges on the longest way to each node; -1 on and behind cycles."""
    waits = [0] * len(ahead)
    for to in ahead:
        for j in to:
            waits[j] += 1
    depth, ready = [0] * len(ahead), [i for i, n in enumerate(waits) if not n]
    for i in ready:  # grows on the way
        for j in ahead[i]:
            depth[j] = max(depth[j], depth[i] + 1)
            waits[j] -= 1
            if not waits[j]:
                ready.append(j)
    return [-1 if w else d for w, d in zip(waits, depth, strict=True)]


def reached(ahead: list[set[int]]) -> list[int]:
    """For each node the set of those behind its edges, as bits; a node is in its own set only on a cycle."""
    depth = depths(ahead)
    order = sorted(range(len(ahead)), key=lambda i: -depth[i])  # without cycles, nodes ahead come first
    reach, changed = [0] * len(ahead), True
    cyclic = -1 in depth
    while changed:
        changed = False
        for i in order:
            bits = reach[i]
            for j in ahead[i]:
                bits |= reach[j] | 1 << j
            changed |= bits != reach[i]
            reach[i] = bits
        changed &= cyclic
    return reach


def places(bits: int, size: int) -> list[int]:
    """The bits that are set."""
    if size <= 64:
        return [j for j in range(size) if bits >> j & 1]
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((size + 7) // 8, "little"), np.uint8), bitorder="little")).tolist()
