"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties each neighbour of u (large: those above u, else those below) and u itself to the least of them."""
    if large:
        edges = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = edges.join(least, "u").where((F.col("v") > F.col("u")) if large else F.lit(True)).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        tied = tied.unionAll(least.select("u", F.col("m").alias("v")))
    return tied.where("u > v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every id that stands in a link; component is the smallest id that it reaches.

    Nulls and links of an id with itself tie nothing. Each round shrinks the paths by a constant factor and is
    written to the shared folder; no link or component passes through the driver.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stored(edges.distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        edges = stored(_star(_star(edges, True), False), "links")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
