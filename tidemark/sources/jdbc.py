"""Relational sources: cursor filters that the database evaluates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")


def read_table(spark: SparkSession, url: str, table: str, cursor: str | None = None, after=None, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options) -> DataFrame:
    """A table over JDBC, in parallel over ranges of a numeric key; the cursor filter is pushed to the database."""
    for name in filter(None, (table, cursor, key)):
        if not _NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no name")
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    df = r.load()
    return df.where(F.col(cursor) > F.lit(after)) if cursor and after is not None else df
