"""Cutting the lineage of loops, and folds over the ordered rows of a key."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed to the folder that the cluster names; a temporary one only on a local master without it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


@contextmanager
def shuffles_freed(spark) -> Iterator[None]:
    """Within it the shuffle files of a query go when it ends, not when the driver collects its garbage.

    For loops that write a table in each round: what was shuffled for it isn't read again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


@contextmanager
def few_rows_a_batch(spark, rows: int = 16) -> Iterator[Callable[[], None]]:
    """Gives a function; from its call on Python gets at most so many rows at once, for rows that hold many values each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    try:
        yield lambda: spark.conf.set(key, str(rows))
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def removed(spark, path: str) -> None:
    """Removes a folder in the work folder that nothing reads any more."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


_LOCAL: dict[str, str] = {}


def work_folder(spark) -> str:
    """The folder that driver and executors share; a temporary one only on a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return f"{root.rstrip('/')}/tidemark"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[app]


def fold_stream(df: DataFrame, key: str, order: list[str], values: list[str], start, step: Callable, result: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """One row per key: a fold over its rows in order, for steps that can't be merged.

    The state goes from batch to batch of a sorted partition, so a key of any size needs little memory. `step` takes the
    state and a row's values; the state that it returns holds the columns of `result` (type for Spark, type for Arrow).
    """
    def run(batches):
        current, state, open_, done = None, None, False, []

        def flush(kind):
            columns = list(zip(*done, strict=True))
            names = [key, *result]
            kinds = [kind, *(t for _, t in result.values())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or k != current:
                    if open_:
                        done.append((current, *state))
                    current, state, open_ = k, start, True
                state = step(state, *row)
            if len(done) >= 10_000:
                yield flush(kind)
                done.clear()
        if open_:
            done.append((current, *state))
        if done:
            yield flush(kind)

    rows = df.select(key, *order, *values).repartition(key).sortWithinPartitions(key, *order).select(key, *values)
    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *(f"{n} {t}" for n, (t, _) in result.items())])
    return rows.mapInArrow(run, schema)


def fold_segments(df: DataFrame, keys: list[str], order: list[str], values: list[str], fold: Callable[[Column], Column], seconds: int = 86400) -> DataFrame:
    """(keys, parts): each key's segments in order, as an array of (segment, part), for steps that can be merged.

    A segment is a day of the first order column; `fold` makes a part of the array of its ordered rows. So a key's rows
    don't meet in one array, only its days do.
    """
    day = F.floor(F.col(order[0]).cast("timestamp").cast("long") / seconds)
    s = df.groupBy(*keys, day.alias("segment")).agg(F.sort_array(F.collect_list(F.struct(*order, *values))).alias("rows"))
    s = s.select(*keys, "segment", fold(F.col("rows")).alias("part"))
    return s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("segment", "part"))).alias("parts"))
