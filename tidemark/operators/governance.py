"""Versions, conflicts, retention, policies, schemas and audit chains."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import fold_stream


def versions(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows numbered by key with valid_until of each (the next row's time); the current one has none."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("version", F.row_number().over(w)).withColumn("valid_until", F.lead(order[0]).over(w))


def conflicts(df: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Keys whose values differ by more than the relative tolerance: smallest, largest and number of values."""
    a = df.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return a.where((F.col("high") - F.col("low")) > tolerance * F.greatest(F.abs("low"), F.abs("high")))


def resolve(df: DataFrame, key: str, value: str, by: list[Column]) -> DataFrame:
    """The value of the row that comes first by the given order (quality, recency, trust ...)."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*by))
    return df.withColumn("rn", rn).where("rn = 1").select(key, value)


def decide(requests: DataFrame, rules: DataFrame, action: str, match: Column) -> DataFrame:
    """Deny overrides: per request (request_id, ...) the decision over matching rules (action, effect, ...); default deny.

    A rule names an action or, as *, any. Requests meet the rules of their action by an equi join, then `match` decides.
    """
    asked = requests.withColumn("action", F.explode(F.array(F.col(action), F.lit("*"))))
    hit = asked.join(rules, (asked["action"] == rules["action"]) & match, "left").groupBy("request_id").agg(F.max((F.col("effect") == "deny").cast("int")).alias("deny"), F.max((F.col("effect") == "allow").cast("int")).alias("allow"), F.count("effect").alias("rules"))
    return hit.select("request_id", F.when(F.coalesce("deny", F.lit(0)) == 1, "deny").when(F.coalesce("allow", F.lit(0)) == 1, "allow").otherwise("deny").alias("decision"), "rules")


def audit_chain(df: DataFrame, key: str, order: list[str], payload: Column) -> DataFrame:
    """(key, n, head): SHA-256 over each key's ordered rows, each hash taking in the one before; null from a null payload on."""
    genesis = hashlib.sha256(b"genesis").hexdigest()

    def step(state, payload):
        n, head = state
        return n + 1, None if head is None or payload is None else hashlib.sha256(f"{head}|{payload}".encode()).hexdigest()

    return fold_stream(df.withColumn("payload", payload), key, order, ["payload"], (0, genesis), step, {"n": ("long", pa.int64()), "head": ("string", pa.string())})


def _link(prev: str, payload: str) -> str:
    return hashlib.sha256(f"{prev}|{payload}".encode()).hexdigest()


def chained(df: DataFrame, key: str, order: list[str], payload: Column) -> DataFrame:
    """(key, seq, payload, prev, hash): the log that audit_chain folds, with every link; null payloads count as empty."""

    def run(batches):
        current, seq, head, fresh = None, 0, "", True
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fresh or k != current:
                    current, seq, head, fresh = k, 0, hashlib.sha256(b"genesis").hexdigest(), False
                prev, head, seq = head, _link(head, text), seq + 1
                out.append((k, seq, text, prev, head))
            if out:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[key, "seq", "payload", "prev", "hash"])

    rows = df.select(key, *order, F.coalesce(payload, F.lit("")).alias("payload")).repartition(key).sortWithinPartitions(key, *order).select(key, "payload")
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, seq long, payload string, prev string, hash string")


def verify_chains(log: DataFrame, key: str, heads: DataFrame | None = None) -> DataFrame:
    """(key, seq, fault) of the first break of each key's chain; keys whose chains hold have no row.

    log: key, seq, payload, prev, hash as stored; heads (key, n, head), if known, tell where a chain should end. Each row
    is checked by itself (payload: its hash isn't that of prev and payload) and against its stored neighbour, found by
    an equi join on seq (link: prev isn't the hash before; gap: the row before is missing; repeat: seq occurs twice;
    end: the last rows are missing). No fold over a key is needed, so a key of any size is spread over tasks.
    """
    genesis = hashlib.sha256(b"genesis").hexdigest()
    rows = log.groupBy(key, "seq").agg(F.count("*").alias("copies"), F.min(F.struct("hash", "prev", "payload")).alias("r")).select(key, "seq", "copies", "r.*")
    before = rows.select(key, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    j = rows.join(before, [key, "seq"], "left").withColumn("before", F.when(F.col("seq") == 1, F.lit(genesis)).otherwise(F.col("before")))
    sound = F.sha2(F.concat_ws("|", F.coalesce("prev", F.lit("")), F.coalesce("payload", F.lit(""))), 256) == F.col("hash")
    fault = F.when(F.col("copies") > 1, "repeat").when(F.col("before").isNull(), "gap").when(~F.coalesce(F.col("prev") == F.col("before"), F.lit(False)), "link").when(~F.coalesce(sound, F.lit(False)), "payload")
    found = j.select(key, "seq", fault.alias("fault")).where("fault is not null")
    if heads is not None:
        last = log.groupBy(key).agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
        ends = heads.join(last, key, "left").where(~(F.coalesce(F.col("seq") == F.col("n"), F.lit(False)) & F.coalesce(F.col("hash") == F.col("head"), F.lit(False))))
        found = found.unionByName(ends.select(key, (F.coalesce("seq", F.lit(0)) + 1).cast("long").alias("seq"), F.lit("end").alias("fault")))
    return found.groupBy(key).agg(F.min(F.struct("seq", "fault")).alias("f")).select(key, "f.seq", "f.fault")


def map_diff(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """(key, field, change, before, after) between the map columns of two tables: added, removed or modified entries."""
    entries = lambda df, name: df.select(key, F.explode(column).alias("field", name))
    j = entries(old, "before").withColumn("was", F.lit(True)).join(entries(new, "after").withColumn("now", F.lit(True)), [key, "field"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return j.select(key, "field", change.alias("change"), "before", "after").where("change is not null")
