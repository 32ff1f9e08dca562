"""Schemas of collections compared, and collections migrated from one to another and back."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes whose property names overlap by more than this (Jaccard) are one class under two names.
RENAMED = 0.5
#: Column that keeps what a migration takes away, so that it can be undone.
UNDO = "_undo"

Schema = dict[str, dict[str, str]]


@dataclass(frozen=True)
class Step:
    """One action on a class: rename (to another name), add, remove or retype a property, or create or drop a class."""

    action: str
    name: str
    prop: str | None = None
    before: str | None = None
    after: str | None = None


def schema_of(collections: dict[str, DataFrame]) -> Schema:
    return {name: {f.name: f.dataType.simpleString() for f in df.schema if f.name != UNDO} for name, df in collections.items()}


def profile(collections: dict[str, DataFrame]) -> DataFrame:
    """(class, property, type, filled): every property of every collection with the number of rows that have it."""

    def one(name: str, df: DataFrame) -> DataFrame:
        of = schema_of({name: df})[name]
        counted = df.agg(*(F.count(c).alias(c) for c in of))
        rows = F.explode(F.array(*(F.struct(F.lit(c).alias("property"), F.lit(t).alias("type"), F.col(c).alias("filled")) for c, t in of.items())))
        return counted.select(F.lit(name).alias("class"), rows.alias("x")).select("class", "x.*")

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in sorted(collections.items())])


def renamed(old: Schema, new: Schema) -> dict[str, str]:
    """Old name -> new name of classes that one side lacks and whose properties overlap most, above RENAMED."""
    gone, come = sorted(set(old) - set(new)), sorted(set(new) - set(old))
    out: dict[str, str] = {}
    for a in gone:
        score = lambda b: len(old[a].keys() & new[b].keys()) / max(1, len(old[a].keys() | new[b].keys()))  # noqa: B023, E731
        left = [b for b in come if b not in out.values() and score(b) > RENAMED]
        if left:
            out[a] = max(left, key=lambda b: (score(b), [-ord(x) for x in b]))
    return out


def plan(old: Schema, new: Schema) -> list[Step]:
    """Steps from one schema to another: renames first, then retypes, additions and removals, then whole classes."""
    moved = renamed(old, new)
    steps = [Step("rename", a, before=a, after=b) for a, b in sorted(moved.items())]
    known = {moved.get(a, a): props for a, props in old.items()}
    for name in sorted(known.keys() & new.keys()):
        before, after = known[name], new[name]
        steps += [Step("retype", name, p, before[p], after[p]) for p in sorted(before.keys() & after.keys()) if before[p] != after[p]]
        steps += [Step("add", name, p, None, after[p]) for p in sorted(after.keys() - before.keys())]
        steps += [Step("remove", name, p, before[p], None) for p in sorted(before.keys() - after.keys())]
    steps += [Step("create", name, after=", ".join(f"{p} {t}" for p, t in new[name].items())) for name in sorted(new.keys() - known.keys())]
    return steps + [Step("drop", name) for name in sorted(known.keys() - new.keys())]


def level(steps: Iterable[Step]) -> str:
    """FULL without steps, PARTIAL if nothing is lost, BREAKING with one loss, INCOMPATIBLE with more."""
    steps = list(steps)
    lost = sum(s.action in ("remove", "retype", "drop") for s in steps)
    return "FULL" if not steps else ("PARTIAL", "BREAKING")[lost] if lost < 2 else "INCOMPATIBLE"


def migrate(collections: dict[str, DataFrame], steps: list[Step]) -> dict[str, DataFrame]:
    """The collections after the steps. Rows stay where they are: values that are removed or retyped go to UNDO.

    A value that can't be cast becomes null (and is still in UNDO). Dropped classes stay as their UNDO alone.
    """
    out, spark = dict(collections), next(iter(collections.values())).sparkSession
    for s in steps:
        if s.action == "rename":
            out[s.after] = out.pop(s.before)
        elif s.action == "create":
            out[s.name] = spark.createDataFrame([], s.after)
    for name, df in out.items():
        own = [s for s in steps if s.name == name or s.action == "rename" and s.after == name]
        kept = [s.prop for s in own if s.action in ("remove", "retype")] + ([c for c in df.columns if c != UNDO] if any(s.action == "drop" for s in own) else [])
        if kept:
            df = df.withColumn(UNDO, F.struct(*kept))
        retyped, gone = {s.prop: s.after for s in own if s.action == "retype"}, {s.prop for s in own if s.action == "remove"}
        if any(s.action == "drop" for s in own):
            out[name] = df.select(UNDO)
            continue
        columns = [F.col(c).try_cast(retyped[c]).alias(c) if c in retyped else F.col(c) for c in df.columns if c not in gone]
        out[name] = df.select(*columns, *(F.lit(None).cast(s.after).alias(s.prop) for s in own if s.action == "add"))
    return out


def rollback(collections: dict[str, DataFrame], steps: list[Step], old: Schema) -> dict[str, DataFrame]:
    """The collections before the steps, with the properties of old in their order."""
    out = dict(collections)
    for s in steps:
        if s.action == "create":
            out.pop(s.name)
    for name, df in list(out.items()):
        back = {s.prop for s in steps if s.name == name and s.action in ("remove", "retype")}
        first = next((s.before for s in steps if s.action == "rename" and s.after == name), name)
        whole = any(s.action == "drop" and s.name == name for s in steps)
        out.pop(name)
        out[first] = df.select(*(F.col(UNDO)[c].alias(c) if whole or c in back else F.col(c) for c in old[first]))
    return out


def checksum(df: DataFrame) -> DataFrame:
    """(rows, sum): equal for equal rows in any order, whatever their files."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("sum"))
