"""Ingestion into a store, duplicates by identifier, ancestry, goal-directed inference, drift by running errors and entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_name
from .graph import components
from .iterate import cut


def ingest(incoming: DataFrame, stored: DataFrame, key: str, order: str, valid: Column) -> DataFrame:
    """incoming with a status: failed (not valid), skipped (its key is stored or came earlier) or success.

    Keys are counted with map-side combining; of equal keys the smallest order succeeds. A null key fails.
    """
    ok = F.coalesce(valid, F.lit(False)) & F.col(key).isNotNull()
    first = incoming.where(ok).groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    first = first.join(stored.select(F.col(key).alias("_known")).distinct(), F.col("_key") == F.col("_known"), "left").select("_key", "_first", F.col("_known").isNotNull().alias("_held"))
    joined = incoming.join(first, F.col(key) == F.col("_key"), "left")
    status = F.when(~ok, "failed").when(F.col("_held") | (F.col(order) != F.col("_first")), "skipped").otherwise("success")
    return joined.select(*incoming.columns, status.alias("status"))


def duplicates(identified: DataFrame, id_col: str, identifiers: str) -> DataFrame:
    """(id, duplicate_of): rows that share any type:value of a map of identifiers with an earlier row."""
    each = identified.select(F.col(id_col).alias("id"), F.explode(F.map_entries(identifiers)).alias("e")).where("e.value is not null and e.value <> ''")
    first = each.groupBy("e").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("e", "first")
    return each.join(first, "e").where("first < id").groupBy("id").agg(F.min("first").alias("duplicate_of"))


def ancestry(parents: DataFrame, rounds: int) -> DataFrame:
    """(node, path) from every node of parents (node, parent) that is no parent itself up to its root."""
    roots = parents.select(F.col("parent").alias("node")).distinct()
    at = parents.join(roots, "node", "left_anti").select("node", F.col("parent").alias("top"), F.array("parent").alias("path"))
    up = parents.select(F.col("node").alias("top"), F.col("parent").alias("next"))
    for _ in range(rounds):
        at = at.join(up, "top", "left").select("node", F.coalesce("next", "top").alias("top"), F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"))
    return at.select("node", "path")


def backward_chain(edges: DataFrame, goals: DataFrame, rounds: int) -> DataFrame:
    """(goal, node, confidence): what proves each goal by a transitive relation, looked for from the goals backwards.

    A binding's confidence is that of its surest proof of fewest steps: the product along it.
    """
    at = cut(goals.select("goal", F.col("goal").alias("node"), F.lit(1.0).alias("confidence")))
    seen = at
    for _ in range(rounds):
        step = at.join(edges.select(F.col("target").alias("node"), "source", "weight"), "node").groupBy("goal", F.col("source").alias("found")).agg(F.max(F.col("confidence") * F.col("weight")).alias("confidence"))
        at = cut(step.withColumnRenamed("found", "node").join(seen.select("goal", "node"), ["goal", "node"], "left_anti"))
        if at.isEmpty():
            break
        seen = seen.unionByName(at)
    return seen.where("goal <> node")


def infer(triples: DataFrame, inverse: list[tuple[str, str]], chains: list[tuple[str, str, str]]) -> DataFrame:
    """(subject, predicate, object) that the rules add: inverses, then chains (a, b, result), in the order given.

    Each rule sees what earlier ones inferred, once; nothing is repeated.
    """
    known = triples.select("subject", "predicate", "object").distinct()
    new = known.where("false")
    for p, q in inverse:
        new = new.unionByName(known.where(F.col("predicate") == p).select(F.col("object").alias("subject"), F.lit(q).alias("predicate"), F.col("subject").alias("object")))
    for a, b, result in chains:
        every = known.unionByName(new)
        left, right = every.where(F.col("predicate") == a).select("subject", F.col("object").alias("via")), every.where(F.col("predicate") == b).select(F.col("subject").alias("via"), "object")
        new = new.unionByName(left.join(right, "via").select("subject", F.lit(result).alias("predicate"), "object").distinct())
    return new.join(known, ["subject", "predicate", "object"], "left_anti")


def ddm(rows: DataFrame, key: str, order: list[str], wrong: Column, least: int = 30, warn: float = 2.0, drift: float = 3.0) -> DataFrame:
    """(key, n, warnings, drifts): rows where a key's running error rate has left its best level.

    p is the share of wrong rows so far and s its deviation; a row warns when p + s is `warn` deviations above the
    least p + s so far, and drifts at `drift` of them, from the `least`-th row on.
    """
    by = F.struct(*order).alias("place")  # names of the columns may clash with those made here
    w = Window.partitionBy("own").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    p = rows.select(F.col(key).alias("own"), by, wrong.cast("double").alias("wrong")).select("own", "place", F.count("*").over(w).alias("i"), F.sum("wrong").over(w).alias("k")).withColumn("p", F.col("k") / F.col("i"))
    p = p.withColumn("s", F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("i")))
    best = F.min(F.when(F.col("i") >= least, F.struct((F.col("p") + F.col("s")).alias("level"), F.col("p").alias("p"), F.col("s").alias("s")))).over(w)
    p = p.withColumn("best", best)
    above = lambda n: F.count(F.when((F.col("i") >= least) & (F.col("p") + F.col("s") > F.col("best.p") + n * F.col("best.s")), 1))
    return p.groupBy(F.col("own").alias(key)).agg(F.count("*").alias("n"), above(warn).alias("warnings"), above(drift).alias("drifts"))


#: Shortest names, without their digits, that may differ by one and by two edits.
ONE_EDIT, TWO_EDITS = 5, 12


def _shorter(keys: Column) -> Column:
    """keys and all that is left of them after one deletion."""
    cut_one = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    return F.array_distinct(F.concat(keys, F.flatten(F.transform(keys, cut_one))))


def evidence(entities: DataFrame, identifiers: DataFrame | None = None, aliases: DataFrame | None = None, edits: int = 2) -> DataFrame:
    """(source, target, kind): pairs of entity ids that stand for the same thing; kind is identifier, name, alias or edits.

    entities has entity_id, entity_type and name. identifiers (entity_id, id_type, id_value): equal type and value,
    case aside. aliases (alias, canonical): entities whose names have one canonical name, and those that bear it. Names
    are compared without case and white space. Edits count between names of one type: digits must be the same, in
    order; other characters may differ by one edit from ONE_EDIT of them on, by two from TWO_EDITS on (at most edits).
    Members of a group of any size are tied to its smallest id, so a group of n gives n - 1 pairs.
    """
    named = cut(entities.select("entity_id", "entity_type", normal_name(F.col("name")).alias("name")).where("name <> ''"))

    def tied(rows: DataFrame, key: list[str], kind: str) -> DataFrame:
        first = rows.groupBy(*key).agg(F.min("entity_id").alias("source"))
        return rows.join(first, key).where("entity_id <> source").select("source", F.col("entity_id").alias("target"), F.lit(kind).alias("kind"))

    out = tied(named, ["name"], "name")
    if identifiers is not None:
        out = out.unionByName(tied(identifiers.select("entity_id", "id_type", F.lower("id_value").alias("id_value")).where("id_type is not null and id_value <> ''"), ["id_type", "id_value"], "identifier"))
    if aliases is not None:
        known = aliases.select(normal_name(F.col("alias")).alias("name"), normal_name(F.col("canonical")).alias("as")).where("name <> '' and `as` <> ''")
        known = known.unionByName(known.select(F.col("as").alias("name"), "as")).distinct()
        out = out.unionByName(tied(named.join(known, "name").select("entity_id", "as"), ["as"], "alias"))
    if edits:
        parts = named.groupBy("entity_type", "name").agg(F.min("entity_id").alias("first")).withColumn("letters", F.regexp_replace("name", "[0-9]", "")).withColumn("digits", F.regexp_replace("name", "[^0-9]", ""))
        size = F.length("letters")
        budget = F.when(size < ONE_EDIT, 0).when(size < TWO_EDITS, min(1, edits)).otherwise(min(2, edits))
        one = _shorter(F.array("letters"))
        keys = F.when(budget == 0, F.array().cast("array<string>")).when(budget == 1, one).otherwise(_shorter(one))
        # a name that just reaches two edits meets one that has one edit less room
        meet = parts.select("entity_type", "digits", "name", "letters", "first", F.explode(keys).alias("left_over"))
        other = meet.select("entity_type", "digits", "left_over", F.col("name").alias("other"), F.col("letters").alias("others"), F.col("first").alias("target"))
        pairs = meet.join(other, ["entity_type", "digits", "left_over"]).where("name < other").select("first", "target", "letters", "others").distinct()
        room = F.when(F.least(F.length("letters"), F.length("others")) < TWO_EDITS, 1).otherwise(min(2, edits))
        out = out.unionByName(pairs.where(F.levenshtein("letters", "others") <= room).select(F.col("first").alias("source"), "target", F.lit("edits").alias("kind")))
    return out


def resolve(entities: DataFrame, identifiers: DataFrame | None = None, aliases: DataFrame | None = None, edits: int = 2) -> DataFrame:
    """(entity_id, cluster, canonical, members, kinds): entities that evidence() ties together, directly or in a chain.

    cluster is the smallest entity_id; canonical is the name of the member of the highest confidence (the longer name,
    then the smaller id, decide ties); kinds says what tied an entity itself to others. Entities without a name or
    evidence stay alone.
    """
    pairs = cut(evidence(entities, identifiers, aliases, edits).where("source <> target"))
    cluster = components(pairs.select("source", "target")).withColumnRenamed("node", "entity_id").withColumnRenamed("component", "cluster")
    kinds = pairs.select(F.explode(F.array("source", "target")).alias("entity_id"), "kind").groupBy("entity_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    confidence = F.col("confidence") if "confidence" in entities.columns else F.lit(0.0)
    all_ = entities.select("entity_id", "name", confidence.alias("confidence")).join(cluster, "entity_id", "left").join(kinds, "entity_id", "left")
    all_ = cut(all_.select("entity_id", "name", "confidence", F.coalesce("cluster", "entity_id").alias("cluster"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds")))
    best = all_.groupBy("cluster").agg(F.min_by("name", F.struct(-F.coalesce("confidence", F.lit(-1.0)), -F.coalesce(F.length("name"), F.lit(-1)), "entity_id")).alias("canonical"), F.count("*").alias("members"))
    return all_.join(best, "cluster").select("entity_id", "cluster", "canonical", "members", "kinds")
