"""Scans, filters, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import ENTITIES_SQL, TRIPLES_SQL, entities, table, triples
from ..operators import predicates as P
from .registry import register


def _sql(body: str, *with_: str) -> str:
    return f"WITH {', '.join(with_)} {body}" if with_ else body


@register("scan_entities_page", _sql("SELECT * EXCLUDE (tags), len(tags) AS n_tags FROM entities ORDER BY entity_id LIMIT 200 OFFSET 100", ENTITIES_SQL))
def scan_page(spark, sf):
    """A page of the entity scan, in a total order."""
    e = entities(spark, sf).orderBy("entity_id").offset(100).limit(200)
    return e.select("entity_id", "entity_type", "name", "domain", "confidence", F.size("tags").alias("n_tags"))


CONDITIONS = [("p_size", "gt", 10), ("p_size", "gte", 11), ("p_size", "lt", 45), ("p_size", "lte", 44), ("p_name", "contains", "ring"), ("p_name", "starts_with", "sm"), ("p_name", "ends_with", "et"), ("p_type", "in", ["ECONOMY", "PROMO"]), ("p_brand", "eq", "Brand#2"), ("p_brand", "ne", "Brand#3"), ("p_name", "regex", "^[a-m].*e"), ("p_name", "gt", 3)]


@register(
    "predicate_operators",
    """SELECT p_partkey, p_size > 10 AS c0, NOT p_size > 10 AS n0, p_size >= 11 AS c1, NOT p_size >= 11 AS n1, p_size < 45 AS c2, NOT p_size < 45 AS n2, p_size <= 44 AS c3, NOT p_size <= 44 AS n3,
    contains(p_name, 'ring') AS c4, NOT contains(p_name, 'ring') AS n4, starts_with(p_name, 'sm') AS c5, NOT starts_with(p_name, 'sm') AS n5, ends_with(p_name, 'et') AS c6, NOT ends_with(p_name, 'et') AS n6,
    p_type IN ('ECONOMY', 'PROMO') AS c7, p_type NOT IN ('ECONOMY', 'PROMO') AS n7, p_brand = 'Brand#2' AS c8, p_brand <> 'Brand#2' AS n8, p_brand <> 'Brand#3' AS c9, p_brand = 'Brand#3' AS n9,
    regexp_matches(p_name, '^[a-m].*e') AS c10, NOT regexp_matches(p_name, '^[a-m].*e') AS n10, coalesce(try_cast(p_name AS DOUBLE) > 3, false) AS c11, NOT coalesce(try_cast(p_name AS DOUBLE) > 3, false) AS n11 FROM part""",
)
def predicate_operators(spark, sf):
    """All predicate operators and their negations, over every part."""
    p = table(spark, sf, "part")
    cols = [P.condition(F.col(c), op, v, negate).alias(f"{'n' if negate else 'c'}{i}") for i, (c, op, v) in enumerate(CONDITIONS) for negate in (False, True)]
    return p.select("p_partkey", *cols)


@register("entity_query", _sql("SELECT entity_id, name, domain, confidence FROM entities WHERE entity_type = 'customer' AND confidence >= 0.2 AND NOT contains(name, '7') ORDER BY confidence DESC, entity_id LIMIT 50 OFFSET 10", ENTITIES_SQL))
def entity_query(spark, sf):
    """Conditions, sort, offset and limit."""
    q = P.query(entities(spark, sf), [("entity_type", "eq", "customer"), ("confidence", "gte", 0.2), ("name", "contains", "7", True)], "confidence", True, 10, 50, "entity_id")
    return q.select("entity_id", "name", "domain", "confidence")


@register("entity_search", _sql("SELECT entity_id, name FROM entities WHERE entity_type = 'part' AND lower(name) = 'red widget' AND list_contains(tags, 'ECONOMY') AND confidence >= 0.3", ENTITIES_SQL))
def entity_search(spark, sf):
    """Type, case-insensitive name, tag and least confidence."""
    return entities(spark, sf).where((F.col("entity_type") == "part") & (F.lower("name") == "red widget") & F.array_contains("tags", "ECONOMY") & (F.col("confidence") >= 0.3)).select("entity_id", "name")


@register("entity_by_tag", _sql("SELECT entity_id, domain FROM entities WHERE list_contains(tags, 'MACHINERY')", ENTITIES_SQL))
def entity_by_tag(spark, sf):
    return entities(spark, sf).where(F.array_contains("tags", "MACHINERY")).select("entity_id", "domain")


@register("retrieval_filter", "SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3') AND n_chars BETWEEN 200 AND 5000 AND text IS NOT NULL")
def retrieval_filter(spark, sf):
    """Source, modality and range filters that reach the scan."""
    return table(spark, sf, "documents").where("lang in ('en', 'fr') and source in ('src1', 'src2', 'src3') and n_chars between 200 and 5000 and text is not null").select("doc_id", "source")


@register("triple_filter", _sql("SELECT subject, object, confidence, rank FROM triples WHERE predicate = 'supplied_by' AND confidence >= 0.97 AND rank <> 'deprecated' AND (valid_from = 0 OR 11000 >= valid_from) AND (valid_until = 0 OR 11000 < valid_until)", TRIPLES_SQL))
def triple_filter(spark, sf):
    """Confidence, rank and validity at a day."""
    return P.filter_triples(triples(spark, sf).where("predicate = 'supplied_by'"), 0.97, day=11000).select("subject", "object", "confidence", "rank")


@register("triple_preferred", _sql("SELECT subject, object FROM triples WHERE rank = 'preferred' AND confidence >= 0.99", TRIPLES_SQL))
def triple_preferred(spark, sf):
    return P.filter_triples(triples(spark, sf), 0.99, only_preferred=True).select("subject", "object")


@register("metadata_overlap", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (3, 17, 42)")
def metadata_overlap(spark, sf):
    """Containment of a metadata value in a set; a scalar counts as a set."""
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.where(F.arrays_overlap(F.array("k"), F.array(F.lit(3), F.lit(17), F.lit(42))))


@register("chunks_of_document", "SELECT conv_id, count(*) AS n_turns, sum(length(text)) AS n_chars FROM conversations WHERE role = 'user' GROUP BY conv_id")
def chunks_of_document(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


@register("audit_query", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 100 OFFSET 20")
def audit_query(spark, sf):
    """Equality and time range, newest first, a page."""
    e = table(spark, sf, "events").where("event_type = 'error' and ts >= timestamp'2024-01-05' and ts <= timestamp'2024-01-20'")
    return e.orderBy(F.desc("ts"), "event_id").offset(20).limit(100).select("event_id", "user_id", "value")


@register("audit_replay", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events WHERE user_id = 7 AND ts < TIMESTAMP '2024-01-15'")
def audit_replay(spark, sf):
    e = table(spark, sf, "events").where("user_id = 7 and ts < timestamp'2024-01-15'")
    return e.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("pos"))


@register("provenance_query", "SELECT event_id FROM events WHERE event_type = 'purchase' AND value IS NOT NULL AND value >= 100 ORDER BY event_id LIMIT 500")
def provenance_query(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase' and value >= 100").select("event_id").orderBy("event_id").limit(500)


@register("low_confidence", _sql("SELECT entity_id, confidence FROM entities WHERE confidence < 0.05", ENTITIES_SQL))
def low_confidence(spark, sf):
    return entities(spark, sf).where("confidence < 0.05").select("entity_id", "confidence")


@register("context_refs", "SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE contains(word, 'tionble') GROUP BY ALL")
def context_refs(spark, sf):
    """(id, reference) pairs of flattened references that hold a pattern."""
    d = table(spark, sf, "documents").where(F.col("text").contains("tionble"))
    return d.select("doc_id", F.explode(F.split("text", " ")).alias("word")).where(F.col("word").contains("tionble")).distinct()


@register("metric_values", "SELECT event_id, value FROM events WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND json_extract_string(props, '$.k') = '42' ORDER BY ts DESC, event_id LIMIT 50")
def metric_values(spark, sf):
    """Samples of a metric by time range and label subset."""
    e = table(spark, sf, "events").where("event_type = 'view' and ts between timestamp'2024-01-10' and timestamp'2024-01-12'")
    labels = F.from_json("props", "map<string,string>")
    return e.where(labels["k"] == "42").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "value")


@register("topic_match", "SELECT event_id, regexp_matches(event_type || '.u' || user_id || '.k', '^[^.]+\\.u7\\.[^.]+$') AS one, regexp_matches(event_type || '.u' || user_id || '.k', '^view\\..*$') AS rest FROM events")
def topic_match(spark, sf):
    topic = F.concat("event_type", F.lit(".u"), F.col("user_id").cast("string"), F.lit(".k"))
    return table(spark, sf, "events").select("event_id", topic.rlike(P.topic_pattern("*.u7.*")).alias("one"), topic.rlike(P.topic_pattern("view.**")).alias("rest"))


@register("policy_rules", "SELECT event_id FROM events WHERE (event_type = 'purchase' OR event_type = 'signup') AND (value > 80 AND value < 200)")
def policy_rules(spark, sf):
    """AND and OR over rule predicates; no rules match everything."""
    either = P.any_of([P.condition(F.col("event_type"), "eq", x) for x in ("purchase", "signup")])
    both = P.all_of([P.condition(F.col("value"), "gt", 80), P.condition(F.col("value"), "lt", 200)])
    return table(spark, sf, "events").where(either & both & P.all_of([])).select("event_id")


@register("artifact_filter", "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%/fr/%' AND length(html) BETWEEN 1000 AND 20000")
def artifact_filter(spark, sf):
    return table(spark, sf, "pages").where(F.lower("url").contains("/fr/") & F.length("html").between(1000, 20000)).select("page_id", "url")


@register("evidence_filter", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers FROM documents WHERE source <> 'src0' AND len(regexp_extract_all(text, '[0-9]+')) > len(regexp_extract_all(text, '[#*$%&|<>]'))")
def evidence_filter(spark, sf):
    """Rows of admissible sources whose target mentions outnumber the others."""
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return table(spark, sf, "documents").where(F.col("source") != "src0").where(n("[0-9]+") > n("[#*$%&|<>]")).select("doc_id", n("[0-9]+").cast("long").alias("n_numbers"))


@register("access_filter", _sql("SELECT entity_id, level FROM (SELECT entity_id, CASE WHEN confidence < 0.25 THEN 0 WHEN confidence < 0.5 THEN 1 WHEN confidence < 0.75 THEN 2 ELSE 3 END AS level FROM entities) WHERE level <= 1", ENTITIES_SQL))
def access_filter(spark, sf):
    """Rows up to the reader's ordinal access level."""
    level = F.when(F.col("confidence") < 0.25, 0).when(F.col("confidence") < 0.5, 1).when(F.col("confidence") < 0.75, 2).otherwise(3)
    return entities(spark, sf).select("entity_id", level.alias("level")).where("level <= 1")


@register(
    "snippets",
    """WITH a AS (SELECT item_id, text, CASE WHEN strpos(lower(text), 'tion') > 0 THEN strpos(lower(text), 'tion') - 1 WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') - 1 ELSE 0 END AS p FROM benchmark),
    b AS (SELECT *, greatest(0, p - 20) AS s FROM a), c AS (SELECT *, least(length(text), s + 60) AS e FROM b)
    SELECT item_id, CASE WHEN length(text) <= 60 THEN text ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || substring(text, s + 1, e - s) || (CASE WHEN e < length(text) THEN '...' ELSE '' END) END AS snippet FROM c""",
)
def snippets(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", P.snippet(F.col("text"), ["tion", "the"], 60).alias("snippet"))


@register("field_transform", "SELECT c_custkey, CASE WHEN length(c_name) > 4 THEN left(c_name, 2) || '***' || right(c_name, 2) ELSE '***' END AS c_name, least(c_acctbal, 5000.0) AS c_acctbal, 'export' AS purpose FROM customer")
def field_transform(spark, sf):
    """Strip, mask, cap and inject fields."""
    c = table(spark, sf, "customer").drop("c_nationkey", "c_mktsegment")
    return c.select("c_custkey", P.mask(F.col("c_name")).alias("c_name"), F.least("c_acctbal", F.lit(5000.0)).alias("c_acctbal"), F.lit("export").alias("purpose"))


@register("weak_points", """SELECT kp, learner, weakness FROM (SELECT *, row_number() OVER (PARTITION BY kp ORDER BY weakness DESC, learner) AS rn FROM (
    SELECT event_type AS kp, user_id AS learner, round(0.4 * (1 - avg(CASE WHEN value >= 35 THEN 1.0 ELSE 0.0 END)) + 0.2 * least(1.0, date_diff('second', max(ts), TIMESTAMP '2024-02-01') / 86400.0 / 30), 6) AS weakness FROM events GROUP BY 1, 2)) WHERE rn <= 20""")
def weak_points(spark, sf):
    """The 20 weakest learners of each point, by missing mastery and recency."""
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("kp"), F.col("user_id").alias("learner"))
    days = (F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.unix_timestamp("t")) / 86400.0
    w = e.agg(F.avg((F.col("value") >= 35).cast("double")).alias("m"), F.max("ts").alias("t")).withColumn("weakness", F.round(0.4 * (1 - F.col("m")) + 0.2 * F.least(F.lit(1.0), days / 30), 6))
    place = F.row_number().over(Window.partitionBy("kp").orderBy(F.desc("weakness"), "learner"))
    return w.withColumn("rn", place).where("rn <= 20").select("kp", "learner", "weakness")


@register("set_algebra", "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 100 EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 300")
def set_algebra(spark, sf):
    e = table(spark, sf, "events")
    of = lambda cond: e.where(cond).select("user_id")
    return of("event_type = 'purchase'").intersect(of("event_type = 'error' and value > 100")).subtract(of("event_type = 'signup' and value > 300"))


@register("union_sources", "SELECT 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part")
def union_sources(spark, sf):
    """Collections of different columns side by side."""
    parts = [table(spark, sf, t).withColumn("kind", F.lit(t)) for t in ("customer", "supplier", "part")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@register("chunk_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS hash, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 2")
def chunk_dedup(spark, sf):
    """The first of equal chunks, by SHA-256."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@register("relation_dedup", "SELECT DISTINCT l_partkey, l_suppkey, first_value(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS first_order FROM lineitem")
def relation_dedup(spark, sf):
    """The first of each (subject, object)."""
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("first_order"))


@register("entity_merge", """SELECT c_mktsegment AS domain, c_nationkey AS nation, min(c_custkey) AS target, count(*) AS merged, array_to_string(list_sort(list(DISTINCT right(c_name, 1))), ',') AS aliases, max(c_acctbal) AS best FROM customer GROUP BY 1, 2""")
def entity_merge(spark, sf):
    """Entities of one key merged: smallest id, union of aliases, best property."""
    c = table(spark, sf, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("domain"), F.col("c_nationkey").alias("nation")).agg(F.min("c_custkey").alias("target"), F.count("*").alias("merged"), F.array_join(F.array_sort(F.collect_set(F.substring("c_name", -1, 1))), ",").alias("aliases"), F.max("c_acctbal").alias("best"))


@register("review_queue", "SELECT event_id, retrievability FROM (SELECT event_id, user_id, round(power(1 + 0.2346 * date_diff('second', ts, TIMESTAMP '2024-02-01') / 86400.0 / (1 + value), -0.5), 6) AS retrievability FROM events WHERE event_type = 'view') ORDER BY retrievability, event_id LIMIT 100")
def review_queue(spark, sf):
    """Lowest retrievability first."""
    days = (F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.unix_timestamp("ts")) / 86400.0
    r = F.round(F.pow(1 + 0.2346 * days / (1 + F.col("value")), F.lit(-0.5)), 6)
    return table(spark, sf, "events").where("event_type = 'view'").select("event_id", r.alias("retrievability")).orderBy("retrievability", "event_id").limit(100)


@register("latest_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def latest_first(spark, sf):
    """A signed sort key."""
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@register("timeline", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04' ORDER BY ts, event_id")
def timeline(spark, sf):
    return table(spark, sf, "events").where("ts >= timestamp'2024-01-03' and ts < timestamp'2024-01-04'").orderBy("ts", "event_id").select("event_id", "event_type")
