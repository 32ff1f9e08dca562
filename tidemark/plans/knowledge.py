"""Ingestion, subgraphs, goal-directed inference, retrieval in stages, learner gates and source round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import ANSWERS_SQL, ENTITIES_SQL, MASTERY_SQL, PREREQUISITES_SQL, TRIPLES_SQL, answers, entities, focus, mastery, points, prerequisites, table, triples
from ..operators import graph as G
from ..operators import store as S
from ..operators.iterate import work_folder
from ..sources import mapping, snapshots
from .registry import register
from .retrieval import _BM25, _bm25

K, R = f"WITH {PREREQUISITES_SQL}", f"WITH RECURSIVE {PREREQUISITES_SQL}"


def _folder(spark):
    return f"{work_folder(spark)}/files-{uuid.uuid4().hex}"


@register("ingest_counts", "WITH f AS (SELECT text, min(doc_id) AS first FROM documents WHERE length(text) >= 10 GROUP BY 1), s AS (SELECT source, CASE WHEN d.text IS NULL OR length(d.text) < 10 THEN 'failed' WHEN d.text IN (SELECT text FROM benchmark WHERE text IS NOT NULL) OR doc_id <> first THEN 'skipped' ELSE 'success' END AS status FROM documents d LEFT JOIN f USING (text)) SELECT source, status, count(*) AS n FROM s GROUP BY 1, 2")
def ingest_counts(spark, sf):
    """Documents taken into a store that holds the benchmark's texts."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    return S.ingest(d, table(spark, sf, "benchmark").select("text"), "text", "doc_id", F.length("text") >= 10).groupBy("source", "status").agg(F.count("*").alias("n"))


@register("duplicate_identifiers", "WITH x AS (SELECT doc_id AS id, 'text' AS k, text AS v FROM documents UNION ALL SELECT doc_id, 'lead', string_split(text, chr(10))[1] FROM documents), f AS (SELECT k, v, min(id) AS first FROM x WHERE v IS NOT NULL AND v <> '' GROUP BY 1, 2) SELECT id, min(first) AS duplicate_of FROM x JOIN f USING (k, v) WHERE first < id GROUP BY 1")
def duplicate_identifiers(spark, sf):
    """Documents that share their text or their first line with an earlier one."""
    ids = F.create_map(F.lit("text"), F.col("text"), F.lit("lead"), F.split("text", "\n", -1)[0])
    return S.duplicates(table(spark, sf, "documents").select("doc_id", ids.alias("ids")), "doc_id", "ids")


@register("ingestion_chunks", "WITH c AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT line, min(doc_id) AS doc_id FROM c WHERE length(line) >= 10 GROUP BY 1) SELECT doc_id, CASE WHEN contains(line, ' | ') THEN 'table' WHEN contains(line, '!!') THEN 'noise' ELSE 'text' END AS content_type, count(*) AS n, sum(length(line))::BIGINT AS chars FROM f GROUP BY 1, 2")
def ingestion_chunks(spark, sf):
    """Chunk by lines, drop short ones, keep the first of equal ones, classify, count per document."""
    c = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.length("line") >= 10)
    kind = F.when(F.col("line").contains(" | "), "table").when(F.col("line").contains("!!"), "noise").otherwise("text")
    return c.groupBy("line").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id", kind.alias("content_type")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@register("memory_search", "SELECT event_id, round(value / 100, 6) AS strength FROM events WHERE event_type = 'purchase' AND value / 100 BETWEEN 0.2 AND 0.8 AND json_extract_string(props, '$.k') IS NOT NULL")
def memory_search(spark, sf):
    """Nodes of one type, with a strength in a range and a metadata key."""
    strength = F.col("value") / 100
    return table(spark, sf, "events").where((F.col("event_type") == "purchase") & strength.between(0.2, 0.8) & F.get_json_object("props", "$.k").isNotNull()).select("event_id", F.round(strength, 6).alias("strength"))


@register("subgraph_extraction", f"{R}, {MASTERY_SQL}, b(node, d) AS (SELECT node, 0 FROM firsts UNION SELECT target, d + 1 FROM b JOIN pre ON source = node WHERE d < 3), n AS (SELECT DISTINCT node FROM b JOIN mast ON mast.kp = node WHERE mastery >= 0.25) SELECT source, target, kind FROM pre WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)")
def subgraph_extraction(spark, sf):
    """Edges among the nodes within three hops of every first point whose quality is high enough."""
    e = prerequisites(spark, sf)
    near = G.bfs(e.select("source", "target"), points(spark, sf).where("step = 1").select(F.col("kp").alias("start")), 3).select("node").distinct()
    good = near.join(mastery(spark, sf).where("mastery >= 0.25").select(F.col("kp").alias("node")), "node")
    return e.join(good.withColumnRenamed("node", "source"), "source", "left_semi").join(good.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target", "kind")


@register("graph_retrieval", f"{R}, b(start, node, d) AS (SELECT node, node, 0 FROM firsts UNION SELECT start, target, d + 1 FROM b JOIN pre ON source = node WHERE d < 3), m AS (SELECT start, node, min(d) AS d FROM b GROUP BY 1, 2), s AS (SELECT start, node AS key, round(1.0::DOUBLE / (1 + d), 8) AS score FROM m UNION ALL SELECT start, source || '>' || target, round(0.8::DOUBLE * weight, 8) FROM m JOIN pre ON source = node) SELECT * FROM (SELECT start, key, score, row_number() OVER (PARTITION BY start ORDER BY score DESC, key) AS rank FROM s) WHERE rank <= 5")
def graph_retrieval(spark, sf):
    """Entities by 1 / (1 + distance) and triples by 0.8 times their confidence, the best five of each start."""
    e = prerequisites(spark, sf)
    near = G.bfs(e.select("source", "target"), points(spark, sf).where("step = 1").select(F.col("kp").alias("start")), 3)
    found = near.select("start", F.col("node").alias("key"), F.round(F.lit(1.0) / (1 + F.col("distance")), 8).alias("score"))
    edges = near.join(e, F.col("node") == F.col("source")).select("start", F.concat_ws(">", "source", "target").alias("key"), F.round(F.lit(0.8) * F.col("weight"), 8).alias("score"))
    rank = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("score"), "key"))
    return found.unionByName(edges).withColumn("rank", rank.cast("long")).where("rank <= 5")


@register("backward_chaining", f"{R}, b(goal, node, c, d) AS (SELECT kp, kp, 1.0::DOUBLE, 0 FROM kp WHERE step = 8 UNION SELECT goal, source, c * weight, d + 1 FROM b JOIN pre ON target = node AND kind = 'prerequisite' WHERE d < 10) SELECT goal, node, round(max(c), 9) AS confidence FROM b WHERE goal <> node GROUP BY 1, 2")
def backward_chaining(spark, sf):
    """All points that prove prerequisite*(?x, goal) for every eighth step."""
    e = prerequisites(spark, sf).where("kind = 'prerequisite'")
    return S.backward_chain(e, points(spark, sf).where("step = 8").select(F.col("kp").alias("goal")), 10).withColumn("confidence", F.round("confidence", 9))


@register("ontology_rules", f"WITH {TRIPLES_SQL}, k AS (SELECT DISTINCT subject, predicate, object FROM triples), a AS (SELECT object AS subject, 'supplies' AS predicate, subject AS object FROM k WHERE predicate = 'supplied_by'), b AS (SELECT DISTINCT x.subject, 'available_in' AS predicate, y.object FROM k x JOIN k y ON x.object = y.subject WHERE x.predicate = 'supplied_by' AND y.predicate = 'located_in'), c AS (SELECT DISTINCT b.subject, 'sold_in' AS predicate, y.object FROM b JOIN k y ON b.object = y.subject AND y.predicate = 'part_of') SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c")
def ontology_rules(spark, sf):
    return S.infer(triples(spark, sf), [("supplied_by", "supplies")], [("supplied_by", "located_in", "available_in"), ("available_in", "part_of", "sold_in")])


@register("community_ancestry", f"WITH {TRIPLES_SQL} SELECT a.subject AS node, a.object || '>' || b.object AS path FROM triples a JOIN triples b ON a.object = b.subject AND b.predicate = 'part_of' WHERE a.predicate = 'located_in'")
def community_ancestry(spark, sf):
    """Leaf to root of each member."""
    parents = triples(spark, sf).where("predicate in ('located_in', 'part_of')").select(F.col("subject").alias("node"), F.col("object").alias("parent"))
    return S.ancestry(parents, 2).select("node", F.array_join("path", ">").alias("path"))


@register("provenance_graph", f"{R}, b(goal, node, d) AS (SELECT kp, kp, 0 FROM kp WHERE step = 8 UNION SELECT goal, source, d + 1 FROM b JOIN pre ON target = node WHERE d < 2), n AS (SELECT goal, node, min(d) AS d FROM b GROUP BY 1, 2), g AS (SELECT goal, 'node' AS kind, node AS item FROM n UNION ALL SELECT goal, 'edge', source || '>' || target FROM n JOIN pre ON target = node WHERE d < 2) SELECT goal, kind, item FROM (SELECT *, row_number() OVER (PARTITION BY goal, kind ORDER BY item) AS k FROM g) WHERE k <= 40")
def provenance_graph(spark, sf):
    """Nodes and edges behind every eighth step within two hops; each list holds at most 20 a hop."""
    e = prerequisites(spark, sf).select("source", "target")
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    near = G.bfs(back, points(spark, sf).where("step = 8").select(F.col("kp").alias("start")), 2)
    nodes = near.select(F.col("start").alias("goal"), F.lit("node").alias("kind"), F.col("node").alias("item"))
    edges = near.where("distance < 2").join(e, F.col("node") == F.col("target")).select(F.col("start").alias("goal"), F.lit("edge").alias("kind"), F.concat_ws(">", "source", "target").alias("item"))
    return nodes.unionByName(edges).withColumn("k", F.row_number().over(Window.partitionBy("goal", "kind").orderBy("item"))).where("k <= 40").drop("k")


@register("concept_path", f"{R}, b(node, path, d) AS (SELECT a, [a], 0 FROM focus UNION ALL SELECT target, list_append(path, target), d + 1 FROM b JOIN pre ON source = node AND kind = 'prerequisite' WHERE d < 8 AND node <> (SELECT b FROM focus)), h AS (SELECT path, d FROM b WHERE node = (SELECT b FROM focus)) SELECT array_to_string(min(path), '>') AS path FROM h WHERE d = (SELECT min(d) FROM h)")
def concept_path(spark, sf):
    """The shortest path along relations of allowed types within eight hops."""
    e = prerequisites(spark, sf).where("kind = 'prerequisite'").select("source", "target")
    return G.shortest_path(e, *focus(spark, sf), 8).select(F.array_join("path", ">").alias("path"))


@register("related_artifacts", f"{K}, n AS (SELECT node AS start, node AS kp, 0 AS indirect FROM firsts UNION ALL SELECT source, target, 1 FROM pre JOIN firsts ON node = source WHERE kind = 'prerequisite'), l AS (SELECT start, l_partkey AS artifact, indirect, max(l_shipdate) AS newest FROM n JOIN lineitem ON kp = 'k' || l_orderkey GROUP BY 1, 2, 3) SELECT start, artifact, indirect, row_number() OVER (PARTITION BY start ORDER BY indirect, newest DESC, artifact) AS rank FROM l")
def related_artifacts(spark, sf):
    """Artifacts of each first point and then of the next one, newest first in each."""
    first = points(spark, sf).where("step = 1").select(F.col("kp").alias("start"))
    near = first.select("start", F.col("start").alias("kp"), F.lit(0).alias("indirect")).unionByName(prerequisites(spark, sf).where("kind = 'prerequisite'").join(first, F.col("source") == F.col("start")).select("start", F.col("target").alias("kp"), F.lit(1).alias("indirect")))
    lines = table(spark, sf, "lineitem").select(F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("kp"), F.col("l_partkey").alias("artifact"), "l_shipdate")
    found = near.join(lines, "kp").groupBy("start", "artifact", "indirect").agg(F.max("l_shipdate").alias("newest"))
    return found.select("start", "artifact", "indirect", F.row_number().over(Window.partitionBy("start").orderBy("indirect", F.desc("newest"), "artifact")).cast("long").alias("rank"))


@register("rerank_stages", f"WITH {_BM25}, ra AS (SELECT query_id, key, score, length(text) AS n, lang FROM bm JOIN documents ON doc_id = key WHERE rank <= 12), rb AS (SELECT *, round(score * (1 + 0.1 * least(1.0, n / 2000.0)), 6) AS s FROM ra), rc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS r FROM rb), rd AS (SELECT query_id, key, round(s * CASE lang WHEN 'en' THEN 1.2 ELSE 1.0 END, 6) AS score FROM rc WHERE r <= 6) SELECT * FROM (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM rd) WHERE rank <= 3")
def rerank_stages(spark, sf):
    """Three stages, each with a number of its own that goes on: lexical, by size, by language."""
    best = lambda df, n: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")).cast("long")).where(F.col("rank") <= n)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.length("text").alias("n"), "lang")
    first = _bm25(spark, sf).where("rank <= 12").select("query_id", "key", "score").join(d, "key")
    second = best(first.withColumn("score", F.round(F.col("score") * (1 + 0.1 * F.least(F.lit(1.0), F.col("n") / 2000.0)), 6)), 6)
    third = second.withColumn("score", F.round(F.col("score") * F.when(F.col("lang") == "en", 1.2).otherwise(1.0), 6))
    return best(third.select("query_id", "key", "score"), 3)


@register("chunk_search", f"WITH {_BM25} SELECT * FROM (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM bm JOIN documents ON doc_id = key WHERE lang = 'en') WHERE rank <= 6")
def chunk_search(spark, sf):
    """Search over the whole corpus, more than wanted, then a filter: it may leave fewer."""
    d = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("key"))
    found = _bm25(spark, sf).select("query_id", "key", "score").join(d, "key", "left_semi")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")).cast("long")).where("rank <= 6")


@register("drift_ddm", f"WITH {ANSWERS_SQL}, a AS (SELECT learner, ts, event_id, count(*) OVER w AS i, sum(CASE WHEN correct THEN 0.0 ELSE 1.0 END) OVER w AS k FROM answers WINDOW w AS (PARTITION BY learner ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, k::DOUBLE / i AS p, sqrt((k::DOUBLE / i) * (1 - k::DOUBLE / i) / i) AS s FROM a), b AS (SELECT *, min(CASE WHEN i >= 30 THEN struct_pack(l := p + s, p := p, s := s) END) OVER (PARTITION BY learner ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM p) SELECT learner, count(*) AS n, count(*) FILTER (i >= 30 AND p + s > best.p + 2 * best.s) AS warnings, count(*) FILTER (i >= 30 AND p + s > best.p + 3 * best.s) AS drifts FROM b GROUP BY 1")
def drift_ddm(spark, sf):
    return S.ddm(answers(spark, sf), "learner", ["ts", "event_id"], ~F.col("correct"))


@register("review_urgency", f"WITH {ANSWERS_SQL}, a AS (SELECT learner, kp, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS m, epoch(max(ts)) AS last FROM answers GROUP BY 1, 2), b AS (SELECT learner, kp, round(m * exp(-((epoch(TIMESTAMP '2024-02-01') - floor(last)) / 86400.0) / 7), 6) AS effective FROM a) SELECT learner, kp, effective, round(0.5 - effective, 6) AS urgency, row_number() OVER (PARTITION BY learner ORDER BY 0.5 - effective DESC, kp) AS rank FROM b WHERE effective < 0.5")
def review_urgency(spark, sf):
    """Points whose decayed mastery is below the threshold, the most urgent first."""
    a = answers(spark, sf).groupBy("learner", "kp").agg(F.avg(F.col("correct").cast("double")).alias("m"), F.unix_timestamp(F.max("ts")).alias("last"))
    days = (F.unix_timestamp(F.lit("2024-02-01T00:00:00Z").cast("timestamp")) - F.col("last")) / 86400.0
    b = a.select("learner", "kp", F.round(F.col("m") * F.exp(-days / 7), 6).alias("effective")).where("effective < 0.5")
    return b.select("learner", "kp", "effective", F.round(0.5 - F.col("effective"), 6).alias("urgency"), F.row_number().over(Window.partitionBy("learner").orderBy(F.desc(0.5 - F.col("effective")), "kp")).cast("long").alias("rank"))


@register("calibration_gate", f"WITH {ANSWERS_SQL} SELECT learner, count(*) AS n, round(greatest(0.01, least(0.99, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END))), 6) AS p_known FROM answers GROUP BY 1 HAVING count(*) >= 30")
def calibration_gate(spark, sf):
    """Groups with enough answers to be fitted, with the value that a fit starts from."""
    a = answers(spark, sf).groupBy("learner").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("m")).where("n >= 30")
    return a.select("learner", "n", F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("m"))), 6).alias("p_known"))


@register("deduction_rules", "SELECT p_partkey, round(1239.841984 / p_size, 6) AS electronvolt, round(1e7 / p_size, 4) AS wavenumber, p_name || ' at ' || p_size || ' nm has ' || round(1239.841984 / p_size, 2) || ' eV' AS text FROM part WHERE p_size > 0")
def deduction_rules(spark, sf):
    """A wavelength found in a text, and what follows from it."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_name", F.lit("at"), F.col("p_size").cast("string"), F.lit("nm")).alias("claim"))
    nm = F.regexp_extract("claim", r"([0-9]+) nm", 1).try_cast("double")
    p = p.withColumn("nm", nm).where("nm > 0")
    return p.select("p_partkey", F.round(1239.841984 / F.col("nm"), 6).alias("electronvolt"), F.round(1e7 / F.col("nm"), 4).alias("wavenumber"), F.concat("claim", F.lit(" has "), F.round(1239.841984 / F.col("nm"), 2).cast("string"), F.lit(" eV")).alias("text"))


@register("domain_rules", "WITH r AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{12,}') THEN 0.0 ELSE 1.0 END AS digits, CASE WHEN contains(text, '!!') THEN 0.5 ELSE 1.0 END AS loud, CASE WHEN length(text) BETWEEN 100 AND 100000 THEN 1.0 ELSE 0.0 END AS size, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 0.0 ELSE 1.0 END AS marks FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(greatest(0.0, (digits + loud + size + marks) / 4 - least(0.3, 0.1 * ((digits = 0)::INT + (marks = 0)::INT))), 6) AS score FROM r")
def domain_rules(spark, sf):
    """The mean of the rules' scores, less a tenth for each severe failure (three tenths at most)."""
    d = table(spark, sf, "documents").where("text is not null")
    rule = lambda bad, low: F.when(bad, low).otherwise(1.0)
    r = d.select("doc_id", rule(F.col("text").rlike("[0-9]{12,}"), 0.0).alias("digits"), rule(F.col("text").contains("!!"), 0.5).alias("loud"), rule(~F.length("text").between(100, 100000), 0.0).alias("size"), rule(F.col("text").rlike("[#$%&*]{3}"), 0.0).alias("marks"))
    severe = (F.col("digits") == 0).cast("int") + (F.col("marks") == 0).cast("int")
    return r.select("doc_id", F.round(F.greatest(F.lit(0.0), (F.col("digits") + F.col("loud") + F.col("size") + F.col("marks")) / 4 - F.least(F.lit(0.3), 0.1 * severe)), 6).alias("score"))


@register("conflict_store", "SELECT o_custkey AS entity_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CASE WHEN min(o_orderpriority) = max(o_orderpriority) THEN 'value' ELSE 'priority' END AS conflict_type, count(*) AS claims FROM orders GROUP BY 1, 2 HAVING min(o_orderstatus) <> max(o_orderstatus)")
def conflict_store(spark, sf):
    """Entities with different states on one day, by the type of the conflict."""
    day = F.to_date("o_orderdate").cast("string")
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_id"), day.alias("day")).agg(F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("b"), F.min("o_orderpriority").alias("p"), F.max("o_orderpriority").alias("q"), F.count("*").alias("claims"))
    return c.where("a <> b").select("entity_id", "day", F.when(F.col("p") == F.col("q"), "value").otherwise("priority").alias("conflict_type"), "claims")


@register("federated_search", f"WITH {ENTITIES_SQL}, r AS (SELECT entity_type AS adapter, entity_id AS key, name, row_number() OVER (PARTITION BY entity_type ORDER BY name, entity_id) AS rank FROM entities WHERE lower(name) LIKE '%er%') SELECT adapter, key, name, rank FROM r WHERE rank <= 5")
def federated_search(spark, sf):
    """Every adapter answers by itself, with a limit of its own."""
    hits = entities(spark, sf).where(F.lower("name").contains("er")).select(F.col("entity_type").alias("adapter"), F.col("entity_id").alias("key"), "name")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("adapter").orderBy("name", "key")).cast("long")).where("rank <= 5")


# round trips of sources and sinks ------------------------------------------------------------------------------------


@register("change_log_compaction", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def change_log_compaction(spark, sf):
    """Two batches appended to a change log, read back and compacted."""
    path = _folder(spark)
    log = table(spark, sf, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"), "event_type")
    for early in (True, False):
        batch = log.where(F.col("event_type").isin("error", "view") if early else ~F.col("event_type").isin("error", "view"))
        snapshots.append_changes(batch.drop("event_type"), f"{path}/log")
    return snapshots.compact(spark, f"{path}/log", f"{path}/state", "user_id long, event_id long, value double, op string", "user_id", ["event_id"]).select("user_id", "event_id", "value")


@register("json_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(spark, sf):
    """A collection exported as one JSON document and imported again."""
    path = _folder(spark)
    snapshots.export_json({"nation": table(spark, sf, "nation"), "region": table(spark, sf, "region")}, path)
    return snapshots.import_json(spark, path, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))


@register("json_ld_round_trip", f"WITH {ENTITIES_SQL} SELECT entity_id AS id, entity_type AS type, name, domain, confidence FROM entities")
def json_ld_round_trip(spark, sf):
    path = _folder(spark)
    snapshots.export_json_ld(entities(spark, sf).drop("tags"), "entity_id", "entity_type", path)
    return snapshots.import_json_ld(spark, path, "@id string, @type string, name string, domain string, confidence double")


@register("csv_round_trip", "SELECT event_id, event_type, value FROM events")
def csv_round_trip(spark, sf):
    path = _folder(spark)
    snapshots.export_csv(table(spark, sf, "events").select("event_id", "event_type", "value"), path)
    return spark.read.option("header", True).schema("event_id long, event_type string, value double").csv(path)


@register("prometheus_lines", "SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def prometheus_lines(spark, sf):
    return snapshots.prometheus(table(spark, sf, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n")), "events_total", ["type"], "n")


@register("line_source", "SELECT count(*) AS lines, sum(length(c_name))::BIGINT AS chars FROM customer")
def line_source(spark, sf):
    """A generic file, line by line."""
    path = _folder(spark)
    table(spark, sf, "customer").select(F.col("c_name").alias("value")).write.text(path)
    return snapshots.read_lines(spark, path).agg(F.count("*").alias("lines"), F.sum(F.length("content")).alias("chars"))


@register("iso_times", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def iso_times(spark, sf):
    """Times in epoch seconds as UTC ISO strings."""
    seconds = F.unix_timestamp("o_orderdate").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", mapping.iso_time(seconds).alias("iso"))


@register("sync_counts", "SELECT CASE WHEN c_acctbal >= 0 THEN 'valid' ELSE 'quarantined' END AS status, count(*) AS n FROM customer GROUP BY 1")
def sync_counts(spark, sf):
    """Mapped, validated, and what isn't valid kept apart."""
    ok, bad = mapping.sync(table(spark, sf, "customer"), {"key": {"source": "c_custkey", "required": True}, "balance": {"source": "c_acctbal"}}, F.col("balance") >= 0)
    n = lambda df, name: df.select(F.lit(name).alias("status")).groupBy("status").agg(F.count("*").alias("n"))
    return n(ok, "valid").unionByName(n(bad, "quarantined"))


@register("resolved_entities", f"""WITH RECURSIVE {ENTITIES_SQL}, e AS (SELECT entity_id, entity_type, name, confidence, regexp_replace(lower(trim(name)), '\\s+', '', 'g') AS n FROM entities),
  f AS (SELECT *, regexp_replace(n, '[0-9]', '', 'g') AS letters, regexp_replace(n, '[^0-9]', '', 'g') AS digits, min(entity_id) OVER (PARTITION BY n) AS same FROM e),
  x AS (SELECT DISTINCT entity_type, n, letters, digits, same FROM f),
  p AS (SELECT a.same AS a, b.same AS b, 'edits' AS kind FROM x a JOIN x b ON a.entity_type = b.entity_type AND a.digits = b.digits AND a.n < b.n AND least(length(a.letters), length(b.letters)) >= 5 AND levenshtein(a.letters, b.letters) <= CASE WHEN least(length(a.letters), length(b.letters)) < 12 THEN 1 ELSE 2 END
        UNION SELECT same, entity_id, 'name' FROM f WHERE same <> entity_id),
  w AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
  c(node, root) AS (SELECT entity_id, entity_id FROM e UNION SELECT w.b, c.root FROM c JOIN w ON w.a = c.node WHERE c.root < w.b),
  m AS (SELECT node AS entity_id, min(root) AS cluster FROM c GROUP BY 1),
  k AS (SELECT cluster, first(name ORDER BY confidence DESC, length(name) DESC, entity_id) AS canonical, count(*) AS members FROM m JOIN e USING (entity_id) GROUP BY 1)
  SELECT entity_id, cluster, canonical, members FROM m JOIN k USING (cluster)""")
def resolved_entities(spark, sf):
    """Clusters of all entities by equal names and by edits, and what each is called."""
    return S.resolve(entities(spark, sf)).select("entity_id", "cluster", "canonical", "members")
