"""Inference, communities, model comparison, evaluation, extraction and memory queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import ANSWERS_SQL, PREREQUISITES_SQL, TRIPLES_SQL, answers, focus, points, prerequisites, table, triples
from ..operators import communities as C
from ..operators import graph as G
from ..operators import inference as I
from ..operators import learner as L
from ..operators import retrieval as R
from .learner import SEQ, _reviews
from .registry import register
from .retrieval import _BM25, _KNN, _RANK, _bm25, _knn


@register("forward_chaining", f"""WITH RECURSIVE {PREREQUISITES_SQL}, base AS (SELECT source AS s, target AS o FROM pre WHERE kind = 'prerequisite'), c(s, o) AS (SELECT s, o FROM base UNION SELECT c.s, b.o FROM c JOIN base b ON c.o = b.s WHERE c.s <> b.o)
  SELECT s AS subject, 'prerequisite' AS predicate, o AS object FROM c WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.s = c.s AND base.o = c.o) UNION ALL SELECT o, 'enables', s FROM c""")
def forward_chaining(spark, sf):
    """A transitive and an inverse rule to the fixpoint."""
    t = prerequisites(spark, sf).where("kind = 'prerequisite'").select(F.col("source").alias("subject"), F.col("kind").alias("predicate"), F.col("target").alias("object"))
    return I.forward_chain(t, transitive=["prerequisite"], inverse={"prerequisite": "enables"}).drop("iteration")


@register("k_shortest_paths", f"WITH RECURSIVE {PREREQUISITES_SQL}, b(node, path, cost, d) AS (SELECT a, [a], 0.0::DOUBLE, 0 FROM focus UNION ALL SELECT target, list_append(path, target), cost + 1 / weight, d + 1 FROM b JOIN pre ON source = node WHERE d < 7 AND node <> (SELECT b FROM focus) AND NOT list_contains(path, target)) SELECT round(cost, 9) AS cost, array_to_string(path, '>') AS path, row_number() OVER (ORDER BY round(cost, 9), array_to_string(path, '>')) AS rank FROM b WHERE node = (SELECT b FROM focus) ORDER BY rank LIMIT 4")
def k_shortest_paths(spark, sf):
    e = prerequisites(spark, sf).select("source", "target", (1 / F.col("weight")).alias("cost"))
    return I.k_paths(e, *focus(spark, sf), 4, 7).withColumn("rank", F.col("rank").cast("long"))


@register("louvain")
def louvain(spark, sf):
    """Communities of the knowledge-point graph, of the coarsest level."""
    return C.top_level(C.leiden(prerequisites(spark, sf)))


@register("leiden_ancestry")
def leiden_ancestry(spark, sf):
    """Each point's communities from the finest to the coarsest."""
    return C.ancestry(C.leiden(prerequisites(spark, sf))).select("node", F.array_join("path", ">").alias("path"))


@register("transe_ranking")
def transe_ranking(spark, sf):
    """The five best tails of each geographic relation by translation distance."""
    t = triples(spark, sf).where("predicate in ('located_in', 'part_of')")
    e, p = I.translate(t)
    heads = t.select("subject", "predicate").distinct().join(F.broadcast(p), "predicate").join(e.select(F.col("entity").alias("subject"), F.col("vector").alias("h")), "subject")
    tails = t.select("object").distinct().join(e.select(F.col("entity").alias("object"), F.col("vector").alias("t")), "object")
    pairs = heads.join(F.broadcast(tails))
    d = F.sqrt(F.aggregate(F.zip_with(F.zip_with("h", "vector", lambda a, b: a + b), "t", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    rank = F.row_number().over(Window.partitionBy("subject", "predicate").orderBy("distance", "object"))
    return pairs.select("subject", "predicate", "object", F.round(d, 9).alias("distance")).withColumn("rank", rank).where("rank <= 5")


@register("multi_hop_propagation", f"WITH {PREREQUISITES_SQL}, s0 AS (SELECT node, 0.9::DOUBLE AS score, 0 AS d FROM firsts), " + ", ".join(f"s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT target, max(score * weight * 0.5 * CASE kind WHEN 'prerequisite' THEN 0.5 ELSE 0.3 END), {i} FROM s{i - 1} JOIN pre ON source = node WHERE d = {i - 1} AND target NOT IN (SELECT node FROM s{i - 1}) GROUP BY 1)" for i in (1, 2, 3)) + " SELECT node, round(score, 9) AS score FROM s3")
def multi_hop_propagation(spark, sf):
    """Influence by edge type, halved each hop; the first round that reaches a node decides."""
    factor = [F.col("weight"), F.lit(0.5), F.when(F.col("kind") == "prerequisite", 0.5).otherwise(0.3)]
    return G.spread(prerequisites(spark, sf), points(spark, sf).where("step = 1").select(F.col("kp").alias("node"), F.lit(0.9).alias("score")), 3, factor).withColumn("score", F.round("score", 9))


@register("payload_join", "SELECT e.event_id, b.item_id FROM events e JOIN benchmark b ON contains(e.props, '\"k\": ' || b.item_id || '}') WHERE e.event_type = 'signup'")
def payload_join(spark, sf):
    """What a stringified payload names: the key is cut out, so the join is an equality."""
    e = table(spark, sf, "events").where("event_type = 'signup'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"))
    return e.join(table(spark, sf, "benchmark").select("item_id"), "item_id").select("event_id", "item_id")


@register("model_comparison", f"WITH {ANSWERS_SQL}, m AS (SELECT learner, kp, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM answers GROUP BY 1, 2), l AS (SELECT learner, sum(n) AS n, count(*) AS k, sum(CASE WHEN p IN (0, 1) THEN 0 ELSE n * (p * ln(p) + (1 - p) * ln(1 - p)) END) AS ll FROM m GROUP BY 1) SELECT learner, round(2 * (k + 1) - 2 * ll, 5) AS aic, round((k + 1) * ln(n) - 2 * ll, 5) AS bic FROM l")
def model_comparison(spark, sf):
    """AIC and BIC of one success rate a point."""
    m = answers(spark, sf).groupBy("learner", "kp").agg(F.avg(F.col("correct").cast("double")).alias("p"), F.count("*").alias("n"))
    p = F.col("p")
    ll = F.when(p.isin(0.0, 1.0), 0.0).otherwise(F.col("n") * (p * F.log("p") + (1 - p) * F.log(1 - p)))
    s = m.groupBy("learner").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(ll).alias("ll"))
    return s.select("learner", F.round(2 * (F.col("k") + 1) - 2 * F.col("ll"), 5).alias("aic"), F.round((F.col("k") + 1) * F.log("n") - 2 * F.col("ll"), 5).alias("bic"))


@register("faithfulness", """WITH c AS (SELECT conv_id, turn, s, list_distinct(string_split(lower(s), ' ')) AS w FROM (SELECT conv_id, turn, trim(unnest(string_split(text, '.')), ' ') AS s FROM conversations WHERE role = 'assistant') WHERE s <> ''),
  u AS (SELECT conv_id, list_distinct(flatten(list(string_split(lower(text), ' ')))) AS ctx FROM conversations WHERE role = 'user' GROUP BY 1)
  SELECT c.conv_id, count(*) AS claims, count(*) FILTER (len(list_intersect(w, ctx)) / len(w)::DOUBLE >= 0.3) AS supported FROM c JOIN u USING (conv_id) GROUP BY 1""")
def faithfulness(spark, sf):
    """Claims of answers that the other side's words support."""
    c = table(spark, sf, "conversations")
    claims = c.where("role = 'assistant'").select("conv_id", F.explode(F.split("text", r"\.")).alias("s")).select("conv_id", F.trim("s").alias("s")).where("s <> ''").select("conv_id", F.array_distinct(F.split(F.lower("s"), " ")).alias("w"))
    ctx = c.where("role = 'user'").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(F.split(F.lower("text"), " ")))).alias("ctx"))
    ok = F.size(F.array_intersect("w", "ctx")) / F.size("w") >= 0.3
    return claims.join(ctx, "conv_id").groupBy("conv_id").agg(F.count("*").alias("claims"), F.count(F.when(ok, 1)).alias("supported"))


@register("voting_consensus", "WITH v AS (SELECT p_size AS topic, p_partkey AS voter, list_distinct(string_split(p_name, '')) AS c, p_name AS answer, p_retailprice AS weight FROM part), p AS (SELECT a.topic, avg(CASE WHEN a.answer = b.answer OR len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c)))::DOUBLE >= 0.6 THEN 1.0 ELSE 0.0 END) AS s FROM v a JOIN v b ON a.topic = b.topic AND a.voter < b.voter GROUP BY 1) SELECT topic, round(s, 6) AS consensus, (SELECT max(struct_pack(w := weight, a := answer)).a FROM v WHERE v.topic = p.topic) AS best FROM p")
def voting_consensus(spark, sf):
    """Share of agreeing pairs: answers are counted first, so equal ones are compared once."""
    v = table(spark, sf, "part").select(F.col("p_size").alias("topic"), F.col("p_name").alias("answer"), F.col("p_retailprice").alias("weight"))
    n = v.groupBy("topic", "answer").agg(F.count("*").alias("n"))
    a, b = n.withColumnsRenamed({"answer": "a", "n": "na"}), n.withColumnsRenamed({"answer": "b", "n": "nb"})
    near = (F.col("a") == F.col("b")) | (T.jaccard(T.characters(F.col("a")), T.characters(F.col("b"))) >= 0.6)
    pairs = F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    s = a.join(b, "topic").where("a <= b").groupBy("topic").agg(F.try_divide(F.sum(F.when(near, pairs).otherwise(0)), F.sum(pairs)).alias("s"))
    best = v.groupBy("topic").agg(F.max(F.struct("weight", "answer"))["answer"].alias("best"))
    return s.where("s is not null").join(best, "topic").select(F.col("topic"), F.round("s", 6).alias("consensus"), "best")


@register("review_evaluation", f"WITH {SEQ}, q AS (SELECT learner, kp, CASE WHEN correct THEN 1.0 ELSE 0.0 END AS a, power(1 + 0.2346 * (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY learner, kp ORDER BY i)) / 86400e6 / 5, -0.5) AS r FROM seq) SELECT kp, round(sum(a * ln(r) + (1 - a) * ln(1 - r)) / count(*), 6) AS log_likelihood, round(sqrt(avg((r - a) * (r - a))), 6) AS rmse, round(avg(abs(r - a)), 6) AS mae FROM q WHERE r < 1 GROUP BY 1")
def review_evaluation(spark, sf):
    """Predicted retention against outcomes."""
    r = _reviews(spark, sf).withColumn("gap", F.col("day") - F.lag("day").over(Window.partitionBy("learner", "kp").orderBy("day", "event_id")))
    r = r.select("kp", (F.col("grade") > 1).cast("double").alias("a"), F.pow(1 + 0.2346 * F.col("gap") / 5, F.lit(-0.5)).alias("r")).where("r < 1")
    a, p = F.col("a"), F.col("r")
    return r.groupBy("kp").agg(F.round(F.sum(a * F.log(p) + (1 - a) * F.log(1 - p)) / F.count("*"), 6).alias("log_likelihood"), F.round(F.sqrt(F.avg((p - a) * (p - a))), 6).alias("rmse"), F.round(F.avg(F.abs(p - a)), 6).alias("mae"))


@register("individual_tracing", f"""WITH RECURSIVE {SEQ}, f(learner, kp, i, n, p) AS (SELECT learner, kp, 0::BIGINT, n, 0.5::DOUBLE FROM seq WHERE i = 1 UNION ALL
  SELECT learner, kp, i, n, post + (1 - post) * (1 / (1 + exp(-(ln(0.1 / 0.9) + ln((0.3 + learner % 5 / 10.0) / (0.7 - learner % 5 / 10.0)))))) FROM (SELECT f.learner, f.kp, s.i, f.n, CASE WHEN s.correct THEN p * 0.8 / (p * 0.8 + (1 - p) * 0.1) ELSE p * 0.2 / (p * 0.2 + (1 - p) * 0.9) END AS post FROM f JOIN seq s ON s.learner = f.learner AND s.kp = f.kp AND s.i = f.i + 1))
  SELECT learner, kp, round(p, 8) AS mastery FROM f WHERE i = n""")
def individual_tracing(spark, sf):
    """Tracing whose chance to learn joins the point's and the learner's on the logit scale."""
    own = 0.3 + F.col("learner") % 5 / 10.0
    t = 1 / (1 + F.exp(-(F.log(F.lit(0.1 / 0.9)) + F.log(own / (1 - own)))))
    return L.traced(answers(spark, sf), ["learner", "kp"], t).select("learner", "kp", F.round("mastery", 8).alias("mastery"))


@register("source_fusion", f"WITH {_BM25}, {_KNN}, f AS (SELECT query_id, key, sum(w / (60 + rank)) AS s, count(DISTINCT l) AS n FROM (SELECT query_id, key, rank, 0.6::DOUBLE AS w, 'text' AS l FROM bm UNION ALL SELECT query_id, key, rank, 0.4::DOUBLE, 'vector' FROM kn) GROUP BY 1, 2), g AS (SELECT query_id, key, round(s + CASE WHEN n > 1 THEN 0.15 * n ELSE 0 END, 9) AS score, n AS sources FROM f) SELECT * FROM (SELECT query_id, key, score, sources, {_RANK} FROM g) WHERE rank <= 10")
def source_fusion(spark, sf):
    """Weighted reciprocal ranks with a bonus for keys that several sources return."""
    lists = [_bm25(spark, sf).withColumn("w", F.lit(0.6)).withColumn("l", F.lit("text")), _knn(spark, sf).withColumn("w", F.lit(0.4)).withColumn("l", F.lit("vector"))]
    u = lists[0].select("query_id", "key", "rank", "w", "l").unionByName(lists[1].select("query_id", "key", "rank", "w", "l"))
    f = u.groupBy("query_id", "key").agg(F.sum(F.col("w") / (60 + F.col("rank"))).alias("s"), F.countDistinct("l").alias("sources"))
    f = f.select("query_id", "key", F.round(F.col("s") + F.when(F.col("sources") > 1, 0.15 * F.col("sources")).otherwise(0), 9).alias("score"), "sources")
    return R.ranked(f, "query_id", "score", "key", 10).withColumn("rank", F.col("rank").cast("long"))


@register("ann_lsh")
def ann_lsh(spark, sf):
    """Approximate neighbours by bands of signs, for all items of benchmark as queries."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    q = v.withColumnRenamed("key", "query_id").join(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    return R.approximate_nearest(v, q, 10).withColumn("rank", F.col("rank").cast("long"))


@register("query_rewrite", "SELECT item_id, array_to_string(list_filter(['tion', 'the', 'er', 'zzz'], lambda t: contains(lower(text), t)), ' ') AS terms, len(list_filter(string_split(text, '.'), lambda s: trim(s) <> '')) AS clauses FROM benchmark")
def query_rewrite(spark, sf):
    """Dictionary terms, longest first, and clauses."""
    words = F.array(*map(F.lit, ("tion", "the", "er", "zzz")))
    low = F.lower("text")
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.filter(words, lambda t: F.contains(low, t)), " ").alias("terms"), F.size(F.filter(F.split("text", r"\."), lambda s: F.trim(s) != "")).cast("long").alias("clauses"))


@register("entity_extraction", "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS mention, 'email' AS kind FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^ ]+')), 'url' FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, 'CC BY[A-Z-]*|Apache License|MIT License')), 'license' FROM documents")
def entity_extraction(spark, sf):
    """Patterns by kind over whole texts, in one pass."""
    kinds = {"email": "[A-Za-z0-9._]+@[A-Za-z0-9.]+", "url": "https?://[^ ]+", "license": "CC BY[A-Z-]*|Apache License|MIT License"}
    named = lambda k, p: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda m: F.struct(m.alias("mention"), F.lit(k).alias("kind")))
    found = F.flatten(F.array(*(named(k, p) for k, p in kinds.items())))
    return table(spark, sf, "documents").select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.mention", "m.kind")


@register("relation_extraction", "SELECT doc_id, regexp_extract(text, '([Ll]icensed|[Rr]eleased) under (?:the )?([A-Z][A-Za-z ]*)', 1) AS relation, trim(regexp_extract(text, '([Ll]icensed|[Rr]eleased) under (?:the )?([A-Z][A-Za-z ]*)', 2), ' ') AS object FROM documents WHERE regexp_matches(text, '([Ll]icensed|[Rr]eleased) under (?:the )?([A-Z][A-Za-z ]*)')")
def relation_extraction(spark, sf):
    p = "([Ll]icensed|[Rr]eleased) under (?:the )?([A-Z][A-Za-z ]*)"
    return table(spark, sf, "documents").where(F.col("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 1).alias("relation"), F.trim(F.regexp_extract("text", p, 2)).alias("object"))


@register("contradictions", "SELECT a.l_partkey, a.s AS a, b.s AS b, round(abs(a.d - b.d), 4) AS gap FROM (SELECT l_partkey, l_suppkey AS s, max(l_discount) AS d FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_partkey, l_suppkey AS s, max(l_discount) AS d FROM lineitem GROUP BY 1, 2) b ON a.l_partkey = b.l_partkey AND a.s < b.s WHERE abs(a.d - b.d) >= 0.095")
def contradictions(spark, sf):
    """Claims of two sources about one thing that differ by a tolerance: smallest and largest bins meet, not all pairs."""
    c = table(spark, sf, "lineitem").groupBy("l_partkey", F.col("l_suppkey").alias("s")).agg(F.max("l_discount").alias("d"))
    top = c.groupBy("l_partkey").agg(F.max("d").alias("hi"), F.min("d").alias("lo"))
    open_ = c.join(top, "l_partkey").where("hi - d >= 0.095 or d - lo >= 0.095").select("l_partkey", "s", "d")
    a, b = open_.withColumnsRenamed({"s": "a", "d": "da"}), open_.withColumnsRenamed({"s": "b", "d": "db"})
    return a.join(b, "l_partkey").where("a < b and abs(da - db) >= 0.095").select("l_partkey", "a", "b", F.round(F.abs(F.col("da") - F.col("db")), 4).alias("gap"))


@register("history_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 1500")
def history_budget(spark, sf):
    """Newest turns that fit a budget of characters; the first that overflows ends it."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role")).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").withColumn("used", F.sum(F.length("text")).over(w)).where("used <= 1500").select("conv_id", "turn")


@register("memory_expiry", "SELECT user_id, count(*) FILTER (TIMESTAMP '2024-02-01' - ts > INTERVAL 168 HOUR) AS expired, count(*) FILTER (TIMESTAMP '2024-02-01' - ts <= INTERVAL 168 HOUR) AS live, least(7, count(*)) AS working FROM events GROUP BY 1")
def memory_expiry(spark, sf):
    """Retention of 168 hours, strictly; a working memory of seven."""
    old = F.col("ts") < F.expr("timestamp_ntz'2024-02-01' - interval 168 hours")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.when(old, 1)).alias("expired"), F.count(F.when(~old, 1)).alias("live"), F.least(F.lit(7), F.count("*")).alias("working"))


@register("error_propagation", "SELECT p_partkey, round(sqrt(0.5 * 0.5 + 0.2 * 0.2), 8) AS sum_error, round(p_size * p_retailprice * sqrt(power(0.5 / p_size, 2) + power(0.2 / p_retailprice, 2)), 6) AS product_error, round(abs(p_retailprice - 1000) / 1000, 8) AS relative_error FROM part")
def error_propagation(spark, sf):
    """Uncertainty of sums and products, relative error."""
    a, b = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", F.round(F.sqrt(F.lit(0.5 * 0.5 + 0.2 * 0.2)), 8).alias("sum_error"), F.round(a * b * F.sqrt(F.pow(0.5 / a, F.lit(2)) + F.pow(0.2 / b, F.lit(2))), 6).alias("product_error"), F.round(F.abs(b - 1000) / 1000, 8).alias("relative_error"))


@register("approximate_counts")
def approximate_counts(spark, sf):
    """Sketches: distinct actors and quantiles within a stated error."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("actors"), F.percentile_approx("value", 0.5, 1000).alias("median"))


@register("graph_boost", f"WITH {TRIPLES_SQL}, d AS (SELECT subject AS e, count(*) AS n FROM triples WHERE predicate = 'supplied_by' GROUP BY 1) SELECT p_partkey, round(p_retailprice / 1000 * (1 + 0.2 * n / (SELECT max(n) FROM d)), 6) AS score FROM part JOIN d ON d.e = 'p:' || p_partkey")
def graph_boost(spark, sf):
    """Scores raised by degree centrality."""
    d = triples(spark, sf).where("predicate = 'supplied_by'").groupBy(F.col("subject").alias("e")).agg(F.count("*").alias("n"))
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("e"))
    return p.join(d, "e").join(F.broadcast(d.agg(F.max("n").alias("most")))).select("p_partkey", F.round(F.col("p_retailprice") / 1000 * (1 + 0.2 * F.col("n") / F.col("most")), 6).alias("score"))


@register("merged_chunks", """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, len(string_split(text, chr(10))) AS n FROM documents),
  f(doc_id, i, n, held, out) AS (SELECT doc_id, 0::BIGINT, n, 0::BIGINT, 0::BIGINT FROM l WHERE i = 1 UNION ALL SELECT f.doc_id, l.i, f.n, CASE WHEN held + length(line) < 400 THEN held + length(line) + CASE WHEN held > 0 THEN 2 ELSE 0 END ELSE length(line) END, out + CASE WHEN held + length(line) < 400 OR held = 0 THEN 0 ELSE 1 END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
  SELECT doc_id, out + CASE WHEN held > 0 THEN 1 ELSE 0 END AS chunks FROM f WHERE i = n""")
def merged_chunks(spark, sf):
    """Chunks after lines are merged until they hold 400 characters."""
    def step(a, line):
        fits = a["held"] + F.length(line) < 400
        return F.struct(F.when(fits, a["held"] + F.length(line) + F.when(a["held"] > 0, 2).otherwise(0)).otherwise(F.length(line)).cast("long").alias("held"), (a["out"] + F.when(fits | (a["held"] == 0), 0).otherwise(1)).cast("long").alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("out"))
    end = lambda a: a["out"] + F.when(a["held"] > 0, 1).otherwise(0)
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.aggregate(F.split("text", "\n"), start, step, end).alias("chunks"))
