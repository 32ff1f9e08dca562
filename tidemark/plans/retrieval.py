"""Retrieval, fusion, reranking and text queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import table
from ..operators import retrieval as R
from .registry import register

_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_TOK = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[a-z][a-z0-9+\\-/]*'), lambda t: t NOT IN {_STOP})"
_BM25 = f"""d AS (SELECT doc_id, {_TOK('text')} AS t FROM documents), dl AS (SELECT doc_id, len(t) AS length, t FROM d WHERE len(t) > 0), st AS (SELECT count(*) AS docs, avg(length) AS mean FROM dl),
  p AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, length, unnest(t) AS term FROM dl) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOK('text')}) AS term FROM benchmark) GROUP BY 1, 2),
  sc AS (SELECT query_id, doc_id AS key, round(sum(times * ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY 1, 2),
  bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM sc) WHERE rank <= 20)"""
_KNN = """vs AS (SELECT q.vec_id AS query_id, v.vec_id AS key, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
  kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM vs) WHERE rank <= 20)"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank"


def _bm25(spark, sf, k=20):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25(table(spark, sf, "documents").select("doc_id", "text"), q, k).withColumnRenamed("doc_id", "key")


def _query_vectors(spark, sf):
    """The stated query set: the vectors of all items of benchmark."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return v.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")), "query_id", "left_semi")


def _knn(spark, sf, k=20):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return R.nearest(v, _query_vectors(spark, sf), k)


@register("bm25", f"WITH {_BM25} SELECT query_id, key, score, rank FROM bm")
def bm25(spark, sf):
    return _bm25(spark, sf).select("query_id", "key", "score", F.col("rank").cast("long").alias("rank"))


@register("vector_knn", f"WITH {_KNN} SELECT query_id, key, score, rank FROM kn")
def vector_knn(spark, sf):
    return _knn(spark, sf).select("query_id", "key", "score", F.col("rank").cast("long").alias("rank"))


@register("vector_knn_filtered", f"WITH vs AS (SELECT q.vec_id AS query_id, v.vec_id AS key, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND v.label IN (1, 2)) SELECT * FROM (SELECT query_id, key, score, {_RANK} FROM vs) WHERE rank <= 5")
def vector_knn_filtered(spark, sf):
    """The metadata filter comes before the top k."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")
    return R.nearest(v.where("label in (1, 2)"), _query_vectors(spark, sf), 5).select("query_id", "key", "score", F.col("rank").cast("long").alias("rank"))


@register("hybrid_rrf", f"WITH {_BM25}, {_KNN}, f AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, key, rank FROM bm UNION ALL SELECT query_id, key, rank FROM kn) GROUP BY 1, 2) SELECT * FROM (SELECT query_id, key, score, {_RANK} FROM f) WHERE rank <= 10")
def hybrid_rrf(spark, sf):
    """Lexical and vector lists fused by reciprocal ranks."""
    return R.rrf([_bm25(spark, sf), _knn(spark, sf)], 10).select("query_id", "key", "score", F.col("rank").cast("long").alias("rank"))


@register("hybrid_min_max", f"WITH {_BM25}, {_KNN}, m AS (SELECT query_id, key, 0.4 * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS s FROM bm WINDOW w AS (PARTITION BY query_id) UNION ALL SELECT query_id, key, 0.6 * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END FROM kn WINDOW w AS (PARTITION BY query_id)), f AS (SELECT query_id, key, round(sum(s), 6) AS score FROM m GROUP BY 1, 2) SELECT * FROM (SELECT query_id, key, score, {_RANK} FROM f) WHERE rank <= 10")
def hybrid_min_max(spark, sf):
    return R.min_max([_bm25(spark, sf), _knn(spark, sf)], [0.4, 0.6], 10).select("query_id", "key", "score", F.col("rank").cast("long").alias("rank"))


@register("hybrid_interleave", f"WITH {_BM25}, {_KNN}, f AS (SELECT query_id, key, min(rank * 10 + l) AS place FROM (SELECT query_id, key, rank, 0 AS l FROM bm UNION ALL SELECT query_id, key, rank, 1 FROM kn) GROUP BY 1, 2) SELECT * FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY place, key) AS rank FROM f) WHERE rank <= 10")
def hybrid_interleave(spark, sf):
    return R.interleave([_bm25(spark, sf), _knn(spark, sf)], 10).withColumn("rank", F.col("rank").cast("long"))


@register("recency_rerank", f"WITH {_BM25}, r AS (SELECT bm.query_id, bm.key, round(score * exp(-ln(2.0) * (key % 365) / 90.0), 6) AS score, round(score * exp(-power((key % 365) / 90.0, 2)), 6) AS gaussian, round(score * greatest(0.0, 1 - (key % 365) / 90.0), 6) AS linear FROM bm) SELECT query_id, key, score, gaussian, linear, {_RANK} FROM r")
def recency_rerank(spark, sf):
    age = F.col("key") % 365
    b = _bm25(spark, sf).drop("rank")
    law = lambda name: F.round(F.col("score") * R.recency(age, 90.0, name), 6)
    out = b.select("query_id", "key", law("exponential").alias("e"), law("gaussian").alias("gaussian"), law("linear").alias("linear")).withColumnRenamed("e", "score")
    return R.ranked(out, "query_id", "score", "key").withColumn("rank", F.col("rank").cast("long"))


@register("quality_rerank", f"WITH {_BM25}, r AS (SELECT bm.query_id, bm.key, round(score * (1 + 0.3 * coalesce(quality, 0)) * (1 + CASE WHEN lang = 'en' THEN 0.1 ELSE 0 END), 6) AS score FROM bm JOIN documents d ON d.doc_id = bm.key LEFT JOIN labels l ON l.doc_id = bm.key) SELECT query_id, key, score, {_RANK} FROM r")
def quality_rerank(spark, sf):
    """Quality and metadata boosts."""
    b = _bm25(spark, sf).drop("rank")
    b = b.join(table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "lang"), "key").join(table(spark, sf, "labels").select(F.col("doc_id").alias("key"), "quality"), "key", "left")
    s = F.round(F.col("score") * (1 + 0.3 * F.coalesce("quality", F.lit(0))) * (1 + F.when(F.col("lang") == "en", 0.1).otherwise(0.0)), 6)
    return R.ranked(b.select("query_id", "key", s.alias("score")), "query_id", "score", "key").withColumn("rank", F.col("rank").cast("long"))


@register("mmr_rerank")
def mmr_rerank(spark, sf):
    """Diverse picks from the nearest vectors."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return R.mmr(_knn(spark, sf).drop("rank").join(v, "key"), 8)


@register("intent", "SELECT conv_id, turn, CASE WHEN greatest(a, b, c) < 0.15 THEN 'concept' WHEN a >= b AND a >= c THEN 'value' WHEN b >= c THEN 'compare' ELSE 'how' END AS intent FROM (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]') THEN 0.4 ELSE 0 END AS a, CASE WHEN regexp_matches(lower(text), '(than|que|als)') THEN 0.35 ELSE 0 END AS b, CASE WHEN contains(text, '?') THEN 0.35 ELSE 0 END AS c FROM conversations WHERE role = 'user')")
def intent(spark, sf):
    """Rule weights; the heaviest wins, weak evidence falls back."""
    t, w = F.col("text"), lambda c, v: F.when(c, v).otherwise(0.0)
    s = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", w(t.rlike("[0-9]"), 0.4).alias("a"), w(F.lower(t).rlike("(than|que|als)"), 0.35).alias("b"), w(t.contains("?"), 0.35).alias("c"))
    rule = F.when(F.greatest("a", "b", "c") < 0.15, "concept").when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")), "value").when(F.col("b") >= F.col("c"), "compare").otherwise("how")
    return s.select("conv_id", "turn", rule.alias("intent"))


@register("boolean_search", f"SELECT doc_id FROM (SELECT doc_id, {_TOK('text')} AS t FROM documents) WHERE list_contains(t, 'thre') AND (list_contains(t, 'thon') OR list_contains(t, 'onre')) AND NOT list_contains(t, 'ening')")
def boolean_search(spark, sf):
    """and, or, not over tokens."""
    d = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    has = lambda w: F.array_contains("t", w)
    return d.where(has("thre") & (has("thon") | has("onre")) & ~has("ening")).select("doc_id")


@register("pseudo_embedding", "SELECT item_id, sha256(text) AS h, round((('0x' || left(sha256(text), 8))::BIGINT / 4294967295.0) * 2 - 1, 8) AS e0, round((('0x' || substring(sha256(text), 9, 8))::BIGINT / 4294967295.0) * 2 - 1, 8) AS e1 FROM benchmark")
def pseudo_embedding(spark, sf):
    """Numbers in [-1, 1] from the blocks of a hash."""
    h = F.sha2("text", 256)
    part = lambda i: F.round(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("double") / 4294967295.0 * 2 - 1, 8)
    return table(spark, sf, "benchmark").select("item_id", h.alias("h"), part(0).alias("e0"), part(1).alias("e1"))


@register("tokenise", f"SELECT item_id, array_to_string({_TOK('text')}, ' ') AS tokens FROM benchmark")
def tokenise(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@register("fixed_chunks", "SELECT doc_id, i AS idx, substring(text, i * 400 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 400.0) AS BIGINT)))) AS i FROM documents WHERE length(text) > 0)")
def fixed_chunks(spark, sf):
    """500 characters with an overlap of 100."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.fixed_chunks(F.col("text"), 500, 100)).alias("idx", "chunk")).withColumn("idx", F.col("idx").cast("long"))


@register("paragraph_chunks", "SELECT doc_id, idx, length(line) AS n_chars, CASE WHEN length(line) > 1500 THEN 1 WHEN length(line) > 500 THEN 2 ELSE 3 END AS level, CASE WHEN regexp_matches(line, ' \\| ') THEN 'table' WHEN regexp_matches(line, '[=+]') THEN 'equation' ELSE 'text' END AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS idx FROM documents) WHERE trim(line) <> ''")
def paragraph_chunks(spark, sf):
    """Paragraphs with level and content type; indexes are set before blank ones go."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")).where(F.trim("line") != "")
    n = F.length("line")
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), n.cast("long").alias("n_chars"), F.when(n > 1500, 1).when(n > 500, 2).otherwise(3).alias("level"), F.when(F.col("line").rlike(r" \| "), "table").when(F.col("line").rlike("[=+]"), "equation").otherwise("text").alias("kind"))


@register("sentence_chunks", "SELECT doc_id, count(*) AS n, max(length(s)) AS longest FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))), ' ') AS s FROM documents) WHERE s <> '' GROUP BY 1")
def sentence_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


@register("classify", "SELECT doc_id, CASE WHEN en >= fr AND en >= de AND en > 0 THEN 'en' WHEN fr >= de AND fr > 0 THEN 'fr' WHEN de > 0 THEN 'de' ELSE 'none' END AS class, round((en + fr + de) * 1000.0 / greatest(1, n_chars), 6) AS density FROM (SELECT doc_id, n_chars, len(regexp_extract_all(lower(text), ' the ')) AS en, len(regexp_extract_all(lower(text), ' les ')) AS fr, len(regexp_extract_all(lower(text), ' der ')) AS de FROM documents)")
def classify(spark, sf):
    """Keyword hits, the first class of the most, density per 1000 characters."""
    n = lambda w: F.size(F.regexp_extract_all(F.lower("text"), F.lit(f" {w} "), F.lit(0)))
    d = table(spark, sf, "documents").select("doc_id", "n_chars", n("the").alias("en"), n("les").alias("fr"), n("der").alias("de"))
    c = F.when(F.expr("en >= fr and en >= de and en > 0"), "en").when(F.expr("fr >= de and fr > 0"), "fr").when(F.col("de") > 0, "de").otherwise("none")
    return d.select("doc_id", c.alias("class"), F.round((F.col("en") + F.col("fr") + F.col("de")) * 1000.0 / F.greatest(F.lit(1), "n_chars"), 6).alias("density"))


@register("numeric_assertions", "SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS value FROM documents")
def numeric_assertions(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).alias("value"))


@register("claims", "SELECT conv_id, turn, regexp_matches(text, '[0-9]') AS numeric_claim, regexp_matches(lower(text), '(donc|weil|because|porque)') AS causal, regexp_matches(lower(text), '(plus que|mehr als|more than|als)') AS comparative FROM conversations WHERE role = 'assistant'")
def claims(spark, sf):
    t, low = F.col("text"), F.lower("text")
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", t.rlike("[0-9]").alias("numeric_claim"), low.rlike("(donc|weil|because|porque)").alias("causal"), low.rlike("(plus que|mehr als|more than|als)").alias("comparative"))


@register("entity_resolution", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE levenshtein(a.n_name, b.n_name) <= 1")
def entity_resolution(spark, sf):
    """Names within one edit, compared within a block."""
    n = table(spark, sf, "nation")
    a, b = (n.select(F.col("n_regionkey").alias("block"), F.col("n_nationkey").alias(x), F.col("n_name").alias(f"name_{x}")) for x in "ab")
    d = F.levenshtein("name_a", "name_b")
    return a.join(b, "block").where("a < b").where(d <= 1).select("a", "b", d.cast("long").alias("distance"))


@register("token_jaccard", f"WITH t AS (SELECT item_id, list_distinct({_TOK('text')}) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 8) AS jaccard FROM t a JOIN t b ON a.item_id + 1 = b.item_id")
def token_jaccard(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    a, b = t.select(F.col("item_id").alias("a"), F.col("t").alias("ta")), t.select(F.col("item_id").alias("b"), F.col("t").alias("tb"))
    return a.join(b, F.col("a") + 1 == F.col("b")).select("a", "b", F.round(T.jaccard(F.col("ta"), F.col("tb")), 8).alias("jaccard"))


@register("name_similarity", "SELECT p_partkey, regexp_replace(lower(trim(p_name)), '\\s+', '', 'g') AS normal, levenshtein(p_name, 'red widget') AS edits, len(list_intersect(list_distinct(string_split(p_name, '')), list_distinct(string_split('red widget', '')))) AS shared FROM part")
def name_similarity(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", T.normal_name(n).alias("normal"), F.levenshtein(n, F.lit("red widget")).cast("long").alias("edits"), F.size(F.array_intersect(T.characters(n), T.characters(F.lit("red widget")))).cast("long").alias("shared"))


@register("seen_penalty", f"WITH {_BM25} SELECT query_id, key, round(score * CASE WHEN row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 1 THEN 0.8 ELSE 1.0 END, 6) AS score FROM bm JOIN documents d ON d.doc_id = bm.key")
def seen_penalty(spark, sf):
    """Hits of a source already seen higher up count less."""
    b = _bm25(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "source"), "key")
    again = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank")) > 1
    return b.select("query_id", "key", F.round(F.col("score") * F.when(again, 0.8).otherwise(1.0), 6).alias("score"))
