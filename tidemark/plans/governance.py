"""Versions, conflicts, retention, policies, validation, privacy and scoring queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import ENTITIES_SQL, TRIPLES_SQL, entities, table, triples
from ..operators import evolution as E
from ..operators import governance as V
from ..operators import iterate
from .registry import register


@register("version_history", "SELECT o_custkey, o_orderkey, row_number() OVER w AS version, CAST(CAST(lead(o_orderdate) OVER w AS DATE) AS VARCHAR) AS valid_until FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def version_history(spark, sf):
    """Versions of each customer's record, each valid until the next."""
    v = V.versions(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return v.select("o_custkey", "o_orderkey", F.col("version").cast("long").alias("version"), F.to_date("valid_until").cast("string").alias("valid_until"))


@register("value_conflicts", "SELECT l_partkey, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS n FROM lineitem GROUP BY 1 HAVING max(l_quantity) - min(l_quantity) > 0.9 * greatest(abs(min(l_quantity)), abs(max(l_quantity)))")
def value_conflicts(spark, sf):
    return V.conflicts(table(spark, sf, "lineitem"), "l_partkey", "l_quantity", 0.9)


@register("conflict_resolution", "SELECT l_partkey, l_quantity FROM (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_discount, l_orderkey, l_linenumber, l_quantity) AS rn FROM lineitem) WHERE rn = 1")
def conflict_resolution(spark, sf):
    """The most recent claim wins, then the most trusted."""
    return V.resolve(table(spark, sf, "lineitem"), "l_partkey", "l_quantity", [F.desc("l_shipdate"), F.col("l_discount"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")])


@register("retention", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'delete' WHEN o_orderdate < TIMESTAMP '1995-01-01' OR o_totalprice < 5000 THEN 'archive' ELSE 'keep' END AS action FROM orders")
def retention(spark, sf):
    """By age and quality."""
    d = F.col("o_orderdate")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, sf, "orders").select("o_orderkey", F.when(d < at("1993-01-01"), "delete").when((d < at("1995-01-01")) | (F.col("o_totalprice") < 5000), "archive").otherwise("keep").alias("action"))


@register("kb_health", f"WITH {TRIPLES_SQL}, {ENTITIES_SQL}, u AS (SELECT subject AS e FROM triples UNION SELECT object FROM triples), s AS (SELECT entity_type, avg(CASE WHEN u.e IS NULL THEN 1.0 ELSE 0.0 END) AS o, avg(CASE WHEN confidence < 0.3 THEN 1.0 ELSE 0.0 END) AS l FROM entities LEFT JOIN u ON u.e = entity_id GROUP BY 1) SELECT entity_type, round(o, 6) AS orphans, round(l, 6) AS low, CASE WHEN o > 0.3 OR l > 0.5 THEN 'critical' WHEN o > 0.1 OR l > 0.2 THEN 'warning' ELSE 'healthy' END AS health FROM s")
def kb_health(spark, sf):
    """Shares of unreferenced and of low-confidence entities."""
    t = triples(spark, sf)
    used = t.select(F.col("subject").alias("entity_id")).unionAll(t.select(F.col("object").alias("entity_id"))).distinct().withColumn("used", F.lit(1))
    s = entities(spark, sf).join(used, "entity_id", "left").groupBy("entity_type").agg(F.avg(F.col("used").isNull().cast("double")).alias("o"), F.avg((F.col("confidence") < 0.3).cast("double")).alias("l"))
    return s.select("entity_type", F.round("o", 6).alias("orphans"), F.round("l", 6).alias("low"), F.when((F.col("o") > 0.3) | (F.col("l") > 0.5), "critical").when((F.col("o") > 0.1) | (F.col("l") > 0.2), "warning").otherwise("healthy").alias("health"))


_RULES = [("view", 0, "allow"), ("click", 0, "allow"), ("purchase", 100, "deny"), ("purchase", 0, "allow"), ("*", 250, "deny")]


@register("policy_decision", "WITH r(action, least, effect) AS (VALUES ('view', 0, 'allow'), ('click', 0, 'allow'), ('purchase', 100, 'deny'), ('purchase', 0, 'allow'), ('*', 250, 'deny')) SELECT e.event_id AS request_id, CASE WHEN max(CASE WHEN effect = 'deny' THEN 1 ELSE 0 END) = 1 THEN 'deny' WHEN max(CASE WHEN effect = 'allow' THEN 1 ELSE 0 END) = 1 THEN 'allow' ELSE 'deny' END AS decision, count(effect) AS rules FROM events e LEFT JOIN r ON (r.action = e.event_type OR r.action = '*') AND e.value >= r.least GROUP BY 1")
def policy_decision(spark, sf):
    """Any deny wins; without a rule the answer is deny."""
    rules = spark.createDataFrame(_RULES, "action string, least int, effect string")
    q = table(spark, sf, "events").select(F.col("event_id").alias("request_id"), "event_type", "value")
    return V.decide(q, rules, "event_type", F.col("value") >= F.col("least"))


@register("audit_chain", "WITH RECURSIVE s AS (SELECT user_id, event_id, event_type || ':' || event_id AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), f(user_id, i, n, h) AS (SELECT DISTINCT user_id, 0::BIGINT, n, sha256('genesis') FROM s UNION ALL SELECT f.user_id, s.i, f.n, sha256(h || '|' || s.payload) FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1) SELECT user_id, n, h AS head FROM f WHERE i = n")
def audit_chain(spark, sf):
    """Hash chain of each actor's log, from a genesis constant."""
    return V.audit_chain(table(spark, sf, "events"), "user_id", ["event_id"], F.concat_ws(":", "event_type", F.col("event_id").cast("string")))


@register("chain_verification", "WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events), k AS (SELECT * FROM s WHERE event_id % 101 <> 0), b AS (SELECT k.user_id, k.seq, CASE WHEN k.seq > 1 AND p.seq IS NULL THEN 'gap' WHEN k.event_id % 97 = 0 THEN 'payload' END AS fault FROM k LEFT JOIN k p ON p.user_id IS NOT DISTINCT FROM k.user_id AND p.seq + 1 = k.seq), e AS (SELECT user_id, max(n) AS n, max(CASE WHEN event_id % 101 <> 0 THEN seq END) AS last FROM s GROUP BY 1), u AS (SELECT user_id, seq, fault FROM b WHERE fault IS NOT NULL UNION ALL SELECT user_id, coalesce(last, 0) + 1, 'end' FROM e WHERE last IS DISTINCT FROM n) SELECT user_id, min(seq)::BIGINT AS seq, arg_min(fault, seq * 10 + CASE fault WHEN 'end' THEN 0 WHEN 'gap' THEN 1 ELSE 2 END) AS fault FROM u GROUP BY 1")
def chain_verification(spark, sf):
    """The first break of each actor's stored log, of which some payloads were changed and some rows were lost."""
    events = table(spark, sf, "events").where("user_id is not null")
    payload = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    log = iterate.cut(V.chained(events, "user_id", ["event_id"], payload))
    heads = log.groupBy("user_id").agg(F.max("seq").alias("n"), F.max_by("hash", "seq").alias("head"))
    number = F.element_at(F.split("payload", ":"), -1).cast("long")
    stored = log.where(number % 101 != 0).withColumn("payload", F.when(number % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return V.verify_chains(stored, "user_id", heads)


def _collections(spark, sf):
    return {"customer": table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "nation": table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")}


def _migrated(spark, sf):
    """Collections, the steps to a schema in which nations are countries, balances are text and tiers stand for segments,
    and the migrated collections, written and read back."""
    old = _collections(spark, sf)
    schema = E.schema_of(old)
    new = {"customer": {**{k: v for k, v in schema["customer"].items() if k != "c_mktsegment"}, "c_acctbal": "string", "c_tier": "string"}, "country": schema["nation"]}
    steps = E.plan(schema, new)
    path, out = f"{iterate.work_folder(spark)}/migrated-{uuid.uuid4().hex}", {}
    for name, df in E.migrate(old, steps).items():
        df.write.parquet(f"{path}/{name}")
        out[name] = spark.read.parquet(f"{path}/{name}")
    return old, steps, out


@register("ontology_diff", """WITH o(class, property, filled) AS (SELECT 'customer', unnest(['c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment']), unnest([count(c_custkey), count(c_name), count(c_acctbal), count(c_mktsegment)]) FROM customer UNION ALL SELECT 'nation', unnest(['n_nationkey', 'n_name', 'n_regionkey']), unnest([count(n_nationkey), count(n_name), count(n_regionkey)]) FROM nation)
  SELECT CASE class WHEN 'nation' THEN 'country' ELSE class END AS class, property, CASE WHEN property = 'c_mktsegment' THEN 'removed' WHEN property = 'c_acctbal' THEN 'retyped' ELSE 'renamed' END AS change, filled AS before, CASE WHEN property = 'c_mktsegment' THEN NULL ELSE filled END AS after FROM o WHERE class = 'nation' OR property IN ('c_mktsegment', 'c_acctbal') UNION ALL SELECT 'customer', 'c_tier', 'added', NULL, 0""")
def ontology_diff(spark, sf):
    """What a migration changed, from the profiles of the collections before and after it."""
    old, steps, new = _migrated(spark, sf)
    names = {s.before: s.after for s in steps if s.action == "rename"}
    to = F.coalesce(*(F.when(F.col("class") == a, b) for a, b in names.items()), F.col("class")) if names else F.col("class")
    before = E.profile(old).select(to.alias("class"), F.col("class").alias("was"), "property", F.col("type").alias("old"), F.col("filled").alias("before"))
    after = E.profile({k: df.drop(E.UNDO) for k, df in new.items()}).select("class", "property", F.col("type").alias("new"), F.col("filled").alias("after"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "retyped").when(F.col("was") != F.col("class"), "renamed")
    return before.join(after, ["class", "property"], "full").select("class", "property", change.alias("change"), "before", "after").where("change is not null")


@register("compatibility", "SELECT 'INCOMPATIBLE' AS level, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS rows, (SELECT count(c_mktsegment) FROM customer) AS lost")
def compatibility(spark, sf):
    """How compatible a migration is, the rows that it passed through and the values that only an undo brings back."""
    _, steps, new = _migrated(spark, sf)
    rows = new["customer"].select(F.col(f"{E.UNDO}.c_mktsegment").isNotNull().alias("lost")).unionByName(new["country"].select(F.lit(False).alias("lost")))
    return rows.agg(F.lit(E.level(steps)).alias("level"), F.count("*").alias("rows"), F.count_if("lost").alias("lost"))


@register("migration_round_trip", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def migration_round_trip(spark, sf):
    """Customers migrated, written, read and rolled back."""
    old, steps, new = _migrated(spark, sf)
    back = E.rollback(new, steps, E.schema_of(old))["customer"]
    return back.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


@register("property_validation", "SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]{9}$') THEN 'name' END, CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY', 'BUILDING') THEN 'segment' END], x -> x IS NOT NULL), ',') AS faults FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000 OR c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY', 'BUILDING') OR NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')".replace("x -> x", "lambda x: x"))
def property_validation(spark, sf):
    """Pattern, range and enumeration constraints; the names of those that fail."""
    rules = {"name": ~F.col("c_name").rlike("^Customer#[0-9]{9}$"), "balance": (F.col("c_acctbal") < 0) | (F.col("c_acctbal") > 9000), "segment": ~F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY", "BUILDING")}
    faults = F.array_compact(F.array(*(F.when(bad, name) for name, bad in rules.items())))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(faults, ",").alias("faults")).where("faults <> ''")


@register("review_verdict", "SELECT doc_id, CASE WHEN s >= 0.75 THEN 'PASS' WHEN s >= 0.5 THEN 'FLAG' ELSE 'BLOCK' END AS verdict, round(s, 6) AS score FROM (SELECT doc_id, 0.40 * least(1.0, n_chars / 1500.0) + 0.25 * CASE WHEN lang IN ('en', 'fr') THEN 1 ELSE 0.6 END + 0.20 * CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END + 0.15 * CASE WHEN regexp_matches(text, '[#*$%&|<>]') THEN 0 ELSE 1 END AS s FROM documents)")
def review_verdict(spark, sf):
    """Weighted composite and its three outcomes."""
    t = F.col("text")
    s = 0.40 * F.least(F.lit(1.0), F.col("n_chars") / 1500.0) + 0.25 * F.when(F.col("lang").isin("en", "fr"), 1.0).otherwise(0.6) + 0.20 * F.when(t.contains("\n"), 1.0).otherwise(0.0) + 0.15 * F.when(t.rlike("[#*$%&|<>]"), 0.0).otherwise(1.0)
    return table(spark, sf, "documents").select("doc_id", F.when(s >= 0.75, "PASS").when(s >= 0.5, "FLAG").otherwise("BLOCK").alias("verdict"), F.round(s, 6).alias("score"))


@register("tolerance_check", "SELECT l_orderkey, l_linenumber, l_quantity, abs(l_quantity - 25) <= 5 AS absolute, abs(l_quantity - 25) / 25 <= 0.1 AS relative, l_quantity <= 40 AS threshold FROM lineitem")
def tolerance_check(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.abs(q - 25) <= 5).alias("absolute"), (F.abs(q - 25) / 25 <= 0.1).alias("relative"), (q <= 40).alias("threshold"))


@register("unit_conversion", "SELECT p_partkey, round(6.626e-34 * 3e8 / (p_retailprice * 1e-9) * 1e19, 6) AS energy, round(1e7 / p_retailprice, 6) AS wavenumber, round(p_size + 273.15, 2) AS kelvin, round(449 * power(n, 3) + 3525 * power(n, 2) + 6823.3 * n + 5520.33, 4) AS cct FROM (SELECT *, ((p_size / 100.0) - 0.332) / (0.1858 - 0.33) AS n FROM part)")
def unit_conversion(spark, sf):
    """Photon energy, wave number, temperature and McCamy's colour temperature."""
    n = ((F.col("p_size") / 100.0) - 0.332) / (0.1858 - 0.33)
    return table(spark, sf, "part").select("p_partkey", F.round(6.626e-34 * 3e8 / (F.col("p_retailprice") * 1e-9) * 1e19, 6).alias("energy"), F.round(1e7 / F.col("p_retailprice"), 6).alias("wavenumber"), F.round(F.col("p_size") + 273.15, 2).alias("kelvin"), F.round(449 * F.pow(n, F.lit(3)) + 3525 * F.pow(n, F.lit(2)) + 6823.3 * n + 5520.33, 4).alias("cct"))


@register("pseudonyms", "SELECT user_id, 'p' || dense_rank() OVER (ORDER BY first) AS pseudonym FROM (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1)")
def pseudonyms(spark, sf):
    """Ids by order of first sight: ranks within at most 100,000 ranges of first events plus the counts of those before."""
    first = table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first"))
    lo, hi = first.agg(F.min("first")).scalar(), first.agg(F.max("first")).scalar()
    part = first.withColumn("range", F.floor((F.col("first") - lo) / ((hi - lo + 1) / 100_000)))
    before = part.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("range").orderBy("first"))
    return part.join(before, "range").select("user_id", F.concat(F.lit("p"), (rank + F.col("before")).cast("string")).alias("pseudonym"))


@register("privacy_buckets", "SELECT event_id, CASE WHEN value < 5 THEN '<5' WHEN value < 15 THEN '5-15' WHEN value < 60 THEN '15-60' ELSE '>=60' END AS bucket, sha256('salt:' || user_id) AS hash FROM events")
def privacy_buckets(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.when(v < 5, "<5").when(v < 15, "5-15").when(v < 60, "15-60").otherwise(">=60").alias("bucket"), F.sha2(F.concat(F.lit("salt:"), F.col("user_id").cast("string")), 256).alias("hash"))


@register("implicit_feedback", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.8 WHEN 'click' THEN least(0.6, value / 100.0) WHEN 'view' THEN least(0.3, value / 200.0) ELSE -1.0 END AS rating FROM events")
def implicit_feedback(spark, sf):
    """Ratings from actions and dwell."""
    k, v = F.col("event_type"), F.col("value")
    return table(spark, sf, "events").select("event_id", F.when(k == "purchase", 1.0).when(k == "signup", 0.8).when(k == "click", F.least(F.lit(0.6), v / 100.0)).when(k == "view", F.least(F.lit(0.3), v / 200.0)).otherwise(-1.0).alias("rating"))


@register("uncertainty_gate", "SELECT event_id, round(power(s, 1 / 1.5), 6) AS score, CASE WHEN power(s, 1 / 1.5) >= 0.7 THEN 'release' WHEN power(s, 1 / 1.5) >= 0.4 THEN 'review' ELSE 'hold' END AS tier FROM (SELECT event_id, 0.6 * least(1.0, value / 100.0) + 0.4 * CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS s FROM events)")
def uncertainty_gate(spark, sf):
    """Weighted signals under a temperature, in three tiers."""
    s = F.pow(0.6 * F.least(F.lit(1.0), F.col("value") / 100.0) + 0.4 * F.when(F.col("event_type") == "error", 0).otherwise(1), F.lit(1 / 1.5))
    return table(spark, sf, "events").select("event_id", F.round(s, 6).alias("score"), F.when(s >= 0.7, "release").when(s >= 0.4, "review").otherwise("hold").alias("tier"))


@register("change_diff", "SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity <> q THEN 'quantity' END, CASE WHEN l_discount <> d THEN 'discount' END, CASE WHEN l_returnflag <> r THEN 'returnflag' END], lambda x: x IS NOT NULL), ',') AS modified FROM (SELECT *, lag(l_quantity) OVER w AS q, lag(l_discount) OVER w AS d, lag(l_returnflag) OVER w AS r FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity)) WHERE q IS NOT NULL")
def change_diff(spark, sf):
    """Fields that changed since the version before."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    was = lambda c: F.lag(c).over(w)
    l = table(spark, sf, "lineitem").withColumns({"q": was("l_quantity"), "d": was("l_discount"), "r": was("l_returnflag")}).where("q is not null")  # noqa: E741
    fields = F.array(F.when(F.col("l_quantity") != F.col("q"), "quantity"), F.when(F.col("l_discount") != F.col("d"), "discount"), F.when(F.col("l_returnflag") != F.col("r"), "returnflag"))
    return l.select("l_orderkey", "l_linenumber", F.array_join(F.array_compact(fields), ",").alias("modified"))
