"""URL filters: dated list entries become validity intervals, and captures are joined as of their fetch day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def host_of(url):
    """Lower-case host of a URL column: without user, port and trailing dot; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, list, active_from, active_to) from dated entries (domain, list, day, action "add" or "remove").

    The state of a (domain, list) holds from its entry to the next one; active_to is null for the last. Of several
    entries on one day a removal wins. Entries with a null domain, list or day or another action say nothing;
    repeated ones count once. The number of entries of one (domain, list) is its history, not the corpus.
    """
    e = entries.where("domain is not null and list is not null and day is not null and action in ('add', 'remove')")
    e = e.select(F.lower("domain").alias("domain"), "list", "day", "action").groupBy("domain", "list", "day").agg(F.max("action").alias("action"))
    state = e.withColumn("active_to", F.lead("day").over(Window.partitionBy("domain", "list").orderBy("day")))
    return state.where("action = 'add'").select("domain", "list", F.col("day").alias("active_from"), "active_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """One row per capture: id, host, day, n_entries, lists (sorted, comma-joined), matched (longest domain), blocked.

    A capture meets an entry when the entry's domain is its host or a parent of it and was active on its day. The
    most specific domain decides: blocked when an active "block" entry stands there and no active "allow" entry does.
    Verdicts depend on the host and the day alone, so distinct pairs are judged once: a host with a third of all
    captures is as many rows as it has days. Both joins are equi-joins on domain or (host, day), and no side is
    broadcast unmeasured. Null or host-less URLs and null days meet nothing and aren't blocked; repeated captures get a
    row each; an empty list blocks nothing.
    """
    c = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(day_col).cast("date").alias("day"))
    pairs = c.where("host is not null and day is not null").select("host", "day").distinct()
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = pairs.select("host", "day", F.explode(parents).alias("domain"))
    hits = keyed.join(intervals(entries), "domain").where("active_from <= day and (active_to is null or day < active_to)")
    by_domain = hits.groupBy("host", "day", "domain").agg(F.count("*").alias("n"), F.max((F.col("list") == "block").cast("int")).alias("block"), F.max((F.col("list") == "allow").cast("int")).alias("allow"), F.collect_set("list").alias("lists"))
    top = F.max(F.struct(F.length("domain").alias("size"), "domain", (F.expr("block = 1 and allow = 0")).alias("blocked")))
    verdict = by_domain.groupBy("host", "day").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))), ",").alias("lists"), top.alias("top"))
    out = c.join(verdict, ["host", "day"], "left")
    return out.select(
        F.col("id").alias(id_col), "host", "day", F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("top.domain").alias("matched"), F.coalesce("top.blocked", F.lit(False)).alias("blocked")
    )


# Dated entries for whole domains.
DOMAIN_ENTRIES = [
    ("example.org", "block", "2024-02-01", "add"),
    ("example.org", "block", "2024-05-01", "remove"),
    ("example.org", "block", "2024-09-15", "add"),
    ("example.net", "allow", "2024-03-01", "add"),
    ("example.com", "block", "2024-11-01", "add"),
    ("example.com", "allow", "2024-12-01", "add"),
]


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the query: the fixed ones, and for every host entries dated by its smallest page_id m:
    blocked from day m % 200 on if m % 3 = 0, unlisted 60 days later if m % 2 = 0, blocked again after 120 days if
    m % 4 = 0, allowed from day m % 150 on if m % 5 = 0; days count from 2024-01-01."""
    spark = pages.sparkSession
    hosts = pages.select(host_of(F.col("url")).alias("domain"), "page_id").where("domain is not null").groupBy("domain").agg(F.min("page_id").alias("m"))
    event = lambda day, name, action, when: F.when(F.expr(when), F.struct(F.expr(f"date_add(date'2024-01-01', cast({day} as int))").alias("day"), F.lit(name).alias("list"), F.lit(action).alias("action")))
    events = F.array(event("m % 200", "block", "add", "m % 3 = 0"), event("m % 200 + 60", "block", "remove", "m % 6 = 0"), event("m % 200 + 120", "block", "add", "m % 12 = 0"), event("m % 150", "allow", "add", "m % 5 = 0"))
    made = hosts.select("domain", F.explode(events).alias("e")).where("e is not null").select("domain", "e.list", "e.day", "e.action")
    fixed = spark.createDataFrame(DOMAIN_ENTRIES, "domain string, list string, day string, action string").select("domain", "list", F.col("day").cast("date").alias("day"), "action")
    return made.unionByName(fixed)


def op6_url_asof_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures, fetched page_id * 7 % 365 days after 2024-01-01."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", F.expr("date_add(date'2024-01-01', cast(page_id * 7 % 365 as int))"))
    return filter_urls(captures, list_entries(pages))


OP6_SQL = """
WITH c AS (
  SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') , '') AS host,
         DATE '2024-01-01' + CAST(page_id * 7 % 365 AS INTEGER) AS day FROM pages),
h AS (SELECT host AS domain, min(page_id) AS m FROM c WHERE host IS NOT NULL GROUP BY 1),
e AS (
  SELECT domain, 'block' AS list, CAST(m % 200 AS INTEGER) AS d, 'add' AS action FROM h WHERE m % 3 = 0
  UNION SELECT domain, 'block', CAST(m % 200 + 60 AS INTEGER), 'remove' FROM h WHERE m % 6 = 0
  UNION SELECT domain, 'block', CAST(m % 200 + 120 AS INTEGER), 'add' FROM h WHERE m % 12 = 0
  UNION SELECT domain, 'allow', CAST(m % 150 AS INTEGER), 'add' FROM h WHERE m % 5 = 0),
f AS (
  SELECT domain, list, DATE '2024-01-01' + d AS day, action FROM e
  UNION SELECT * FROM (VALUES ('example.org', 'block', DATE '2024-02-01', 'add'), ('example.org', 'block', DATE '2024-05-01', 'remove'), ('example.org', 'block', DATE '2024-09-15', 'add'),
    ('example.net', 'allow', DATE '2024-03-01', 'add'), ('example.com', 'block', DATE '2024-11-01', 'add'), ('example.com', 'allow', DATE '2024-12-01', 'add')) v(domain, list, day, action)),
g AS (SELECT domain, list, day, max(action) AS action FROM f GROUP BY 1, 2, 3),
i AS (SELECT *, lead(day) OVER (PARTITION BY domain, list ORDER BY day) AS until FROM g),
hits AS (
  SELECT c.page_id, i.domain, i.list FROM c JOIN i ON (c.host = i.domain OR ends_with(c.host, '.' || i.domain)) AND i.action = 'add' AND i.day <= c.day AND (i.until IS NULL OR c.day < i.until)),
n AS (SELECT page_id, count(*) AS n_entries, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists, max(struct_pack(size := length(domain), domain := domain)).domain AS matched FROM hits GROUP BY 1)
SELECT c.page_id, c.host, c.day, coalesce(n_entries, 0) AS n_entries, coalesce(lists, '') AS lists, matched,
  coalesce(EXISTS (SELECT 1 FROM hits x WHERE x.page_id = c.page_id AND x.domain = n.matched AND x.list = 'block') AND NOT EXISTS (SELECT 1 FROM hits x WHERE x.page_id = c.page_id AND x.domain = n.matched AND x.list = 'allow'), false) AS blocked
FROM c LEFT JOIN n USING (page_id)
"""
