import datetime
import random

from pyspark.sql import functions as F

from tidemark.llm.urls import filter_urls, host_of

D = datetime.date(2024, 1, 1)
SCHEMA = "page_id long, url string, day date, list string, domain string"
ENTRIES = "domain string, list string, day date, action string, host string"


def brute(captures, entries):
    out = []
    for i, host, day in captures:
        hits = []
        if host and day:
            for domain, name in {(d.lower(), n) for d, n, x, a in entries if None not in (d, n, x) and a in ("add", "remove")}:
                if host != domain and not host.endswith("." + domain):
                    continue
                past = [(x, a == "remove") for d, n, x, a in entries if d and d.lower() == domain and n == name and x and x <= day and a in ("add", "remove")]
                if past and not max(past)[1]:
                    hits.append((domain, name))
        top = max((d for d, _ in hits), key=lambda d: (len(d), d), default=None)
        out.append((i, host, day, len(hits), ",".join(sorted({n for _, n in hits})), top, (top, "block") in hits and (top, "allow") not in hits))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(5)
    hosts = ["a.b.c", "b.c", "c", "x.b.c", "q.a.b.c", "ab.c", None]
    caps = [(i, r.choice(hosts), D + datetime.timedelta(r.randint(0, 40)) if r.random() < 0.95 else None) for i in range(400)]
    caps += [(None, "c", D), (7, "b.c", D)]
    entries = [(r.choice(["a.b.c", "B.C", "c", "b.c", "zz", None]), r.choice(["block", "allow", "other", None]), D + datetime.timedelta(r.randint(0, 40)), r.choice(["add", "remove", "add", "bad", None])) for _ in range(40)]
    entries += entries[:5]
    url = lambda h: None if h is None else f"HTTP://user@{h.upper()}:80/p?q=http://zz/"
    got = filter_urls(spark.createDataFrame([(i, url(h), d, "s", "t") for i, h, d in caps], SCHEMA), spark.createDataFrame([(*e, "h") for e in entries], ENTRIES))
    assert sorted(map(tuple, got.collect()), key=str) == brute(caps, entries)


def test_empty_and_hosts(spark):
    none = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ENTRIES)
    assert filter_urls(*none).count() == 0
    caps = spark.createDataFrame([(1, "http://h/", D, "", ""), (2, "not a url", D, "", ""), (3, "http:///x", D, "", ""), (4, "https://u:p@H.com.:8080?x", D, "", "")], SCHEMA)
    assert filter_urls(caps, none[1]).where("blocked or n_entries > 0").count() == 0
    assert [x[0] for x in caps.orderBy("page_id").select(host_of(F.col("url"))).collect()] == ["h", None, None, "h.com"]
