import base64
import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm.common import new_folder
from tidemark.llm.warc import read_warc, write_warc

SCHEMA = "page_id long, url string, html string, digest string, offset int"


def brute(rows, least):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, u, h in rows:
        p = (h or "").encode()
        to = first.get(h or "") if i is not None and len(p) >= least else None
        to = None if to == i else to
        out.append((i, u, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(5, "http://a/1", "<p>é漢</p>\r\n\r\nx"), (2, "http://a/ 2%20\n", "<p>é漢</p>\r\n\r\nx"), (7, None, None), (1, "u", ""), (9, "z" * 3000, "w" * 200_000), (None, "n", "<p>é漢</p>\r\n\r\nx"), (9, "again", "w" * 200_000), (2**60 + 1, "big", "b")]
    rows += [(100 + i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(300)]
    for least in (0, 5):
        folder = new_folder(spark, "warc")
        index = write_warc(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), folder, least)
        assert index.count() == len(rows)
        got = read_warc(index, folder)
        assert sorted(map(tuple, got.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(rows, least)
        html = {r.page_id: r.html for r in got.where("record_type = 'response'").collect()}
        assert html[9] == "w" * 200_000 and html[2] == "<p>é漢</p>\r\n\r\nx"
        assert read_warc(index, folder, with_html=False).where("html is not null").count() == 0
        some = read_warc(index.where(F.col("page_id") % 7 == 0), folder)
        assert some.count() == sum(r[0] is not None and r[0] % 7 == 0 for r in rows)


def test_empty(spark):
    folder = new_folder(spark, "warc")
    assert read_warc(write_warc(spark.createDataFrame([], SCHEMA), folder), folder).count() == 0


def test_reading_is_dealt_out(spark):
    """An index of several stretches is read by several tasks."""
    folder = new_folder(spark, "warc")
    rows = [(i, "u", random.Random(i).randbytes(300_000).hex(), "x", 1) for i in range(60)]
    index = write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder)
    got = read_warc(index, folder, with_html=False).withColumn("task", F.spark_partition_id())
    assert got.count() == 60 and got.select("task").distinct().count() > 1
