"""WARC archives with an index written first: byte ranges of the selected records are sorted and coalesced."""

from __future__ import annotations

import base64
import gzip
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, stored
from .files import read_range, write_file
from .frames import frame

#: Compressed bytes after which a task begins the next archive.
ARCHIVE_BYTES = 16 << 20
#: Ranges of one archive that stand at most this far apart are read at once, up to READ_BYTES (or one record).
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"

INDEX = "archive string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(url: str) -> str:
    """A header value: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _plain(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value)


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the response."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = http
    else:
        block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse(data: bytes) -> dict:
    """The record of one gzip member; a payload that doesn't match its digest or length raises."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    block = rest[: int(fields["Content-Length"])]
    kind, sha, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    html = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or digest(payload) != sha:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        html = payload.decode()
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": None if url is None else _plain(url),
        "payload_bytes": size,
        "payload_digest": sha,
        "record_type": kind,
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "html": html,
    }


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) to archives in folder and returns their index.

    Among rows with equal payloads of at least least_bytes the one with the smallest page_id is a response and the
    others are revisits of it; smaller payloads are all responses, and so are rows without a page_id. A null html is
    an empty payload, a null url leaves the header out. Rows that repeat the smallest id are responses too. Each task
    streams its rows into archives of bounded size; only names in the returned (stored) index are ever read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    big = F.octet_length("html") >= least_bytes
    # payloads that occur once join nothing; where one is frequent, adaptive execution can split its rows
    first = rows.where(big & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    rows = rows.join(first, "sha", "left").select("page_id", "url", "html", F.when(big & (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        held, index, at = [], [], 0

        def flush():
            name = write_file(folder, "pages.warc.gz", b"".join(held))
            return frame([(name, *x) for x in index], INDEX)

        for pdf in batches:
            for page_id, url, html, refers_to in zip(pdf.page_id.tolist(), pdf.url.tolist(), pdf.html.tolist(), pdf.refers_to.tolist(), strict=True):
                payload = html.encode()
                sha = digest(payload)
                number = lambda v: None if v is None or v != v else int(v)
                data = record(number(page_id), url, payload, sha, number(refers_to))
                index.append((at, len(data), url, sha, "response" if number(refers_to) is None else "revisit", number(page_id)))
                held.append(data)
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    yield flush()
                    held, index, at = [], [], 0
        if index:
            yield flush()

    return stored(_exact(rows).mapInPandas(write, INDEX), "warc-index")


def _exact(df: DataFrame) -> DataFrame:
    """Ids as strings on the way to pandas, which would turn a nullable long into a double."""
    return df.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to") if c in df.columns})


def read_warc(index: DataFrame, folder: str, with_html: bool = True) -> DataFrame:
    """The records that the rows of index name. Every archive's ranges are sorted by offset, and near ones read at once.

    Ranges are dealt out by archive and stretch of READ_BYTES over as many tasks as the index names stretches, up to
    four times the session's number of shuffle partitions. Each run that was read is handed on before the next is read. Without
    with_html records are checked in the task and only their fields leave it.
    """

    def read(batches):
        for pdf in batches:
            run = []

            def fetch(run):
                name, start = run[0][0], run[0][1]
                data = read_range(folder, name, start, run[-1][1] + run[-1][2] - start)
                rows = [tuple(parse(data[o - start : o - start + n]).values()) for _, o, n in run]
                return frame(rows if with_html else [(*r[:-1], None) for r in rows], RECORD)

            for x in zip(pdf.archive.tolist(), pdf.offset.tolist(), pdf.length.tolist(), strict=True):
                if run and (x[0] != run[0][0] or x[1] - run[-1][1] - run[-1][2] > GAP_BYTES or x[1] + x[2] - run[0][1] > READ_BYTES):
                    yield fetch(run)
                    run = []
                run.append(x)
            if run:
                yield fetch(run)

    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-size // READ_BYTES), int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4))
    ranges = index.select("archive", F.col("offset"), "length").repartition(tasks, "archive", F.floor(F.col("offset") / READ_BYTES))
    return ranges.sortWithinPartitions("archive", "offset").mapInPandas(read, RECORD)


def op9_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    index = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(index, folder, with_html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
