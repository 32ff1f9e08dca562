"""Line dedup over overlapping windows of three lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Consecutive lines in a window.
WINDOW = 3


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of each text, and a key of the row that is never null: a repeated id with another text is another row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return d.select(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast(d.schema["doc_id"].dataType)).alias("id"), F.xxhash64("text").alias("text")).alias("row"), F.split("text", "\n", -1).alias("lines"))


def _windows(docs: DataFrame) -> DataFrame:
    """(row, pos, key) of each window; two hashes of 64 bits each stand for the three lines."""
    hashed = docs.where(F.size("lines") >= WINDOW).select("row", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(F.lit(7), x)).alias("b"))
    at = lambda name: [F.col(name)[F.col("pos") + k] for k in range(WINDOW)]
    placed = hashed.select("row", "a", "b", F.explode(F.sequence(F.lit(0), F.size("a") - WINDOW)).alias("pos"))
    return placed.select("row", "pos", F.struct(F.xxhash64(*at("a")).alias("a"), F.xxhash64(*at("b")).alias("b")).alias("key"))


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, positions): where each text has a window of lines that occurred before, in the order of (id, position).

    Keys are counted with map-side combining, so a hot window is one row a task before the shuffle; only keys that
    occur twice are joined back, and the join may be split where one key is hot.
    """
    windows = _windows(_keyed(docs, id_col, text_col))
    twice = windows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first")).where("n > 1").select("key", "first")
    later = windows.join(twice, "key").where(F.struct("row", "pos") != F.col("first"))
    # a set: rows equal in id and text share their positions, however many they are
    return later.groupBy("row").agg(F.collect_set("pos").alias("positions"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later occurrences of repeated windows taken out of text_col, and n_lines and n_removed added.

    A line goes if any window that covers it occurred before; the covered positions of all such windows are merged.
    Lines are cut at line feeds and compared exactly. Texts of fewer than three lines stay, a null text stays null
    (0 lines), a text whose lines all go becomes empty. Of rows with the same id and another text the smaller hash of
    the text comes first; rows equal in id and text count as one occurrence. Null ids come first. Other columns pass
    through; columns named n_lines or n_removed are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    d = docs.select(*keep)
    key = F.struct(F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(id_col), F.lit(0).cast(d.schema[id_col].dataType)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text"))
    d = d.select(F.struct(*keep).alias("doc"), key.alias("row"), F.split(F.col(text_col).cast("string"), "\n", -1).alias("lines"))
    joined = d.join(later_windows(docs, id_col, text_col), "row", "left")
    covered = F.flatten(F.transform("positions", lambda p: F.sequence(p, p + (WINDOW - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    text = F.when(F.col("positions").isNull(), F.col(f"doc.{text_col}")).otherwise(F.array_join(F.transform("kept", lambda i: F.col("lines")[i]), "\n"))
    joined = joined.withColumn("kept", F.when(F.col("positions").isNotNull(), kept))
    lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    removed = F.when(F.col("positions").isNull(), 0).otherwise(F.size("lines") - F.size("kept"))
    columns = [text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in keep]
    return joined.select(*columns, lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def op5_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP5_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 0))) AS pos FROM l),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY ls[pos + 1], ls[pos + 2], ls[pos + 3] ORDER BY doc_id, pos) AS rn FROM w),
gone AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM k WHERE rn > 1),
lines AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM l),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN ls IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - coalesce(n, 0), 0)::BIGINT AS n_removed
FROM l LEFT JOIN kept USING (doc_id)
"""
