"""Snapshots of collections as JSON lines with a manifest, change logs, and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"


def _fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, sha): SHA-256 over the sorted SHA-256 of the collection's files. Files are hashed by tasks."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.sha2("content", 256).alias("h"), "length")
    return f.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("sha"))


def save_snapshot(collections: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each collection as JSON lines under path and a manifest with counts and checksums; returns the manifest."""
    spark = next(iter(collections.values())).sparkSession
    rows = []
    for name, df in sorted(collections.items()):
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")
        n = spark.read.text(f"{path}/{name}").agg(F.count("*").alias("rows"))
        rows.append(_fingerprint(spark, f"{path}/{name}").join(n).select(F.lit(name).alias("collection"), F.lit(VERSION).alias("version"), "rows", "files", "bytes", "sha"))
    reduce(DataFrame.unionByName, rows).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("collection string, version string, rows long, files long, bytes long, sha string").json(f"{path}/manifest")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(collection, intact) for every collection of the manifest."""
    known = manifest(spark, path)
    now = [_fingerprint(spark, f"{path}/{r.collection}").select(F.lit(r.collection).alias("collection"), F.col("sha").alias("now")) for r in known.select("collection").collect()]
    return known.join(reduce(DataFrame.unionByName, now), "collection").select("collection", (F.col("sha") == F.col("now")).alias("intact"))


def load_snapshot(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The collections under their schemas; a damaged one or another version raises."""
    bad = [r.collection for r in verify(spark, path).where("not intact").collect()]
    bad += [r.collection for r in manifest(spark, path).where(F.col("version") != VERSION).collect()]
    if bad:
        raise ValueError(f"snapshot collections {bad} don't match the manifest")
    return {name: spark.read.schema(s).json(f"{path}/{name}") for name, s in schemas.items()}


def append_changes(changes: DataFrame, path: str) -> None:
    """Appends a batch to the change log."""
    changes.write.mode("append").json(path)


def read_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same log as a stream."""
    return spark.readStream.schema(schema).json(path)


def compact(spark: SparkSession, log: str, into: str, schema: str, key: str, order: list[str]) -> DataFrame:
    """Writes the state after the log as Parquet and returns it."""
    from .mapping import latest_changes

    latest_changes(read_changes(spark, log, schema), key, order).write.mode("overwrite").parquet(into)
    return spark.read.parquet(into)


def export_json(collections: dict[str, DataFrame], path: str) -> None:
    """Collections as JSON documents {collection: [records]}, as many as their tasks; import_json reads them together."""
    def documents(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.to_json(F.struct(F.array(F.struct(*df.columns)).alias(name)), {"ignoreNullFields": "false"}).alias("value"))

    reduce(DataFrame.unionByName, [documents(n, df) for n, df in sorted(collections.items())]).write.mode("overwrite").text(path)


def import_json(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """One collection of JSON documents, a line or a file each, that hold an array of records for each."""
    docs = spark.read.json(path)
    if "_corrupt_record" in docs.columns:
        docs = spark.read.option("multiLine", True).json(path)
    return docs.select(F.explode(collection).alias("r")).select("r.*")


def export_json_ld(df: DataFrame, id_col: str, type_col: str, path: str) -> None:
    """Rows as nodes: @id, @type and the rest, one document a line."""
    rest = [c for c in df.columns if c not in (id_col, type_col)]
    df.select(F.struct(F.col(id_col).alias("@id"), F.col(type_col).alias("@type"), *rest).alias("n")).select(F.to_json("n").alias("value")).write.mode("overwrite").text(path)


def import_json_ld(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nodes from lines, each a node or a document with a @graph of nodes."""
    raw = spark.read.text(path).select(F.parse_json("value").alias("v"))
    graph = F.try_variant_get("v", "$['@graph']", "array<variant>")
    nodes = raw.select(F.explode(F.coalesce(graph, F.array("v"))).alias("n"))
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return nodes.select(*(F.try_variant_get("n", f"$['{name.strip('`')}']", kind).alias(name.strip("`").lstrip("@")) for name, kind in fields))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def prometheus(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """(line): text exposition of samples."""
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels))
    return df.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A generic file as (line, content), lines counted from 1 within each file."""
    from pyspark.sql import Window

    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    return t.select("file", F.row_number().over(Window.partitionBy("file").orderBy("at")).alias("line"), F.col("value").alias("content"))
