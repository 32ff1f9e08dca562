"""A training corpus from documents: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.lines import dedup_lines
from tidemark.llm.minhash import one_of_each, text_hash
from tidemark.llm.mixing import mix_sources, n_words
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import fit_chain, with_verdict


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the line field keep; a null or empty text fails. Repeated rows are judged alike."""
    chain = fit_chain(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "verdict"
    while name in docs.columns:
        name += "_"
    return with_verdict(docs, chain, name).where(F.col(name)["kept"]).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated windows of lines; n_chars follows the text.

    A null text stays null, one whose lines all go becomes empty; rows equal in id and text count as one occurrence.
    """
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Rows without an id or a word stay; of rows that repeat an id each is judged by its own text, and of rows equal in
    id and text one stays. An empty table gives no rows.
    """
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times.

    A null text, or one without a word, has no size and isn't taken; a null source is a source of its own. Of rows
    equal in id and text each counts by itself. An empty table gives no rows.
    """
    key = [F.col("doc_id").alias("mix_id"), text_hash(F.col("text")).alias("mix_text")]
    sized = docs.select(*key, n_words(F.col("text")).alias("words"), "source")
    taken = mix_sources(sized, "mix_id", F.col("words"), F.array("source"), keep=("mix_text",))
    times = taken.groupBy("mix_id", "mix_text").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("taken") > 0, F.col("taken") / F.col("size"))).cast("long").alias("times"))
    times = stored(times.where("times > 0"), "times")
    inner = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("own_id"), text_hash(F.col("text")).alias("own_text"))
    same = F.col("own_id").eqNullSafe(F.col("mix_id")) & (F.col("own_text") == F.col("mix_text"))
    found = inner.join(times, same).select("doc", F.floor(F.col("times") / F.col("rows")).alias("n"))
    rest = inner.join(times.where("times % rows > 0"), same).dropDuplicates(["own_id", "own_text"]).select("doc", (F.col("times") % F.col("rows")).alias("n"))
    return found.unionAll(rest).where("n > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids; a null text is an end id only, and repeated rows are packed one by one."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix), ("packing", packing)]

#: The line field, the near-duplicate join and the packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
