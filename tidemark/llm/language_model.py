"""Texts scored by a context-mixing language model that learns from all training documents of the corpus."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import context_mix as cm
from .common import new_folder, stored
from .files import read_file, write_file
from .words import strips

#: Tokens of a chunk, the unit that is looked up and scored at once; a longer document is a chunk of its own.
CHUNK = 6 << 20
SEEN = pa.schema([("chunk", pa.int64()), ("word", pa.binary()), ("place", pa.int32()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64())), ("file", pa.string())])
SEEN_SQL = "chunk long, word binary, place int, n long, doc_ids array<long>, held array<boolean>, sizes array<long>, bytes array<long>, file string"
LOOKED_UP = "chunk long, c binary, ranks binary"
#: Tokens that a learner has at least, where there are so many: its tables leave it full, however few they are.
LEARNER = 1 << 23
#: Ways that the learners' other values are added up in.
WAYS = 64
PARTS = "part int, slice int, offsets binary, counts binary"
PART = pa.schema([("part", pa.int32()), ("slice", pa.int32()), ("offsets", pa.binary()), ("counts", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def _chunked(size: int, folder: str):
    """Documents as places in the word list of their chunk; the end of a text is the empty word, at place 0.

    Places and words go to a file of their own; what is shuffled is its name.
    """

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        place = ids = docs = held_words = None

        def start():
            nonlocal place, ids, docs, held_words
            place, ids, docs, held_words = defaultdict(count().__next__), [], [], 0
            place[b""]

        def flush():
            nonlocal seq
            chunk, seq = (part << 32) + seq, seq + 1
            all_ids, words = np.concatenate(ids), list(place)
            known, held, sizes, lengths = (list(x) for x in zip(*docs, strict=True))
            learned = np.bincount(all_ids[np.repeat(~np.array(held, bool), sizes)], minlength=len(words))
            n = len(words)
            null = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(words, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(learned), null, pa.nulls(n, pa.list_(pa.bool_())), null, null, pa.nulls(n, pa.string())], schema=SEEN)
            data = all_ids.astype("<i4").tobytes()
            packed = zstandard.compress(len(data).to_bytes(8, "little") + data + b" ".join(words))
            one = {"chunk": chunk, "doc_ids": known, "held": held, "sizes": sizes, "bytes": lengths, "file": write_file(folder, "tokens.zst", packed)}
            yield pa.RecordBatch.from_pylist([one], SEEN)

        start()
        for batch in batches:
            for doc_id, held, text in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), batch.column("text"), strict=True):
                data = memoryview(text.as_buffer()).tobytes()
                own = [np.fromiter(map(place.__getitem__, w), np.int32, len(w)) for w in (s.split() for s in strips(data))]
                ids += [*own, np.zeros(1, np.int32)]
                docs.append((doc_id, held, sum(map(len, own)) + 1, len(data)))
                held_words += docs[-1][2]
                if held_words >= size:
                    yield from flush()
                    start()
        if docs:
            yield from flush()

    return run


def _looked_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts and ranks (-1: not in the dictionary) of a chunk's words, by place."""
    pdf = pdf.sort_values("place")
    whole = lambda name, none: pdf[name].fillna(none).to_numpy(np.int64).tobytes()
    return pd.DataFrame([(int(pdf["chunk"].iloc[0]), whole("c", 0), whole("rank", -1))], columns=[f.split()[0] for f in LOOKED_UP.split(", ")])


def _ranked(counts: DataFrame) -> DataFrame:
    """(word, c, rank): rank from 0 by falling count, then word, of words that occur twice or more; null for others.

    Ranks are places in ranges of the order, after the sizes of the ranges before; no task sees more than a range.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc("c"), "word")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = counts.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("word", "c", F.spark_partition_id().alias("part"), inside.alias("at"))
    placed = stored(placed, "ranks")
    before = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")  # one row a range
    return placed.join(F.broadcast(before), "part").select("word", "c", F.when(F.col("c") > 1, F.col("before") + F.col("at")).alias("rank"))


def _rows(batch: pa.RecordBatch):
    """One row at a time: a batch holds some chunks."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _tokens(row: dict, code: dict, folder: str) -> cm.Tokens:
    data = zstandard.decompress(read_file(folder, row["file"]))
    end = 8 + int.from_bytes(data[:8], "little")
    words, ranks = data[end:].split(b" "), np.frombuffer(row["ranks"], np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    spelled = b"".join([words[i] + b" " for i in np.flatnonzero(ranks < 0)])
    return cm.Tokens(np.frombuffer(data[8:end], "<i4"), ranks, hashes, spelled, 0, code)


def _learning(code: dict, folder: str):
    """What a task's learner has counted, in slices; its other values are part ORDERS."""

    def run(batches):
        learner = cm.Learner()
        for batch in batches:
            for row in _rows(batch):
                tokens = _tokens(row, code, folder)
                learner.learn(tokens, np.flatnonzero(np.repeat(~np.array(row["held"], bool), row["sizes"])))
        for order, n, offsets, counts in learner.slices():
            yield pa.RecordBatch.from_pylist([{"part": order, "slice": n, "offsets": offsets, "counts": counts}], PART)
        way = TaskContext.get().partitionId() % WAYS
        yield pa.RecordBatch.from_pylist([{"part": cm.ORDERS, "slice": way, "offsets": b"", "counts": learner.cells().tobytes()}], PART)

    return run


def _summed(batches):
    """Parts in order of (part, slice), added up; slices of tables are packed."""
    total, cells, at = np.zeros((cm.SLICE, 2), np.int64), np.zeros(cm.CELLS), None

    def done():
        table = cells if at[0] == cm.ORDERS else cm.packed(total)
        return pa.RecordBatch.from_pylist([{"part": at[0], "slice": at[1], "table": table.tobytes()}], pa.schema([("part", pa.int32()), ("slice", pa.int32()), ("table", pa.binary())]))

    for batch in batches:
        for row in batch.to_pylist():
            if (row["part"], row["slice"]) != at:
                if at:
                    yield done()
                at = (row["part"], row["slice"])
                total[:] = 0
                cells[:] = 0
            if at[0] == cm.ORDERS:
                cells += np.frombuffer(row["counts"], np.float64)
                continue
            places = np.frombuffer(row["offsets"], "<u2")
            width = len(row["counts"]) // len(places) // 2
            total[places] += np.frombuffer(row["counts"], f"<u{width}").reshape(-1, 2)
    if at:
        yield done()


def _scoring(model, code: dict, folder: str, n: int, v: int, once: int, twice: int):
    # left out of its own text, a word that occurs once is new and one that occurs twice occurs once
    new, single = (-np.log2(x / (once + 2 * twice)) if x else 0.0 for x in (once, 2 * twice))
    single += np.log2(max(1, once))

    def run(batches):
        scorer = cm.Scorer(*model.value)
        for batch in batches:
            for row in _rows(batch):
                tokens, sizes = _tokens(row, code, folder), np.array(row["sizes"])
                starts = np.cumsum(sizes) - sizes
                c = np.frombuffer(row["c"], np.int64)
                base = np.log10((c + 1) / (n + (v + 1)))[tokens.ids]
                path, spelling = scorer.bits(tokens)
                bits = np.add.reduceat(path + np.array([new, single, 0.0])[np.minimum(c, 2)][tokens.ids], starts)
                whole = np.add.reduceat(path + spelling, starts)
                out = [row["doc_ids"], row["held"], sizes, np.add.reduceat((c > 0)[tokens.ids].astype(np.int64), starts), np.full(len(sizes), n), np.add.reduceat(base, starts), bits * -np.log10(2), whole / (np.array(row["bytes"]) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, SCORES, strict=True)], schema=SCORES)

    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A-Z are lower-cased; tokens are the words between white space (ASCII), then an end. base_score sums
    log10((c + 1) / (N + V + 1)) over tokens: c, N and V count the tokens of documents that are not held out. score is
    the log10 probability of the same events (each known word, or a new one) under the mix of context_mix, which learns
    from the same documents: behind its escape, words that occur once share what twice the words that occur twice have
    of them and those that occur once, and new ones have the rest. bits_per_byte counts the bits of all text, spellings
    in place of such shares, and divides by the bytes of the text and its end.

    A null text is empty (its end alone), a null held_out is false, rows that repeat an id or a text count each, ids may
    be null; an empty table gives an empty result; other columns are ignored.

    Texts are cut once, into chunks with word lists of their own; counts are joined to those lists, not to tokens, so no
    vocabulary is broadcast. Tasks learn online from their chunks; their tables are added slot by slot (2**BITS slots
    an order at every size of the corpus, 13 MB to broadcast), their weights are averaged by use.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    folder = new_folder(docs.sparkSession, "tokens")
    first = stored(rows.mapInArrow(_chunked(chunk, folder), SEEN_SQL), "chunks")
    seen = first.where("word is not null").select("chunk", "word", "place", "n")
    counts = stored(seen.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    n, v, once, twice = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    ranked = stored(_ranked(counts), "ranked")
    mass = ranked.where("rank is not null").groupBy((F.length(F.bin(F.col("rank") + 1)) - 1).alias("k")).agg(F.sum("c").alias("c"))  # at most 63 rows
    code = cm.huffman({cm.ESCAPE: max(1, once)} | {r["k"]: r["c"] for r in mass.collect()})

    words = seen.select("chunk", "place", "word").join(ranked, "word", "left").select("chunk", "place", "c", "rank")
    found = words.groupBy("chunk").applyInPandas(_looked_up, LOOKED_UP)
    coded = stored(first.where("file is not null").select("chunk", "doc_ids", "held", "sizes", "bytes", "file").join(found, "chunk"), "coded")

    tables, values = np.tile(cm.packed(np.zeros((1, 2), np.int64)), (cm.ORDERS, 1 << cm.BITS)), np.zeros(cm.CELLS)
    learned = coded.select("held", "sizes", "file", "ranks").coalesce(max(1, -(-n // LEARNER))).mapInArrow(_learning(code, folder), PARTS)
    slices = learned.repartition("part", "slice").sortWithinPartitions("part", "slice")
    for r in slices.mapInArrow(_summed, "part int, slice int, table binary").collect():  # ORDERS * 2**BITS slots of two bytes
        if r["part"] == cm.ORDERS:
            values += np.frombuffer(r["table"], np.float64)
        else:
            tables[r["part"], r["slice"] * cm.SLICE : (r["slice"] + 1) * cm.SLICE] = np.frombuffer(r["table"], "<u2")
    model = sc.broadcast((tables, values))
    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    return coded.mapInArrow(_scoring(model, code, folder, n, v, once, twice), ", ".join(f"{f.name} {kinds[f.type]}" for f in SCORES)).withColumnRenamed("doc_id", id_col)


def op12_context_mixing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose crc32(doc_id as text) mod 7 is 2 are held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
