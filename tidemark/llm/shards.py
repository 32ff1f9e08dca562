"""Token files: shards of range-coded ids with a directory of documents and of checksummed blocks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, stored
from .files import read_range, write_file
from .frames import frame
from .range_coder import BLOCK, LANES, decode_blocks, encode_blocks
from .tokens import memo

END_ID = 2
MAGIC = b"TMRC0003"
#: Ids after which a task begins the next shard; a longer document is a shard of its own.
SHARD_IDS = BLOCK * LANES
#: Lanes that a short shard is cut into at least (down to blocks of MIN_BLOCK ids), as lanes are coded together.
MIN_LANES, MIN_BLOCK = 256, 1024

_HEAD = struct.Struct("<8sQQQII")  # magic, documents, blocks, ids, bytes of the directory, its crc32
SHARDS = "part long, seq long, file string, bytes long, docs long, ids long"


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard: header, compressed directory (presence, id and length of documents; length, crc32, bytes of blocks), payloads."""
    block = int(min(BLOCK, max(MIN_BLOCK, -(-len(ids) // MIN_LANES))))
    blocks = encode_blocks(ids, block)
    parts = [
        np.array([x is not None for x in doc_ids], "<u1"),
        np.array([x or 0 for x in doc_ids], "<i8"),
        np.array(lengths, "<u8"),
        *(np.array([b[k] if k < 2 else len(b[2]) for b in blocks], "<u4") for k in range(3)),
    ]
    directory = zlib.compress(b"".join(p.tobytes() for p in parts), 6)
    head = _HEAD.pack(MAGIC, len(doc_ids), len(blocks), len(ids), len(directory), zlib.crc32(directory))
    return b"".join([head, directory, *(b[2] for b in blocks)])


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a shard; anything damaged raises."""
    magic, docs, blocks, n_ids, size, crc = _HEAD.unpack_from(data)
    directory = data[_HEAD.size : _HEAD.size + size]
    if magic != MAGIC or zlib.crc32(directory) != crc:
        raise ValueError("the shard's directory is damaged")
    raw, at = zlib.decompress(directory), 0
    out = []
    for kind, n in (("<u1", docs), ("<i8", docs), ("<u8", docs), ("<u4", blocks), ("<u4", blocks), ("<u4", blocks)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    known, doc_ids, lengths, sizes, crcs, widths = out
    ends = _HEAD.size + size + np.cumsum(widths, dtype=np.int64)
    ids = decode_blocks([(int(n), int(c), data[e - w : e]) for n, c, e, w in zip(sizes, crcs, ends.tolist(), widths.tolist(), strict=True)])
    if len(ids) != n_ids or lengths.sum() != n_ids:
        raise ValueError("the shard's lengths are wrong")
    return [int(d) if k else None for k, d in zip(known, doc_ids, strict=True)], lengths.astype(np.int64), ids


def write_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all texts with an end id each, writes them in ascending id order and returns the table of shards.

    Nulls: a null text is an empty one (its end id only), null ids come first. Rows that repeat an id stand in the order
    of a hash of their text. Rows are dealt out by ranges of (id, hash), so no task holds more than its range, and a
    shard is written as soon as it is full. An empty table gives no shard. Other columns are ignored.
    """

    def write(batches):
        part, seq = TaskContext.get().partitionId(), 0
        coder = memo(tokenizer, True)
        doc_ids, pieces, held = [], [], 0

        def flush():
            data = pack(doc_ids, [len(p) // coder.bytes_each for p in pieces], np.frombuffer(b"".join(pieces), coder.kind))
            return frame([(part, seq, write_file(folder, "ids.tmrc", data), len(data), len(doc_ids), held)], SHARDS)

        end = np.array([END_ID], coder.kind).tobytes()
        for pdf in batches:
            for i, ids in zip(pdf.id.tolist(), coder.encode_all(pdf.text.tolist()), strict=True):
                ids += end
                n = len(ids) // coder.bytes_each
                if held and held + n > SHARD_IDS:
                    yield flush()
                    doc_ids, pieces, held, seq = [], [], 0, seq + 1
                doc_ids.append(None if i is None else int(i))
                pieces.append(ids)
                held += n
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("n"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "n", "h").sortWithinPartitions("n", "h").select(F.col("n").cast("string").alias("id"), "text")
    return stored(rows.mapInPandas(write, SHARDS), "shards")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the shards; start counts the ids before it.

    ids holds little-endian unsigned 32-bit integers. Shards are few (SHARD_IDS ids each), so their prefix sum is taken
    over their table; each is read and decoded in a task of its own.
    """
    order = Window.orderBy("part", "seq")
    placed = shards.withColumn("first", F.sum("ids").over(order) - F.col("ids")).withColumn("turn", F.row_number().over(order))

    def read(batches):
        for pdf in batches:
            for name, size, first in zip(pdf.file, pdf.bytes, pdf["first"], strict=True):
                doc_ids, lengths, ids = unpack(read_range(folder, name, 0, int(size)))
                ends = np.cumsum(lengths)
                for k in range(0, len(doc_ids), 512):
                    rows = []
                    for i in range(k, min(k + 512, len(doc_ids))):
                        own = ids[ends[i] - lengths[i] : ends[i]].tobytes()
                        rows.append((doc_ids[i], int(first + ends[i] - lengths[i]), int(lengths[i]), zlib.crc32(own), own))
                    yield frame(rows, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")

    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = placed.repartitionByRange(max(parts, 200), "turn")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op3_range_coded_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "ids")
    shards = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(shards, folder).drop("ids")
