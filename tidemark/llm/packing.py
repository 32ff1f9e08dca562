"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .frames import frame
from .tokens import memo

WINDOW = 4096
END_ID = 2
#: Ids that a shard of the index holds on average; its documents are packed by one task.
SHARD_IDS = 4_000_000
#: Documents, drawn at random, that the tree of shards is fitted on; those of them that a leaf holds at least.
FIT_DOCS, LEAF_DOCS = 4096, 32
#: Numbers of a document's sketch, and parts that each leaf is cut into.
DIMENSIONS, PARTS = 64, 64
#: Terms that more than one in so many texts of a shard hold are kept as rows of scores instead of lists.
DENSE = 8
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def directions(vocabulary: int) -> np.ndarray:
    """Random directions of the ids: sums of them keep the angles between texts, up to chance."""
    return np.random.default_rng(11).standard_normal((vocabulary, DIMENSIONS), dtype=np.float32)


def sketch(terms: np.ndarray, idf: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """A text's weighted terms, brought down to DIMENSIONS numbers of length 1."""
    v = idf[terms] @ ways[terms]
    return v / max(1e-9, float(np.sqrt(v @ v)))


def distinct(ids: bytes, kind: np.dtype) -> np.ndarray:
    """The different ids, ascending."""
    terms = np.sort(np.frombuffer(ids, kind), kind="stable")  # 16 bits: by radix
    return terms[np.concatenate([[True], terms[1:] != terms[:-1]])[: len(terms)]]


class Tree:
    """Cuts sketches in halves, each time at the median along the direction in which they differ most."""

    def __init__(self, x: np.ndarray, depth: int):
        self.depth = depth
        self.ways, self.cuts = np.zeros((1 << depth, DIMENSIONS), np.float32), np.zeros(1 << depth, np.float32)
        node = np.ones(len(x), np.int64)
        for level in range(depth):
            for k in range(1 << level, 2 << level):
                own = x[node == k]
                if len(own) > 1:
                    _, _, ways = np.linalg.svd(own - own.mean(axis=0), full_matrices=False)
                    self.ways[k] = ways[0]
                    self.cuts[k] = np.median(own @ self.ways[k])
            node = self._down(x, node)

    def _down(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        return 2 * node + (np.einsum("ij,ij->i", x, self.ways[node]) > self.cuts[node])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = self._down(x, node)
        return node - (1 << self.depth)


def fit_tree(texts: DataFrame, n: int, tokenizer: str, vocabulary: int) -> tuple[Tree, np.ndarray]:
    """A tree of shards, and the term weights of its sketches, from about FIT_DOCS texts (at most twice as many)."""

    def terms(batches):
        coder = memo(tokenizer, False)
        for pdf in batches:
            yield pd.DataFrame({"terms": [distinct(ids, coder.kind).astype("<u4").tobytes() for ids in coder.encode_all(pdf.text.tolist())]})

    some = texts.sample(min(1.0, FIT_DOCS / max(1, n)), 17).limit(2 * FIT_DOCS)
    found = [np.frombuffer(r.terms, "<u4") for r in some.select("text").mapInPandas(terms, "terms binary").collect()]
    frequency = np.bincount(np.concatenate([np.empty(0, np.int64), *found]).astype(np.int64), minlength=vocabulary)
    idf = np.log1p((len(found) + 0.5) / (frequency + 0.5)).astype(np.float32)
    x = np.array([sketch(t, idf, directions(vocabulary)) for t in found], np.float32).reshape(-1, DIMENSIONS)
    return Tree(x, max(0, (len(x) // LEAF_DOCS).bit_length() - 1)), idf


def tokenised(texts: DataFrame, tokenizer: str, vocabulary: int, tree: Tree, weights: np.ndarray) -> DataFrame:
    """(doc_id, ids, bucket, row, counts): little-endian unsigned ids with the end id of each document.

    bucket: the leaf of the text's sketch and, in it, a part by the smallest hash of its ids, which texts that share
    most ids have in common. row is a number of its own. The last row of a task has no ids but, in counts, how many of
    its documents hold each id of the vocabulary.
    """
    sent = texts.sparkSession.sparkContext.broadcast((tree, weights))

    def encode(batches):
        coder, ways = memo(tokenizer, False), directions(vocabulary)
        tree, weights = sent.value
        end = np.array([END_ID], coder.kind).tobytes()
        hashes = np.random.default_rng(5).permutation(vocabulary)
        counts, row = np.zeros(vocabulary, "<i8"), TaskContext.get().partitionId() << 40
        for pdf in batches:
            found = [ids + end for ids in coder.encode_all(pdf.text.tolist())]
            x, part = np.empty((len(found), DIMENSIONS), np.float32), np.empty(len(found), np.int64)
            for k, ids in enumerate(found):
                terms = distinct(ids, coder.kind)
                counts[terms] += 1
                x[k], part[k] = sketch(terms, weights, ways), hashes[terms].min() % PARTS
            yield pd.DataFrame({"doc_id": pdf.id, "ids": found, "bucket": tree.leaf(x) * PARTS + part, "row": row + np.arange(len(found)), "counts": None})
            row += len(found)
        yield pd.DataFrame({"doc_id": [None], "ids": [None], "bucket": [-1], "row": [-1], "counts": [counts.tobytes()]})

    return stored(texts.mapInPandas(encode, "doc_id string, ids binary, bucket long, row long, counts binary"), "ids")


def document_frequency(counts: DataFrame, vocabulary: int) -> np.ndarray:
    """Over all documents, how many hold each id; as many numbers as the vocabulary has ids reach the driver."""

    def split(batches):
        for pdf in batches:
            for data in pdf.counts:
                n = np.frombuffer(data, "<i8")
                yield pd.DataFrame({"id": np.flatnonzero(n), "n": n[n > 0]})

    out = np.zeros(vocabulary, np.int64)
    for r in counts.mapInPandas(split, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def deal(sizes: dict[int, int], shard_ids: int) -> tuple[list[tuple[int, int, int]], int]:
    """(bucket, first shard, shards) of each bucket by its ids, and how many shards there are.

    Buckets that follow each other share a shard of about shard_ids ids; a larger one is dealt over several.
    """
    out, shard, held = [], 0, 0
    for bucket, n in sorted(sizes.items()):
        if held and held + n > shard_ids * 1.2:
            shard, held = shard + 1, 0
        several = max(1, -(-n // int(shard_ids * 1.2)))
        out.append((bucket, shard, several))
        held += n
        if several > 1:
            shard, held = shard + several, 0
    return out, shard + (held > 0)


class Index:
    """BM25 postings of a shard's texts; document frequencies and the mean length are those of the whole corpus."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = n = len(texts)
        found = [np.unique(t, return_counts=True) for t in texts]
        self.own = [t for t, _ in found]
        terms, counts = (np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]).astype(np.int64) for k in (0, 1))
        text = np.repeat(np.arange(n), [len(t) for t in self.own])
        shape = (K1 * (1 - B + B * np.maximum(1, [len(t) for t in texts]) / mean)).astype(np.float32) if n else np.empty(0)
        order = np.argsort(terms, kind="stable")
        self.text = text[order].astype(np.int32)
        self.score = (idf[terms] * counts * (K1 + 1) / (counts + shape[text])).astype(np.float32)[order]
        self.ends = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        often = np.flatnonzero(np.diff(self.ends) * DENSE > n)
        self.dense = np.full(len(idf), -1)
        self.dense[often] = np.arange(len(often))
        self.table = np.zeros((len(often), n), np.float32)
        for k, t in enumerate(often):
            s = slice(self.ends[t], self.ends[t + 1])
            self.table[k, self.text[s]] = self.score[s]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every text for all terms of the seed."""
        terms = self.own[seed]
        rows = self.dense[terms]
        on = np.zeros(len(self.table), np.float32)
        on[rows[rows >= 0]] = 1
        terms = terms[rows < 0]
        counts = self.ends[terms + 1] - self.ends[terms]
        at = np.repeat(self.ends[terms] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return on @ self.table + np.bincount(self.text[at], self.score[at], self.n).astype(np.float32)


def ranked(scores: np.ndarray, unused: np.ndarray):
    """Unused texts by descending score, equal scores by number, in blocks; those without a score aren't neighbours."""
    some = np.flatnonzero((scores > 0) & unused)
    size = 32
    while len(some):
        least = np.partition(scores[some], -size)[-size] if len(some) > size else 0.0
        best = some[scores[some] >= least]
        yield best[np.lexsort((best, -scores[best]))].tolist()
        some, size = some[scores[some] < least], 8 * size


def pack_shard(texts: list[np.ndarray], idf: np.ndarray, window: int = WINDOW, mean: float | None = None) -> list[tuple]:
    """(document number, start, length, sequence, offset): every id of the texts in exactly one piece.

    Whole windows of long texts are sequences of their own. The rest of the longest unused text seeds a window; its
    unused neighbours fill it by descending score, and what the last one has left over stays unused. Only where no
    unused text shares a term with the seed, the next unused texts serve. So only the last sequence isn't full.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    pieces = [(i, at, window) for i, n in enumerate(lengths.tolist()) for at in range(0, n - window + 1, window)]
    pieces = [(*p, q, 0) for q, p in enumerate(pieces)]
    start = lengths // window * window
    left = lengths - start
    index = Index([t[s:] for t, s in zip(texts, start, strict=True)], idf, mean or max(1.0, float(np.maximum(1, left).mean() if len(left) else 1)))
    order, turn, unused, sequence = np.argsort(-left, kind="stable").tolist(), 0, left > 0, len(pieces)
    offset = 0

    def place(i: int) -> bool:
        nonlocal offset
        n = int(min(left[i], window - offset))
        pieces.append((i, int(lengths[i] - left[i]), n, sequence, offset))
        left[i] -= n
        unused[i] = left[i] > 0
        offset += n
        return offset == window

    while True:
        while turn < len(order) and not unused[order[turn]]:
            turn += 1
        if turn == len(order):
            return pieces
        offset = 0
        if not place(order[turn]):
            neighbours = (i for block in ranked(index.scores(order[turn]), unused) for i in block)
            if not any(map(place, neighbours)):
                any(place(i) for i in order[turn:] if unused[i])
        sequence += 1


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pieces of all documents in sequences of at most window ids, one row each (see PIECES).

    A document is its ids and an end id. The index is sharded by a lexical key, so that neighbours meet: a tree, fitted
    on a sample of FIT_DOCS documents, cuts weighted term sketches in halves, its leaves are cut by a MinHash of the
    ids, and consecutive buckets share a shard of about shard_ids ids. A larger bucket, such as a group of copies, is
    dealt over several shards by row numbers. Each shard has an inverted index of all its documents with the document
    frequencies and mean length of the whole corpus; a seed asks its shard by all its terms. A sequence shorter than
    window is the last of its shard and is padded, unless its length is a power of two. Null texts are an end id only,
    null ids stay, rows that repeat an id are packed one by one; an empty table gives no pieces; other columns are
    ignored.
    """
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if vocabulary <= 65536 else 4
    texts = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = tokenised(texts, tokenizer, vocabulary, *fit_tree(texts, docs.count(), tokenizer, vocabulary))
    ids = found.where("ids is not null").select("doc_id", "ids", "bucket", "row", (F.octet_length("ids") / width).cast("long").alias("n"))
    sizes = {r.bucket: r for r in ids.groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("n").alias("ids"), F.sum(F.greatest(F.lit(1), F.col("n") % window)).alias("rest")).collect()}
    dealt, shards = deal({b: r.ids for b, r in sizes.items()}, shard_ids)
    n = sum(r.docs for r in sizes.values())
    frequency = document_frequency(found.where("counts is not null").select("counts"), vocabulary)
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    sent = ids.sparkSession.sparkContext.broadcast((idf, sum(r.rest for r in sizes.values()) / max(1, n)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "ids"], kind="stable")
        texts = [np.frombuffer(x, f"<u{width}") for x in pdf.ids]
        doc_ids, shard = pdf.key.tolist(), int(pdf["shard"].iloc[0])
        rows = []
        idf, mean = sent.value
        for i, start, length, sequence, offset in pack_shard(texts, idf, window, mean):
            crc = zlib.crc32(texts[i][start : start + length].astype("<u4").tobytes())
            rows.append((None if doc_ids[i] == "" else int(doc_ids[i]), start, length, crc, len(texts[i]), (shard << 32) + sequence, offset))
        return frame(rows, PIECES)

    buckets = ids.sparkSession.createDataFrame(dealt, "bucket long, first int, several int")  # PARTS a leaf at most
    placed = ids.join(F.broadcast(buckets), "bucket").select(F.coalesce("doc_id", F.lit("")).alias("key"), "ids", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("several"))).cast("int").alias("shard"))
    return placed.repartitionByRange(max(1, shards), "shard").groupBy("shard").applyInPandas(pack, PIECES)


def op2_bm25_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
