"""Near-duplicate texts: DartMinHash signatures, banded candidates, exact similarity, components."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import darts
from .common import stored
from .components import connected_components
from .frames import frame

SIMILARITY = 0.8
#: Bands whose buckets are joined by hubs before all bands are looked through.
FIRST_BANDS = 3
#: Members and bytes of shingles of a block of a group that is looked through; a pair of blocks is one unit of work.
BLOCK, BLOCK_BYTES = 256, 2 << 20
#: Below this estimate from COORDINATES signature bytes a pair of similarity SIMILARITY has a chance of 5 in a million.
ESTIMATE = 0.62


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, cut at space and \\t..\\r."""
    return text.lower().encode().split() if text else []


def _digest(words: list[bytes]) -> bytes | None:
    return hashlib.sha1(b" ".join(words)).digest() if words else None


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sha, digest, bands, sig) of every row; those without an id or a word have no digest and no bands."""

    @F.pandas_udf("digest binary, bands array<long>, sig binary")
    def sign(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = words_of(t)
            sig = darts.signature(*darts.shingles(words)) if words else None
            rows.append((_digest(words), darts.bands(sig) if words else None, darts.short(sig) if words else None))
        return pd.DataFrame(rows, columns=["digest", "bands", "sig"])

    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("sha"), F.when(F.col(id_col).isNotNull(), text).alias("text"))
    return stored(d.select("doc_id", "sha", sign("text").alias("s")).select("doc_id", "sha", "s.*"), "signed")


def text_hash(text):
    """What tells rows with one id apart; a null text has none."""
    return F.sha1(text.cast("binary"))


def _shingles_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the representatives in wanted (node, rep, digest): their hashed shingles and weights."""
    d = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).where("rep is not null and text is not null")

    @F.pandas_udf("digest binary, shingles binary")
    def packed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = words_of(t)
            rows.append((_digest(words), darts.packed(*darts.shingles(words))))
        return pd.DataFrame(rows, columns=["digest", "shingles"])

    packed = packed.asNondeterministic()  # else the join's test of the digest runs it on all rows as well
    wanted = stored(wanted, "wanted")  # its size is known then: where it is small, no text is shuffled
    d = d.join(wanted.select("rep").distinct(), "rep", "left_semi").select("rep", packed("text").alias("p")).select("rep", "p.*")
    return stored(d.join(wanted, ["rep", "digest"]).select("node", "shingles").dropDuplicates(["node"]), "shingles")


def _linked(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose weighted Jaccard similarity, computed in full, reaches the threshold."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            small, large = sorted((darts.unpacked(a), darts.unpacked(b)), key=lambda v: int(v[1].sum()))
            out.append(small[1].sum() >= threshold * large[1].sum() and darts.similarities(large, [small])[0] >= threshold)
        return pd.Series(out, dtype=bool)

    both = pairs.join(shingles.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(shingles.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return stored(both.where(near("x", "y")).select("a", "b"), "near")


def _to_hubs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of the first bands' buckets with up to three hubs of each, the same ones in most buckets."""
    member = nodes.select("node", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("key"))
    turned = F.col("node").bitwiseXOR(F.lit(0x155555555))
    hubs = member.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.min(turned).bitwiseXOR(F.lit(0x155555555)).alias("c")).where("a < b")
    met = member.join(hubs.select("key", F.array_distinct(F.array("a", "b", "c")).alias("hubs")), "key").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("hubs"))).alias("hubs"))
    pairs = met.select(F.col("node").alias("a"), F.explode("hubs").alias("b")).where("a != b")
    return stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")


def _groups(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(host, node, part, outside): what is left to look through once parts are known, a row per group and member.

    In a bucket that holds several parts, its most frequent one is the host of the members of all others. A host's
    group is its own members and, outside, those that it hosts. So any two members of a bucket that are in different
    parts meet in a group where at least one of them is outside.
    """
    labelled = stored(nodes.join(parts.select(F.col("id").alias("node"), "component"), "node", "left").select("node", F.coalesce("component", "node").alias("part"), "bands"), "parts")
    member = labelled.select("node", "part", F.explode("bands").alias("key"))
    top = member.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "part")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.part").alias("host"))
    outside = stored(member.join(top, (member.key == top.key) & (member.part != top.host)).select("host", "node", "part").distinct(), "outside")
    hosts = outside.select(F.col("host").alias("part")).distinct()
    inside = labelled.join(hosts, "part").select(F.col("part").alias("host"), "node", "part", F.lit(False).alias("outside"))
    return outside.withColumn("outside", F.lit(True)).unionByName(inside)


def _look_through(groups: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (a, b) between parts, from the pairs of each group's blocks of which one holds members from outside."""
    sizes = groups.groupBy("host", "outside").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum(F.octet_length("shingles")) / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    placed = groups.join(sizes, ["host", "outside"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    values = ["node", "part", "sig", "shingles"]
    packed = placed.groupBy("host", "outside", "block").agg(F.collect_list(F.struct(*values)).alias("rows"))
    counts = sizes.groupBy("host").agg(F.max(F.when(F.col("outside"), F.col("blocks"))).alias("out_blocks"))
    left = packed.join(counts, "host").select("host", "outside", "block", "rows", F.explode(F.expr("if(outside, sequence(block, out_blocks - 1), sequence(0, out_blocks - 1))")).alias("other"))
    right = packed.where("outside").select("host", F.col("block").alias("other"), F.col("rows").alias("others"))
    both = left.join(right, ["host", "other"]).select("rows", "others", (F.col("outside") & (F.col("block") == F.col("other"))).alias("same"))

    def run(batches):
        for pdf in batches:
            for rows, others, same in zip(pdf["rows"], pdf["others"], pdf["same"], strict=True):
                yield frame(_links_of(rows, others, bool(same), threshold), "a long, b long")

    return stored(both.mapInPandas(run, "a long, b long"), "near")


def _links_of(rows, others, same: bool, threshold: float) -> list[tuple]:
    """Links between parts that members of two blocks make; between parts that are joined already none is looked for."""
    sigs = lambda block: np.frombuffer(b"".join(r["sig"] for r in block), np.uint8).reshape(len(block), -1)
    mine, theirs = sigs(rows), sigs(others)
    part = [np.array([r["part"] for r in block], np.int64) for block in (rows, others)]
    theirs_own = [None] * len(others)
    root: dict[int, int] = {}

    def find(p):
        while p in root:
            p = root[p]
        return p

    out = []
    for i, r in enumerate(rows):
        agree = ((mine[i] == theirs).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
        agree[part[1] == part[0][i]] = -1
        if same:
            agree[: i + 1] = -1
        some = np.flatnonzero(agree >= ESTIMATE)
        some = some[np.argsort(-agree[some], kind="stable")]
        own = darts.unpacked(r["shingles"]) if len(some) else None
        for k in range(0, len(some), 32):
            left = [j for j in some[k : k + 32].tolist() if find(int(part[0][i])) != find(int(part[1][j]))]
            for j in left:
                if theirs_own[j] is None:
                    theirs_own[j] = darts.unpacked(others[j]["shingles"])
            near = darts.similarities(own, [theirs_own[j] for j in left]) >= threshold if left else ()
            for j in (j for j, yes in zip(left, near, strict=True) if yes):
                p, q = find(int(part[0][i])), find(int(part[1][j]))
                if p != q:
                    root[p] = q
                    out.append((int(r["node"]), int(others[j]["node"])))
    return out


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, sha, class_id, kept, alone) of each row: see near_classes; sha tells rows with one id apart.

    kept: the row stands for its class, having its smallest id and, of the texts with that id, the one whose digest and
    then hash is smallest. Only rows equal in id and text share a kept row. alone: without an id or a word.
    """
    signed = _signed(docs, id_col, text_col)
    nodes = signed.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "sha")).alias("least"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # stored, so the numbers stay
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), F.col("least.doc_id").alias("rep"), "least.sha", "digest", "bands", "sig"), "nodes")
    named = nodes.select("node", "rep", "sha", "digest")

    pairs = _to_hubs(nodes)
    used = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    shingles = _shingles_of(docs, named.join(used, "node", "left_semi"), id_col, text_col)
    links = _linked(pairs, shingles, threshold)
    groups = _groups(nodes.select("node", "bands"), connected_components(links, "a", "b"))
    more = named.join(groups.select("node").distinct(), "node", "left_semi").join(shingles.select("node"), "node", "left_anti")
    shingles = shingles.unionByName(_shingles_of(docs, more, id_col, text_col))
    groups = groups.join(nodes.select("node", "sig").join(shingles, "node"), "node")
    links = links.unionByName(_look_through(groups, threshold, block))
    parts = connected_components(links, "a", "b").select(F.col("id").alias("node"), "component")

    known = stored(named.join(parts, "node", "left").select("digest", F.struct("rep", "digest", "sha").alias("row"), F.coalesce("component", "node").alias("component")), "known")
    known = known.select("digest", "component").join(known.groupBy("component").agg(F.min("row").alias("first")), "component").select(F.col("digest").alias("own"), "first")
    found = signed.join(known, signed.digest == known.own, "left")
    stands = (F.col("digest") == F.col("first.digest")) & (F.col("doc_id") == F.col("first.rep")) & (F.col("sha") == F.col("first.sha"))
    return found.select("doc_id", "sha", F.coalesce("first.rep", "doc_id").alias("class_id"), F.coalesce(stands, F.lit(True)).alias("kept"), F.col("digest").isNull().alias("alone"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, class_id (the smallest id of its group) and kept (the row stands for its group).

    Texts are lower-cased and cut at white space. Equal word sequences form a class of copies. Texts whose signatures
    agree in a band are candidates; candidates link when the weighted Jaccard similarity of their five-word shingles,
    computed in full, reaches the threshold; groups are the components.

    Members of the buckets of the first bands are compared with a few hubs, which joins most of a large group with as
    many comparisons as it has members. Then all bands count: where a bucket still holds several components, those
    outside the most frequent one are compared with it and with each other, in pairs of blocks inside tasks: by
    estimates from the signatures first, and in full where an estimate may reach the threshold. A member is a row per
    group there, not per bucket, and only links leave a task, never pairs.

    Null ids and texts without a word are groups of their own and kept. Rows that repeat an id with another text are
    judged by their own text; of such rows in a group only one is kept. Rows equal in id and text share a group and
    are kept or not together. An empty table gives no rows; other columns are ignored.
    """
    found = classes_of(docs, id_col, text_col, threshold, block)
    return found.select(F.col("doc_id").alias(id_col), "class_id", "kept")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their groups, one of each: of rows equal in id and text one stays.

    Rows without an id or a word stay. Other columns pass through, whatever their names.
    """
    found = stored(classes_of(docs, id_col, text_col, threshold), "classes")
    row = [F.col("doc_id").alias("n_id"), F.unhex("sha").alias("n_sha")]
    twice = found.where("kept and not alone").groupBy("doc_id", "sha").agg(F.count("*").alias("n")).where("n > 1").select(*row)
    twice = stored(twice, "twice")
    gone = stored(found.where("not kept").select(*row).distinct().unionAll(twice), "gone")  # of known size, as above
    inner = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("id"), F.unhex(text_hash(F.col(text_col).cast("string"))).alias("sha"))
    same = (F.col("id") == F.col("n_id")) & (F.col("sha") == F.col("n_sha"))
    once = inner.join(gone, same, "left_anti")
    if not twice.isEmpty():
        once = once.unionByName(inner.join(twice, same, "left_semi").dropDuplicates(["id", "sha"]))
    return once.select("doc.*")


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
