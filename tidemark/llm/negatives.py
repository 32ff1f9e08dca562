"""Hard negatives by a two-dimensional block product: partial int64 score tiles, added in the shuffle, cut to top ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: Anchors and rows of a score tile (8 bytes a pair), and dimensions of a partial product.
ANCHOR_TILE, ROW_TILE, DIMS = 512, 2048, 32
#: Scores are compared a hundredfold in 64 bits.
MOST = 2**63 // 128

PACKED = "g long, n int, tile int, chunk int, chunks int, codes binary, kind string, faces binary"
PARTIAL = "g long, n int, a_tile int, r_tile int, tile binary, a_faces binary, r_faces binary"


def _columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _packed(rows: DataFrame, tile: int, dims: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (g, n, faces, q: arrays of longs) in tiles by hash within (g, n), a block for each run of dims dimensions;
    and the number of tiles of each (g, n)."""
    sizes = rows.groupBy("g", "n").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    placed = rows.join(sizes, ["g", "n"]).withColumn("tile", F.pmod(F.xxhash64("faces"), F.col("tiles")).cast("int"))

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        one, faces = pdf.iloc[0], np.stack(pdf["faces"]).astype(np.int64)
        q = np.stack(pdf["q"]).astype(np.int64).reshape(len(pdf), -1)
        top = max(1, int(np.abs(q).max(initial=0)))
        kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if top <= np.iinfo(k).max)
        chunks = max(1, -(-q.shape[1] // dims))
        out = [(one.g, one.n, one.tile, c, chunks, q[:, c * dims : (c + 1) * dims].astype(kind).tobytes(), kind, None if c else faces.tobytes()) for c in range(chunks)]
        return pd.DataFrame(out, columns=_columns(PACKED))

    return stored(placed.select("g", "n", "tile", "faces", "q").groupBy("g", "n", "tile").applyInPandas(bundle, PACKED), name), sizes


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers; in doubles where every sum is below 2**53, and so exact."""
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def score_tiles(anchors: DataFrame, rows: DataFrame, reduce, schema: str, anchor_tile: int, row_tile: int, dims: int) -> DataFrame:
    """reduce(scores, anchor faces, row faces) of the score tiles of every (anchor, row) of equal (g, n).

    Both sides are (g, n, faces, q). Every block of anchors meets the block of rows of the same dimensions in a task of
    its own; the partial tile that comes of it is shuffled by its place, and the partials of a place are added one after
    the other. A task holds two tiles at most, however many anchors, rows or dimensions there are.
    """
    a, a_sizes = _packed(anchors, anchor_tile, dims, "anchor-tiles")
    r, r_sizes = _packed(rows, row_tile, dims, "row-tiles")
    left = a.join(r_sizes.withColumnRenamed("tiles", "others"), ["g", "n"]).select("g", "n", "chunk", F.col("tile").alias("a_tile"), F.explode(F.expr("sequence(0, others - 1)")).alias("r_tile"), *(F.col(c).alias(f"a_{c}") for c in ("codes", "kind", "faces")))
    right = r.join(a_sizes.withColumnRenamed("tiles", "others"), ["g", "n"]).select("g", "n", "chunk", F.col("tile").alias("r_tile"), F.explode(F.expr("sequence(0, others - 1)")).alias("a_tile"), *(F.col(c).alias(f"r_{c}") for c in ("codes", "kind", "faces")))

    def multiply(batches):
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                width = max(0, min(dims, x.n - x.chunk * dims))
                side = lambda codes, kind: np.frombuffer(codes, kind).reshape(-1, width) if width else None
                tile = _product(side(x.a_codes, x.a_kind), side(x.r_codes, x.r_kind)).tobytes() if width else b""
                yield pd.DataFrame([(x.g, x.n, x.a_tile, x.r_tile, tile, x.a_faces, x.r_faces)], columns=_columns(PARTIAL))

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = a_faces = r_faces = None
        for pdf in parts:
            for x in pdf.itertuples(index=False):
                part = np.frombuffer(x.tile, np.int64)
                total = part.copy() if total is None else total + part
                if x.a_faces is not None:
                    a_faces, r_faces = x.a_faces, x.r_faces
        na, nr = (np.frombuffer(f, np.int64) for f in (a_faces, r_faces))
        # the first value of a face is the number of its values
        na, nr = na.reshape(-1, int(na[0])), nr.reshape(-1, int(nr[0]))
        total = total.reshape(len(na), len(nr)) if len(total) else np.zeros((len(na), len(nr)), np.int64)
        yield reduce(total, na, nr)

    partials = left.join(right, ["g", "n", "chunk", "a_tile", "r_tile"]).mapInPandas(multiply, PARTIAL)
    return partials.groupBy("g", "n", "a_tile", "r_tile").applyInPandas(add, schema)


def _best(positives: int):
    """The best rows for each anchor of a tile but itself. Faces: width, row, id."""

    def reduce(scores: np.ndarray, anchors: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
        order = np.argsort(rows[:, 2], kind="stable")
        rows, scores = rows[order], scores[:, order]
        own = anchors[:, 1][:, None] == rows[:, 1][None, :]
        keep = min(positives + 1, len(rows))
        best = np.argsort(-scores, axis=1, kind="stable")[:, :keep]  # stable: ties by id; one more, as it may be itself
        a = np.repeat(np.arange(len(anchors)), keep)
        r = best.ravel()
        other = ~own[a, r]
        a, r = a[other], r[other]
        return pd.DataFrame({"anchor": anchors[a, 1], "id": rows[r, 2], "score": scores[a, r]})

    return reduce


def _in_windows(negatives: int, low: int, high: int):
    """For each anchor and positive of a tile the best rows of other labels inside the window.

    Faces: width, row, id, label; an anchor's go on with its positives' ids and scores, then their number.
    """

    def reduce(scores: np.ndarray, anchors: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
        order = np.argsort(rows[:, 2], kind="stable")
        rows, scores = rows[order], scores[:, order]
        slots = (anchors.shape[1] - 5) // 2
        out = []
        for face, own in zip(anchors, scores, strict=True):
            other = np.flatnonzero(rows[:, 3] != face[3])
            other = other[np.argsort(-own[other], kind="stable")]
            falling = -100 * own[other]
            for k in range(int(face[-1])):
                positive, score = face[4 + k], face[4 + slots + k]
                start, end = np.searchsorted(falling, -high * score, "left"), np.searchsorted(falling, -low * score, "right")
                some = other[start : min(end, start + negatives)]
                out.append(pd.DataFrame({"anchor": face[1], "anchor_id": face[2], "slot": k, "positive_id": positive, "positive_score": score, "negative_id": rows[some, 2], "negative_score": own[some]}))
        return pd.concat(out) if out else pd.DataFrame(columns=_columns(WINDOWED))

    return reduce


WINDOWED = "anchor long, anchor_id long, slot int, positive_id long, positive_score long, negative_id long, negative_score long"


def mine_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchor_tile: int = ANCHOR_TILE, row_tile: int = ROW_TILE, dims: int = DIMS) -> DataFrame:
    """For each anchor and each of its best positives (other rows of its label) the best rows of other labels whose
    scores lie between low and high percent of the positive's: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product; ties go by id. Rows with a null id, label
    or vector or with a null or non-finite component take no part; vectors of different lengths have no score. Rows that
    repeat an id count as rows of their own. Scores that a hundredfold don't fit 64 bits raise an error. An empty
    table, or no anchor, gives an empty result; other columns are ignored.

    Positives come from the products of rows of equal labels; the windows that they set are then looked for in the
    products of all anchors with all rows. Neither keeps a score tile.
    """
    finite = F.forall(F.col(vector_col), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite
    rows = df.where(good).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("q"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "codes")
    size = F.coalesce(F.array_max(F.transform("q", lambda x: F.abs(x))), F.lit(0))
    top, width = rows.agg(F.max(size), F.max(F.size("q"))).first()
    if top and top * top * max(1, width) > MOST:
        raise ValueError(f"scores of {width} components of up to {top} may exceed 64 bits")
    labels = stored(rows.select("label").distinct().withColumn("g", F.monotonically_increasing_id()), "labels")
    rows = stored(rows.join(labels, "label").select("g", F.size("q").alias("n"), "row", "id", "is_anchor", "q"), "labelled")
    face = lambda *c: F.array(F.lit(len(c) + 1).cast("long"), *c)

    by_label = rows.withColumn("faces", face(F.col("row"), F.col("id"))).select("g", "n", "faces", "q", "is_anchor")
    found = score_tiles(by_label.where("is_anchor").drop("is_anchor"), by_label.drop("is_anchor"), _best(positives), "anchor long, id long, score long", anchor_tile, row_tile, dims)
    first = found.withColumn("slot", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))).where(F.col("slot") <= positives)
    best = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "id", "score"))).alias("p"))
    best = stored(best, "positives")

    padded = lambda name: [F.coalesce(F.get("p", F.lit(k))[name], F.lit(0).cast("long")) for k in range(positives)]
    known = rows.where("is_anchor").join(best.withColumnRenamed("anchor", "row"), "row")
    sided = known.select(F.lit(0).cast("long").alias("g"), "n", face(F.col("row"), F.col("id"), F.col("g"), *padded("id"), *padded("score"), F.size("p").cast("long")).alias("faces"), "q")
    everything = rows.select(F.lit(0).cast("long").alias("g"), "n", face(F.col("row"), F.col("id"), F.col("g")).alias("faces"), "q")
    windowed = score_tiles(sided, everything, _in_windows(negatives, low, high), WINDOWED, anchor_tile, row_tile, dims)
    ranked = windowed.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id"))).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_block_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of embeddings whose vec_id is divisible by 100; where it is divisible by 7 the label is
    first moved on by one of ten."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])), 0)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
