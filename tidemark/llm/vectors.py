"""Near-duplicate embeddings: int8 tile products with error bounds, then full precision where a pair may pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

THRESHOLD = 0.98
#: Vectors in a tile: a pair of tiles is one task's unit of work, at most 2 * TILE vectors in memory.
TILE = 2048
#: Rows of a product held at once.
STRIP = 512


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scale, norm of the quantised part and norm of what it leaves out, of each unit row of x."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    kept = codes * scale[:, None]
    return codes, scale, np.linalg.norm(kept, axis=1), np.linalg.norm(unit - kept, axis=1)


def possible(a: tuple, b: tuple, threshold: float):
    """Strips (first row, pairs as a boolean matrix) of two tiles' pairs that may reach threshold; a tile is what
    quantise returns.

    x.y = (kx + ex).(ky + ey), so by Cauchy-Schwarz the product of the codes errs by at most
    |kx||ey| + |ex||ky| + |ex||ey|. Pairs that stay below the threshold with that much added are out. Integer products
    below 2**24 are exact in float32.
    """
    (qa, sa, ka, ea), (qb, sb, kb, eb) = a, b
    kind = np.float32 if qa.shape[1] * 127 * 127 < 2**24 else np.float64
    right = qb.astype(kind).T
    for at in range(0, len(qa), STRIP):
        s = slice(at, at + STRIP)
        near = (qa[s].astype(kind) @ right).astype(np.float64) * sa[s, None] * sb[None, :]
        near += ka[s, None] * eb[None, :] + ea[s, None] * (kb + eb)[None, :] + 1e-9
        yield at, near >= threshold


def _scaled(xs: pd.Series) -> pd.Series:
    """Vectors as bytes of doubles, a power of two away so that no norm overflows or vanishes; null what can't link."""
    out = []
    for v in xs:
        x = np.asarray([] if v is None else v, dtype=np.float64)
        top = np.abs(x).max() if len(x) else 0.0
        out.append((np.ldexp(x, -max(-1000, int(np.floor(np.log2(top))))) + 0.0).tobytes() if 0 < top < np.inf else None)
    return pd.Series(out, dtype=object)


TILES = "g string, n int, tiles int, tile int, nodes binary, codes binary, parts binary"
FLAGGED = "g string, n int, tile int, other int, a_nodes binary, b_nodes binary, pairs binary"


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per input row: id, n_links, component_id (smallest id reachable by links) and kept.

    Vectors link when their groups are equal and not null and their cosine reaches threshold. Null, empty and zero
    vectors, and those with a null or non-finite component, link with nothing; neither do rows without an id or
    vectors of different lengths. Equal vectors count once with their number of copies, so a hot vector costs one row.

    Vectors are quantised once, and every pair of tiles of a group ships eight bits a component; of its pairs that may
    reach the threshold the full vectors of both sides follow, and those pairs alone are computed in double precision.
    What leaves a task is counts and a spanning forest, never all links. Rows that repeat an id count as vectors of
    their own. An empty table gives an empty result; other columns are ignored.
    """
    as_bytes = F.pandas_udf(_scaled, "binary").asNondeterministic()  # or it runs again for each test of its result
    base = stored(df.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("g"), as_bytes(F.col(vector_col).cast("array<double>")).alias("x")), "vectors")
    good = F.col("g").isNotNull() & F.col("id").isNotNull() & F.col("x").isNotNull()
    classes = base.where(good).groupBy("g", "x").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes.select("g", "x", F.col("rep").cast("long").alias("rep"), "copies", (F.octet_length("x") / 8).cast("int").alias("n"), F.monotonically_increasing_id().alias("node")), "classes")
    tiles = classes.groupBy("g", "n").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    placed = classes.join(tiles, ["g", "n"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        codes, *parts = quantise(np.frombuffer(b"".join(pdf.x), np.float64).reshape(len(pdf), -1))
        return pd.DataFrame([(one.g, one.n, one.tiles, one.tile, pdf.node.to_numpy(np.int64).tobytes(), codes.tobytes(), np.stack(parts).tobytes())], columns=[f.split()[0] for f in TILES.split(", ")])

    packed = stored(placed.select("g", "n", "tiles", "tile", "node", "x").groupBy("g", "n", "tile").applyInPandas(bundle, TILES), "tiles")
    blobs = ("nodes", "codes", "parts")
    left = packed.select("g", "n", F.explode(F.expr("sequence(tile, tiles - 1)")).alias("other"), "tile", *(F.col(c).alias(f"a_{c}") for c in blobs))
    right = packed.select("g", "n", F.col("tile").alias("other"), *(F.col(c).alias(f"b_{c}") for c in blobs))

    def flag(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield _flagged(row, threshold)

    flagged = stored(left.join(right, ["g", "n", "other"]).mapInPandas(flag, FLAGGED).withColumn("pair", F.monotonically_increasing_id()), "flagged")
    sides = flagged.select("pair", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"{side}_nodes").alias("nodes")) for k, side in enumerate("ab")))).alias("s")).select("pair", "s.*")

    def split(batches):
        for pdf in batches:
            for pair, side, data in zip(pdf["pair"], pdf["side"], pdf["nodes"], strict=True):
                nodes = np.frombuffer(data, np.int64)
                yield pd.DataFrame({"pair": pair, "side": side, "place": np.arange(len(nodes)), "node": nodes})

    rows = sides.mapInPandas(split, "pair long, side int, place int, node long").join(classes.select("node", "copies", "x"), "node")
    rows = rows.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("side", "place", "node", "copies", "x"))).alias("rows"))

    def link(batches):
        for pdf in batches:
            for rows, pairs, same in zip(pdf["rows"], pdf["pairs"], pdf["same"], strict=True):
                yield _linked(rows, pairs, same, threshold)

    both = rows.join(flagged.select("pair", "pairs", (F.col("tile") == F.col("other")).alias("same")), "pair")
    found = stored(both.mapInPandas(link, "id long, links long, root long"), "found")
    counts = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    parts = connected_components(found, "id", "root").withColumnRenamed("id", "node")
    known = stored(classes.join(counts, "node", "left").join(parts, "node", "left").select("g", "x", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "known")
    known = known.join(known.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("g", "x", "n_links", "component_id")
    linked = base.where(good).join(known, ["g", "x"]).select("id", "n_links", "component_id")
    alone = base.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    return linked.unionAll(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long"), F.col("component_id").cast("long"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _flagged(row, threshold: float) -> pd.DataFrame:
    """Of a pair of tiles, the vectors of both sides that stand in possible pairs, and which of their pairs are possible."""
    same = row.tile == row.other

    def read(nodes, codes, parts):
        nodes = np.frombuffer(nodes, np.int64)
        return nodes, (np.frombuffer(codes, np.int8).reshape(len(nodes), -1), *np.frombuffer(parts, np.float64).reshape(3, -1))

    na, a = read(row.a_nodes, row.a_codes, row.a_parts)
    nb, b = (na, a) if same else read(row.b_nodes, row.b_codes, row.b_parts)
    may = np.concatenate([m for _, m in possible(a, b, threshold)])
    if same:
        may = np.triu(may, 1)
    on_a, on_b = may.any(axis=1), may.any(axis=0)
    if not on_a.any():
        return pd.DataFrame(columns=[f.split()[0] for f in FLAGGED.split(", ")])
    bits = np.packbits(may[on_a][:, on_b]).tobytes()
    return pd.DataFrame([(row.g, row.n, row.tile, row.other, na[on_a].tobytes(), nb[on_b].tobytes(), bits)], columns=[f.split()[0] for f in FLAGGED.split(", ")])


def _linked(rows, pairs: bytes, same: bool, threshold: float) -> pd.DataFrame:
    """Links of the possible pairs in double precision: how many each vector has, and a forest that spans them."""
    side = [[r for r in rows if r["side"] == k] for k in (0, 1)]
    xa, xb = (np.frombuffer(b"".join(r["x"] for r in own), np.float64).reshape(len(own), -1) for own in side)
    (ia, ca), (ib, cb) = ((np.array([r["node"] for r in own], np.int64), np.array([r["copies"] for r in own], np.int64)) for own in side)
    may = np.unpackbits(np.frombuffer(pairs, np.uint8), count=len(xa) * len(xb)).reshape(len(xa), len(xb)).astype(bool)
    na, nb = np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1)
    r, c = np.nonzero(may)
    for k in range(0, len(r), 65536):
        i, j = r[k : k + 65536], c[k : k + 65536]
        may[i, j] = np.einsum("ij,ij->i", xa[i], xb[j]) / (na[i] * nb[j]) >= threshold
    ids, place = np.unique(np.concatenate([ia, ib]), return_inverse=True)
    pa, pb = place[: len(ia)], place[len(ia) :]
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    np.add.at(links, pa, may @ cb)
    np.add.at(links, pb, ca @ may)
    for k in np.flatnonzero(may.any(axis=1)):
        roots = np.unique(root[np.append(pb[may[k]], pa[k])])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    hit = links > 0
    return pd.DataFrame({"id": ids[hit], "links": links[hit], "root": ids[root[hit]]})


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
