"""Counts by hash bucket, as sparse slices that tasks emit and Spark adds up; bitmaps of the buckets that pass a threshold.

A bitmap has a fixed size (2**bits / 8 bytes), however large the corpus is, so it may be collected and broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Buckets of a slice: offsets in it take two bytes.
SLICE = 1 << 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)


def count_type(most: int) -> np.dtype:
    return np.dtype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def sparse_slices(buckets: np.ndarray, most: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Slices, offsets and counts of some buckets. Counts stop at most: whether a sum reaches most stays the same."""
    if not len(buckets):
        return [], [], []
    found, n = np.unique(buckets, return_counts=True)
    cuts = np.flatnonzero(np.diff(found // SLICE)) + 1
    firsts = np.concatenate([[0], cuts])
    offsets, counts = (found % SLICE).astype("<u2"), np.minimum(n, most).astype(count_type(most))
    return [int(x) for x in found[firsts] // SLICE], [x.tobytes() for x in np.split(offsets, cuts)], [x.tobytes() for x in np.split(counts, cuts)]


def slice_rows(buckets: np.ndarray, most: int) -> pa.RecordBatch:
    slices, offsets, counts = sparse_slices(buckets, most)
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(offsets, pa.binary()), pa.array(counts, pa.binary())], ["slice", "offsets", "counts"])


def bitmap(slices: DataFrame, bits: int, least: int) -> np.ndarray:
    """Packed bits of the buckets whose counts in slices (slice, offsets, counts; made with most = least) reach least.

    A slice is added up in a stream of its parts, in 8 * SLICE bytes; what reaches the driver is 2**bits / 8 bytes.
    """
    kind = count_type(least)

    def add(batches):
        total, at = np.zeros(SLICE, np.int64), None

        def bits_of():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["slice", "set"])

        for batch in batches:
            for n, offsets, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "offsets", "counts")), strict=True):
                if n != at:
                    if at is not None:
                        yield bits_of()
                    at, total[:] = n, 0
                total[np.frombuffer(offsets, "<u2")] += np.frombuffer(counts, kind)  # offsets of a part are distinct
        if at is not None:
            yield bits_of()

    out = np.zeros(max(SLICE, 1 << bits) // 8, np.uint8)
    for row in slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, set binary").collect():
        start = row["slice"] * (SLICE // 8)
        out[start : start + SLICE // 8] = np.frombuffer(row["set"], np.uint8)
    return out


def is_set(bits_set: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bits_set[buckets >> 3] >> (buckets & 7).astype(np.uint8) & 1).astype(bool)
