"""A set of 64-bit keys as a bitmap of fixed size.

Membership tests against it may say yes wrongly, never no wrongly, so it only saves work:
whoever uses it decides exactly afterwards. Its size is a parameter and doesn't grow with
the data, so it may be broadcast; the more keys, the less it saves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows in which a bitmap is brought to the driver.
SLICES = 64


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """bits: a power of two. The top bits of a key choose its place."""
    return keys >> np.uint64(64 - (bits.bit_length() - 1))


def holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = positions(keys, len(bitmap) * 8)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def broadcast_bitmap(blobs: DataFrame, bits: int) -> Broadcast:
    """The bitmap of the keys in the binary column ``keys`` (uint64, little endian).

    Every task fills the slices that its keys fall into; equal slices are met by Spark in
    groups, and the driver gets SLICES rows of bits / SLICES bits each.
    """
    share = bits // SLICES

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(b, np.uint64) for b in batch.column(0).to_pylist()]
            at = np.unique(positions(np.concatenate(keys), bits)) if keys else np.zeros(0, np.uint64)
            part = (at // np.uint64(share)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(SLICES + 1))
            found = [i for i in range(SLICES) if cuts[i] < cuts[i + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array([(at[cuts[i]:cuts[i + 1]] % np.uint64(share)).astype(np.uint32).tobytes() for i in found], pa.binary())],
                ["slice", "places"],
            )

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slices.setdefault(i, np.zeros(share, bool))[np.frombuffer(places, np.uint32)] = True
        for i, marks in slices.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())],
                ["slice", "bits"],
            )

    rows = (
        blobs.select("keys").mapInArrow(sliced, "slice int, places binary")
        .repartition(SLICES, F.col("slice")).mapInArrow(filled, "slice int, bits binary").collect()
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in rows:
        bitmap[row["slice"] * share // 8 : (row["slice"] + 1) * share // 8] = np.frombuffer(row["bits"], np.uint8)
    return blobs.sparkSession.sparkContext.broadcast(bitmap)
