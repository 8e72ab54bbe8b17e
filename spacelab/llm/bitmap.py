"""A broadcast set of hashes as a bitmap of bounded size.

It never misses a member.  Other hashes hit by chance, the more often the fuller the bitmap is, so it is used only where
an exact step follows; however large the set, no more than ``MOST_BITS`` bits are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 29  # 64 MB
CHUNK_BITS = 16


def _chunks(bits: int):
    """Hashes -> (chunk, bytes): the bits of each chunk that this task's rows set, held for one task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool) if bits <= 24 else None
        table = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            if own is not None:
                own[at] = True
            else:
                np.bitwise_or.at(table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if own is not None:
            table = np.packbits(own, bitorder="little")
        size = min(1 << CHUNK_BITS, 1 << bits) // 8
        parts = table.reshape(-1, size)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["chunk", "bits"])

    return run


class Bitmap:
    """Which 64-bit hashes may belong to a set."""

    def __init__(self, spark, table: np.ndarray, bits: int):
        self.bits = bits
        self._shared = spark.sparkContext.broadcast(table.tobytes())

    @staticmethod
    def of(hashes: DataFrame, column: str, most_bits: int = MOST_BITS) -> Bitmap:
        """The bitmap of a column of 64-bit hashes: 16 bits a hash, within bounds."""
        count = hashes.count()
        bits = int(min(most_bits, max(10, (16 * count).bit_length())))
        # hashes are dealt by their upper bits, so a chunk is made in one task and collected once
        chunk = F.shiftrightunsigned(column, 64 - bits + CHUNK_BITS) if bits > CHUNK_BITS else F.lit(0)
        dealt = hashes.select(F.col(column).alias("h"), chunk.alias("chunk")).repartition("chunk").select("h")
        table = np.zeros((1 << bits) // 8, np.uint8)
        size = min(1 << CHUNK_BITS, 1 << bits) // 8
        for row in dealt.mapInArrow(_chunks(bits), "chunk long, bits binary").toLocalIterator():  # 64 MB at most
            part = table[row["chunk"] * size : (row["chunk"] + 1) * size]
            part |= np.frombuffer(bytes(row["bits"]), np.uint8)
        return Bitmap(hashes.sparkSession, table, bits)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self._shared.value, np.uint8)
        at = hashes >> np.uint64(64 - self.bits)
        return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def __getstate__(self):
        return {"bits": self.bits, "_shared": self._shared}
