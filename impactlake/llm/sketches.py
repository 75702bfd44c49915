"""Arrays of fixed size that tasks fill and Spark adds up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

BLOCK = 1 << 16


def sums(rows: DataFrame, size: int, fill, kind=np.uint32) -> np.ndarray:
    """The sum over all tasks of the array (uint32, or another kind) of `size` (a power of two, at most 2**24) that fill(array, batch) adds to.

    Tasks send compressed blocks; a block's owner adds them one by one. Sums end at 2**32 - 1; the driver gets
    them once, on a logarithmic scale of 256 steps, one byte each.
    """

    def send(batches):
        own = np.zeros(size, kind)
        any_ = False
        for batch in batches:
            fill(own, batch)
            any_ = True
        if any_:
            for b in range(0, size, BLOCK):
                part = own[b : b + BLOCK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], ["block", "part"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zstandard.decompress(part), kind)
                total[b] = total[b] + part if b in total else part.astype(np.uint64)
        for b, x in total.items():
            steps = np.minimum(255, np.ceil(np.log2(x + 1.0) * 8)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([steps.tobytes()], pa.binary())], ["block", "part"])

    out = np.zeros(size, np.uint8)
    merged = rows.mapInArrow(send, "block long, part binary").repartition("block").mapInArrow(add, "block long, part binary")
    for r in merged.collect():  # `size` bytes
        part = np.frombuffer(r["part"], np.uint8)
        out[r["block"] : r["block"] + len(part)] = part
    return out
