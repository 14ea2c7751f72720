"""Arrays of a fixed size that tasks fill and Spark merges: Bloom filters and count sketches.

Every task fills an array of its own and hands it on in compressed chunks. Chunks are merged
in two levels (tasks in 256 groups, then groups), so no task holds more than a small share
of the partial arrays. The merged array has the size its maker fixed, whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 16
_PARTS = "chunk int, part int, data binary"


def merged(df: DataFrame, fill: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int, dtype: str, add: bool) -> np.ndarray:
    """fill turns a task's batches into its array; results are added, or joined by OR."""
    kind = np.dtype(dtype)
    step = CHUNK_BYTES // kind.itemsize

    def emit(batches):
        array = fill(batches)
        if array is None:
            return
        part = TaskContext.get().partitionId()
        for chunk in range(-(-size // step)):
            piece = array[chunk * step : (chunk + 1) * step]
            if piece.any():
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array([chunk], pa.int32()), "part": pa.array([part % 256], pa.int32()),
                     "data": pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())}
                )

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for data in rows["data"]:
            piece = np.frombuffer(zlib.decompress(data), kind)
            total = piece.copy() if total is None else (total + piece if add else total | piece)
        return pd.DataFrame(
            {"chunk": [int(rows["chunk"].iloc[0])], "part": [int(rows["part"].iloc[0])], "data": [zlib.compress(total.tobytes(), 1)]}
        )

    partial = df.mapInArrow(emit, _PARTS).groupBy("chunk", "part").applyInPandas(join, _PARTS)
    out = np.zeros(size, kind)
    for row in partial.groupBy("chunk").applyInPandas(join, _PARTS).collect():
        piece = np.frombuffer(zlib.decompress(row["data"]), kind)
        out[row["chunk"] * step : row["chunk"] * step + len(piece)] = piece
    return out


class Bloom:
    """Three bits per 64-bit key in an array of 2^bits bits."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.bytes = np.zeros(1 << (bits - 3), np.uint8) if words is None else words

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        keys = keys.astype(np.int64, copy=False).view(np.uint64)
        for mult in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            yield (keys * np.uint64(mult)) >> np.uint64(64 - self.bits)

    def add(self, keys: np.ndarray) -> None:
        for at in self._places(keys):
            np.bitwise_or.at(self.bytes, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys):
            out &= (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def bloom_of(keys: DataFrame, bits: int, key: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> Bloom:
    """Filter of the keys in the first column, or of what key makes of a batch."""

    def fill(batches):
        own = None
        for batch in batches:
            if batch.num_rows:
                own = own or Bloom(bits)
                own.add(key(batch) if key else batch.column(0).to_numpy())
        return own.bytes if own else None

    return Bloom(bits, merged(keys, fill, 1 << (bits - 3), "u1", add=False))

