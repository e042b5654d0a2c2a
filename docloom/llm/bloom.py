"""A Bloom filter of bounded size, built in slices on the executors.

It thins a scan before anything is shuffled; the join behind it stays exact. The size never
exceeds ``MAX_BITS`` (8 MB, what Spark's own runtime filters allow), whatever the number of
keys: beyond that only its rate of false hits grows, never the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shingling import mix

U = np.uint64
MAX_BITS = 1 << 26
SLICES = 64


class Bloom:
    """Two bits a key; key space and filter are cut into ``SLICES`` slices."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # uint8 per bit group, shape (SLICES, bytes)

    @staticmethod
    def places(keys: np.ndarray, per_slice: int):
        h = mix(keys.astype(np.uint64) ^ U(0xB10F))
        return (h % U(SLICES)).astype(np.int64), ((h >> U(8)) % U(per_slice)).astype(np.int64), ((h >> U(36)) % U(per_slice)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        s, a, b = self.places(keys, self.bits.shape[1] * 8)
        return ((self.bits[s, a >> 3] >> (a & 7)) & (self.bits[s, b >> 3] >> (b & 7)) & 1).astype(bool)

    def column(self, key: Column | str) -> Column:
        """Whether the bigint ``key`` may be among the keys; only it goes to Python."""

        @F.pandas_udf("boolean")
        def found(ids: pd.Series) -> pd.Series:
            return pd.Series(self.contains(ids.to_numpy().view(np.uint64)))

        return found(F.col(key) if isinstance(key, str) else key)


def build(ids: DataFrame, column: str, count: int) -> Bloom:
    """The filter of the bigint ``column``; ``count`` is how many values it has about."""
    per_slice = 1 << max(10, int(np.ceil(np.log2(max(1, count) * 20 / SLICES))))
    per_slice = min(per_slice, MAX_BITS // SLICES)

    def fold(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            s, x, y = Bloom.places(b.column(0).to_numpy().view(np.uint64), per_slice)
            for one in np.unique(s):
                bits = got.setdefault(int(one), np.zeros(per_slice, np.uint8))
                own = s == one
                bits[x[own]] = 1
                bits[y[own]] = 1
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in got.values()], pa.binary())], ["slice", "bits"])

    # One value of the partitioning column is one slice, so every slice is made in one task
    # and what reaches the driver is one filter, of at most MAX_BITS / 8 bytes.
    keyed = ids.select(F.col(column).alias("id"))
    parts = keyed.mapInArrow(fold, "slice int, bits binary")
    out = np.zeros((SLICES, per_slice // 8), np.uint8)
    merged = parts.repartition(min(SLICES, 8), "slice").mapInArrow(_merge, "slice int, bits binary")
    for row in merged.collect():
        out[row["slice"]] |= np.frombuffer(row["bits"], np.uint8)
    return Bloom(out)


def _merge(batches):
    got: dict[int, np.ndarray] = {}
    for b in batches:
        for s, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(bits, np.uint8)
            got[s] = got[s] | x if s in got else x
    yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([v.tobytes() for v in got.values()], pa.binary())], ["slice", "bits"])
