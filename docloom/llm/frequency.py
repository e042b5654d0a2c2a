"""Document frequencies of shingles in a table of fixed size, counted over all texts.

The table has ``SLOTS`` one-byte entries; a shingle is counted in the slot its hash names, once per text, and
the sum is kept as its logarithm, in steps of a quarter of a doubling, so no number of texts fills an entry
and frequent shingles stay apart from rare ones. It serves as a global order (rare first): every text uses the same
table, so the order is the same everywhere, and an order is all the exactness of a prefix filter
needs. Collisions cost speed only. Its 4 MB are what reaches the driver and is broadcast, at any size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm import shingling

U = np.uint64
SLOTS = 1 << 22
SLICES = 64
_ZSTD = pa.Codec("zstd", compression_level=1)
_SIZE = SLOTS // SLICES


def count(texts: DataFrame, k: int = 3) -> np.ndarray:
    """The table of the one string column of ``texts``."""
    partial = texts.mapInArrow(_count(k), "slice int, counts binary")
    merged = partial.repartition(min(SLICES, 12), "slice").mapInArrow(_sum, "slice int, counts binary")
    out = np.zeros((SLICES, _SIZE), np.uint8)
    for row in merged.collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.uint8)
    return out.ravel()


def slots(values: np.ndarray) -> np.ndarray:
    return (values & U(SLOTS - 1)).astype(np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    """Counts as the numbers that are kept, 0 to 255; a larger count is never a smaller number."""
    return np.minimum(255, np.round(4 * np.log2(counts.astype(np.float64) + 1))).astype(np.uint8)


def _packed(counts: np.ndarray) -> bytes:
    """Counters as byte planes, of which only the lowest is seldom zero."""
    return _ZSTD.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def _rows(slices: list[int], blobs: list[bytes]):
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "counts"])


def _count(k: int):
    def run(batches):
        total = np.zeros(SLOTS, np.uint32)
        for b in batches:
            values = shingling.shingled(b.column(0).to_pylist(), k).values
            total += np.bincount(slots(values), minlength=SLOTS).astype(np.uint32)
        for i, own in enumerate(total.reshape(SLICES, _SIZE)):
            if own.any():
                yield _rows([i], [_packed(own)])

    return run


def _sum(batches):
    got: dict[int, np.ndarray] = {}
    for b in batches:
        for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            planes = np.frombuffer(_ZSTD.decompress(blob, decompressed_size=4 * _SIZE, asbytes=True), np.uint8).reshape(4, -1)
            x = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.uint64)
            got[s] = got[s] + x if s in got else x
    yield _rows(list(got), [level(v).tobytes() for v in got.values()])
