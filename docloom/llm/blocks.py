"""Packed blocks: sorted columns of keys with row references, the unit that is shuffled.

Signature keys are random numbers, a row of Spark's shuffle costs about twice its payload, and
a corpus has dozens of keys per text. So each task packs the keys of a batch into one binary
per key range: keys ascending, split into byte planes (the leading planes are long runs and
compress to little), with two-byte references into a list of row identifiers. A key range is
one shuffle partition; inside it numpy works on whole columns.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

U = np.uint64
KEY_BYTES = 5
_ZSTD = pa.Codec("zstd", compression_level=1)


def _planes(x: np.ndarray, width: int) -> bytes:
    raw = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(raw.T).tobytes()


def _unplanes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def split_ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """The key range each 64-bit key lies in; ranges are equal shares of the key space."""
    return ((keys >> U(32)) * U(parts)) >> U(32)


def pack(keys: np.ndarray, rows: np.ndarray, ids: np.ndarray, parts: int, extra: list[tuple[np.ndarray, int]] = (), key_bytes: int = KEY_BYTES, marks: list[np.ndarray] = ()):
    """Yields (part, binary) for 64-bit ``keys`` of the rows ``rows`` (numbers into ``ids``).

    ``extra`` holds further columns with their width in bytes, ``marks`` 64-bit columns of the rows themselves.
    """
    order = np.argsort(keys)
    k, r = keys[order], rows[order]
    more = [(x[order], w) for x, w in extra]
    edges = np.searchsorted(split_ranges(k, parts), np.arange(parts + 1, dtype=np.uint64))
    kept = k >> U(64 - 8 * key_bytes)
    for p in range(parts):
        lo, hi = edges[p], edges[p + 1]
        if lo == hi:
            continue
        used, local = np.unique(r[lo:hi], return_inverse=True)
        wide = 2 if len(used) <= 65536 else 4
        body = b"".join([_planes(kept[lo:hi], key_bytes), _planes(local.astype(np.uint64), wide), _planes(ids[used].astype(np.uint64), 8), *(_planes(m[used], 8) for m in marks), *(_planes(x[lo:hi].astype(np.uint64), w) for x, w in more)])
        head = struct.pack("<QQQB", hi - lo, len(used), len(body), wide)
        yield p, head + _ZSTD.compress(body, asbytes=True)


def unpack(blob: bytes, extra: tuple[int, ...] = (), key_bytes: int = KEY_BYTES, marks: int = 0) -> list[np.ndarray]:
    """Keys, identifiers, marks and further columns of a block; keys ascending."""
    n, m, size, wide = struct.unpack_from("<QQQB", blob)
    body = _ZSTD.decompress(memoryview(blob)[25:], decompressed_size=size, asbytes=True)
    at = 0

    def take(count: int, width: int) -> np.ndarray:
        nonlocal at
        x = _unplanes(body[at : at + count * width], count, width)
        at += count * width
        return x

    keys, local, ids = take(n, key_bytes), take(n, wide), take(m, 8)
    own = [take(m, 8)[local] for _ in range(marks)]
    return [keys, ids[local], *own, *(take(n, w) for w in extra)]


def gather(blobs: list[bytes], extra: tuple[int, ...] = (), key_bytes: int = KEY_BYTES, marks: int = 0) -> list[np.ndarray]:
    """The columns of several blocks, one after the other."""
    cols = [unpack(b, extra, key_bytes, marks) for b in blobs]
    return [np.concatenate(x) for x in zip(*cols)] if cols else [np.empty(0, np.uint64)] * (2 + marks + len(extra))


def parts_for(entries: float, least: int, per_part: float = 4e6) -> int:
    """Number of key ranges such that one holds about ``per_part`` entries at most."""
    return int(max(least, 1, -(-entries // per_part)))
