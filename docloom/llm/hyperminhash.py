"""HyperMinHash sketches: per bucket a leading-zero count and mantissa bits of the smallest hash.

A sketch has ``reps`` independent repetitions of ``BUCKETS`` buckets. Every shingle falls into
one bucket per repetition; the bucket keeps the smallest of its hash values, stored as the
count of leading zeros (6 bits) and the 10 bits that follow (one 16-bit *register*). Buckets
that stay empty borrow the register of the next filled one, marked with the distance, so that
short texts have full sketches too. Two sets agree in a register with about the probability of
their Jaccard similarity, plus that of an accidental collision, which ``jaccard`` takes off.
"""

from __future__ import annotations

import numpy as np

from docloom.llm.shingling import Shingled, mix

U = np.uint64
BUCKETS = 16
MANTISSA = 10
EMPTY = 0xFFFF
_MAX = U(0xFFFFFFFFFFFFFFFF)


def sketch(s: Shingled, reps: int) -> np.ndarray:
    """Filled registers (uint16), shaped (rows, reps, BUCKETS); those of a row without shingles are EMPTY."""
    n = len(s.offsets) - 1
    out = np.empty((n, reps, BUCKETS), np.uint16)
    base = (s.rows * BUCKETS).astype(np.int64)
    for r in range(reps):
        out[:, r, :] = fill(_raw(s, r, base, n))
    return out


def raw_sketch(s: Shingled, reps: int) -> np.ndarray:
    """Registers before filling: the smaller the hash, the smaller the register, so the sketch of a
    union is the elementwise minimum; EMPTY, the largest value, where a bucket is empty."""
    n = len(s.offsets) - 1
    base = (s.rows * BUCKETS).astype(np.int64)
    return np.stack([_raw(s, r, base, n) for r in range(reps)], axis=1)


def _raw(s: Shingled, r: int, base: np.ndarray, n: int) -> np.ndarray:
    """59 less the leading zeros (that is, the exponent) above ten mantissa bits, of the smallest values.

    The floating-point form of a number holds just these two.
    """
    h = mix(s.values * U(2 * (r * 0x1F3D5B79 + 0x2545F491) + 1) + U(r + 1))
    low = np.full(n * BUCKETS, _MAX, np.uint64)
    np.minimum.at(low, base + (h >> U(60)).astype(np.int64), h & U((1 << 60) - 1))
    bits = (low.astype(np.float64).view(np.uint64) >> U(52 - MANTISSA)).astype(np.int64)
    reg = np.maximum(bits - (1023 << MANTISSA), 0).astype(np.uint16)
    reg[low == _MAX] = EMPTY
    return reg.reshape(n, BUCKETS)


def fill(reg: np.ndarray) -> np.ndarray:
    """Lets empty buckets (last axis) borrow the register of the next filled one, marked with the distance."""
    row, col = np.nonzero(reg == EMPTY)
    if not len(row):
        return reg
    out = reg.copy()
    for step in range(1, BUCKETS):
        src = reg[row, (col + step) % BUCKETS]
        has = src != EMPTY
        out[row[has], col[has]] = src[has] ^ np.uint16(step * 0x0861)
        row, col = row[~has], col[~has]
        if not len(row):
            break
    return out


def band_keys(registers: np.ndarray, width: int) -> np.ndarray:
    """Hashes of bands: each joins the same bucket of ``width`` different repetitions."""
    n, reps, _ = registers.shape
    bands = reps // width
    keys = np.zeros((n, bands, BUCKETS), np.uint64)
    for i in range(width):
        keys = keys * U(0x9E3779B97F4A7C15) + registers[:, i : bands * width : width, :].astype(np.uint64) + U(1)
    tag = np.arange(bands * BUCKETS, dtype=np.uint64).reshape(bands, BUCKETS)
    return mix(keys ^ mix(tag + U(0x51ED27))).reshape(n, bands * BUCKETS)


def short(registers: np.ndarray, reps: int) -> np.ndarray:
    """One byte per register of the first ``reps`` repetitions: four bits of the leading-zero
    count, four of the mantissa; what is carried along for the estimate."""
    r = registers[:, :reps, :]
    lz = np.clip(59 - (r >> MANTISSA).astype(np.int16), 0, 15).astype(np.uint8)
    out = (lz << 4) | ((r >> (MANTISSA - 4)) & 15).astype(np.uint8)
    return np.where(r == EMPTY, 255, out).astype(np.uint8).reshape(len(r), -1)


def jaccard(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, mantissa: int = 4) -> np.ndarray:
    """Jaccard similarity from equal registers, less the collisions expected for sets of ``n`` and ``m``.

    The expected number is the approximation of the HyperMinHash paper (Yu and Weber, 2017):
    0.1699 * 2**-r per register, scaled by 4x / (1 + x)**2 with x the ratio of the sizes.
    """
    equal = (left == right).mean(axis=1)
    x = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    chance = 0.169919487159739 * 2.0**-mantissa * 4 * x / (1 + x) ** 2
    return np.clip(equal - chance, 0, 1)
