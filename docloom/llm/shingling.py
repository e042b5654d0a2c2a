"""Words, shingles and their hashes, computed for whole Arrow batches at once.

*Normal text* is NFKC, hyphens at line ends resolved, lower case; white space only separates
words here, so collapsing it changes nothing. *Words* are the longest runs of letters and
digits. A *shingle* is a run of ``k`` consecutive words; sets hold distinct shingles.

Shingles are 48-bit hashes of the words they consist of. For two sets of ``n`` and ``m``
shingles the chance that any two different shingles agree is below ``n * m / 2**48``.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
HYPHEN = re.compile(r"(\w)-\s*\n\s*(\w)")
MIN_WORDS = 12
U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
#: Rows handled at once; the row number shares a 64-bit sort key with a 48-bit shingle.
CHUNK = 16_384


class _WordHashes(dict):
    """Hash of each word, remembered; emptied when it has grown, so its size is bounded."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def normal_text(text: str) -> str:
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if "-" in text and "\n" in text:
        text = HYPHEN.sub(r"\1\2", text)
    return text.lower()


def words_of(text: str) -> list[str]:
    return WORD.findall(normal_text(text))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


@dataclass
class Shingled:
    """Distinct shingles of several texts: row ``i`` owns ``values[offsets[i]:offsets[i + 1]]``, ascending."""

    offsets: np.ndarray
    values: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.sizes)


def shingled(texts: list[str], k: int = 3, min_words: int = MIN_WORDS) -> Shingled:
    """Shingle sets of ``texts``; a text with fewer than ``min_words`` words has none."""
    flat: list[str] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        w = words_of(text) if text else []
        if len(w) < max(min_words, k):
            w = []
        counts[i] = len(w)
        flat += w
    h = np.fromiter(map(_HASHES.__getitem__, flat), np.uint64, len(flat))
    return from_word_hashes(h, counts, k)


def from_word_hashes(h: np.ndarray, counts: np.ndarray, k: int = 3) -> Shingled:
    n = len(counts)
    parts_o, parts_v = [np.zeros(1, np.int64)], []
    starts = np.concatenate([[0], np.cumsum(counts)])
    base = 0
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        c = counts[lo:hi]
        w = h[starts[lo] : starts[hi]]
        if len(w) >= k:
            row = np.repeat(np.arange(hi - lo, dtype=np.uint64), c)
            x = _combine(w, k)
            last = len(w) - k + 1
            same = row[:last] == row[k - 1 :]
            key = (row[:last][same] << U(48)) | (x[same] >> U(16))
            key.sort()
            if len(key):
                key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            per = np.bincount((key >> U(48)).astype(np.int64), minlength=hi - lo)
            parts_v.append(key & U((1 << 48) - 1))
        else:
            per = np.zeros(hi - lo, np.int64)
        parts_o.append(base + np.cumsum(per))
        base += int(per.sum())
    values = np.concatenate(parts_v) if parts_v else np.empty(0, np.uint64)
    return Shingled(np.concatenate(parts_o).astype(np.int64), values)


def _combine(w: np.ndarray, k: int) -> np.ndarray:
    last = len(w) - k + 1
    x = np.zeros(last, np.uint64)
    for i in range(k):
        x = x * _B + (w[i : i + last] ^ _C) * _A
        x ^= x >> U(31)
    return mix(x)


def to_bytes(values: np.ndarray) -> bytes:
    """48-bit values as six bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_bytes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def overlaps(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Number of common values of each pair of sets, given as six-byte strings."""
    out = np.zeros(len(left), np.int64)
    for i, (a, b) in enumerate(zip(left, right)):
        x = np.concatenate([from_bytes(a), from_bytes(b)])
        x.sort()
        out[i] = np.count_nonzero(x[1:] == x[:-1])
    return out
