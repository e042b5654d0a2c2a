"""An exact prefix-filter join on rare shingles, between two sides or within one.

Two sets of ``n`` and ``m`` shingles with a similarity above ``t`` share more than ``t * max(n,
m)`` of them, so they share one of the ``n - floor(t * n)`` rarest of the one and of the ``m -
floor(t * m)`` rarest of the other, whatever the order is as long as it is global. A meeting in such
a prefix counts as a candidate only if the sizes allow the similarity (``min > t * max``) and the
positions leave room for enough common shingles. No pair above the threshold is lost; what is
found has to be verified.

Texts of few different words meet by chance, in a number that grows with the square of the corpus. So a text
carries a bitmap of ``64 * WORDS`` bits in which each of its shingles turns one over. Where those of two texts
differ, one has a shingle the other lacks, so they share at most ``(n + m - differences) / 2``; a meeting that
leaves too few is dropped by the task that sees it, before anything is sent. This loses no pair; beyond about 130
shingles the bitmaps are full and drop little.

A shingle with more than ``HOT`` meetings is not joined in the task that holds it: its entries go to a
second join, which Spark splits (AQE skew join).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import blocks, frequency, shingling
from docloom.session import materialize, shuffle_partitions

U = np.uint64
HOT = 4_000_000
STEP = 2_000_000
WORDS = 3
EVAL, TRAIN = 1, 2


def candidates(rows: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """``(a, b)``: every pair of ``rows (id, text, flags)`` across the sides that may be near; frequencies are those of ``texts (text)``."""
    spark = rows.sparkSession
    order = spark.sparkContext.broadcast(frequency.count(texts, k))
    parts = blocks.parts_for(texts.count() * 32, shuffle_partitions(spark))
    packed = rows.mapInArrow(_pack_prefixes(parts, k, threshold, order), "part int, block binary")
    met = materialize(packed.repartitionById(parts, F.col("part")).mapInArrow(_meet(threshold), f"a long, b long, n int, pos int, flags int, {', '.join(f'{w} long' for w in _MARKS)}"), "prefix-meetings")
    pairs = met.where("flags = 0").select("a", "b")
    hot = met.where("flags > 0").select(F.col("a").alias("token"), F.col("b").alias("id"), "n", "pos", "flags", *_MARKS)
    x, y = hot.where("flags % 2 = 1").alias("x"), hot.where("flags > 1").alias("y")
    differ = " + ".join(f"bit_count(x.{w} ^ y.{w})" for w in _MARKS)
    allowed = f"x.token = y.token and least(x.n, y.n) > {threshold}D * greatest(x.n, y.n) and least(x.n - x.pos, y.n - y.pos) > {threshold / (1 + threshold)}D * (x.n + y.n) - 1e-6 and (x.n + y.n - ({differ})) / 2 > {threshold / (1 + threshold)}D * (x.n + y.n) - 1e-6"
    pairs = pairs.unionByName(x.join(y, F.expr(allowed)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    return materialize(pairs.distinct(), "candidates")


_MARKS = [f"w{i}" for i in range(WORDS)]


def bitmaps(s: shingling.Shingled) -> np.ndarray:
    """Shaped (WORDS, texts): a bit is set if an odd number of the text's shingles falls on it."""
    n, size = len(s.offsets) - 1, 64 * WORDS
    at = s.rows * size + (shingling.mix(s.values ^ U(0xB175)) % U(size)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * size) & 1).astype(np.uint8).reshape(n, size)
    return np.ascontiguousarray(np.packbits(odd, axis=1).view(U).T)


def _pack_prefixes(parts: int, k: int, threshold: float, order):
    def run(batches):
        for b in batches:
            b = b.filter(pc.greater(b.column(2), 0))
            both = b.column(0).to_numpy() , b.column(2).to_numpy().astype(np.int64)
            _, at = np.unique(np.stack([both[0], both[1]]), axis=1, return_index=True)
            ids, flags = both[0][at].view(np.uint64), both[1][at]
            s = shingling.shingled(b.column(1).take(pa.array(at)).to_pylist(), k)
            if not len(s.values):
                continue
            token, row, pos, n = prefixes(s, order.value, threshold)
            out = list(blocks.pack(token << U(16), row, ids, parts, [(n, 4), (pos, 4), (flags[row], 1)], marks=list(bitmaps(s))))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "block"])

    return run


def prefixes(s: shingling.Shingled, order: np.ndarray, threshold: float):
    """Tokens, rows, positions and sizes of the rarest ``n - floor(threshold * n)`` shingles of each row."""
    rows, sizes = s.rows, s.sizes
    rank = np.lexsort((s.values, order[frequency.slots(s.values)], rows))
    pos = np.arange(len(rank)) - s.offsets[:-1][rows]
    n = sizes[rows]
    keep = pos < n - np.floor(threshold * n + 1e-9).astype(np.int64)
    return s.values[rank][keep], rows[keep], pos[keep], n[keep]


def _meet(threshold: float):
    def run(batches):
        blobs = [x for b in batches for x in b.column(1).to_pylist()]
        if not blobs:
            return
        keys, ids, *marks, n, pos, flags = blocks.gather(blobs, (4, 4, 1), marks=WORDS)
        order = np.argsort(keys, kind="stable")
        marks = [w[order] for w in marks]
        keys, ids, n, pos, flags = keys[order], ids[order].view(np.int64), n[order].astype(np.int64), pos[order].astype(np.int64), flags[order].astype(np.int64)
        e, t = np.flatnonzero(flags & EVAL), np.flatnonzero(flags & TRAIN)
        lo, hi = np.searchsorted(keys[t], keys[e], "left"), np.searchsorted(keys[t], keys[e], "right")
        many = hi - lo
        # Meetings per token, to find hot ones: entries of the evaluation side times the other's.
        token, which = np.unique(keys[e], return_inverse=True)
        meetings = np.bincount(which, many, minlength=len(token))
        hot = token[meetings > HOT]
        if len(hot):
            own = np.isin(keys, hot)
            yield _rows(keys[own].view(np.int64), ids[own], n[own], pos[own], flags[own], [w[own].view(np.int64) for w in marks])
            many = np.where(meetings[which] > HOT, 0, many)
        ends = np.cumsum(many)
        found = []
        first = 0
        while first < len(e):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + STEP, "right")))
            c = many[first:last]
            i = np.repeat(e[first:last], c)
            j = t[np.repeat(lo[first:last], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
            room = np.minimum(n[i] - pos[i], n[j] - pos[j])
            ok = (np.minimum(n[i], n[j]) > threshold * np.maximum(n[i], n[j])) & (room > threshold / (1 + threshold) * (n[i] + n[j]) - 1e-6)
            i, j = i[ok], j[ok]
            both = n[i] + n[j]
            differ = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in marks)
            ok = (both - differ) / 2 > threshold / (1 + threshold) * both - 1e-6
            found.append(np.unique(np.stack([ids[i[ok]], ids[j[ok]]]), axis=1))
            first = last
        if found:
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            for at in range(0, len(a), 200_000):
                x, y = a[at : at + 200_000], b[at : at + 200_000]
                zero = np.zeros(len(x), np.int64)
                yield _rows(x, y, zero, zero, zero, [zero] * WORDS)

    return run


def _rows(a, b, n, pos, flags, marks):
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array(x.astype(np.int32)) for x in (n, pos, flags)), *(pa.array(w) for w in marks)], ["a", "b", "n", "pos", "flags", *_MARKS])
