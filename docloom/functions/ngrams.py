"""The strongest character n-grams of every document, without a row for each n-gram of each document.

An n-gram's weight needs the number of documents that have it, so documents are read twice. The first time every task
counts its own documents, and only its counts are shuffled, one row per n-gram and piece of work. The second time the n-grams of a
document that cannot be among its strongest are dropped where they are seen. For that, all tasks know the counts of the
``KNOWN`` most frequent n-grams (at most 12 MB, at any size of the corpus), and of all others that they are in one document at least and in
no more than the most frequent of them. What may be among the strongest gets its count by a join, unless it is known, and is ranked after, so
the result is exact; a larger vocabulary costs rows, never results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import features
from docloom.session import materialize

LOW, HIGH = 3, 5
#: N-grams whose counts are known to all tasks, and the letters these may have: codes of 12 bits, five in a key.
KNOWN, LETTERS = 1 << 20, 4095
#: N-grams that are spread out at a time; a longer document is by itself.
CHUNK = 1 << 22
#: More than weights that are equal when rounded to six places can be apart.
APART = 2e-6


def strongest(documents: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    """``(doc, rank, gram, weight)``: the ``k`` n-grams of each document with the largest ``tf_idf``, rounded to six places; equal ones by n-gram.

    Rows of the same document are one document; documents without an identity are one, which is not counted.
    """
    texts = documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("__doc"), F.col(text).alias("__text"))
    if not texts.groupBy("__doc").count().where("count > 1").isEmpty():
        # A line end is no part of a word.
        texts = materialize(texts.groupBy("__doc").agg(F.array_join(F.collect_list("__text"), "\n").alias("__text")), "whole-texts")
    # The words of features.words, apart by one blank.
    rows = texts.select("__doc", F.trim(F.regexp_replace(F.lower("__text"), features.WORD, " ")).alias("words"))
    counts = materialize(rows.mapInArrow(_count, "gram string, d bigint").groupBy("gram").agg(F.sum("d").alias("d")), "gram-counts")
    # One row: the count of documents.
    first = counts.where("gram = ''").first()
    total = first[1] if first else 0
    counts = counts.where("gram <> ''")
    known = _known(counts)
    shared = documents.sparkSession.sparkContext.broadcast((*known, total))
    kept = rows.mapInArrow(_choose(shared, k), f"__doc {texts.schema['__doc'].dataType.simpleString()}, gram string, n bigint, d bigint")
    if known[3]:
        kept = materialize(kept, "gram-candidates")
        kept = kept.where("d is not null").unionByName(kept.where("d is null").drop("d").join(counts, "gram"))
    w = kept.select(F.col("__doc").alias(doc), "gram", F.round((1 + F.log("n")) * F.log(F.lit(float(total)) / F.col("d")), 6).alias("weight"))
    return features.top_per_group(w, doc, [F.desc("weight"), F.col("gram")], k).select(doc, F.col("rank").cast("bigint").alias("rank"), "gram", "weight")


def _known(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Letters, keys in order, and counts of the most frequent n-grams; the largest count of the others, 0 if there are none."""
    step = F.floor(8 * F.log2("d")).alias("step")
    # Eight rows for each doubling of the number of documents.
    steps = sorted(counts.groupBy(step).agg(F.min("d"), F.max("d"), F.count(F.lit(1))).collect(), reverse=True)
    size, least, rest = 0, None, 0
    for _, low, high, n in steps:
        size += n
        if size > KNOWN:
            rest = high
            break
        least = low
    if least is None:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), rest
    found = counts.where(F.col("d") >= least).toArrow()
    grams, d = np.array(found["gram"].to_pylist(), f"U{HIGH}").view(np.uint32).reshape(-1, HIGH), found["d"].to_numpy()
    often = np.bincount(grams.ravel())
    often[0] = 0
    letters = np.sort(np.argsort(-often, kind="stable")[: min(LETTERS, np.count_nonzero(often))]).astype(np.uint32)
    keys, whole = _keys(grams, letters)
    order = np.argsort(keys[whole])
    return letters, keys[whole][order], d[whole][order], int(max(rest, d[~whole].max(initial=0)))


def _keys(grams: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of n-grams by the codes of their letters, and whether all of these have one."""
    code = np.zeros(max(int(grams.max(initial=0)), int(letters.max(initial=0))) + 1, np.int64)
    code[letters] = np.arange(1, len(letters) + 1)
    codes = code[grams]
    key = np.zeros(len(grams), np.int64)
    for column in codes.T:
        key = key << 12 | column
    return key, ((codes > 0) | (grams == 0)).all(axis=1)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams in order, as rows of letters filled up with 0; the numbers of each word's n-grams in turn, every occurrence; how many each word has."""
    letters = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
    blank = letters == 32
    code = np.cumsum(np.bincount(letters) > 0)
    base = int(code[-1]) + 1
    inner = np.concatenate([~blank, np.zeros(HIGH, bool)])
    here = np.flatnonzero(inner[1 : len(letters)] & (np.arange(1, len(letters)) + 1 < len(letters)))
    ok = np.ones((len(here), HIGH - LOW + 1), bool)
    for n in range(LOW + 1, HIGH + 1):
        ok[:, n - LOW] = ok[:, n - LOW - 1] & inner[here + n - 2] & (here + n <= len(letters))
    a = np.concatenate([code[letters], np.zeros(HIGH, np.int64)])
    key = np.zeros(len(here), np.int64)
    for i in range(LOW):
        key = key * base + a[here + i]
    if base**HIGH >= 1 << 63:
        key = np.unique(key, return_inverse=True)[1]
    keys = np.empty(ok.shape, np.int64)
    keys[:, 0] = key * base ** (HIGH - LOW)
    for n in range(LOW + 1, HIGH + 1):
        keys[:, n - LOW] = keys[:, n - LOW - 1] + a[here + n - 1] * base ** (HIGH - n)
    _, at, ids = np.unique(keys[ok], return_index=True, return_inverse=True)
    start, width = (np.broadcast_to(x, ok.shape)[ok][at] for x in (here[:, None], np.arange(LOW, HIGH + 1)))
    padded = np.concatenate([letters, np.zeros(HIGH, np.uint32)])
    grams = np.stack([np.where(width > i, padded[start + i], 0) for i in range(HIGH)], axis=1).astype(np.uint32)
    owner = np.cumsum(blank)[here] - 1
    return grams, ids, np.bincount(owner, ok.sum(axis=1), len(words)).astype(np.int64)


def _names(grams: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(grams).view(f"<U{HIGH}").ravel().tolist(), pa.string())


def _chunks(batches, often: bool = True):
    """``(docs, grams, doc, gram, n)`` of some documents at a time: their identities; the n-grams; how often each document, by place, has each n-gram, by both (``often``; else not counted)."""
    for b in batches:
        b = b.filter(pc.not_equal(b.column(1), ""))
        lists = pc.split_pattern(b.column(1), " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        words = lists.flatten()
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        spread = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])[ends[:-1]] * (HIGH - LOW + 1) // CHUNK
        for lo, hi in zip(*(lambda cut: (cut, [*cut[1:], len(sizes)]))(np.flatnonzero(np.diff(spread, prepend=-1)).tolist())):
            yield b.column(0).slice(lo, hi - lo), *_counted(sizes[lo:hi], words.slice(ends[lo], ends[hi] - ends[lo]).dictionary_encode(), often)


def _counted(sizes: np.ndarray, words: pa.DictionaryArray, often: bool):
    grams, ids, lengths = _grams(words.dictionary.to_pylist())
    pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(lengths) + words.indices.to_numpy(), return_counts=True)
    doc, word = np.divmod(pairs, len(lengths))
    many = lengths[word]
    ends = np.cumsum(many)
    place = np.arange(ends[-1]) + np.repeat((np.cumsum(lengths) - lengths)[word] - (ends - many), many)
    bits, low = int(len(grams) - 1).bit_length(), int(times.max()).bit_length()
    key = np.repeat(doc << bits, many) | ids[place]
    if not often:
        if len(sizes) << bits < 1 << 31:
            key = key.astype(np.int32)
        key.sort()
        key = key[np.flatnonzero(np.diff(key, prepend=key.dtype.type(-1)))]
        return grams, key >> bits, key & ((1 << bits) - 1), None
    n = np.repeat(times, many)
    if len(sizes) << (bits + low) < 1 << 63:
        key <<= low
        key |= n
        key.sort()
        key, n = key >> low, key & ((1 << low) - 1)
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return grams, key[first] >> bits, key[first] & ((1 << bits) - 1), np.add.reduceat(n, first)


def _count(batches):
    """How many documents have each n-gram, by piece of work; under the empty one, how many with an identity have any."""
    for docs, grams, doc, gram, _ in _chunks(batches, False):
        some = np.zeros(len(docs), bool)
        some[doc] = True
        named = int((some & docs.is_valid().to_numpy(zero_copy_only=False)).sum())
        d = np.concatenate([np.bincount(gram, minlength=len(grams)), [named]])
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([_names(grams), pa.array([""])]), pa.array(d, pa.int64())], ["gram", "d"])


def _choose(shared, k: int):
    """The n-grams that may be among the ``k`` strongest of their documents, with their counts if these are known."""

    def run(batches):
        letters, keys, counts, rest, total = shared.value
        for docs, grams, doc, gram, n in _chunks(batches):
            own, whole = _keys(grams, letters)
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            d = np.where(whole & (keys[at] == own), counts[at], 0) if len(keys) else np.zeros(len(grams), np.int64)
            with np.errstate(divide="ignore"):
                least, most = (np.log(total / np.where(d, d, x)) for x in (max(1, rest), 1))
            tf = 1 + np.log(n)
            low = tf * least[gram]
            cuts = np.searchsorted(doc, np.arange(len(docs) + 1)).tolist()
            bound = np.full(len(docs), -np.inf)
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b - a > k:
                    bound[i] = np.partition(low[a:b], b - a - k)[b - a - k]
            keep = np.flatnonzero(tf * most[gram] >= bound[doc] - APART)
            doc, gram, n = doc[keep], gram[keep], n[keep]
            d = d[gram]
            # Of n-grams that are as frequent in the document and in the corpus, the first in order go before the others.
            order = np.lexsort((gram, d, n, doc))
            new = np.flatnonzero(np.any([np.diff(x[order], prepend=-1) != 0 for x in (doc, n, d)], axis=0))
            place = np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order)))
            order = np.sort(order[(place < k) | (d[order] == 0)])
            doc, gram, n, d = doc[order], gram[order], n[order], d[order]
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(doc)), _names(grams[gram]), pa.array(n, pa.int64()), pa.array(d, pa.int64(), mask=d == 0)], ["__doc", "gram", "n", "d"])

    return run
