"""The strongest n-grams of documents against plain Python, and what is moved for them."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docloom.functions import ngrams


def plain(rows, k):
    """Weights by definition; the words of ``rows`` are in lower case and apart by one blank."""
    own = defaultdict(Counter)
    for doc, text in rows:
        for w in (text or "").split():
            p = f" {w} "
            own[doc].update(p[i : i + n] for n in (3, 4, 5) for i in range(len(p) - n + 1))
    own = {d: c for d, c in own.items() if c}
    count = Counter(g for c in own.values() for g in c)
    total = sum(d is not None for d in own)
    out = set()
    for d, c in own.items():
        weights = sorted((-round((1 + math.log(n)) * math.log(total / count[g]), 6), g) for g, n in c.items())
        out |= {(d, i + 1, g, -w) for i, (w, g) in enumerate(weights[:k])}
    return out


def texts():
    r = random.Random(5)
    words = ["".join(r.choice("aabcdeßö𐐨字") for _ in range(r.choice([1, 2, 3, 5, 9]))) for _ in range(120)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 4, 40, 200])))) for i in range(60)]
    odd = [(0, "zz zz qq"), (3, "aaaaaaa"), (None, "ab abc"), (None, "abc"), (None, None), (70, ""), (71, None), (72, "a"), (73, "1 22 333")]
    return rows + odd


@pytest.mark.parametrize("known, letters", [(1 << 20, 4095), (300, 4095), (0, 4095), (1 << 20, 4)])
def test_strongest(spark, monkeypatch, known, letters):
    """Whatever is known to all tasks, the result is that of the definition; rows of one document, or of none, are one."""
    monkeypatch.setattr(ngrams, "KNOWN", known)
    monkeypatch.setattr(ngrams, "LETTERS", letters)
    rows = texts()
    got = {(r.d, r["rank"], r.gram, r.weight + 0.0) for r in ngrams.strongest(spark.createDataFrame(rows, "d bigint, t string"), "d", "t", 10).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in plain(rows, 10)}
    assert dict((x[:3], x[3]) for x in got) == pytest.approx(dict((x[:3], x[3]) for x in plain(rows, 10)), abs=1e-5)


@pytest.mark.parametrize("letters", [40, 7000])
def test_pieces(monkeypatch, letters):
    """Documents in pieces of any size and words of many letters have the n-grams they have."""
    r = random.Random(6)
    words = [["".join(chr(0x4E00 + r.randrange(letters)) for _ in range(r.randrange(1, 9))) for _ in range(r.choice([0, 3, 900]))] for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([*(" ".join(ws) for ws in words[:-1]), None])], ["d", "words"])
    for size in (1 << 21, 500):
        monkeypatch.setattr(ngrams, "CHUNK", size)
        got = {}
        for docs, grams, doc, gram, n in ngrams._chunks([batch]):
            names = ngrams._names(grams).to_pylist()
            assert names == sorted(names)
            got |= {(docs[int(d)].as_py(), names[g]): int(x) for d, g, x in zip(doc, gram, n)}
        want = Counter((d, f" {w} "[i : i + n]) for d, ws in enumerate(words[:-1]) for w in ws for n in (3, 4, 5) for i in range(len(w) + 3 - n))
        assert got == dict(want)
        assert {(docs[int(d)].as_py(), ngrams._names(grams[[g]])[0].as_py()) for docs, grams, doc, gram, _ in ngrams._chunks([batch], False) for d, g in zip(doc, gram)} == set(want)


def test_no_row_for_each_gram_of_each_document(spark, tmp_path):
    """What is shuffled for the query is less than its texts (before: several times as much)."""
    from docloom.plans import registry

    r = np.random.default_rng(7)
    words = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(300)]
    rows = [(i, " ".join(words[j] for j in r.integers(0, 300, 100))) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    assert registry.QUERIES["char_ngram_tfidf"](spark, str(tmp_path)).count() == 20_000
    assert shuffled() - before < sum(len(t) for _, t in rows)
