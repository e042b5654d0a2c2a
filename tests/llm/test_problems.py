"""The operators for training data against brute force on small fixtures, and on awkward input."""

import bisect
import itertools
import random
import re
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.text import normal_key
from docloom.llm import blocks, bloom, components, forest, frequency, history, hyperminhash, mixing, near, overlap, packing, prefix, quality, queries, sampling, shingling, splits, store, tokens
from docloom.session import materialize, shared_path

HYPHEN, BLANK, WORD = re.compile(r"(\w)-\s*\n\s*(\w)"), re.compile(r"\s+"), re.compile(r"[^\W_]+")


def words(t):
    return WORD.findall(BLANK.sub(" ", HYPHEN.sub(r"\1\2", unicodedata.normalize("NFKC", t))).strip().lower())


def shingle_set(t):
    w = words(t)
    return set(zip(w, w[1:], w[2:])) if len(w) >= 12 else set()


def similarity(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def near_pairs(texts: dict) -> set:
    names = sorted(texts)
    sets = {n: shingle_set(texts[n]) for n in names}
    out = set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) > 0.5 * len(x | y):
                out.add((a, b))
    return out


def closed(pairs: set) -> set:
    group = {}

    def find(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in pairs:
        group[find(a)] = find(b)
    members = defaultdict(list)
    for x in group:
        members[find(x)].append(x)
    return {(a, b) for m in members.values() for a in m for b in m if a < b}


def sentence(rnd, n):
    return [rnd.choice(["der", "die", "und", "wort"]) + str(rnd.randint(0, 4000)) for _ in range(n)]


def corpus(seed=1, families=25, size=4):
    """Families of edited texts, fillers, copies, and texts that are near to nothing."""
    rnd, texts = random.Random(seed), {}
    for f in range(families):
        base = sentence(rnd, rnd.randint(30, 80))
        for v in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, len(w) // 10)):
                i = rnd.randrange(len(w))
                w[i : i + rnd.choice([0, 1])] = sentence(rnd, rnd.choice([0, 1, 1]))
            texts[f"f{f:02}-{v}"] = " ".join(w)
    for i in range(60):
        texts[f"x{i:02}"] = " ".join(sentence(rnd, 40))
    texts |= {"copy-a": texts["x00"], "copy-b": texts["x00"], "short-a": "nur elf " * 5 + "ende", "short-b": "nur elf " * 5 + "ende", "empty": "", "upper": texts["x01"].upper(), "hyphen": texts["x02"][:20] + texts["x02"][20:].replace("wort", "wo-\n rt", 3)}
    return texts


# Building blocks


def test_shingles_match_the_definition():
    texts = list(corpus().values()) + ["ﬁnal " * 15, "²³ ½ x_y " * 6, "ÄÖÜ straße İstanbul " * 6]
    s = shingling.shingled(texts)
    assert s.sizes.tolist() == [len(shingle_set(t)) for t in texts]
    sets = [shingling.to_bytes(s.values[a:b]) for a, b in zip(s.offsets, s.offsets[1:])]
    common = shingling.overlaps(sets[:-1], sets[1:])
    assert common.tolist() == [len(shingle_set(a) & shingle_set(b)) for a, b in zip(texts, texts[1:])]
    assert shingling.shingled([]).sizes.tolist() == [] and shingling.shingled([None, ""]).sizes.tolist() == [0, 0]
    assert (shingling.shingled(list(texts)).sizes > 0).tolist() == [len(words(t)) >= 12 for t in texts]


def test_sketch_merges_and_estimates():
    rnd = random.Random(2)
    a, b = " ".join(sentence(rnd, 300)), " ".join(sentence(rnd, 50))
    s = shingling.shingled([a, b])
    raw = hyperminhash.raw_sketch(s, 6)
    both = shingling.Shingled(np.array([0, len(np.unique(s.values))]), np.unique(s.values))
    assert (np.minimum(raw[0], raw[1]) == hyperminhash.raw_sketch(both, 6)[0]).all()
    assert (hyperminhash.fill(raw.reshape(-1, 16)).reshape(raw.shape) == hyperminhash.sketch(s, 6)).all()
    errors = []
    for _ in range(60):
        base = sentence(rnd, 100)
        other = [w if rnd.random() > 0.08 else "neu" + str(rnd.random()) for w in base]
        t = [" ".join(base), " ".join(other)]
        s = shingling.shingled(t)
        r = hyperminhash.short(hyperminhash.sketch(s, 8), 8)
        errors.append(hyperminhash.jaccard(r[:1], r[1:], s.sizes[:1], s.sizes[1:])[0] - similarity(*t))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    keys, rows, ids = rng.integers(0, 2**64, 5000, dtype=np.uint64), rng.integers(0, 700, 5000), rng.integers(0, 2**64, 700, dtype=np.uint64)
    got = [blocks.unpack(b, (4,)) for _, b in blocks.pack(keys, rows, ids, 7, [(rows, 4)])]
    k, i, r = (np.concatenate(x) for x in zip(*got))
    order = np.argsort(keys)
    assert (k == keys[order] >> np.uint64(24)).all() and (r == rows[order]).all() and (i == ids[rows[order]]).all()
    assert list(blocks.pack(keys[:0], rows[:0], ids, 3)) == []


def test_bloom_and_frequencies(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("k"))
    b = bloom.build(df, "k", 5000)
    keys = np.array([r.k for r in df.collect()], np.int64).view(np.uint64)
    assert b.contains(keys).all() and b.contains(keys + np.uint64(1)).mean() < 0.05
    assert df.where(~b.column("k")).count() == 0
    assert not bloom.build(df.limit(0), "k", 0).contains(keys).any()
    texts = list(corpus().values())
    t = spark.createDataFrame([(x,) for x in texts], "t string").repartition(3)
    table = frequency.count(t)
    want = np.zeros(frequency.SLOTS, int)
    for x in texts:
        np.add.at(want, frequency.slots(shingling.shingled([x]).values), 1)
    assert (table == frequency.level(want)).all()
    assert frequency.level(np.array([0, 1, 2, 2**40])).tolist() == [0, 4, 6, 160]


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (5, 5)]
    df = spark.createDataFrame([*pairs, (None, 1), (2, None)], "a long, b long")
    got = {r.node: r.component for r in components.hash_to_min(df).collect()}
    assert {(a, b) for a in got for b in got if a < b and got[a] == got[b]} == closed({p for p in pairs})
    assert all(c <= n for n, c in got.items()) and components.hash_to_min(df.limit(0)).count() == 0


# Problem 1


def test_splits_keep_related_records_together(spark):
    rows = [(f"p{i}", None if i % 7 == 0 else f"t{i % 13}", "A" if i % 13 < 6 else None) for i in range(200)] + [("p1", "t20", "A"), (None, None, "B"), (None, None, "B"), (None, "t3", "A")]
    df = spark.createDataFrame(rows, "source_path string, template string, class string").withColumn("component_x", F.lit(1))
    out = splits.assign_splits(df, ["template", "source_path"], "class", {"gold": 5, "train": 2, "calib": 1})
    got = out.collect()
    assert len(got) == len(rows) and set(out.columns) >= {"component_x", "assigned_split"}
    for key in ("template", "source_path", "component"):
        seen = defaultdict(set)
        for r in got:
            if r[key] is not None:
                seen[r[key]].add(r.assigned_split)
        assert all(len(s) == 1 for s in seen.values())
    assert len({r.component for r in got if r.template in ("t1", "t20")}) == 1
    again = {(r.source_path, r.template): r.assigned_split for r in splits.assign_splits(df.repartition(7), ["template", "source_path"], "class", {"calib": 1, "gold": 5, "train": 2}).collect()}
    assert again == {(r.source_path, r.template): r.assigned_split for r in got}
    assert splits.assign_splits(df.limit(0), ["template", "source_path"], "class", {"gold": 1.0}).count() == 0


def test_splits_reach_the_proportions_although_one_template_is_half_of_a_class(spark):
    rows = [(f"a{i}", "hot" if i < 480 else f"t{i % 97}", "A") for i in range(1000)] + [(f"b{i}", f"u{i % 8}", "B") for i in range(400)] + [(f"c{i}", None, "C") for i in range(3000)]
    want = {"gold": 5 / 8, "calib": 1 / 8, "train": 2 / 8}
    out = splits.assign_splits(spark.createDataFrame(rows, "source_path string, template string, class string"), ["template", "source_path"], "class", want)
    got = {(r["class"], r.assigned_split): r["count"] for r in out.groupBy("class", "assigned_split").count().collect()}
    for c, n, most in (("A", 1000, 0.02), ("B", 400, 0.001), ("C", 3000, 0.05)):
        for name, share in want.items():
            assert got.get((c, name), 0) / n == pytest.approx(share, abs=most), (c, name)


def test_rendezvous_proportions(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("c"))
    share = lambda w: {r[0]: r[1] / 20000 for r in df.select(splits.rendezvous(F.col("c"), w, "s").alias("s")).groupBy("s").count().collect()}
    got = share({"gold": 5, "calib": 1, "train": 2})
    assert got["gold"] == pytest.approx(0.625, abs=0.015) and got["calib"] == pytest.approx(0.125, abs=0.01)
    both = df.select(splits.rendezvous(F.col("c"), {"a": 1, "b": 1}, "s").alias("x"), splits.rendezvous(F.col("c"), {"a": 1, "b": 2}, "s").alias("y"))
    assert both.where("x = 'b' and y = 'a'").count() == 0  # a larger share of b only draws rows to b


def test_conflicting_and_names(spark):
    rows = [("a", "T-1", "gold"), ("b", "t_1 ", " GOLD"), ("c", "Ｔ 1", "train"), ("d", "t2", "gold"), ("e", "t2", None), ("f", None, "train"), ("g", "--", "gold"), ("h", "--", "train")]
    df = spark.createDataFrame(rows, "source_path string, template_id string, s string").select("source_path", normal_key("template_id").alias("template"), overlap.split_value("s").alias("split"))
    assert sorted(r.source_path for r in splits.conflicting(df.where("template is not null"), ["template"], "split").collect()) == ["a", "b", "c"]


# Problem 2


def found(spark, texts, **kw):
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "segment_id string, text string, id string").repartition(5)
    df = df.unionByName(df.limit(20))  # repeated rows
    return {tuple(r) for r in near.group_pairs(near.near_groups(df, "segment_id", "text", **kw), "segment_id").collect()}


def test_near_groups_equal_brute_force(spark):
    texts = corpus()
    want = closed(near_pairs(texts))
    assert ("copy-a", "copy-b") in want and ("upper", "x01") in want and not any("short-a" in p for p in want)
    assert found(spark, texts) == want


def test_near_groups_with_large_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "STAR", 3)
    monkeypatch.setattr(near, "BLOCK", 2)
    texts = corpus(5, families=6, size=14)
    assert found(spark, texts) == closed(near_pairs(texts))


def test_near_groups_of_one_large_bucket(spark, monkeypatch):
    """Half of all texts are edits of one: candidates grow with the texts, not with their pairs."""
    rnd = random.Random(8)
    base = sentence(rnd, 80)
    texts = {}
    for i in range(300):
        w = list(base)
        w[rnd.randrange(80)] = f"z{i}"
        texts[f"n{i}"] = " ".join(w)
        texts[f"o{i}"] = " ".join(sentence(rnd, 40))
    seen, real = [], near.verified

    def counted(nodes, pairs, threshold, k=3):
        pairs = materialize(pairs, "counted")
        seen.append(pairs.count())
        return real(nodes, pairs, threshold, k)

    monkeypatch.setattr(near, "verified", counted)
    df = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(4)
    rows = near.near_groups(df, "id", "text").collect()
    assert {r.id for r in rows if r.group_size == 300} == {f"n{i}" for i in range(300)}
    assert {r.group_id for r in rows if r.group_size == 300} == {"n0"}
    assert sum(seen) < 60 * 300  # all pairs would be 44 850


def test_near_groups_odd_input(spark):
    schema = "segment_id string, text string"
    long = " ".join(sentence(random.Random(9), 30_000))
    df = spark.createDataFrame([(None, "a b c"), ("a", None), ("b", ""), ("c", long), ("d", long + " ende"), ("e", long)], schema)
    g = near.near_groups(df, "segment_id", "text").collect()
    assert sorted(r.segment_id for r in g) == ["c", "d", "e"] and {r.group_size for r in g} == {3}
    assert near.near_groups(df.limit(0), "segment_id", "text").count() == 0


# Problem 3


def test_sample_is_stable(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 == 0, "gold").when(F.col("id") % 3 == 1, "train").alias("s"), F.lit(0.5).alias("unit"))
    draw = lambda d, rate: {r.k for r in sampling.stable_sample(d, F.col("k"), rate, F.col("s")).collect()}
    small = draw(df.where("id < 1500") if "id" in df.columns else df.limit(1500), 0.2)
    all_rows = draw(df.repartition(9), 0.2)
    first = {r.k for r in df.limit(1500).collect()}
    assert small == all_rows & first and draw(df, 0.4) >= all_rows
    assert len(all_rows) == pytest.approx(400, abs=70)
    assert draw(df, {"gold": 1.0}) == {r.k for r in df.where("s = 'gold'").collect()}
    assert draw(df, {"gold": 0.0}) == set() and draw(df.limit(0), 0.5) == set()
    assert sampling.stable_sample(spark.createDataFrame([(None,)], "k string"), F.col("k"), 1.0).count() == 0


# Problem 4


def sequential(docs, segments):
    """One document after the other, by the letter of the definition."""
    text = {}
    for d in {r[0] for r in segments}:
        own = sorted({(i, s, t) for x, s, i, t in segments if x == d})
        text[d] = " ".join(t for _, _, t in own)
    first = {}
    for d, at, dig in docs:
        if d not in first or at < first[d][0]:
            first[d] = (at, dig)
    sets = {d: shingle_set(t) for d, t in text.items()}
    accepted, digests, cases = [], set(), set()
    for d, (_, dig) in sorted(first.items(), key=lambda x: (x[1][0], x[0])):
        m = re.search("[0-9a-f]{64}$", (dig or "").lower().strip())
        dig = m and m[0]
        mine = sets.get(d, set())
        if dig in digests or any(mine and sets[a] and len(mine & sets[a]) > 0.5 * len(mine | sets[a]) for a in accepted if a in sets):
            cases.add(d)
        else:
            accepted.append(d)
            if dig:
                digests.add(dig)
    return cases


def archive(seed=6):
    rnd, texts = random.Random(seed), corpus(seed, 12, 5)
    names = sorted(texts)
    rnd.shuffle(names)
    docs, segments = [], []
    t0 = datetime(2026, 1, 1)
    for n, name in enumerate(names):
        d = f"{rnd.randrange(16**8):08x}{n:03}"
        digest = f"{rnd.randrange(10**9) if rnd.random() > 0.1 else 7:064x}"
        docs.append((d, t0 + timedelta(days=n // 25), rnd.choice(["{}", "sha256:{}", " {} ", "{}"]).format(digest.upper() if rnd.random() < 0.3 else digest)))
        w = texts[name].split(" ")
        cut = [0, len(w) // 3, len(w)]
        for i, (a, b) in enumerate(zip(cut, cut[1:])):
            segments.append((d, f"{d}-{i}", 3 * i, " ".join(w[a:b])))
    long = [" ".join(sentence(rnd, 30)) for _ in range(150)]
    for d, day, parts in (("long-1", 0, long), ("long-2", 3, long[:130] + long[10:20])):
        docs.append((d, t0 + timedelta(days=day), None))
        segments += [(d, f"{d}-{i}", i, t) for i, t in enumerate(parts)]
    docs += [(docs[0][0], t0 + timedelta(days=9), docs[0][2]), ("no-text", t0, "kaputt"), ("no-text-2", t0, "kaputt")]
    return docs, segments + segments[:30]


def load(spark, docs, segments):
    d = spark.createDataFrame(docs, "document_id string, ingested_at timestamp, content_sha256 string").withColumn("id", F.lit(0))
    return d, spark.createDataFrame(segments, "document_id string, segment_id string, index long, text string").repartition(6)


@pytest.mark.parametrize("star", [forest.STAR, 2])
def test_history_equals_one_after_the_other(spark, monkeypatch, star):
    monkeypatch.setattr(forest, "STAR", star)
    monkeypatch.setattr(history, "RUNS", 1)  # merges after the second load
    docs, segments = archive()
    want = sequential(docs, segments)
    assert "long-2" in want and len(want) > 20
    d, s = load(spark, docs, segments)
    ordered = materialize(history.in_order(d), "ordered")
    store, got = history.History(spark, shared_path(spark, "history")), set()
    days = sorted({r[0] for r in ordered.select("at").distinct().collect()})
    for lo, hi in ((0, 2), (2, 3), (3, len(days))):
        part = ordered.where(F.col("at").isin(days[lo:hi]))
        got |= {r.document_id for r in store.add_ordered(part, s).where("is_case").collect()}
    assert got == want


@pytest.mark.parametrize("blocks_of_stored", [1, 3])
def test_history_meets_what_is_stored_in_large_ranges(spark, blocks_of_stored):
    """A form that fills large ranges of a batch: its texts are below the threshold of each other and of the earliest, but some
    are just above it of a stored text (of one row, or of several blocks) that has the form too."""
    rnd = random.Random(11)
    some = lambda n: [f"w{rnd.randrange(10**8)}" for _ in range(n)]
    form, own, t0 = some(400), [some(200) for _ in range(240)], datetime(2026, 1, 1)
    texts = {f"d{i:03}": [*form, *w] for i, w in enumerate(own)}
    stored = {f"s{i}": [*form, *own[40 * i + 7][:4], *some(196)] for i in range(6)}
    docs = [(n, t0, None) for n in stored] + [(n, t0 + timedelta(days=1), None) for n in texts]
    cut = lambda w: [w[i::1][: len(w) // blocks_of_stored] for i in range(0, len(w), len(w) // blocks_of_stored)]
    segments = [(n, f"{n}-{i}", i * history.BLOCK, " ".join(w)) for n, all_ in stored.items() for i, w in enumerate(cut(all_))] + [(n, f"{n}-0", 0, " ".join(w)) for n, w in texts.items()]
    want = sequential(docs, segments)
    assert want == {f"d{40 * i + 7:03}" for i in range(6)}
    d, s = load(spark, docs, segments)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one task has the whole batch, so ranges are large in it
    try:
        store, got = history.History(spark, shared_path(spark, "history")), set()
        for day in (0, 1):
            part = d.where(F.col("ingested_at") == F.lit(t0 + timedelta(days=day)))
            got |= {r.document_id for r in store.add(part, s).where("is_case").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


def test_history_odd_input(spark):
    d, s = load(spark, [("a", None, None), ("b", datetime(2026, 1, 1), "x" * 64), (None, datetime(2026, 1, 1), "y")], [("c", "c-0", 0, "text")])
    s = s.unionByName(spark.createDataFrame([("a", None, None, None), (None, "z", 0, "t"), ("b", "b-0", None, "kurz")], s.schema))
    store = history.History(spark, shared_path(spark, "history"))
    assert {(r.document_id, r.is_case) for r in store.add(d, s).collect()} == {("a", False), ("b", False)}
    assert store.add(d.limit(0), s.limit(0)).count() == 0
    assert history.prefix_length(0.5) == 4 and history.prefix_length(0.9) > 4


def test_history_of_batches_with_their_own_segments(spark):
    """A stored document of several blocks is compared as a whole though only its own batch had its segments."""
    rnd = random.Random(4)
    parts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(12)) for _ in range(192)]
    d, s = load(spark, [("long", datetime(2026, 1, 1), None), ("whole", datetime(2026, 1, 2), None)], [("long", f"l-{i}", i, t) for i, t in enumerate(parts)] + [("whole", "w-0", 0, " ".join([*parts, "und noch ein Satz"]))])
    store, got = history.History(spark, shared_path(spark, "history")), {}
    for name in ("long", "whole"):
        own = F.col("document_id") == name
        got |= {r.document_id: r.is_case for r in store.add(d.where(own), s.where(own)).collect()}
    assert got == {"long": False, "whole": True}


def test_history_reads_only_what_a_batch_touches(spark):
    """A second job opens the store, and its batch reads the row groups its labels and keys fall into."""
    texts = corpus(9, 250, 1)
    names = sorted(texts)
    docs = [(n, datetime(2026, 1, 1 + (i == len(names) - 1)), None) for i, n in enumerate(names)]
    segments = [(n, f"{n}-0", 0, texts[n]) for n in names]
    d, s = load(spark, docs, segments)
    path = shared_path(spark, "history")
    first = history.History(spark, path)
    old = F.col("ingested_at") < F.lit(datetime(2026, 1, 2))
    assert first.add(d.where(old), s).where("is_case").count() == len(sequential(docs, segments) - {names[-1]})
    second = history.History(spark, path)
    assert second.next == len(names) - 1 and len(second.runs) == 1 and second.made["threshold"] == 0.5
    with pytest.raises(ValueError):
        history.History(spark, path, threshold=0.7)
    # The blocks of a share of the key space: a query reads the one its range falls into.
    uri, parts = second._forest(second.runs)[0]
    everything = sum(len(t["block"][i].as_py()) for p in range(parts) for t in store.everything(f"{uri}/bucket={p}", ["block"]) for i in range(t.num_rows))
    lo = next(store.everything(f"{uri}/bucket=0", ["lo"]))["lo"].to_numpy()[:1]
    store.READ["bytes"] = 0
    assert sum(t.num_rows for p in range(parts) for t in store.overlapping(f"{uri}/bucket={p}", "lo", "hi", lo, lo, ["lo", "hi", "block"])) > 0
    assert 0 < store.READ["bytes"] < everything / parts * 2
    got = {r.document_id: r.is_case for r in second.add(d, s).collect()}
    assert set(got) == {names[-1]}  # the others were taken before
    assert got[names[-1]] == (names[-1] in sequential(docs, segments))
    with pytest.raises(RuntimeError):
        first._commit([], 0)  # another writer was there


def test_forest_recall_and_parts():
    assert forest.recall_at(0.5, history.prefix_length(0.5)) >= 0.98 > forest.recall_at(0.5, history.prefix_length(0.5) + 1)
    byte = np.random.default_rng(1).integers(0, 256, (40, forest.REPS * hyperminhash.BUCKETS), dtype=np.uint8)
    keys = forest.keys_of(byte)
    assert keys.shape == (40, forest.TREES) and len(np.unique((keys >> np.uint64(24)) & np.uint64(255))) == forest.TREES


def test_history_decides_long_chains(spark, monkeypatch):
    """Forty versions, each near the one before only: every other one is accepted, in few rounds."""
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(40 * 12 + 60)]
    docs = [(f"d{i:02}", datetime(2026, 1, 1), None) for i in range(40)]
    segments = [(f"d{i:02}", f"d{i:02}-0", 0, " ".join(words[12 * i : 12 * i + 60])) for i in range(40)]
    monkeypatch.setattr(history, "ROUNDS", 1)
    d, s = load(spark, docs, segments)
    got = {r.document_id for r in history.History(spark, shared_path(spark, "history")).add(d, s).where("is_case").collect()}
    assert got == sequential(docs, segments) and len(got) == 20


@pytest.mark.parametrize("few", [None, 0])
def test_history_decides_small_batches_in_one_step(spark, monkeypatch, few):
    """No rounds for a small batch; in rounds, and chains by component, the result is the same."""
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(40 * 12 + 60)]
    docs = [(f"d{i:02}", datetime(2026, 1, 1), None) for i in range(40)]
    segments = [(f"d{i:02}", f"d{i:02}-0", 0, " ".join(words[12 * i : 12 * i + 60])) for i in range(40)]
    monkeypatch.setattr(history, "ROUNDS", 1)
    if few is not None:
        monkeypatch.setattr(history, "FEW", few)
    made, write = [], history.materialize
    monkeypatch.setattr(history, "materialize", lambda df, label: (made.append(label), write(df, label))[1])
    d, s = load(spark, docs, segments)
    got = {r.document_id for r in history.History(spark, shared_path(spark, "history")).add(d, s).where("is_case").collect()}
    assert got == sequential(docs, segments) and len(got) == 20
    assert ("states" in made) == (few == 0)


def test_loads_get_their_own_segments_only(spark, monkeypatch):
    add, given = history.History.add, []

    def seen(self, documents, segments):
        given.append(({r[0] for r in documents.select("document_id").collect()}, [r[0] for r in segments.select("document_id").collect()]))
        return add(self, documents, segments)

    monkeypatch.setattr(history.History, "add", seen)
    d = "/root/testdata/sf0.001"
    got = {r["document_id"] for r in queries.p4_decided(spark, d).collect()}
    whole = spark.read.parquet(f"{d}/ingested_documents.parquet").where("document_id is not null").select("document_id").distinct()
    assert got == {r[0] for r in whole.collect()} and len(given) == 8
    wanted = Counter(r[0] for r in spark.read.parquet(f"{d}/segments.parquet").where("document_id is not null and text is not null").select("document_id").collect())
    for documents, segments in given:
        assert Counter(segments) == Counter({k: n for k, n in wanted.items() if k in documents})


# Problem 5


def test_overlap_equals_brute_force(spark, monkeypatch):
    texts = corpus(7)
    rnd = random.Random(8)
    side = {k: rnd.choice(["train", " Train ", "gold", "CALIB", None, "test"]) for k in texts} | {"copy-a": "train", "copy-b": "gold"}
    docs = spark.createDataFrame([(f"d-{k}", f"p/{k}") for k in texts for _ in range(2)], "document_id string, source_path string")
    man = spark.createDataFrame([(f"p/{k}", v) for k, v in side.items() if k != "x05"], "source_path string, split string")
    seg = spark.createDataFrame([(k, f"d-{k}", t, "a") for k, t in texts.items()] + [("n", "d-x00", None, "a"), (None, "d-x00", "t", "a")], "segment_id string, document_id string, text string, flags string").repartition(4)
    kind = {k: {"train": 2, "gold": 1, "calib": 1}.get((v or "").strip().lower(), 0) for k, v in side.items()} | {"x05": 0}
    want = {(a, b) for a, b in near_pairs(texts) if {kind[a], kind[b]} == {1, 2}}
    assert len(want) > 15
    for hot in (prefix.HOT, 0):
        monkeypatch.setattr(prefix, "HOT", hot)
        got = {tuple(sorted(r)) for r in overlap.overlapping_segments(seg, docs, man).collect()}
        assert got == want
    assert overlap.overlapping_segments(seg.limit(0), docs, man).count() == 0


FEW_WORDS = [f"wort{i}" for i in range(24)]


@pytest.mark.parametrize("hot", [prefix.HOT, 0])
def test_texts_of_few_words_are_not_paired_by_chance(spark, monkeypatch, hot):
    monkeypatch.setattr(prefix, "HOT", hot)
    rnd = random.Random(21)
    texts = {f"r{i:03}": " ".join(rnd.choices(FEW_WORDS, k=rnd.choice([20, 45, 60, 62]))) for i in range(400)}
    for i in range(0, 40, 2):
        words = texts[f"r{i:03}"].split()
        words[i % len(words)] = "anders"
        texts[f"near{i}"] = " ".join(words[: len(words) * (20 - i // 4) // 20])
    want = {tuple(sorted((texts[a], texts[b]))) for a, b in near_pairs(texts)}
    rows = spark.createDataFrame([(t, i, 3) for i, t in enumerate(texts.values())], "text string, id long, flags int").repartition(3)
    names = list(texts.values())
    got = {tuple(sorted((names[a], names[b]))) for a, b in prefix.candidates(rows.select("id", "text", "flags"), rows.select("text"), 0.5, 3).collect() if a != b}
    assert len(want) > 10 and want <= got
    assert len(got) < 4 * len(want)


def test_bitmaps_never_allow_less_than_is_common():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(FEW_WORDS, k=rnd.choice([12, 40, 300]))) for _ in range(60)]
    texts += [t + " und noch etwas mehr" for t in texts]
    s = shingling.shingled(texts)
    marks, n = prefix.bitmaps(s), s.sizes
    sets = [set(s.values[lo:hi]) for lo, hi in zip(s.offsets, s.offsets[1:])]
    for i, j in itertools.product(range(len(texts)), repeat=2):
        assert len(sets[i] & sets[j]) <= (n[i] + n[j] - int(np.bitwise_count(marks[:, i] ^ marks[:, j]).sum())) / 2


# Problem 6


def best_fit(sizes, capacity):
    """Best-fit decreasing, the usual yardstick."""
    rooms, n = [], 0
    for t in sorted(sizes, reverse=True):
        i = bisect.bisect_left(rooms, t)
        if i == len(rooms):
            n += 1
            bisect.insort(rooms, capacity - t)
        else:
            bisect.insort(rooms, rooms.pop(i) - t)
    return n


def test_packing(spark):
    rnd = random.Random(11)
    sizes = [(i, rnd.choice([0, 1, 5, 40, 90, 100, 101, 250]) if i % 3 else rnd.randint(1, 60)) for i in range(3000)]
    df = spark.createDataFrame([*sizes, (5000, None), (None, 7)], "doc_id long, tokens long")
    out = packing.pack_items(df, [("a", 100), ("b", 64)])
    rows = out.collect()
    for profile, cap in (("a", 100), ("b", 64)):
        own = [r for r in rows if r.profile == profile]
        fill, parts = Counter(), defaultdict(list)
        for r in own:
            fill[r.container] += r.tokens
            parts[r.item].append((r.start, r.tokens))
        assert max(fill.values()) <= cap
        for i, t in sizes:
            p = sorted(parts.get(i, []))
            assert sum(n for _, n in p) == t and [s for s, _ in p] == list(np.cumsum([0] + [n for _, n in p])[: len(p)])
            assert len(p) <= 1 or t > cap
        # No more sequences than best-fit needs on the same pieces, within two percent.
        assert len(fill) <= 1.02 * best_fit([r.tokens for r in own], cap) + 1
    again = packing.pack_items(df.repartition(9), [("b", 64), ("a", 100)])
    assert out.exceptAll(again).count() == 0
    assert packing.pack_items(df.limit(0), [("a", 10)]).count() == 0 and packing.pack_items(df, []).count() == 0
    with pytest.raises(ValueError):
        packing.pack_items(df, [("a", 0)])
    r = {x.profile: x for x in packing.report(out).collect()}
    assert r["a"].largest_fill == 100 and 0 <= r["a"].unused_share < 0.05


def test_packing_of_repeated_and_named_items(spark):
    """Every row is an item of its own, also if keys are strings or come again."""
    df = spark.createDataFrame([("x", 250), ("x", 250), ("x", 30), ("y", 100), ("y", 100)], "name string, tokens long")
    rows = packing.pack_items(df, [("a", 100)], key="name").collect()
    fill = Counter()
    for r in rows:
        fill[r.container] += r.tokens
    assert max(fill.values()) <= 100 and sum(fill.values()) == 730 and {r.item for r in rows} == {"x", "y"}
    assert sum(r.tokens == 100 for r in rows) == 6


def test_packing_balances_cost():
    sizes = np.sort(np.random.default_rng(2).integers(10, 900, 400))[::-1]
    where = packing.pack(sizes, 4096)
    cost = np.bincount(where, sizes + packing.QUADRATIC * sizes.astype(float) ** 2)
    assert cost.std() / cost.mean() < 0.1


# Problem 7


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 50)
    rnd = random.Random(12)
    rows = [(i, rnd.choice(["gross"] * 6 + ["mittel"] * 3 + ["klein"]), rnd.randint(1, 400)) for i in range(900)] + [(9000, None, 5), (9001, "klein", None), (None, "klein", 5), (9002, "klein", 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("m", "gross", 1.0, 1), ("m", "mittel", 1.0, 2), ("m", "klein", 2.0, 3), ("m", "fehlt", 5.0, 1), ("m", "gross", 1.0, 1), ("n", "klein", 0.0, 1), ("n", "mittel", None, 2), (None, "klein", 1.0, 1)], "mix_name string, source string, target_weight double, max_repeats long")
    out = mixing.mix(sizes, targets, "doc_id")
    got = out.collect()
    limit = {"gross": 1, "mittel": 2, "klein": 3}
    assert all(1 <= r.repeats <= limit[r.source] for r in got) and {r.mix_name for r in got} == {"m"}
    total = Counter()
    for r in got:
        total[r.source] += r.tokens * r.repeats
    all_tokens = sum(total.values())
    for s, share in (("gross", 0.4), ("mittel", 0.2), ("klein", 0.4)):
        assert total[s] / all_tokens == pytest.approx(share, abs=0.01)
    assert out.exceptAll(mixing.mix(sizes.repartition(7), targets, "doc_id")).count() == 0
    available = sizes.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("available"))
    rep = {(r.mix_name, r.source): r for r in mixing.report(out, available, targets).collect()}
    assert rep[("m", "fehlt")].reached_share == 0 and rep[("m", "klein")].most_repeats == 3
    assert mixing.mix(sizes.limit(0), targets, "doc_id").count() == 0 and mixing.mix(sizes, targets.limit(0), "doc_id").count() == 0
    capped = Counter()
    for r in mixing.mix(sizes, targets, "doc_id", total_tokens=10**9).collect():
        capped[r.source] += r.repeats
    assert capped["klein"] == 3 * sum(1 for _, s, t in rows[:900] if s == "klein")


def test_mixing_fills_every_gap_that_a_record_fits(spark):
    rnd = random.Random(5)
    rows = [(i, "s", rnd.choice([1, 3, 700, 900])) for i in range(400)] + [(1000, "o", 50_000)]
    targets = spark.createDataFrame([("m", "s", 1.0, 1), ("m", "o", 1.0, 1)], "mix_name string, source string, target_weight double, max_repeats long")
    got = [r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), targets, "doc_id").collect() if r.source == "s"]
    gap = 50_000 - sum(r.tokens for r in got)
    left = {i: t for i, s, t in rows if s == "s" and i not in {r.doc_id for r in got}}
    assert 0 <= gap and all(t > gap for t in left.values())


def test_prefix_sums(spark):
    rnd = random.Random(13)
    rows = [(i, rnd.choice("ab"), rnd.randint(1, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, source string, tokens long")
    got = mixing.prefix_sums(df, ["source"], "k", 16).collect()
    from docloom.llm.unit import unit

    at = {r.k: r.u for r in df.select("k", unit("mix", F.col("k").cast("string")).alias("u")).collect()}
    for r in got:
        assert r.before == sum(t for k, s, t in rows if s == r.source and (at[k], k) < (at[r.k], r.k))


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world", "s"), (2, "", "s"), (3, None, None), (4, "<|endoftext|>", "s"), (5, "ä" * 200_000, "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.tokens for r in tokens.with_tokens(df, "doc_id", "text", keep=("source",)).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 10_000


# Problem 8

PROSE = "Die Frist für den laufenden Auftrag wurde auf den 3. Mai verlegt. Wir bitten Sie, die Unterlagen bis zum Monatsende an den Einkauf zu senden. Rückfragen beantwortet das Büro."
JUNK = {
    "list": "TOP 1: Netz\nTOP 2: Posten KU-3\nTOP 3: Modul\nTOP 4: Plan, Halle",
    "table": "Posten | Menge | Betrag\nMontage | 3 | 4,50 EUR\nPrüfung | 12 | 1.204,00 EUR",
    "contents": "1 Zentrum\n   1.1 für Lizenz und Ablauf\n   1.2 für Störung und Plan\n2 Verzeichnis\n   2.1 für Raum und Liste",
    "numbers": "6 16.140 957.130 90\n525.384 88 86 5.806",
    "base64": "OM4JhpDwTeg/N4CwpuJ2eFhHwBcf4xl/4IZRhZgv+8CQZUB4UiIqRSym77RuUalVp7UYQ",
    "symbols": "#####=====****",
    "blank": " \n\t",
    "empty": "",
}


def test_quality_profiles(spark):
    texts = {"prose": PROSE, "upper": PROSE.upper(), "lower": PROSE.lower(), "quoted": "> " + PROSE.replace(". ", ".\n> "), "english": "The delivery was delayed because the contract had not been signed. Please return the form to us before the end of the month.", "wrapped": re.sub(r"(.{30,40}) ", r"\1\n", PROSE), "mixed": PROSE + "\n\nA | 1\nB | 2", "alike": "Gegenstand ist das offene Zentrum am Standort Rahlau, einschließlich des Kontos. Gegenstand ist das Lager am Standort Moorfeld, einschließlich des Pakets.", **JUNK, "null": None}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "k string, text string, words int")
    got = {r.k: r for r in quality.text_quality(df, "k", "text").collect()}
    assert {k for k, r in got.items() if r.prose_share >= 0.5} == {"prose", "upper", "lower", "quoted", "english", "wrapped", "mixed", "alike"}
    assert got["english"].language == "en" and got["prose"].language == "de" and got["null"].profile == "empty" and got["symbols"].profile == "junk"
    assert got["prose"].words == len(re.findall(r"[^\W_]+", PROSE)) and got["null"].chars == 0
    assert got["prose"].ended_lines_share == 1.0 and got["table"].symbol_share > 0.05
    assert quality.text_quality(df.limit(0), "k", "text").count() == 0
    assert quality.classify(["wort " * 100_000])[0][1] == 100_000


#: The same letter in languages whose function words the operator does not know.
OTHERS = {
    "da": "Vi har modtaget jeres brev om den nye aftale og vil gerne svare på de spørgsmål, som I har stillet. Den første levering kommer i næste uge, og resten følger senere på måneden. Hvis der er noget, som ikke passer, må I endelig skrive til os.",
    "tr": "Geçen hafta size gönderdiğimiz sözleşmenin imzalı bir kopyasını henüz alamadık. Bu nedenle teslimat tarihini birkaç gün ertelemek zorunda kaldık. Lütfen belgeyi en kısa sürede bize gönderin ve varsa sorularınızı yazın.",
    "el": "Σας ευχαριστούμε για το γράμμα που μας στείλατε την περασμένη εβδομάδα. Η παράδοση θα γίνει στο τέλος του μήνα και το τιμολόγιο θα σταλεί με το ταχυδρομείο.",
    "cs": "Děkujeme vám za dopis, který jste nám poslali minulý týden. Zboží bude dodáno na konci měsíce a fakturu pošleme poštou. Pokud by se objevil nějaký problém, napište nám prosím co nejdříve.",
    "pl": "Dziękujemy za list, który otrzymaliśmy w zeszłym tygodniu. Towar zostanie dostarczony pod koniec miesiąca, a faktura będzie wysłana pocztą. Jeśli pojawi się jakiś problem, prosimy o jak najszybszy kontakt.",
    "fi": "Kiitämme teitä kirjeestä, jonka saimme viime viikolla. Tavarat toimitetaan kuun lopussa ja lasku lähetetään postitse. Jos jokin asia ei ole kunnossa, ottakaa meihin yhteyttä mahdollisimman pian.",
    "ru": "Благодарим вас за письмо, которое мы получили на прошлой неделе. Товар будет доставлен в конце месяца, а счёт мы отправим по почте. Если возникнет какая-либо проблема, пожалуйста, напишите нам.",
}
OTHER_LISTS = ["Jablka\nHrušky\nMrkev, cibule\nČokoláda 200 g\nMléko 1 l\nMáslo\nRohlíky 10 ks\nSýr\nSůl\nPepř", "Nr | Nazwa | Ilość\n1 | śruba M4 | 200\n2 | nakrętka | 200", "Elma, armut, kiraz, çilek, karpuz, kavun, üzüm, incir, nar", "Skruer.\nSøm.\nHammer, stor.\nSav.\nBor 8 mm.\nMaling, hvid.", "gfz, mfxbtkgks, vbwv, dm, vk dhtdrxkc xsmqtxsz wlt, fwnmfrt. grcd, zp czr drpdlvr sqsnqlv zvkf cjnsvv jndfg qxqcsfx."]


def test_quality_of_other_languages():
    """Prose is known as such in any alphabetic language, and no language is named that it is not."""
    for name, r in zip(OTHERS, quality.classify(list(OTHERS.values()))):
        assert r[7] > 0.9 and r[8] is None and r[-1] == "prose", name
    assert all(r[7] < 0.5 for r in quality.classify(OTHER_LISTS))


def test_divergence():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.5, 0.5])
    assert quality.divergence(p, p) == 0 and quality.divergence(p, q) == pytest.approx(0.5)
    seen = {quality.INDEX["der"]: 3, quality.INDEX["und"]: 1}
    own = np.zeros(quality.LANGUAGES.shape[1])
    own[list(seen)] = np.array([3, 1]) / 4
    assert np.allclose(quality.language_divergence(seen), quality.divergence(own, quality.LANGUAGES))


# Queries


def test_queries_run_on_the_smallest_tables(spark):
    import os

    from docloom.llm.queries import ORACLE, QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    assert set(ORACLE) <= set(QUERIES)
    for name in ("p1_shares", "p3_growth", "p5_report", "p6_report", "p7_report", "p8_found"):
        assert QUERIES[name](spark, sf).count() > 0, name
