"""Near-duplicate texts with small edits: HyperMinHash bands, estimate, exact verification, groups.

``near_groups`` gives one row per record with the group it belongs to, ``group_pairs`` all pairs
within the groups. Two texts are near if the Jaccard similarity of their sets of shingles is
above a threshold; a group is closed under chains of near texts. A text with fewer than twelve
words is near to nothing, not even to its copy; null texts likewise.

Plan: one pass over the texts computes sketches and sends only band keys (packed blocks, one
per key range). Records with byte-equal texts are one node, identified by a 64-bit hash of the
text (the chance that any two of n texts share one is about ``n**2 / 2**65``). Texts that agree
in at least two bands are candidates; a second pass over just those (thinned by a Bloom filter
of bounded size) compares sketches with the expected collisions taken off, a third fetches the
shingle sets of what is left and counts exactly. Components of the verified links are groups.

Recall of a pair of similarity s with b bands of r registers, two of which must agree, is
``1 - (1 - s**r)**b - b * s**r * (1 - s**r)**(b - 1)``; for the defaults 0.96 at 0.5, 0.997 at
0.55 and 0.9997 at 0.6, more for texts that several others link.

Skew: copies are one node, and are dropped within a task before anything is sent. A bucket of up
to ``STAR`` texts is compared pair by pair. In a larger one every text is compared with the smallest
only; a task that finds a large bucket among its own texts does so at once and sends just the smallest, so
no task is sent a whole hot bucket. After the components of that are known, the texts of buckets that
are not in one component go through an exact prefix join on rare shingles (see ``prefix``), where what
the bucket has in common does not count as rare. So no link between components is lost, and a bucket of
k texts costs about k comparisons, whether they are near each other or only share boilerplate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import blocks, bloom, hyperminhash, prefix, shingling
from docloom.llm.components import hash_to_min
from docloom.session import materialize, shuffle_partitions

U = np.uint64
STAR = 32
STEP = 100_000
CARRIED = 8
BLOCK = 256


def text_key(text: str) -> Column:
    """The node of a text; byte-equal texts are one node."""
    return F.xxhash64(F.col(text))


def near_links(df: DataFrame, text: str, threshold: float = 0.5, k: int = 3, width: int = 4, reps: int = 20, agree: int = 2) -> DataFrame:
    """``(a, b)``: verified near texts by their ``text_key``, ``a < b``; complete up to components."""
    spark = df.sparkSession
    nodes = df.where(F.col(text).isNotNull()).select(text_key(text).alias("id"), F.col(text).alias("text"))
    bands = reps // width * hyperminhash.BUCKETS
    parts = blocks.parts_for(nodes.count() * bands, shuffle_partitions(spark))
    packed = nodes.mapInArrow(_pack_bands(parts, k, width, reps, agree), _ROWS)
    raw = materialize(packed.repartitionById(parts, F.col("part")).mapInArrow(_bucket_pairs(agree), _ROWS).select("a", "b", "hits", "bucket"), "bucket-pairs")
    pairs = raw.groupBy("a", "b").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= agree).select("a", "b")
    links = verified(nodes, pairs, threshold, k)
    stars = raw.where("bucket is not null").select("bucket", "a", "b").distinct()
    if stars.limit(1).count():
        known = hash_to_min(links)
        x, y = known.select(F.col("node").alias("a"), F.col("component").alias("ca")), known.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        placed = stars.join(x, "a", "left").join(y, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
        mixed = placed.where("ca <> cb").select("bucket").distinct()
        ids = materialize(placed.join(mixed, "bucket", "left_semi").select(F.explode(F.array("a", "b")).alias("id")).distinct(), "mixed-texts")
        if ids.limit(1).count():
            few = bloom.build(ids, "id", ids.count())
            texts = nodes.where(few.column("id")).join(ids, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")).withColumn("flags", F.lit(3))
            texts = materialize(texts, "mixed")
            rest = prefix.candidates(texts, texts.select("text"), threshold, k).where("a < b")
            rest = rest.join(x, "a", "left").join(y, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
            links = materialize(links.unionByName(verified(texts.select("id", "text"), rest, threshold, k)).distinct(), "links")
    return links


_ROWS = "part int, block binary, a long, b long, hits int, bucket long"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _pair_rows(a: np.ndarray, b: np.ndarray, hits: np.ndarray, bucket: np.ndarray | None, part: np.ndarray | None = None):
    for lo in range(0, len(a), 100_000):
        own = slice(lo, lo + 100_000)
        n = len(a[own])
        where = pa.array(part[own].astype(np.int32)) if part is not None else pa.nulls(n, pa.int32())
        name = pa.array(bucket[own].view(np.int64)) if bucket is not None else pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([where, pa.nulls(n, pa.binary()), pa.array(a[own]), pa.array(b[own]), pa.array(hits[own].astype(np.int32)), name], _NAMES)


def _star(keys: np.ndarray, ids: np.ndarray, marked: np.ndarray | None = None):
    """Entries sorted by key and text: of each large (or marked) bucket the smallest text, the others, and their places."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    large = size > STAR
    if marked is not None and len(marked):
        large |= np.isin(keys[start], marked) & (size > 1)
    inside = np.repeat(large, size)
    first = np.zeros(len(keys), bool)
    first[start] = True
    others = np.flatnonzero(inside & ~first)
    return np.repeat(start, size)[others], others


def _pack_bands(parts: int, k: int, width: int, reps: int, agree: int):
    def run(batches):
        for b in batches:
            ids, at = np.unique(b.column(0).to_numpy(), return_index=True)
            s = shingling.shingled(b.column(1).take(pa.array(at)).to_pylist(), k)
            has = np.flatnonzero(s.sizes)
            if not len(has):
                continue
            keys = hyperminhash.band_keys(hyperminhash.sketch(s, reps), width)[has]
            rows = np.repeat(np.arange(len(has)), keys.shape[1])
            # Keys as they are stored, so that a bucket has the same name in every task.
            keys = keys.ravel() >> U(64 - 8 * blocks.KEY_BYTES)
            own = ids[has]
            order = np.lexsort((own[rows], keys))
            keys, rows = keys[order], rows[order]
            centre, gone = _star(keys, own[rows])
            if len(gone):
                wide = keys[gone] << U(64 - 8 * blocks.KEY_BYTES)
                yield from _pair_rows(own[rows[centre]], own[rows[gone]], np.full(len(gone), agree), keys[gone], blocks.split_ranges(wide, parts).astype(np.int64))
                keep = np.ones(len(keys), bool)
                keep[gone] = False
                keys, rows = keys[keep], rows[keep]
            out = list(blocks.pack(keys << U(64 - 8 * blocks.KEY_BYTES), rows, own.view(np.uint64), parts))
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], _NAMES)

    return run


def _bucket_pairs(agree: int):
    """Pairs of each bucket: all of a small one; of a large one those with its smallest text, with the bucket's name."""

    def run(batches):
        blobs, marked = [], [np.empty(0, np.int64)]
        for b in batches:
            passed = b.column(2).is_valid()
            if passed.true_count:
                rows = b.filter(passed)
                marked.append(np.unique(rows.column(5).to_numpy()))
                yield pa.RecordBatch.from_arrays(rows.columns, _NAMES)
            blobs += b.column(1).drop_null().to_pylist()
        if not blobs:
            return
        keys, ids = blocks.gather(blobs)
        ids = ids.view(np.int64)
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        keep = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[keep], ids[keep]
        centre, gone = _star(keys, ids, np.unique(np.concatenate(marked)).view(np.uint64))
        yield from _pair_rows(ids[centre], ids[gone], np.full(len(gone), agree), keys[gone])
        keep = np.ones(len(keys), bool)
        keep[gone] = False
        keys, ids = keys[keep], ids[keep]
        hi = np.searchsorted(keys, keys, "right")
        for at in range(0, len(keys), STEP):
            own = np.arange(at, min(len(keys), at + STEP))
            many = hi[own] - own - 1
            i = np.repeat(own, many)
            j = i + 1 + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield from _pair_rows(ids[i], ids[j], np.ones(len(i)), None)

    return run


def verified(nodes: DataFrame, pairs: DataFrame, threshold: float, k: int = 3) -> DataFrame:
    """Those ``pairs (a, b)`` of ``nodes (id, text)`` whose similarity is above ``threshold``.

    First by sketches, which are smaller than the sets and rule out most wrong candidates (a
    pair is kept unless its estimate is more than four standard errors too low, where only the buckets
    count that a text of this size fills by itself), then exactly.
    """
    pairs = materialize(pairs, "candidates")
    likely = materialize(_compare(nodes, pairs, k, "sketch", _estimated(threshold)), "likely")
    return materialize(_compare(nodes, likely, k, "set", _exact(threshold)), "verified")


def _compare(nodes: DataFrame, pairs: DataFrame, k: int, what: str, keep) -> DataFrame:
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = bloom.build(ids, "id", 2 * pairs.count())
    data = nodes.mapInArrow(_payload(found, k, what), "id long, n int, data binary").groupBy("id").agg(F.first("n").alias("n"), F.first("data").alias("data"))
    left = data.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("data").alias("da"))
    right = data.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("data").alias("db"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "na", "nb", "da", "db").mapInArrow(keep, "a long, b long")


def _payload(found: bloom.Bloom, k: int, what: str):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            at = np.flatnonzero(found.contains(ids.view(np.uint64)))
            ids, first = np.unique(ids[at], return_index=True)
            if not len(ids):
                continue
            s = shingling.shingled(b.column(1).take(pa.array(at[first])).to_pylist(), k)
            if what == "sketch":
                data = [x.tobytes() for x in hyperminhash.short(hyperminhash.sketch(s, CARRIED), CARRIED)]
            else:
                data = [shingling.to_bytes(s.values[lo:hi]) for lo, hi in zip(s.offsets, s.offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(s.sizes, pa.int32()), pa.array(data, pa.binary())], ["id", "n", "data"])

    return run


def least_estimate(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest estimate of a pair at the threshold, four standard errors below it, by the smaller set's size."""
    filled = 1 - (1 - 1 / hyperminhash.BUCKETS) ** np.maximum(sizes, 1)
    return threshold - 4 * np.sqrt(threshold * (1 - threshold) / (CARRIED * hyperminhash.BUCKETS * filled))


def _estimated(threshold: float):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (4, 5))
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            ok = hyperminhash.jaccard(x, y, n, m) >= least_estimate(np.minimum(n, m), threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])

    return run


def _exact(threshold: float):
    def run(batches):
        for b in batches:
            common = shingling.overlaps(b.column(4).to_pylist(), b.column(5).to_pylist())
            ok = common > threshold * (b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy() - common)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])

    return run


def near_groups(df: DataFrame, record: str, text: str, threshold: float = 0.5, k: int = 3, **settings) -> DataFrame:
    """One row ``(record, group_id, group_size)`` per distinct ``record`` that is near another one.

    ``group_id`` is the smallest record of the group. Rows with a null record are ignored. A record that
    comes with several texts is in the group of each of them (one row each). Other columns of ``df``, whatever
    their names, play no part.
    """
    rows = df.select(F.col(record).alias("record"), F.col(text).alias("text")).where("record is not null and text is not null")
    links = near_links(rows, "text", threshold, k, **settings)
    known = hash_to_min(links)
    keyed = materialize(rows.select("record", text_key("text").alias("id")).distinct(), "records")
    # Copies that nothing else is near to are a group as well, if they are long enough.
    copies = keyed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(known.select(F.col("node").alias("id")), "id", "left_anti").select("id")
    copies = materialize(copies, "copies")
    few = bloom.build(copies, "id", copies.count())
    long = rows.select(text_key("text").alias("id"), "text").where(few.column("id")).mapInArrow(_long_enough(k), "id long").distinct().join(copies, "id", "left_semi")
    named = known.select(F.col("node").alias("id"), F.col("component").alias("node")).unionByName(long.select("id", F.col("id").alias("node")))
    grouped = keyed.join(named, "id").select("record", "node").distinct()
    sizes = grouped.groupBy("node").agg(F.count(F.lit(1)).alias("group_size"), F.min("record").alias("group_id")).where("group_size > 1")
    return grouped.join(sizes, "node").select(F.col("record").alias(record), "group_id", "group_size")


def _long_enough(k: int):
    def run(batches):
        for b in batches:
            ids, at = np.unique(b.column(0).to_numpy(), return_index=True)
            s = shingling.shingled(b.column(1).take(pa.array(at)).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[s.sizes > 0])], ["id"])

    return run


def group_pairs(groups: DataFrame, record: str) -> DataFrame:
    """``(record_a, record_b)``: all pairs of distinct records of one group, smaller first.

    A group is cut into blocks of about ``BLOCK`` records and pairs of blocks are the rows that
    are spread, so the work of the largest group is shared by all tasks.
    """
    g = groups.select(F.col(record).alias("r"), "group_id", F.pmod(F.xxhash64(record), F.ceil(F.col("group_size") / BLOCK).cast("long")).alias("block"))
    chunks = g.groupBy("group_id", "block").agg(F.collect_set("r").alias("rs"))
    x, y = chunks.alias("x"), chunks.alias("y")
    met = x.join(y, F.expr("x.group_id = y.group_id and x.block <= y.block")).select(F.col("x.rs").alias("p"), F.col("y.rs").alias("q"))
    pairs = met.select(F.explode("p").alias("p"), "q").select("p", F.explode("q").alias("q")).where("p <> q")
    return pairs.select(F.least("p", "q").alias(f"{record}_a"), F.greatest("p", "q").alias(f"{record}_b")).distinct()
