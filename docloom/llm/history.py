"""Duplicates of new documents against everything accepted so far: a persistent prefix-tree hash forest.

``History`` is a store in a folder all executors share; a later job opens it again by its path.
``History.add`` takes the documents of a new batch, says which of them are duplicates, and adds the
rest. A document is a duplicate if an earlier document that is none itself (earlier by ``ingested_at``,
then by ``document_id``) has the same digest or a text with a similarity above the threshold.

What was added before is not worked through again. The signatures of the batch are searched in the sorted
sequences of each run (see ``forest``); a task reads the row groups of stored blocks that its share of
the new labels falls into. Candidates meet in two trees. Each text first meets those that share its whole
label (depth 5) in two; only for texts that are no duplicate by then the prefix is widened, value by value,
until a pair at the threshold is found with at least the wanted recall. Candidates are verified exactly on
whole texts, fetched by number from the run that holds them. Accepted documents become a run of their own;
when there are more than ``RUNS``, ``compact`` merges them, without the texts of rejected documents.

Documents are numbered in order of time: ``number = sequence * 2**16 + bucket``, so a smaller number is an
earlier document, and the number alone says in which run and bucket a text lies.

Long documents: segments are put together in blocks of ``BLOCK`` index values, so a document that holds a
third of all segments is spread over many tasks. Its signature is the minimum of those of its blocks and of
the shingles across their borders; its set is compared as rows, not as one value. Hyphens at line ends are
resolved within blocks. Copies of one text are one node.

Skew: a range of more than ``forest.STAR`` new texts is compared with its earliest text only, in the task that
meets them first. Those of its texts that are still accepted after the decisions go through an exact
prefix join on rare shingles (see ``prefix``) with each other and with the stored texts of the range, until nothing
changes; so no link between accepted texts is lost, and a large range costs as many comparisons as it has texts. Decisions are taken in rounds over
keys (a key of any size is a partial minimum); what is left after ``ROUNDS`` of them, long chains of versions,
is decided component by component, in tasks of at most ``CHAIN`` rows. A batch with at most ``FEW`` rows to
decide is decided in one task, and one with at most ``FEW`` candidates verifies all of them in one step.

Null or empty tables give empty results. Documents without text, or with fewer than twelve words,
are duplicates by digest only; a null or malformed digest matches nothing. A null ``ingested_at``
comes last. Rows without ``document_id`` are ignored; a document the store has taken before is left out of
the result; further columns play no part. One writer at a time: a second one fails when it commits.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import bloom, forest, hyperminhash, near, prefix, shingling, store
from docloom.llm.components import hash_to_min
from docloom.llm.forest import prefix_length  # noqa: F401
from docloom.session import materialize, shuffle_partitions

U = np.uint64
BLOCK = 64
RUNS = 4
ROUNDS = 6
CHAIN = 1 << 20
FEW = 1 << 17
_PIECE = "no long, block long, words int, head array<string>, tail array<string>, data binary"
_SIGNED = "bucket int, no long, hi long, lo long, signature binary, text string"


def digest(column: str) -> Column:
    """The 64 hex digits of a SHA-256 in any notation (prefix, case, blanks, separators); else null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.col(column)), r"^\s*(sha-?256\s*[:=]?|0x)", ""), "[^0-9a-z]", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def in_order(documents: DataFrame) -> DataFrame:
    """``(document_id, at, digest)``: every document once, at its earliest ``ingested_at``."""
    at = F.coalesce(F.col("ingested_at"), F.expr("timestamp '9999-12-31 00:00:00'"))
    rows = documents.where("document_id is not null").select("document_id", at.alias("at"), digest("content_sha256").alias("digest"))
    first = rows.groupBy("document_id").agg(F.min(F.struct("at", "digest")).alias("f"))
    return first.select("document_id", F.col("f.at").alias("at"), F.col("f.digest").alias("digest"))


def doc_key(column: str = "document_id") -> Column:
    return F.xxhash64(F.col(column))


def _key(kind: int, what: str) -> Column:
    """A 128-bit key of a document's name (kind 0) or digest (kind 1)."""
    return F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.col(what)).alias("hi"), F.xxhash64(F.lit("second"), F.col(what)).alias("lo"))


def _keys(rows: DataFrame, buckets: int) -> DataFrame:
    """``(no, kind, hi, lo, bucket)``: what documents ``(no, document_id, digest, hi, lo)`` are known by: name, digest, text (kind 2)."""
    node = F.when(F.col("hi").isNotNull(), F.struct(F.lit(2).alias("kind"), "hi", "lo"))
    keys = F.array_compact(F.array(_key(0, "document_id"), F.when(F.col("digest").isNotNull(), _key(1, "digest")), node))
    return rows.select("no", F.explode(keys).alias("key")).select("no", "key.*").withColumn("bucket", F.pmod("hi", F.lit(buckets)).cast("int"))


# Texts ---------------------------------------------------------------------------------------


def _joined(batches, most: int = 4096, most_chars: int = 8 << 20):
    """Lists of (number, block, text) from sorted rows; repeated rows of a segment count once.

    A row of block -1 has the number of a document, and rows without such a row before them belong to no
    document of the batch. A list ends with ``most`` texts or ``most_chars`` characters.
    """
    out, current, no, parts, last, size = [], None, {}, [], None, 0

    def close():
        nonlocal size
        if current is not None and parts and current[0] in no:
            out.append((no[current[0]], current[1], " ".join(parts)))
            size += len(out[-1][2])

    for b in batches:
        for i, k, n, s, t, number in zip(*(c.to_pylist() for c in b.columns[1:7])):
            if (i, k) != current:
                close()
                if len(out) >= most or size >= most_chars:
                    yield out
                    out, size = [], 0
                if current is None or current[0] != i:
                    no = {}
                current, parts, last = (i, k), [], None
            if k < 0:
                no = {i: number}
            elif (n, s, t) != last:
                parts.append(t)
                last = (n, s, t)
    close()
    if out:
        yield out


def _sign(buckets: int, k: int):
    """Number, node, signature and text of documents of one block; of equal texts the earliest stands for all."""

    def run(batches):
        for group in _joined(batches):
            texts = [t for _, _, t in group]
            s = shingling.shingled(texts, k)
            has = np.flatnonzero(s.sizes)
            if not len(has):
                continue
            nos = np.array([group[i][0] for i in has], np.int64)
            node = np.array([xxhash.xxh3_128_intdigest(texts[i]).to_bytes(16, "little") for i in has], "V16").view(np.int64).reshape(-1, 2)
            order = np.lexsort((nos, node[:, 1], node[:, 0]))
            own = node[order]
            first = order[np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])]
            keep = np.zeros(len(texts), bool)
            keep[has[first]] = True
            kept = shingling.Shingled(np.concatenate([[0], np.cumsum(s.sizes[keep])]), s.values[keep[s.rows]])
            signature = forest.values(hyperminhash.sketch(kept, forest.REPS))
            at = np.cumsum(keep) - 1
            yield _signed(nos, node, [signature[at[i]].tobytes() if keep[i] else None for i in has], [texts[i] if keep[i] else None for i in has], buckets)

    return run


def _signed(nos, node, signature, text, buckets):
    order = np.lexsort((nos, nos & (buckets - 1)))
    take = pa.array(order)
    return pa.RecordBatch.from_arrays(
        [pa.array((nos & (buckets - 1)).astype(np.int32)).take(take), pa.array(nos).take(take), pa.array(node[:, 0].copy()).take(take), pa.array(node[:, 1].copy()).take(take), pa.array(signature, pa.binary()).take(take), pa.array(text, pa.string()).take(take)],
        ["bucket", "no", "hi", "lo", "signature", "text"],
    )


def _piece_rows(what: str, k: int):
    """Per block ``(no, block, text)``: words, the first and last two, and registers or the shingles themselves."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                no, block, text = (b.column(i).slice(lo, 512).to_pylist() for i in range(3))
                words = [shingling.words_of(t) for t in text]
                s = shingling.shingled(text, k, k)
                yield _piece_batch(no, block, [len(w) for w in words], [w[: k - 1] for w in words], [w[-(k - 1) :] for w in words], _data(s, what))

    return run


def _data(s: shingling.Shingled, what: str) -> list[bytes]:
    if what == "registers":
        return [x.tobytes() for x in hyperminhash.raw_sketch(s, forest.REPS).reshape(len(s.offsets) - 1, -1)]
    return [shingling.to_bytes(s.values[lo:hi]) for lo, hi in zip(s.offsets, s.offsets[1:])]


def _piece_batch(no, block, words, head, tail, data):
    strings = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(block, pa.int64()), pa.array(words, pa.int32()), pa.array(head, strings), pa.array(tail, strings), pa.array(data, pa.binary())], ["no", "block", "words", "head", "tail", "data"])


def _with_borders(pieces: DataFrame, what: str, k: int) -> DataFrame:
    """Adds, for each block, the shingles that begin in an earlier block. Only words count, so blocks
    without any are left out first; with at least one word each, the k - 1 before are enough."""
    w = Window.partitionBy("no").orderBy("block")
    filled = pieces.where("words > 0")
    before = F.flatten(F.array(*(F.coalesce(F.lag("tail", i).over(w), F.array().cast("array<string>")) for i in range(k - 1, 0, -1))))
    border = filled.select("no", "block", "head", before.alias("before")).where("size(before) > 0")

    def run(batches):
        for b in batches:
            texts = [" ".join([*(x[-(k - 1) :]), *h]) for h, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            if texts:
                yield _piece_batch(b.column(0).to_pylist(), b.column(1).to_pylist(), [0] * len(texts), [[]] * len(texts), [[]] * len(texts), _data(shingling.shingled(texts, k, k), what))

    return filled.unionByName(border.mapInArrow(run, _PIECE))


def _sign_long(pieces: DataFrame, buckets: int, k: int) -> DataFrame:
    """Signatures of documents of several blocks: registers of their blocks, the minimum of each."""
    size = forest.REPS * hyperminhash.BUCKETS

    def spread(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            reg = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint16).astype(np.int32)
            words = np.repeat(b.column(2).to_numpy(), size)
            words[np.arange(len(words)) % size > 0] = 0
            # Blocks of one document that come together are one before anything is sent.
            at, no = np.tile(np.arange(size), n), np.repeat(b.column(0).to_numpy(), size)
            order = np.lexsort((at, no))
            start = np.flatnonzero(np.concatenate([[True], (at[order][1:] != at[order][:-1]) | (no[order][1:] != no[order][:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(no[order][start]), pa.array(at[order][start].astype(np.int32)), pa.array(np.minimum.reduceat(reg[order], start)), pa.array(np.add.reduceat(words[order].astype(np.int64), start))], ["no", "at", "reg", "words"])

    def close(batches):
        for b in batches:
            keep = np.flatnonzero(b.column(1).to_numpy() >= max(shingling.MIN_WORDS, k))
            if not len(keep):
                continue
            reg = np.array([b.column(2)[int(i)].as_py() for i in keep], np.uint16).reshape(len(keep), forest.REPS, hyperminhash.BUCKETS)
            filled = hyperminhash.fill(reg.reshape(-1, hyperminhash.BUCKETS)).reshape(reg.shape)
            nos = b.column(0).to_numpy()[keep].astype(np.int64)
            # A node of its own; copies of a long document are found by their signature.
            node = np.stack([shingling.mix(nos.view(np.uint64)).view(np.int64), nos], axis=1)
            yield _signed(nos, node, [x.tobytes() for x in forest.values(filled)], [None] * len(nos), buckets)

    whole = _with_borders(pieces, "registers", k).mapInArrow(spread, "no long, at int, reg int, words long")
    least = whole.groupBy("no", "at").agg(F.min("reg").alias("reg"), F.sum("words").alias("words"))
    rows = least.groupBy("no").agg(F.sum("words").alias("words"), F.transform(F.array_sort(F.collect_list(F.struct("at", "reg"))), lambda x: x["reg"]).alias("regs"))
    return rows.mapInArrow(close, _SIGNED)


# In tasks ------------------------------------------------------------------------------------


def _homes(runs: list[dict], nos: np.ndarray):
    """The run and bucket of each number: ``(run, bucket, numbers)``, ascending numbers."""
    for r in runs:
        own = nos[(nos >> 16 >= r["first"]) & (nos >> 16 < r["next"])]
        for bucket in np.unique(own & (r["buckets"] - 1)):
            yield r, int(bucket), np.sort(own[own & (r["buckets"] - 1) == bucket])


def _sets(runs: list[dict], k: int):
    """The shingle sets of the texts with these numbers; those of long documents are not among them."""

    def run(batches):
        nos = np.unique(np.concatenate([np.empty(0, np.int64), *(b.column(0).to_numpy() for b in batches)]))
        for r, bucket, own in _homes(runs, nos):
            for table in store.rows_of(f"{r['uri']}/texts/bucket={bucket}", "no", own, ["no", "text"]):
                table = table.filter(table["text"].is_valid())
                for lo in range(0, table.num_rows, 1024):
                    part = table.slice(lo, 1024)
                    s = shingling.shingled(part["text"].to_pylist(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(part["no"].to_numpy()), pa.array(s.sizes, pa.int32()), pa.array(_data(s, "set"), pa.binary())], ["no", "n", "data"])

    return run


def _texts(runs: list[dict]):
    """The texts ``(id, text, flags)`` with these numbers, as the training side; those of long documents are not among them."""

    def run(batches):
        nos = np.unique(np.concatenate([np.empty(0, np.int64), *(b.column(0).to_numpy() for b in batches)]))
        for r, bucket, own in _homes(runs, nos):
            for table in store.rows_of(f"{r['uri']}/texts/bucket={bucket}", "no", own, ["no", "text"]):
                table = table.filter(table["text"].is_valid()).rename_columns(["id", "text"])
                yield from table.append_column("flags", pa.array(np.full(table.num_rows, prefix.TRAIN, np.int32))).to_batches(1024)

    return run


def _known(runs: list[dict], among: int):
    """The keys ``(no, kind, hi, lo, bucket)`` that a run holds, as ``(no, kind)``."""

    def run(batches):
        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        no, kind, hi, lo, bucket = (rows[c].to_numpy() for c in ("no", "kind", "hi", "lo", "bucket"))
        for one in np.unique(bucket):
            own = np.flatnonzero(bucket == one)
            own = own[np.argsort(hi[own], kind="stable")]
            wanted = np.unique(hi[own])
            for r in runs:
                for b in store.buckets_of(int(one), among, r["buckets"]):
                    for table in store.rows_of(f"{r['uri']}/keys/bucket={b}", "hi", wanted, ["hi", "lo"]):
                        h, low = table["hi"].to_numpy(), table["lo"].to_numpy()
                        first, last = np.searchsorted(hi[own], h, "left"), np.searchsorted(hi[own], h, "right")
                        many = last - first
                        i = own[np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                        i = i[lo[i] == np.repeat(low, many)]
                        yield pa.RecordBatch.from_arrays([pa.array(no[i]), pa.array(kind[i])], ["no", "kind"])

    return run


def _pieces_of(runs: list[dict]):
    """Blocks of long documents: rows ``(no, bucket)`` to ``(no, block, text)``."""

    def run(batches):
        for b in batches:
            nos, bucket = b.column(0).to_numpy(), b.column(1).to_numpy()
            for one in np.unique(bucket):
                own = np.unique(nos[bucket == one])
                for r in runs:
                    mine = own[(own >> 16 >= r["first"]) & (own >> 16 < r["next"])]
                    if len(mine):
                        for table in store.rows_of(f"{r['uri']}/pieces/bucket={one}", "no", mine, ["no", "block", "text"]):
                            yield from table.to_batches(1024)

    return run


def _blocks_of(batches):
    """Whole blocks of long documents from sorted segments; a row per block."""
    current, bucket, parts, last = None, None, [], None
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = ["bucket", "no", "block", "text"]
    for b in batches:
        out = []
        for where, no, k, n, s, t in zip(*(c.to_pylist() for c in b.columns)):
            if (no, k) != current:
                if current is not None:
                    out.append((bucket, *current, " ".join(parts)))
                current, bucket, parts, last = (no, k), where, [], None
            if (n, s, t) != last:
                parts.append(t)
                last = (n, s, t)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), types)], names)
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], x) for c, x in zip((bucket, *current, " ".join(parts)), types)], names)


def _merge_keys(runs: list[dict], buckets: int):
    """The keys of all runs by bucket of the merged one."""

    def run(batches):
        for b in batches:
            for bucket in b.column(0).to_pylist():
                for r in runs:
                    for table in store.everything(f"{r['uri']}/keys/bucket={bucket % r['buckets']}", ["hi", "lo"]):
                        table = table.filter(pa.array(table["hi"].to_numpy() & (buckets - 1) == bucket))
                        yield from table.add_column(0, "bucket", pa.array(np.full(table.num_rows, bucket, np.int32))).to_batches()

    return run


def _merge_texts(runs: list[dict], buckets: int, keep: bloom.Bloom, what: str):
    """The texts (or blocks of long ones) of all runs by bucket of the merged one; signatures are in the forest by now."""
    columns = ["no", "hi", "lo", "signature", "text"] if what == "texts" else ["no", "block", "text"]

    def run(batches):
        for b in batches:
            for bucket in b.column(0).to_pylist():
                for r in runs:
                    for table in store.everything(f"{r['uri']}/{what}/bucket={bucket % r['buckets']}", columns):
                        no = table["no"].to_numpy()
                        at = no if what == "texts" else (no >> 16) + table["block"].to_numpy()
                        ok = (at & (buckets - 1) == bucket) & keep.contains(no.view(np.uint64)) & table["text"].is_valid().to_numpy()
                        table = table.filter(pa.array(ok))
                        if what == "texts":
                            table = table.set_column(3, "signature", pa.nulls(table.num_rows, pa.binary()))
                        yield from table.add_column(0, "bucket", pa.array(np.full(table.num_rows, bucket, np.int32))).to_batches()

    return run


def _explode_sets(batches):
    for b in batches:
        for i, blob in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
            h = shingling.from_bytes(blob)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int64)), pa.array(h.view(np.int64))], ["no", "h"])


def _one_after_the_other(tab: pa.Table) -> pa.Table:
    """Decides the documents of one component: rows ``(no, hi, lo, offer)``."""
    no, hi, lo, offer = (tab[c].to_pylist() for c in ("no", "hi", "lo", "offer"))
    rows: dict[int, list] = {}
    for n, *key in zip(no, hi, lo, offer):
        rows.setdefault(n, []).append(key)
    taken, out = set(), []
    for n in sorted(rows):
        case = any((h, x) in taken for h, x, _ in rows[n])
        if not case:
            taken.update((h, x) for h, x, o in rows[n] if o)
        out.append((n, 2 if case else 1))
    return pa.table({"no": pa.array([n for n, _ in out], pa.int64()), "state": pa.array([s for _, s in out], pa.int32())})


def _all_of_them(batches):
    """``_one_after_the_other`` for all rows of a task."""
    if batches := [b for b in batches if b.num_rows]:
        yield from _one_after_the_other(pa.Table.from_batches(batches)).to_batches()


class History:
    """A growing set of accepted documents in the folder ``path``; an existing store is opened as it is.

    ``threshold``, ``k`` and ``recall`` are those the store was made with; others for an existing store are an error.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.5, k: int = 3, recall: float = 0.98):
        self.spark, self.path = spark, path.rstrip("/")
        self.uri = store.address(spark, self.path)
        made = {"threshold": threshold, "k": k, "recall": recall, "trees": forest.TREES, "depth": forest.DEPTH}
        self.number, found = store.state(spark, self.path)
        if found is None:
            found = {"made": made, "next": 0, "runs": []}
        if found["made"] != made:
            raise ValueError(f"the store was made with {found['made']}")
        self.next, self._runs = found["next"], found["runs"]
        self.threshold, self.k, self.made = threshold, k, made
        self.length = prefix_length(threshold, recall)
        if self.length < 2 or forest.recall_at(threshold, self.length) < recall:
            raise ValueError("no prefix of two values or more has this recall: use a higher threshold")

    @property
    def runs(self) -> list[dict]:
        """The runs: name, numbers of the documents it took, buckets and shares of the key space."""
        return [{**r, "uri": f"{self.uri}/{r['name']}"} for r in self._runs]

    def _forest(self, runs: list[dict]) -> list[tuple[str, int]]:
        return [(f"{r['uri']}/forest", r["parts"]) for r in runs]

    def add(self, documents: DataFrame, segments: DataFrame) -> DataFrame:
        """Takes the ``documents`` (in order of time after all before) and gives those not taken before as
        ``(document_id, at, is_case)``. ``segments`` has their texts; segments of other documents play no part."""
        return self.add_ordered(in_order(documents), segments)

    def add_ordered(self, documents: DataFrame, segments: DataFrame) -> DataFrame:
        """``add`` for documents that ``in_order`` has prepared."""
        run = {"name": f"run-{uuid.uuid4().hex}", "first": self.next, "buckets": store.power(shuffle_partitions(self.spark), forest.LONG)}
        path = f"{self.path}/{run['name']}"
        docs, run["next"], mine, many = self._numbered(documents, segments, run["buckets"])
        if run["next"] == self.next:
            return docs.select("document_id", "at", F.lit(False).alias("is_case"))
        run["long"] = many is not None
        run["parts"] = store.power(max(run["buckets"], (run["next"] - run["first"]) * forest.TREES / 4e6))
        signed = self._signed(docs, segments.where(mine), many, path, run["buckets"])
        runs = [*self.runs, {**run, "uri": f"{self.uri}/{run['name']}"}]

        keyed = docs.select("no", "document_id", "at", "digest").join(signed.select("no", "hi", "lo"), "no", "left")
        if self._runs:
            keyed = materialize(keyed, "keyed")
            known = _keys(keyed, run["buckets"]).repartitionById(run["buckets"], F.col("bucket")).mapInArrow(_known(self.runs, run["buckets"]), "no long, kind int")
            known = known.groupBy("no").agg(*(F.max(F.col("kind") == n).alias(c) for n, c in enumerate(("taken", "same", "copy"))))
            keyed = keyed.join(known, "no", "left").na.fill(False, ["taken", "same", "copy"])
        else:
            keyed = keyed.select("*", *(F.lit(False).alias(c) for c in ("taken", "same", "copy")))
        keyed = materialize(keyed, "checked")
        docs = keyed.where("not taken")
        nodes = keyed.where("hi is not null").select("no", "hi", "lo")

        met = self._met(signed, run, many is not None)
        settled = keyed.where("copy").select("no")
        old = F.shiftright("b", 16) < run["first"]
        stepwise = bool(self._runs) and met.count() > FEW
        if stepwise:
            # From the whole label to the widest prefix: what is settled by then is not looked at again.
            deep = met.where(old & (F.col("deep") >= forest.AGREE)).select("a", "b").join(settled.withColumnRenamed("no", "a"), "a", "left_anti")
            found = self._verified(deep, runs)
            settled = settled.unionByName(found.select(F.col("a").alias("no")))
        wide = met.join(settled.select(F.col("no").alias("a")), "a", "left_anti").join(settled.select(F.col("no").alias("other")), F.col("b") == F.col("other"), "left_anti")
        if stepwise:
            wide = wide.where(~old | (F.col("deep") < forest.AGREE))
        found = self._verified(wide.select("a", "b"), runs)
        blocked = keyed.where("same or copy").select("no")
        if self._runs:
            settled = settled.unionByName(found.where(old).select(F.col("a").alias("no"))).distinct()
            blocked = materialize(blocked.unionByName(self._copies_of(settled, nodes)).distinct(), "blocked")
        edges = found.where(~old)
        cases = self._decide(docs, nodes, edges, blocked)
        if met.where("hot").limit(1).count():
            hot = materialize(met.where("hot").select(F.explode(F.array("a", "b")).alias("no")).distinct(), "hot")
            held = self._held(hot, run["first"]) if self._runs else None
            compared = met.select("a", "b")
            while True:
                alive = self._copies_of(docs.join(cases, "no", "left_anti").select("no"), nodes)
                texts = signed.where("text is not null").join(hot, "no", "left_semi").join(alive, "no", "left_semi").select(F.col("no").alias("id"), "text", F.lit(3).alias("flags"))
                texts = materialize(texts if held is None else texts.unionByName(held), "alive")
                rest = prefix.candidates(texts, texts.select("text"), self.threshold, self.k).where((F.col("a") < F.col("b")) | old)
                if any(r["long"] for r in self._runs):
                    rest = rest.unionByName(self._left_out(met, old, alive)).distinct()
                rest = materialize(rest.join(compared, ["a", "b"], "left_anti"), "rest")
                if not rest.limit(1).count():
                    break
                compared = compared.unionByName(rest)
                found = self._verified(rest, runs)
                edges = materialize(edges.unionByName(found.where(~old)).distinct(), "edges")
                if self._runs:
                    blocked = materialize(blocked.unionByName(self._copies_of(found.where(old).select(F.col("a").alias("no")), nodes)).distinct(), "blocked")
                cases = self._decide(docs, nodes, edges, blocked)
        decided = self._keep(docs, cases, signed, path, run)
        self._commit([*self._runs, run], run["next"])
        if len(self._runs) > RUNS:
            self.compact()
        return decided.select("document_id", "at", F.col("hit").alias("is_case"))

    def _commit(self, runs: list[dict], taken: int) -> None:
        store.commit(self.spark, self.path, self.number + 1, {"made": self.made, "next": taken, "runs": runs})
        self.number, self._runs, self.next = self.number + 1, runs, taken
        # What the batch has left on the driver, and with it the shuffle files of its steps, goes before the next one.
        gc.collect()
        self.spark._jvm.System.gc()

    # One batch ---------------------------------------------------------------------------------

    def _numbered(self, documents: DataFrame, segments: DataFrame, buckets: int) -> tuple[DataFrame, int, Column, Column | None]:
        """The batch as ``(no, id, document_id, at, digest)``, the next sequence number, and filters of segments: those of
        the batch, and of it those of long documents (none if there are none)."""
        rows = materialize(documents.withColumn("id", doc_key()).orderBy("at", "document_id").withColumn("m", F.monotonically_increasing_id()), "batch")
        part = F.shiftright("m", 33)
        # One row per partition of the sorted batch: its place in the sequence.
        sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        offsets, at = [], self.next
        for p, n in sizes:
            offsets += [F.lit(p).cast("bigint"), F.lit(at).cast("bigint")]
            at += n
        total = sum(n for _, n in sizes)
        if not total:
            return rows.withColumn("no", F.lit(0).cast("bigint")), self.next, F.lit(False), None
        found = bloom.build(rows, "id", total)
        mine = found.column(doc_key())
        extent = segments.where("document_id is not null and text is not null").where(mine).select(doc_key().alias("id"), F.floor(F.coalesce("index", F.lit(0)) / BLOCK).alias("block"))
        extent = extent.groupBy("id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi")
        long = materialize(extent.select("id"), "long-documents")
        count = long.count()
        many = bloom.build(long, "id", count).column(F.col("id")) if count else None
        seq = F.element_at(F.create_map(*offsets), part) + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
        no = F.shiftleft(seq.cast("bigint"), 16).bitwiseOR(F.pmod("id", F.lit(buckets))).bitwiseOR(F.lit(0) if many is None else F.when(many, F.lit(forest.LONG)).otherwise(0))
        docs = rows.select(no.cast("bigint").alias("no"), "id", "document_id", "at", "digest")
        return docs if many is None else materialize(docs, "numbered"), at, mine, many

    def _signed(self, docs: DataFrame, segments: DataFrame, many: Column | None, path: str, buckets: int) -> DataFrame:
        """Writes and gives the signed texts of the batch, see ``_SIGNED``."""
        rows = segments.where("document_id is not null and text is not null").select(doc_key().alias("id"), F.coalesce("index", F.lit(0)).cast("bigint").alias("index"), F.col("segment_id").cast("string").alias("segment_id"), "text")
        block = F.floor(F.col("index") / BLOCK).cast("bigint")
        bucket = F.pmod("id", F.lit(buckets)).cast("int")
        heads = docs.select(bucket.alias("bucket"), "id", F.lit(-1).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("index"), F.lit("").alias("segment_id"), F.lit("").alias("text"), "no")
        one = (rows if many is None else rows.where(~many)).select(bucket.alias("bucket"), "id", F.lit(0).cast("bigint").alias("block"), "index", "segment_id", "text", F.lit(None).cast("bigint").alias("no"))
        both = heads.unionByName(one).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("id", "block", "index", "segment_id", "text")
        store.write(both.mapInArrow(_sign(buckets, self.k), _SIGNED).sortWithinPartitions("bucket", "no"), f"{path}/texts")
        if many is not None:
            own = docs.where(F.col("no").bitwiseAND(F.lit(forest.LONG)) > 0).select("id", "no")
            parts = rows.where(many).withColumn("block", block).join(own, "id")
            spread = F.pmod(F.shiftright("no", 16) + F.col("block"), F.lit(buckets)).cast("int")
            parts = parts.select(spread.alias("bucket"), "no", "block", "index", "segment_id", "text").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("no", "block", "index", "segment_id", "text")
            store.write(parts.mapInArrow(_blocks_of, "bucket int, no long, block long, text string").sortWithinPartitions("bucket", "no", "block"), f"{path}/pieces")
            pieces = self.spark.read.parquet(f"{path}/pieces").select("no", "block", "text").mapInArrow(_piece_rows("registers", self.k), _PIECE)
            store.write(_sign_long(materialize(pieces, "long-pieces"), buckets, self.k).sortWithinPartitions("bucket", "no"), f"{path}/texts", "append")
        return self.spark.read.schema(_SIGNED).parquet(f"{path}/texts")

    def _met(self, signed: DataFrame, run: dict, has_long: bool) -> DataFrame:
        """``(a, b, deep, hot)``: a new text and an earlier or stored one that meet in two trees."""
        entries = signed.where("signature is not null").select("no", "signature")
        spared = None
        if has_long:
            long = entries.where(F.col("no").bitwiseAND(F.lit(forest.LONG)) > 0)
            prefix = materialize(long.mapInArrow(forest.prefixes(self.length), "prefix long"), "long-prefixes")
            spared = bloom.build(prefix, "prefix", prefix.count()).contains
        packed = entries.mapInArrow(forest.pack(run["parts"], self.length, True, spared), forest._ROWS)
        raw = packed.repartitionById(run["parts"], F.col("part")).mapInArrow(forest.search(self._forest(self.runs), run["parts"], self.length), forest._ROWS)
        met = raw.groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.sum("deep").alias("deep"), F.bool_or("hot").alias("hot"))
        return materialize(met.where(F.col("hits") >= forest.AGREE).select("a", "b", "deep", "hot"), "met")

    def _held(self, hot: DataFrame, first: int) -> DataFrame:
        """Stored texts of ranges that new texts were left out of, as ``(id, text, flags)`` of the training side."""
        buckets = max(r["buckets"] for r in self._runs)
        stored = hot.where((F.shiftright("no", 16) < first) & (F.col("no").bitwiseAND(F.lit(forest.LONG)) == 0)).withColumn("bucket", F.col("no").bitwiseAND(F.lit(buckets - 1)).cast("int"))
        return stored.repartitionById(buckets, F.col("bucket")).mapInArrow(_texts(self.runs), "id long, text string, flags int")

    def _left_out(self, met: DataFrame, old: Column, alive: DataFrame) -> DataFrame:
        """``(a, b)``: new texts that were left out of a range, and the long stored documents their earliest text has met in one;
        these have no text of one row that could go through the prefix join."""
        long = met.where(F.col("hot") & old & (F.col("b").bitwiseAND(F.lit(forest.LONG)) > 0)).select("a", F.col("b").alias("stored"))
        left = met.where(F.col("hot") & ~old).select("a", F.col("b").alias("no")).join(alive, "no", "left_semi")
        return left.join(long, "a").select(F.col("no").alias("a"), F.col("stored").alias("b"))

    def _copies_of(self, nos: DataFrame, nodes: DataFrame) -> DataFrame:
        """All numbers of texts equal to those of ``nos``, with these."""
        own = nodes.join(nos, "no", "left_semi").select("hi", "lo").distinct()
        return nodes.join(own, ["hi", "lo"], "left_semi").select("no")

    def _verified(self, pairs: DataFrame, runs: list[dict]) -> DataFrame:
        """Those of ``pairs (a, b)`` whose texts are near, by whole texts."""
        k, t = self.k, self.threshold
        pairs = materialize(pairs, "candidates")
        is_long = (F.col("a").bitwiseOR(F.col("b"))).bitwiseAND(F.lit(forest.LONG)) > 0
        buckets = max(r["buckets"] for r in runs)
        ids = pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct().withColumn("bucket", F.col("no").bitwiseAND(F.lit(buckets - 1)).cast("int"))
        sets = materialize(ids.where(F.col("no").bitwiseAND(F.lit(forest.LONG)) == 0).repartitionById(buckets, F.col("bucket")).mapInArrow(_sets(runs, k), "no long, n int, data binary"), "sets")
        x = sets.select(F.col("no").alias("a"), F.col("n").alias("na"), F.col("data").alias("da"))
        y = sets.select(F.col("no").alias("b"), F.col("n").alias("nb"), F.col("data").alias("db"))
        short = pairs.where(~is_long).join(x, "a").join(y, "b").select("a", "b", "na", "nb", "da", "db").mapInArrow(near._exact(t), "a long, b long")
        wide = pairs.where(is_long)
        if any(r["long"] for r in runs) and wide.limit(1).count():
            spread = wide.select(F.explode(F.array("a", "b")).alias("no")).distinct().where(F.col("no").bitwiseAND(F.lit(forest.LONG)) > 0)
            # The blocks of a long document lie in all buckets.
            spread = spread.select("no", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
            pieces = spread.repartitionById(buckets, F.col("bucket")).mapInArrow(_pieces_of(runs), "no long, block long, text string").mapInArrow(_piece_rows("set", k), _PIECE)
            rows = _with_borders(materialize(pieces, "wide-pieces"), "set", k).select("no", "data").mapInArrow(_explode_sets, "no long, h long")
            other = wide.select(F.explode(F.array("a", "b")).alias("no")).distinct()
            rows = rows.unionByName(sets.select("no", "data").join(other, "no", "left_semi").mapInArrow(_explode_sets, "no long, h long"))
            rows = materialize(rows.distinct(), "wide-sets")
            n = rows.groupBy("no").agg(F.count(F.lit(1)).alias("n"))
            sized = wide.join(n.select(F.col("no").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("no").alias("b"), F.col("n").alias("nb")), "b").where(f"least(na, nb) > {t}D * greatest(na, nb)")
            common = sized.join(rows.select(F.col("no").alias("a"), "h"), "a").join(rows.select(F.col("no").alias("b"), "h"), ["b", "h"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
            short = short.unionByName(common.where(f"c > {t}D * (na + nb - c)").select("a", "b"))
        return materialize(short, "verified")

    def _decide(self, docs: DataFrame, nodes: DataFrame, edges: DataFrame, blocked: DataFrame) -> DataFrame:
        """The ``no`` of every document that is a case, as if they were taken one after the other.

        Every document *offers* its digest and its text and *watches* its digest, its text and the
        texts near it. It is a case if an earlier accepted document offers what it watches, and
        accepted if no earlier document that could still be accepted does. Both only need the
        earliest offer of a key, so a key of any size is a partial minimum.
        """
        mark = F.when(F.col("digest").isNotNull(), F.struct(F.xxhash64("digest").alias("hi"), F.xxhash64(F.lit("second"), "digest").alias("lo")))
        node = F.when(F.col("hi").isNotNull(), F.struct("hi", "lo"))
        free = docs.join(blocked, "no", "left_anti")
        offers = free.select("no", F.explode(F.array_compact(F.array(mark, node))).alias("key")).select("no", "key.*", F.lit(True).alias("offer"))
        a, b = nodes.select(F.col("no").alias("a"), F.col("hi").alias("ah"), F.col("lo").alias("al")), nodes.select(F.col("no").alias("b"), F.col("hi").alias("bh"), F.col("lo").alias("bl"))
        named = edges.join(a, "a").join(b, "b")
        both = named.select(F.explode(F.array(F.struct("ah", "al", "bh", "bl"), F.struct(F.col("bh").alias("ah"), F.col("bl").alias("al"), F.col("ah").alias("bh"), F.col("al").alias("bl")))).alias("e")).select("e.*").distinct()
        nears = both.join(free.select("no", "hi", "lo"), (F.col("hi") == F.col("ah")) & (F.col("lo") == F.col("al"))).select("no", F.col("bh").alias("hi"), F.col("bl").alias("lo"), F.lit(False).alias("offer"))
        rows = offers.unionByName(nears)
        # Only keys of a second document can decide anything.
        shared = rows.groupBy("hi", "lo").agg(F.min("no").alias("x"), F.max("no").alias("y")).where("x < y").select("hi", "lo")
        rows = materialize(rows.join(shared, ["hi", "lo"], "left_semi").distinct().withColumn("state", F.lit(0)), "watches")
        found = docs.join(blocked, "no", "left_semi").select("no")
        if rows.count() <= FEW:
            # The same decisions in one task instead of dozens of small jobs.
            done = rows.select("no", "hi", "lo", "offer").coalesce(1).mapInArrow(_all_of_them, "no long, state int")
            return materialize(found.unionByName(done.where("state = 2").select("no")), "cases")
        for turn in range(1_000_000):
            if turn == ROUNDS:
                rows = self._chains(rows)
            # 0 open, 1 accepted, 2 case; the rows of cases offer nothing any more.
            live = rows.where("offer and state < 2")
            first = live.groupBy("hi", "lo").agg(F.min(F.when(F.col("state") == 1, F.col("no"))).alias("sure"), F.min("no").alias("any"))
            view = rows.where("state = 0").join(first, ["hi", "lo"], "left").groupBy("no").agg(F.max(F.coalesce(F.col("sure") < F.col("no"), F.lit(False))).alias("case"), F.max(F.coalesce(F.col("any") < F.col("no"), F.lit(False))).alias("wait"))
            view = view.select("no", F.when(F.col("case"), 2).when(F.col("wait"), 0).otherwise(1).alias("now"))
            rows = materialize(rows.join(view, "no", "left").select("no", "hi", "lo", "offer", F.coalesce("now", "state").alias("state")), "states")
            if not rows.where("state = 0").limit(1).count():
                break
        return found.unionByName(rows.where("state = 2").select("no").distinct())

    def _chains(self, rows: DataFrame) -> DataFrame:
        """Decides what is still open in components of at most ``CHAIN`` rows, each in one task."""
        watched = rows.where("state = 0").select("hi", "lo").distinct()
        part = materialize(rows.where("state < 2").join(watched, ["hi", "lo"], "left_semi"), "open")
        least = part.groupBy("hi", "lo").agg(F.min("no").alias("a"))
        found = hash_to_min(part.join(least, ["hi", "lo"]).select("a", F.col("no").alias("b")).distinct())
        placed = part.join(found.withColumnRenamed("node", "no"), "no")
        small = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= CHAIN).select("component")
        done = placed.join(small, "component", "left_semi").select("component", "no", "hi", "lo", "offer").groupBy("component").applyInArrow(_one_after_the_other, "no long, state int")
        return materialize(rows.join(done.withColumnRenamed("state", "now"), "no", "left").select("no", "hi", "lo", "offer", F.coalesce("now", "state").alias("state")), "states")

    def _keep(self, docs: DataFrame, cases: DataFrame, signed: DataFrame, path: str, run: dict) -> DataFrame:
        """Writes the keys and the entries of what is accepted; gives every document with whether it was a case."""
        hit = cases.withColumn("hit", F.lit(True))
        rows = materialize(docs.join(hit, "no", "left").select("no", "document_id", "at", "digest", "hi", "lo", F.coalesce("hit", F.lit(False)).alias("hit")), "decided")
        # Of a rejected document only the name is known later.
        named = rows.select("no", "document_id", *(F.when(~F.col("hit"), F.col(c)).alias(c) for c in ("digest", "hi", "lo")))
        own = _keys(named, run["buckets"]).select("bucket", "hi", "lo").distinct()
        store.write(own.repartitionById(run["buckets"], F.col("bucket")).sortWithinPartitions("bucket", "hi"), f"{path}/keys")
        # Of copies the earliest text that was signed stands for all.
        texts = signed.where("signature is not null").join(rows.where("not hit").where("hi is not null").select("hi", "lo").distinct(), ["hi", "lo"], "left_semi")
        first = texts.groupBy("hi", "lo").agg(F.min("no").alias("no")).select("no")
        entries = texts.select("no", "signature").join(first, "no", "left_semi").mapInArrow(forest.pack(run["parts"], self.length, False), forest._ROWS)
        store.write(entries.select("part", "block").repartitionById(run["parts"], F.col("part")).mapInArrow(forest.merge, forest._BLOCKS).sortWithinPartitions("bucket", "lo"), f"{path}/forest")
        return rows

    # All batches -------------------------------------------------------------------------------

    def compact(self) -> None:
        """Merges all runs into one, share by share and in place: nothing of them is shuffled.

        The merged run is complete before the state that refers to it; the old runs are deleted after that, so
        what was opened before has to be opened again. Texts that were not accepted are left out, but for
        false hits of a filter of bounded size, which nothing refers to.
        """
        spark, runs = self.spark, self.runs
        run = {"name": f"run-{uuid.uuid4().hex}", "first": min(r["first"] for r in runs), "next": max(r["next"] for r in runs), "buckets": max(r["buckets"] for r in runs), "parts": max(r["parts"] for r in runs), "long": any(r["long"] for r in runs)}
        path = f"{self.path}/{run['name']}"

        def shares(n: int) -> DataFrame:
            return spark.range(0, n, 1, min(n, 4 * shuffle_partitions(spark)))

        store.write(shares(run["parts"]).mapInArrow(forest.merge_runs(self._forest(runs), run["parts"]), forest._BLOCKS).sortWithinPartitions("bucket", "lo"), f"{path}/forest")
        stored = spark.read.schema("lo long, block binary").parquet(f"{path}/forest")
        ids = materialize(stored.mapInArrow(forest.numbers, "no long").distinct(), "stored")
        keep = bloom.build(ids, "no", ids.count())
        store.write(shares(run["buckets"]).mapInArrow(_merge_keys(runs, run["buckets"]), "bucket int, hi long, lo long").sortWithinPartitions("bucket", "hi"), f"{path}/keys")
        store.write(shares(run["buckets"]).mapInArrow(_merge_texts(runs, run["buckets"], keep, "texts"), _SIGNED).sortWithinPartitions("bucket", "no"), f"{path}/texts")
        if run["long"]:
            store.write(shares(run["buckets"]).mapInArrow(_merge_texts(runs, run["buckets"], keep, "pieces"), "bucket int, no long, block long, text string").sortWithinPartitions("bucket", "no", "block"), f"{path}/pieces")
        self._commit([run], self.next)
        for r in runs:
            store.delete(spark, f"{self.path}/{r['name']}")
