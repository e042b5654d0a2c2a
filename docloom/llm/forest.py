"""A forest of sorted signatures: labels, packed entries, range search with widening prefixes.

Every text has a label of ``DEPTH`` one-byte signature values in each of ``TREES`` trees. An entry's key
is label and tree in the order ``value 1, value 2, tree, value 3, ...``, so one sorted sequence holds all
trees, texts whose labels begin alike lie together in it, and a share of its key space holds a share
of every tree. A run stores it as blocks of ``ENTRIES`` entries with their first and last key.

A query finds the range of its label in each sequence and widens the prefix from the whole label to
``WIDEST`` values. Recall of a text of similarity s at prefix p, if it counts from two trees on:
``1 - (1 - s**p)**L - L * s**p * (1 - s**p)**(L - 1)``; with L = 96 and p = 4 that is 0.985 at 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from docloom.llm import blocks, hyperminhash, shingling, store

U = np.uint64
REPS = 24
WIDTH = 4
DEPTH = 5
TREES = REPS // WIDTH * hyperminhash.BUCKETS
KEY_BYTES = DEPTH + 1
AGREE = 2
#: Entries of a stored block, and largest range that is compared pair by pair.
ENTRIES = 2048
STAR = 32
STEP = 1_000_000
PACKED = 4096
#: The bit of a document's number that says it is long.
LONG = 1 << 15


def recall_at(similarity: float, length: int, trees: int = TREES) -> float:
    """The chance that a pair of this similarity meets in at least two trees at this prefix."""
    q = similarity**length
    return 1 - (1 - q) ** trees - trees * q * (1 - q) ** (trees - 1)


def prefix_length(threshold: float, recall: float = 0.98, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that finds a pair at the threshold in two trees with this probability."""
    p = depth
    while p > 1 and recall_at(threshold, p, trees) < recall:
        p -= 1
    return p


def values(registers: np.ndarray) -> np.ndarray:
    """One byte per register, shaped (rows, REPS * BUCKETS); what is kept of a signature."""
    return (shingling.mix(registers.astype(np.uint64) + U(0x5EED)) >> U(56)).astype(np.uint8).reshape(len(registers), -1)


def keys_of(byte: np.ndarray) -> np.ndarray:
    """Keys of KEY_BYTES bytes, shaped (rows, TREES), of signatures as ``values`` gives them."""
    n = len(byte)
    v = byte.reshape(n, REPS // WIDTH, WIDTH, hyperminhash.BUCKETS).astype(np.uint64)
    out = np.zeros((n, REPS // WIDTH, hyperminhash.BUCKETS), np.uint64)
    for d in range(DEPTH):
        value = v[:, :, d, :] if d < WIDTH else np.roll(v[:, :, d % WIDTH, :], 5 * (d // WIDTH), axis=-1)
        place = d if d < 2 else d + 1
        out |= value << U(8 * (KEY_BYTES - 1 - place))
    tree = np.arange(TREES, dtype=np.uint64).reshape(1, REPS // WIDTH, hyperminhash.BUCKETS)
    return (out | (tree << U(8 * (KEY_BYTES - 3)))).reshape(n, TREES)


def _mask(length: int) -> np.uint64:
    """The bits of a key below a prefix of ``length`` values (two at least)."""
    return U((1 << 8 * (DEPTH - length)) - 1)


_ROWS = "part int, block binary, a long, b long, hits int, deep int, hot boolean, prefix long"


def _blobs(parts, found):
    n = len(found)
    nothing = pa.nulls(n)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(found, pa.binary()), *(nothing.cast(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()))], _NAMES)


def _marks(prefix: np.ndarray, parts: int):
    """Rows that tell the task of each prefix that a task before it has left texts of that range out."""
    n = len(prefix)
    part = ((prefix * U(parts)) >> U(8 * KEY_BYTES)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(part), *(pa.nulls(n).cast(t) for t in (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())), pa.array(prefix.astype(np.int64))], _NAMES)


_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _pairs(a, b, hits, deep, hot: bool, part: int = 0):
    """Pairs in steps of bounded size; equal ones of one step are added up first."""
    keep = a != b
    a, b = a[keep], b[keep]
    if not len(a):
        return
    hits, deep = np.broadcast_to(hits, keep.shape)[keep], np.broadcast_to(deep, keep.shape)[keep]
    order = np.lexsort((b, a))
    a, b, hits, deep = a[order], b[order], hits[order], deep[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    a, b, hits, deep = a[start], b[start], np.add.reduceat(hits, start), np.add.reduceat(deep, start)
    for s in range(0, len(a), 100_000):
        n = len(a[s : s + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.nulls(n).cast(pa.binary()), pa.array(a[s : s + n]), pa.array(b[s : s + n]), pa.array(hits[s : s + n].astype(np.int32)), pa.array(deep[s : s + n].astype(np.int32)), pa.array(np.full(n, hot)), pa.nulls(n).cast(pa.int64())], _NAMES)


def is_long(nos: np.ndarray) -> np.ndarray:
    """Whether numbers are those of long documents."""
    return (nos & LONG) > 0


def _stars(keys: np.ndarray, nos: np.ndarray, length: int, spared=None, marked: np.ndarray | None = None):
    """Large (or ``marked``) ranges of sorted entries: the pairs of their earliest text with the others, whether they agree in
    all values, and which entries those are. Long documents meet every text of the range and stay in it;
    ranges whose prefix is ``spared`` stay whole."""
    mask = _mask(length)
    start = np.flatnonzero(np.concatenate([[True], (keys[1:] & ~mask) != (keys[:-1] & ~mask)]))
    size = np.diff(np.append(start, len(keys)))
    large = np.flatnonzero(size > STAR) if marked is None else np.flatnonzero((size > STAR) | np.isin(keys[start] & ~mask, marked) & (size > 1))
    if spared is not None and len(large):
        large = large[~spared(keys[start[large]] & ~mask)]
    if not len(large):
        return None
    inside = np.concatenate([np.arange(start[i], start[i] + size[i]) for i in large])
    group = np.repeat(np.arange(len(large)), size[large])
    order = np.lexsort((nos[inside], group))
    inside = inside[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    centre = inside[first][group]
    a, b, gone = [centre], [inside], ~first & ~is_long(nos[inside])
    for i in inside[is_long(nos[inside])]:
        at = np.searchsorted(start[large], i, "right") - 1
        own = np.arange(start[large[at]], start[large[at]] + size[large[at]])
        earlier = nos[own] < nos[i]
        a.append(np.where(earlier, own, i))
        b.append(np.where(earlier, i, own))
    a, b = np.concatenate(a), np.concatenate(b)
    return nos[a], nos[b], keys[a] == keys[b], inside[gone]


def prefixes(length: int):
    """The prefixes of all labels of (no, signature) rows."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                byte = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array((keys_of(byte).ravel() & ~_mask(length)).view(np.int64))], ["prefix"])

    return run


def pack(parts: int, length: int, star: bool, spared=None):
    """From (no, signature) to blocks per share of the key space.

    With ``star``, a range that is large within the task already is compared with its earliest text here,
    and only that text goes on; so no task of the search is sent more than a few entries of such
    a range per task before it, however many texts it has.
    """

    def run(batches):
        # A few thousand texts at a time have hundreds of thousands of entries.
        for b in (whole.slice(lo, PACKED) for whole in batches for lo in range(0, whole.num_rows, PACKED)):
            nos = b.column(0).to_numpy().astype(np.int64)
            byte = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(nos), -1)
            keys = keys_of(byte).ravel()
            rows = np.repeat(np.arange(len(nos)), TREES)
            order = np.argsort(keys, kind="stable")
            keys, rows = keys[order], rows[order]
            if star and (found := _stars(keys, nos[rows], length, spared)):
                a, c, same, gone = found
                yield _marks(np.unique(keys[gone] & ~_mask(length)), parts)
                yield from _pairs(a, c, AGREE, np.where(same, AGREE, 0), True, int(nos[0] % parts))
                keep = np.ones(len(keys), bool)
                keep[gone] = False
                keys, rows = keys[keep], rows[keep]
            out = list(blocks.pack(keys << U(64 - 8 * KEY_BYTES), rows, nos.view(np.uint64), parts, key_bytes=KEY_BYTES))
            yield _blobs([p for p, _ in out], [x for _, x in out])

    return run


def _gathered(blobs):
    keys, nos = blocks.gather(blobs, key_bytes=KEY_BYTES)
    nos = nos.view(np.int64)
    order = np.lexsort((nos, keys))
    keys, nos = keys[order], nos[order]
    keep = np.concatenate([[True], (nos[1:] != nos[:-1]) | (keys[1:] != keys[:-1])])
    return keys[keep], nos[keep]


def search(runs: list[tuple[str, int]], parts: int, length: int):
    """Meetings of the new texts of a share of the key space, with each other and with stored runs.

    ``runs`` are the addresses of their blocks and their numbers of buckets. Rows ``(a, b, hits, deep,
    hot)``, a new and b later or stored: ``hits`` trees in which the labels agree in ``length`` values, ``deep`` of them in all.
    A large range of new texts is compared with its earliest text (``hot``); what is stored was
    accepted, so it has no near texts, and ranges of it are met whole, in steps of bounded size.
    Where a task before has left texts of a range out, the stored texts of the range are ``hot`` as well: they meet
    one new text that is here, long ones every one, for what was left out has met none of them.
    """
    mask = _mask(length)

    def left_out(keys, marked, i, old):
        """Which pairs of places ``i`` and stored numbers stand for a range of which texts were left out."""
        mine = np.isin(keys & ~mask, marked)
        first = np.concatenate([[True], (keys[1:] & ~mask) != (keys[:-1] & ~mask)])
        return mine[i] & (first[i] | is_long(old))

    def inner(keys, nos, marked):
        stars = _stars(keys, nos, length, marked=marked)
        live = np.ones(len(keys), bool)
        if stars:
            a, c, same, gone = stars
            yield from _pairs(a, c, AGREE, np.where(same, AGREE, 0), True)
            live[gone] = False
        k, n = keys[live], nos[live]
        hi = np.searchsorted(k & ~mask, k & ~mask, "right")
        for at in range(0, len(k), STEP // STAR):
            own = np.arange(at, min(len(k), at + STEP // STAR))
            many = hi[own] - own - 1
            i = np.repeat(own, many)
            j = i + 1 + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield from _pairs(np.minimum(n[i], n[j]), np.maximum(n[i], n[j]), np.ones(len(i), np.int64), (k[i] == k[j]).astype(np.int64), False)

    def outer(part, keys, nos, marked):
        first = np.unique(keys & ~mask).astype(np.int64)
        for uri, stored in runs:
            # Shares of the key space nest: both numbers are powers of two.
            own = [part * stored // parts] if stored <= parts else range(part * (stored // parts), (part + 1) * (stored // parts))
            for bucket in own:
                held = []
                for table in store.overlapping(f"{uri}/bucket={bucket}", "lo", "hi", first, first + int(mask), ["lo", "hi", "block"]):
                    lo, hi = table["lo"].to_numpy(), table["hi"].to_numpy()
                    at = np.searchsorted(first + int(mask), lo)
                    meets = np.flatnonzero((at < len(first)) & (first[np.minimum(at, len(first) - 1)] <= hi))
                    held += [table["block"][int(x)].as_py() for x in meets]
                    if len(held) >= 256:
                        yield from matched(keys, nos, marked, held)
                        held = []
                if held:
                    yield from matched(keys, nos, marked, held)

    def matched(keys, nos, marked, held):
        k, n = _gathered(held)
        lo, hi = np.searchsorted(k, keys & ~mask, "left"), np.searchsorted(k, keys | mask, "right")
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            many = (hi - lo)[at:to]
            i = np.repeat(np.arange(at, to), many)
            j = np.repeat(lo[at:to], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            deep = (keys[i] == k[j]).astype(np.int64)
            if len(marked):
                hot = left_out(keys, marked, i, n[j])
                yield from _pairs(nos[i[hot]], n[j[hot]], AGREE, deep[hot], True)
                i, j, deep = i[~hot], j[~hot], deep[~hot]
            yield from _pairs(nos[i], n[j], np.ones(len(i), np.int64), deep, False)
            at = to

    def run(batches):
        by: dict[int, list] = {}
        marks: list[np.ndarray] = []
        for b in batches:
            passed = b.column(2).is_valid()
            if passed.true_count:
                yield pa.RecordBatch.from_arrays(b.filter(passed).columns, _NAMES)
            marks.append(b.column(7).drop_null().to_numpy().view(np.uint64))
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if blob is not None:
                    by.setdefault(p, []).append(blob)
        marked = np.unique(np.concatenate(marks)) if marks else np.empty(0, np.uint64)
        for part, blobs in by.items():
            keys, nos = _gathered(blobs)
            yield from inner(keys, nos, marked)
            yield from outer(part, keys, nos, marked)

    return run


_BLOCKS = "bucket int, lo long, hi long, block binary"


def _sorted_blocks(part, keys, nos):
    for s in range(0, len(keys), 64 * ENTRIES):
        rows = []
        for t in range(s, min(s + 64 * ENTRIES, len(keys)), ENTRIES):
            k, n = keys[t : t + ENTRIES], nos[t : t + ENTRIES]
            distinct, at = np.unique(n, return_inverse=True)
            (_, blob), = blocks.pack(k << U(64 - 8 * KEY_BYTES), at, distinct.view(np.uint64), 1, key_bytes=KEY_BYTES)
            rows.append((part, int(k[0]), int(k[-1]), blob))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["bucket", "lo", "hi", "block"])


def numbers(batches):
    """The numbers of all texts of stored blocks ``(lo, block)``, repeated."""
    for b in batches:
        for blob in b.column(1).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(blocks.unpack(blob, key_bytes=KEY_BYTES)[1]).view(np.int64))], ["no"])


def merge(batches):
    """Blocks of one share of the key space, as ``pack`` gives them, to one sorted sequence of stored blocks."""
    by: dict[int, list] = {}
    for b in batches:
        for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(p, []).append(blob)
    for part, blobs in by.items():
        yield from _sorted_blocks(part, *_gathered(blobs))


def merge_runs(runs: list[tuple[str, int]], parts: int):
    """The stored blocks of several runs to one sequence, share by share; ``parts`` is at least theirs."""

    def run(batches):
        everything = np.array([0], np.int64), np.array([(1 << 8 * KEY_BYTES) - 1], np.int64)
        for b in batches:
            for part in b.column(0).to_pylist():
                width = (1 << 8 * KEY_BYTES) // parts
                blobs = [x for uri, stored in runs for t in store.overlapping(f"{uri}/bucket={part * stored // parts}", "lo", "hi", *everything, ["lo", "hi", "block"]) for x in t["block"].to_pylist()]
                if blobs:
                    keys, nos = _gathered(blobs)
                    lo, hi = np.searchsorted(keys, U(part * width)), np.searchsorted(keys, U((part + 1) * width))
                    yield from _sorted_blocks(part, keys[lo:hi], nos[lo:hi])

    return run
