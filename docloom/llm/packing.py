"""Filling sequences of fixed capacity with texts, balanced by attention cost.

A text of t tokens costs ``t + quadratic * t**2``: the linear layers see every token, attention
sees pairs of tokens of one text. Texts are taken in descending size and put into the sequence of
the lowest cost so far that has room; if none has, a new one is opened. Opening at first as many as can hold all at
least keeps costs most alike; opening none in advance often needs fewer sequences when they hold few
texts each. Both are tried, and fewer sequences win (equal numbers: the first way). A text larger
than the capacity fills whole sequences with its first tokens and takes part with the rest; no
other text is cut.

Scale: texts go to shards by a hash of their key; a shard has about ``SHARD`` sequences and is packed
in one task, whatever the size of the corpus. The loss is part of one sequence per shard. Whole
sequences of long texts never reach a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 1024
QUADRATIC = 1 / 4096
_SCHEMA = "profile string, capacity_tokens bigint, container string, item {}, start bigint, tokens bigint, cost double"


def pack(sizes: np.ndarray, capacity: int, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each item; ``sizes`` descending, none above the capacity."""
    least = max(1, int(-(-sizes.sum() // capacity)))
    wide = _assign(sizes, capacity, quadratic, least)
    if len(wide) == 0 or wide.max() + 1 <= least:
        return wide
    tight = _assign(sizes, capacity, quadratic, 1)
    return tight if tight.max() < wide.max() else wide


def _assign(sizes: np.ndarray, capacity: int, quadratic: float, n: int) -> np.ndarray:
    """Each item to the lowest-cost sequence with room, ``n`` being open at first."""
    out = np.empty(len(sizes), np.int64)
    room, cost = np.full(2 * n + 8, capacity, np.int64), np.zeros(2 * n + 8)
    for i, t in enumerate(sizes.tolist()):
        fits = np.where(room[:n] >= t, cost[:n], np.inf)
        at = int(fits.argmin())
        if fits[at] == np.inf:
            at = n
            n += 1
            if n > len(room):
                room, cost = np.concatenate([room, np.full(n, capacity, np.int64)]), np.concatenate([cost, np.zeros(n)])
        out[i] = at
        room[at] -= t
        cost[at] += t + quadratic * t * t
    return out


def pack_items(sizes: DataFrame, capacities: list[tuple[str, int]], key: str = "doc_id", tokens: str = "tokens", quadratic: float = QUADRATIC) -> DataFrame:
    """Placements ``(profile, capacity_tokens, container, item, start, tokens, cost)``.

    ``sizes`` has one row per item (a repeated key of any type is a further item of its own), ``capacities`` a few named sizes (positive). An item
    with null or no tokens needs no room and gets no row. ``start`` is the first token of the piece,
    0 unless the item was cut. The result depends on the keys and sizes only, not on partitions.
    """
    for name, size in capacities:
        if not size or size < 1:
            raise ValueError(f"capacity of {name}: {size}")
    rows = sizes.where(F.col(key).isNotNull() & (F.col(tokens) > 0)).select(F.col(key).alias("item"), F.col(tokens).cast("bigint").alias("t"))
    kind = rows.schema["item"].dataType
    schema = _SCHEMA.format(kind.simpleString())
    if not capacities:
        return rows.sparkSession.createDataFrame([], schema)
    # Repeated keys are counted before they are spread, so a hot key is one row per task and then one per copy.
    copies = rows.groupBy("item", "t").agg(F.count(F.lit(1)).alias("n"))
    items = copies.select("item", "t", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    rest = [F.sum(F.col("t") % size).alias(f"c{i}") for i, (_, size) in enumerate(capacities)]
    totals = items.agg(*rest).first()
    spec = [F.struct(F.lit(name).alias("profile"), F.lit(size).cast("bigint").alias("c"), F.lit(max(1, round((totals[i] or 0) / (size * SHARD)))).cast("bigint").alias("shards")) for i, (name, size) in enumerate(capacities)]
    each = items.select("item", "t", "copy", F.explode(F.array(*spec)).alias("s")).select("item", "t", "copy", "s.profile", "s.c", "s.shards")
    whole = each.where("t >= c").select("profile", F.col("c").alias("capacity_tokens"), "item", "t", "copy", F.explode(F.sequence(F.lit(0), (F.col("t") / F.col("c")).cast("bigint") - 1)).alias("n"))
    full = whole.select("profile", "capacity_tokens", F.concat_ws("-", F.lit("w"), F.col("item").cast("string"), F.col("t"), F.col("copy"), F.col("n")).alias("container"), "item", (F.col("n") * F.col("capacity_tokens")).alias("start"), F.col("capacity_tokens").alias("tokens"), (F.col("capacity_tokens") + F.lit(quadratic) * F.col("capacity_tokens") * F.col("capacity_tokens")).alias("cost"))
    left = each.where("t % c > 0").select("profile", F.col("c").alias("capacity_tokens"), F.pmod(F.xxhash64("item", "copy", F.lit("pack")), F.col("shards")).alias("shard"), "item", (F.col("t") - F.col("t") % F.col("c")).alias("start"), (F.col("t") % F.col("c")).alias("tokens"))

    def one(tab: pa.Table) -> pa.Table:
        size = tab["tokens"].to_numpy()
        order = np.asarray(pc.sort_indices(tab, [("tokens", "descending"), ("item", "ascending"), ("start", "ascending")]))
        capacity, shard = tab["capacity_tokens"][0].as_py(), tab["shard"][0].as_py()
        seq = pack(size[order], capacity, quadratic)
        t = size[order]
        return pa.table(
            {
                "profile": tab["profile"].take(pa.array(order)),
                "capacity_tokens": tab["capacity_tokens"].take(pa.array(order)),
                "container": pa.array([f"p-{shard}-{s}" for s in seq.tolist()]),
                "item": tab["item"].take(pa.array(order)),
                "start": tab["start"].take(pa.array(order)),
                "tokens": pa.array(t),
                "cost": pa.array(t + quadratic * t.astype(float) ** 2),
            }
        )

    packed = left.groupBy("profile", "shard").applyInArrow(one, schema)
    return full.unionByName(packed)


def report(placements: DataFrame) -> DataFrame:
    """Per profile: containers, tokens, share of room unused, and how evenly the cost is spread."""
    box = placements.groupBy("profile", "capacity_tokens", "container").agg(F.sum("tokens").alias("t"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n"))
    return box.groupBy("profile", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("n").alias("pieces"),
        F.sum("t").alias("tokens"),
        F.round(1 - F.sum("t") / (F.count(F.lit(1)) * F.first("capacity_tokens")), 6).alias("unused_share"),
        F.max("t").alias("largest_fill"),
        F.round(F.stddev_pop("cost") / F.avg("cost"), 6).alias("cost_variation"),
    )
