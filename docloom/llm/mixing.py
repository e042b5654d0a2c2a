"""Mixing sources to target weights, by size.

Every record gets a hash-random key; within a source, records in the order of their keys are an
unbiased sequence. With running sums of their sizes the sequence is cut where the source's budget
ends. A budget above the source's size takes the source whole as often as it fits (an *epoch*) and
the beginning of the sequence once more.

The sums are distributed: keys are uniform, so equal slices of the key range hold about equally
many records of a source; slices are summed first (partial aggregates), the sums of a source's slices
are accumulated, and records are accumulated within their slice only. A slice has about
``SLICE`` records, so a source with a third of all rows is no larger task than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.unit import unit
from docloom.session import materialize

SLICE = 20_000


def prefix_sums(rows: DataFrame, by: list[str], key: str, slices: int, salt: str = "mix") -> DataFrame:
    """``rows`` with ``before``: the tokens of the records of its group ``by`` with smaller hash-random keys.

    ``slices`` is the number of equal parts the key range is cut into.
    """
    at = rows.withColumn("r", unit(salt, F.col(key).cast("string"))).withColumn("slice", F.floor(F.col("r") * slices))
    sums = at.groupBy(*by, "slice").agg(F.sum("tokens").alias("s"))
    w = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "slice", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*by, "slice").orderBy("r", key, "tokens").rowsBetween(Window.unboundedPreceding, -1)
    local = at.withColumn("local", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return local.join(offsets, [*by, "slice"]).withColumn("before", F.col("offset") + F.col("local")).drop("slice", "offset", "local", "r")


def budgets(available: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per mix and source: ``available``, ``target_share`` (among the sources that deliver) and ``budget``.

    Without ``total_tokens`` a mix is as large as it can be with every share reached: the smallest
    of ``available * max_repeats / share``. With it, budgets are cut at ``available * max_repeats``.
    Weights that are null or not positive take nothing; several rows of one source in a mix add up
    their weights, and the smallest ``max_repeats`` holds; null repeats count as one.
    """
    t = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("w"), F.greatest(F.min(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats"))
    j = t.join(available, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    live = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("w")).otherwise(0.0)
    mix = Window.partitionBy("mix_name")
    j = j.withColumn("target_share", F.when(F.sum(live).over(mix) > 0, live / F.sum(live).over(mix)).otherwise(0.0))
    most = F.col("available") * F.col("max_repeats")
    if total_tokens is None:
        total = F.floor(F.min(F.when(F.col("target_share") > 0, most / F.col("target_share"))).over(mix))
    else:
        total = F.lit(total_tokens)
    return j.withColumn("budget", F.least(F.coalesce(F.floor(F.col("target_share") * total), F.lit(0)), most).cast("bigint"))


def mix(sizes: DataFrame, targets: DataFrame, key: str, total_tokens: int | None = None, salt: str = "mix") -> DataFrame:
    """``(mix_name, source, key, tokens, repeats)``: the records of each mix and how often each occurs.

    Records without source, without size, or with a null key are in no mix. The last, partial epoch
    takes records that end within what is left of the budget. Where a long record stands across
    the cut it is passed over, and the sequence goes on with the records behind it that fit into
    the gap, until no record left fits. Every pass takes at least the first record that fits, and the gap is
    then smaller than the record across the cut, so passes are few.
    """
    rows = sizes.where(F.col("source").isNotNull() & F.col(key).isNotNull() & (F.col("tokens") > 0)).select(key, "source", "tokens")
    rows = materialize(rows, "sizes")
    slices = max(1, -(-rows.count() // SLICE))
    available = rows.groupBy("source").agg(F.sum("tokens").cast("bigint").alias("available"))
    plan = materialize(budgets(available, targets, total_tokens).where("budget > 0").select("mix_name", "source", "available", "max_repeats", "budget"), "budgets")
    epochs = F.floor(F.col("budget") / F.col("available")).cast("bigint")
    plan = plan.select("mix_name", "source", epochs.alias("epochs"), (F.col("budget") - epochs * F.col("available")).alias("gap"))
    by = ["mix_name", "source"]
    taken, open_rows = None, rows.join(plan, "source")
    while True:
        placed = prefix_sums(open_rows.where("tokens <= gap").select(*by, key, "tokens", "gap"), by, key, slices, salt)
        now = materialize(placed.select(*by, key, "tokens", "gap", (F.col("before") + F.col("tokens") <= F.col("gap")).alias("take")), "cut")
        if taken is not None and not now.limit(1).count():
            break
        got = now.where("take").select(*by, key, "tokens")
        taken = got if taken is None else taken.unionByName(got)
        used = now.where("take").groupBy(*by).agg(F.sum("tokens").alias("used"))
        open_rows = now.where("not take").drop("take").join(used, by, "left").withColumn("gap", F.col("gap") - F.coalesce("used", F.lit(0))).drop("used")
    whole = rows.join(plan.where("epochs > 0"), "source").select(*by, key, "tokens", F.col("epochs").alias("repeats"))
    once = taken.withColumn("repeats", F.lit(1).cast("bigint"))
    return whole.unionByName(once).groupBy(*by, key, "tokens").agg(F.sum("repeats").alias("repeats"))


def report(mixed: DataFrame, available: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per mix and source: what was wanted, what there is, and the share reached."""
    plan = budgets(available, targets, total_tokens)
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("repeats").alias("most_repeats"))
    w = Window.partitionBy("mix_name")
    j = plan.join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "records", "most_repeats"])
    reached = F.when(F.sum("tokens").over(w) > 0, F.col("tokens") / F.sum("tokens").over(w)).otherwise(0.0)
    return j.select("mix_name", "source", F.round("target_share", 6).alias("target_share"), "available", "budget", "tokens", "records", "most_repeats", F.round(reached, 6).alias("reached_share"))
