"""The append-only log of labels: current labels, chains of corrections, weights, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much a label counts in training, by its source.
SOURCE_WEIGHTS = {"generator": 1.0, "human": 1.0, "llm": 0.3, "rule": 0.2, "bootstrap": 0.0}
GOLD_SOURCES = ("human", "generator")
CORRECTION_WEIGHT = 2.0


def events(df: DataFrame) -> DataFrame:
    """The log without repeated rows."""
    return df.dropDuplicates(["event_id"])


def current(df: DataFrame) -> DataFrame:
    """The latest event of each document (by time, then number); ``max_by`` keeps it a partial aggregate."""
    best = F.max_by(F.struct("event_id", "class_key", "source", "actor", "created_at"), F.struct("created_at", "event_id"))
    return df.where("document_id is not null").groupBy("document_id").agg(best.alias("e")).select("document_id", "e.*")


def weight(source: Column, corrected: Column | None = None) -> Column:
    """Training weight of a label; a human correction counts more for a time."""
    w = F.create_map(*(F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv))[source]
    return w if corrected is None else F.when(corrected & (source == "human"), F.lit(CORRECTION_WEIGHT)).otherwise(w)


def chains(df: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(document_id, length)``: the longest chain of events that supersede one another.

    Pointers are doubled each round (a chain of n events takes log2 n joins). Links to events that
    do not exist, or to an event itself, end a chain; a cycle is an error.
    """
    from docloom.session import materialize

    e = events(df).select("event_id", "document_id", "supersedes")
    ids = e.select(F.col("event_id").alias("supersedes"))
    known = e.join(ids, "supersedes", "left_semi").where("supersedes <> event_id").select("event_id", "supersedes")
    step = e.select("event_id", "document_id").join(known, "event_id", "left").select("event_id", "document_id", F.col("supersedes").alias("to"), F.when(F.col("supersedes").isNotNull(), 1).otherwise(0).cast("bigint").alias("n"))
    step = materialize(step, "chains")
    for _ in range(max_rounds):
        if not step.where("to is not null").limit(1).count():
            return step.groupBy("document_id").agg((F.max("n") + 1).alias("length"))
        nxt = step.select(F.col("event_id").alias("to"), F.col("to").alias("far"), F.col("n").alias("more"))
        step = materialize(step.join(nxt, "to", "left").select("event_id", "document_id", F.col("far").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "chains")
    raise ValueError("events supersede one another in a cycle")


def forest(df: DataFrame, key: str, parent: str, max_rounds: int = 64) -> DataFrame:
    """``(key, root, depth)`` of every row whose parents lead to a root (a row without parent).

    Pointers are doubled each round. Rows below a parent that does not exist have no root and are left out; a cycle is an error.
    A key with several parents has a row for each way.
    """
    from docloom.session import materialize

    step = materialize(df.select(F.col(key).alias("k"), F.col(parent).alias("to"), F.when(F.col(parent).isNotNull(), 1).otherwise(0).cast("bigint").alias("n")), "forest")
    step = step.withColumn("root", F.when(F.col("to").isNull(), F.col("k")))
    for _ in range(max_rounds):
        if not step.where("to is not null").limit(1).count():
            return step.select(F.col("k").alias(key), "root", F.col("n").alias("depth"))
        far = step.select(F.col("k").alias("to"), F.col("to").alias("far"), F.col("n").alias("more"), F.col("root").alias("end"))
        done, open_ = step.where("to is null"), step.where("to is not null")
        moved = open_.join(far, "to").select("k", F.col("far").alias("to"), (F.col("n") + F.col("more")).alias("n"), F.col("end").alias("root"))
        step = materialize(done.unionByName(moved), "forest")
    raise ValueError("parents form a cycle")


def snapshot_hash(df: DataFrame, columns: list[str], buckets: int = 4096) -> DataFrame:
    """One row ``(rows, digest)``: a hash of the rows that does not depend on their order.

    Row hashes are sorted within buckets of their first digits; the digest is that of the buckets'
    digests in order, so no list holds more than a small part of all rows. ``buckets`` may be raised with the data, up to
    2**31; another number gives another digest.
    """
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))
    h = df.select(F.sha2(line, 256).alias("h")).withColumn("b", (F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % buckets))
    per = h.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    return per.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def guard_gold(gold: DataFrame) -> None:
    """Gold labels come from people or the generator; anything else is an error that names the sources."""
    wrong = gold.where(~F.col("source").isin(*GOLD_SOURCES) | F.col("source").isNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source").collect()
    if wrong:
        raise ValueError("gold labels from " + ", ".join(f"{r['source']} ({r['n']})" for r in wrong))


def with_parent_mail(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """Attachments with the subject and the sender's domain of the mail they came with."""
    docs = documents.select("document_id", "parent_document_id").where("parent_document_id is not null").distinct()
    head = segments.where("kind = 'mail_kopf'").groupBy("document_id").agg(F.min_by("heading", "index").alias("subject"), F.min_by("text", "index").alias("head"))
    domain = F.lower(F.regexp_extract("head", r"From: [^@]*@([^\s>]+)", 1))
    return docs.join(head.select(F.col("document_id").alias("parent_document_id"), "subject", F.when(domain != "", domain).alias("sender_domain")), "parent_document_id", "left")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns: one row ``(n, observed, expected, kappa, alarm)``."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0)).alias("same"))
    px, py = n.groupBy("x").agg(F.sum("n").alias("nx")), n.groupBy("y").agg(F.sum("n").alias("ny"))
    e = px.join(py, px.x == py.y).agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("chance"))
    # Two single rows, put side by side through a constant key.
    j = total.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").where("n > 0")
    observed, expected = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    kappa = F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(1.0)
    return j.select("n", F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(kappa, 6).alias("kappa"), (kappa < 0.7).alias("alarm"))


def first_two_labels(df: DataFrame) -> DataFrame:
    """For documents with two events or more, the classes of the first two."""
    w = Window.partitionBy("document_id").orderBy("created_at", "event_id")
    n = events(df).withColumn("n", F.row_number().over(w)).where("n <= 2")
    return n.groupBy("document_id").agg(F.max(F.when(F.col("n") == 1, F.col("class_key"))).alias("first"), F.max(F.when(F.col("n") == 2, F.col("class_key"))).alias("second")).where("second is not null")
