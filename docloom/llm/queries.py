"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import normal_key
from docloom.llm import history, mixing, near, overlap, packing, quality, sampling, splits, store, tokens
from docloom.llm.oracle import ORACLE  # noqa: F401
from docloom.session import materialize, shared_path, table

#: Shares of the splits, for every class: of eight templates five gold, one calib, two train.
PROPORTIONS = {"gold": 5 / 8, "calib": 1 / 8, "train": 2 / 8}
SAMPLE_RATE = 0.2


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of distinct segments of one group of near texts."""
    groups = near.near_groups(table(spark, sf_dir, "segments"), "segment_id", "text")
    return near.group_pairs(groups, "segment_id")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per segment that is near another: its group and the size of the group."""
    return near.near_groups(table(spark, sf_dir, "segments"), "segment_id", "text")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlapping_segments(table(spark, sf_dir, "segments"), table(spark, sf_dir, "ingested_documents"), table(spark, sf_dir, "manifest"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near segments across gold or calib on the one side and train on the other."""
    pair = _overlaps(spark, sf_dir)
    return pair.select(F.least("eval_segment", "train_segment").alias("segment_id_a"), F.greatest("eval_segment", "train_segment").alias("segment_id_b")).distinct()


def p4_decided(spark: SparkSession, sf_dir: str, loads: int = 8) -> DataFrame:
    """Every ingested document with whether it was accepted already.

    The batches (distinct ``ingested_at``) are taken in order, in ``loads`` steps of as many batches; each
    step meets what the ones before have stored. After the fifth the runs are merged. The segments are told
    apart by load once, so a load reads its own and not the whole table.
    """
    segments, documents = table(spark, sf_dir, "segments"), table(spark, sf_dir, "ingested_documents")
    # One row per batch: bounded by the number of batches, not by their size.
    batches = [r[0] for r in documents.where("ingested_at is not null").select("ingested_at").distinct().orderBy("ingested_at").collect()]
    cuts = sorted({batches[len(batches) * i // loads] for i in range(1, loads)}) if batches else []
    at = F.coalesce("ingested_at", F.expr("timestamp '9999-12-31 00:00:00'"))
    kept = history.History(spark, shared_path(spark, "history"))
    load = sum((F.when(at >= F.lit(cut), 1).otherwise(0) for cut in cuts), F.lit(0))
    by_load = shared_path(spark, "loads")
    owned = documents.where("document_id is not null").select("document_id", load.cast("int").alias("load")).distinct()
    mine = segments.where("text is not null").select("document_id", "index", "segment_id", "text").join(owned, "document_id")
    mine.write.option("compression", "zstd").partitionBy("load").parquet(by_load)
    out = None
    for n in range(len(cuts) + 1):
        part = spark.read.schema(mine.schema).parquet(by_load).where(F.col("load") == n)
        decided = kept.add(documents.where(load == n), part.drop("load"))
        out = decided if out is None else out.unionByName(decided)
        store.delete(spark, f"{by_load}/load={n}")
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content or text was already accepted."""
    return p4_decided(spark, sf_dir).where("is_case").select("document_id")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split, template and source, and per source of the training side: segments that training has too, and the pairs.

    Copies are counted, not paired: a link between two texts stands for the segments that have the one times those that have the other.
    """
    segments, docs = table(spark, sf_dir, "segments"), table(spark, sf_dir, "ingested_documents")
    links = overlap.overlapping_texts(segments, docs, table(spark, sf_dir, "manifest"))
    record = _manifest(spark, sf_dir).where("split in ('gold', 'calib', 'train')").select("source_path", "split", "template", F.substring_index("source_path", "/", 1).alias("source")).distinct()
    where = docs.select("document_id", "source_path").distinct().join(record, "source_path").select("document_id", "split", "template", "source").distinct()
    member = overlap.members(segments).join(where, "document_id").select("segment_id", "id", "split", "template", "source").distinct()
    member = materialize(member, "members")
    sides = ["split", "template", "source"]
    e = member.where("split <> 'train'").groupBy(F.col("id").alias("a"), *sides).agg(F.count(F.lit(1)).alias("ne"))
    t = member.where("split = 'train'").select(F.col("id").alias("b"), F.col("source").alias("train_source"), "segment_id").distinct().groupBy("b", "train_source").agg(F.count(F.lit(1)).alias("nt"))
    # A segment of a document on both sides is no pair with itself.
    both = member.where("split <> 'train'").select(F.col("id").alias("a"), *sides, "segment_id").join(member.where("split = 'train'").select("segment_id", F.col("source").alias("train_source")).distinct(), "segment_id")
    own = both.groupBy("a", *sides, "train_source").agg(F.count(F.lit(1)).alias("own"))
    met = links.join(e, "a").join(t, "b").groupBy("a", *sides, "train_source").agg(F.max("ne").alias("ne"), F.sum(F.col("ne") * F.col("nt")).alias("pairs"), F.sum("nt").alias("nt"), F.max(F.col("a") == F.col("b")).alias("itself"))
    keys = ["a", *sides, "train_source"]
    met, own = met.alias("m"), own.alias("o")
    on = [F.col(f"m.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    n = F.when(F.col("m.itself"), F.coalesce("o.own", F.lit(0))).otherwise(0)
    # Where the only partner of a text is the segment itself, that segment has none.
    lone = F.when(F.col("m.nt") == 1, n).otherwise(0)
    got = met.join(own, on, "left").select(*(F.col(f"m.{k}").alias(k) for k in keys), (F.col("m.pairs") - n).alias("pairs"), (F.col("m.ne") - lone).alias("segments"))
    return got.groupBy(*sides, "train_source").agg(F.sum("segments").alias("segments"), F.sum("pairs").alias("pairs")).where("pairs > 0")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with names in one spelling, every record once."""
    m = table(spark, sf_dir, "manifest")
    named = m.select("source_path", normal_key("class_key", "_").alias("class"), normal_key("template_id").alias("template"), overlap.split_value("split").alias("split"))
    return materialize(named.distinct(), "manifest")


def p1_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the manifest with its split, all records of a template (or path) in one."""
    placed = splits.assign_splits(_manifest(spark, sf_dir), ["template", "source_path"], "class", PROPORTIONS)
    return placed.select("source_path", "class", "template", "split", "component", "component_class", "assigned_split")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of records whose component by template has several splits at present."""
    named = _manifest(spark, sf_dir).where("template is not null")
    return splits.conflicting(named, ["template"], "split").select("source_path").where("source_path is not null").distinct()


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per class and split (also splits that got none), their share of the class and what was wanted.

    ``largest_share`` is the share of the class's largest component, which no split can be without.
    """
    n = p1_assigned(spark, sf_dir).groupBy("component_class", "assigned_split", "component").agg(F.count(F.lit(1)).alias("n"))
    split = F.explode(F.array(*(F.struct(F.lit(s).alias("assigned_split"), F.lit(p).alias("target_share")) for s, p in sorted(PROPORTIONS.items()))))
    classes = n.groupBy("component_class").agg(F.sum("n").alias("total"), F.max("n").alias("largest")).select("*", split.alias("s")).select("component_class", "total", "largest", "s.*")
    got = n.groupBy(F.col("component_class").alias("k"), F.col("assigned_split").alias("s")).agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("components"))
    j = classes.join(got, F.col("component_class").eqNullSafe(F.col("k")) & (F.col("assigned_split") == F.col("s")), "left").na.fill(0, ["records", "components"])
    return j.select("component_class", "assigned_split", "records", "components", F.round(F.col("records") / F.col("total"), 6).alias("share"), "target_share", F.round(F.col("largest") / F.col("total"), 6).alias("largest_share"))


def _drawn(rows: DataFrame) -> DataFrame:
    """The sample of ``rows (source_path, template, split)``, by the template's name (by the path where there is none)."""
    key = F.coalesce(F.concat(F.lit("template:"), "template"), F.concat(F.lit("path:"), "source_path"))
    return sampling.stable_sample(rows, key, SAMPLE_RATE, F.col("split"), salt="p3")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample per split, in which records of one template are treated alike."""
    rows = _manifest(spark, sf_dir).select("source_path", "template", "split").distinct()
    return _drawn(rows).select("source_path", "template", "split", "unit")


def p3_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch and split: records that came with it, how many the sample draws of all records, how many it drew
    when only the earlier half of the batches was there, and how many of these it has lost since.

    A record that was never ingested has no batch and counts as late.
    """
    rows = _manifest(spark, sf_dir).select("source_path", "template", "split").where("split is not null").distinct()
    docs = table(spark, sf_dir, "ingested_documents")
    first = docs.groupBy("source_path").agg(F.min("ingested_at").alias("batch"))
    rows = materialize(rows.join(first, "source_path", "left"), "arrivals")
    # One row per batch.
    batches = [r[0] for r in docs.select("ingested_at").where("ingested_at is not null").distinct().orderBy("ingested_at").collect()]
    half = batches[len(batches) // 2] if batches else None
    late = _drawn(rows).withColumn("late", F.lit(1))
    early = _drawn(rows.where(F.col("batch") < F.lit(half))).withColumn("early", F.lit(1))
    tags = rows.unionByName(late, True).unionByName(early, True)
    out = tags.groupBy("source_path", "template", "split").agg(F.max("batch").alias("batch"), F.max("late").alias("late"), F.max("early").alias("early"))
    counts = (F.count(F.lit(1)).alias("records"), F.count("late").alias("drawn"), F.count("early").alias("drawn_early"), F.count_if(F.col("early").isNotNull() & F.col("late").isNull()).alias("lost"))
    return out.groupBy(F.unix_micros("batch").alias("batch"), "split").agg(*counts)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.with_tokens(docs, "doc_id", "text", keep=("source",))


def _placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A fixed table of a few container sizes.
    capacities = [(r["profile"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_capacities").collect()]
    sizes = materialize(_sizes(spark, sf_dir).select("doc_id", "tokens"), "sizes")
    return packing.pack_items(sizes, sorted(capacities))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document (or piece of one longer than the container) lies, for each container size."""
    return _placements(spark, sf_dir)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, unused room and spread of cost per container size."""
    return packing.report(_placements(spark, sf_dir))


def _mix_inputs(spark: SparkSession, sf_dir: str):
    sizes = _sizes(spark, sf_dir).select("doc_id", normal_key("source", "_").alias("source"), "tokens")
    targets = table(spark, sf_dir, "mix_targets").select("mix_name", normal_key("source", "_").alias("source"), "target_weight", "max_repeats")
    return sizes, targets


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix and how often each occurs in it."""
    sizes, targets = _mix_inputs(spark, sf_dir)
    return mixing.mix(sizes, targets, "doc_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source of every mix."""
    sizes, targets = _mix_inputs(spark, sf_dir)
    sizes = materialize(sizes, "sizes")
    available = sizes.where("source is not null and tokens > 0").groupBy("source").agg(F.sum("tokens").cast("bigint").alias("available"))
    return mixing.report(mixing.mix(sizes, targets, "doc_id"), available, targets)


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and structural profile of every document."""
    return quality.text_quality(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which less than half belongs to running sentences."""
    return p8_quality(spark, sf_dir).where("prose_share < 0.5").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_assigned": p1_assigned,
    "p1_shares": p1_shares,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_sample": p3_sample,
    "p3_growth": p3_growth,
    "p4_found": p4_found,
    "p4_decided": p4_decided,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_packed": p6_packed,
    "p6_report": p6_report,
    "p7_mixed": p7_mixed,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_quality": p8_quality,
}
