"""Ground truth: manifest, frozen splits, coverage and leakage checks."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.running import running
from docloom.sources import schemas

GOLD_PER_CLASS, CALIB_PER_CLASS = 5, 1


def assign_splits(templates: list[tuple[str, str]], frozen: dict[str, str] | None = None, seed: int = 7) -> dict[str, str]:
    """Splits of the templates ``(class_key, template_id)``; frozen ones never change.

    Per class, new templates are taken in a seeded order and fill the free gold places, then the free
    calibration places; the rest is for training. A class with too few templates, or with places left
    over, is an error. The list of templates is configuration, so this runs on the driver; for
    tables use ``rank_splits``.
    """
    frozen, by_class = dict(frozen or {}), defaultdict(set)
    for key, template in templates:
        by_class[key].add(template)
    need = GOLD_PER_CLASS + CALIB_PER_CLASS + 1
    out = dict(frozen)
    for key in sorted(by_class):
        names = by_class[key]
        if len(names) < need:
            raise ValueError(f"class {key} has {len(names)} templates, {need} are needed")
        places = ["gold"] * (GOLD_PER_CLASS - sum(frozen.get(t) == "gold" for t in names)) + ["calib"] * (CALIB_PER_CLASS - sum(frozen.get(t) == "calib" for t in names))
        new = sorted(names - frozen.keys())
        random.Random(f"{seed}:{key}").shuffle(new)
        if len(places) > len(new):
            raise ValueError(f"class {key}: {len(places)} places of gold and calib, {len(new)} new templates")
        out |= dict(zip(new, places + ["train"] * (len(new) - len(places))))
    return out


def rank_splits(templates: DataFrame, frozen: DataFrame, seed: str = "7", gold: int = GOLD_PER_CLASS, calib: int = CALIB_PER_CLASS) -> DataFrame:
    """``assign_splits`` for tables ``(class_key, template_id)`` and ``(template_id, split)``, ordered by a seeded MD5.

    Classes with too few templates get what there is.
    """
    t = templates.where("class_key is not null and template_id is not null").groupBy("template_id").agg(F.min("class_key").alias("class_key"))
    j = t.join(frozen.groupBy("template_id").agg(F.min("split").alias("frozen")), "template_id", "left")
    counts = j.groupBy("class_key").agg(*(F.greatest(F.lit(n) - F.count_if(F.col("frozen") == name), F.lit(0)).alias(f"free_{name}") for name, n in (("gold", gold), ("calib", calib))))
    # Numbers within a class in the order of the MD5, as a running count over its leading digits.
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "class_key", "template_id")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    j = j.withColumns({"is_new": F.col("frozen").isNull(), "u": u})
    j = running(j, "u", {"n": F.lit(1)}, ["class_key", "is_new"], descending=False, ties=False, order=["template_id"]).join(counts, "class_key")
    split = F.when(~F.col("is_new"), F.col("frozen")).when(F.col("n") <= F.col("free_gold"), "gold").when(F.col("n") <= F.col("free_gold") + F.col("free_calib"), "calib").otherwise("train")
    return j.select("class_key", "template_id", split.alias("split"), "is_new")


def drift(templates: DataFrame, frozen: DataFrame) -> DataFrame:
    """Templates without a frozen split (``new``) and frozen splits without a template (``orphaned``)."""
    a, b = templates.select("template_id").where("template_id is not null").distinct(), frozen.select("template_id").where("template_id is not null").distinct()
    return a.subtract(b).withColumn("state", F.lit("new")).unionByName(b.subtract(a).withColumn("state", F.lit("orphaned")))


def drift_report(new: list[str], orphaned: list[str]) -> list[str]:
    """What to tell about a drift; nothing is changed."""
    out = []
    if new:
        out.append(f"{len(new)} new templates were assigned and frozen: {', '.join(new)}")
        out.append("the file of splits has changed and must be committed")
    if orphaned:
        out.append(f"{len(orphaned)} frozen entries have no template any more (kept): {', '.join(orphaned)}")
    return out


def document_names(df: DataFrame, order: list[Column], width: int = 4) -> DataFrame:
    """Neutral running names ``doc-0001`` in a fixed order; meant for generated corpora (one global order)."""
    return df.withColumn("name", F.format_string(f"doc-%0{width}d", F.row_number().over(Window.orderBy(*order))))


def manifest_frame(spark: SparkSession, specs: list, splits: dict[str, str], paths: list[str]) -> DataFrame:
    """The truth about generated files; as many paths as specs."""
    rows = [(p, s.class_key, s.template_id, s.variant, splits[s.template_id], p.rsplit(".", 1)[-1]) for s, p in zip(specs, paths, strict=True)]
    return schemas.to_frame(spark, rows, "manifest")


def best_guess(df: DataFrame, feature: list[str], label: str) -> DataFrame:
    """The share the best guesser of ``label`` gets right who sees only ``feature``: one row ``(rows, right, share)``."""
    counts = df.groupBy(*feature, label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*feature).agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg(F.sum("n").alias("rows"), F.sum("best").alias("right")).withColumn("share", F.round(F.try_divide("right", "rows"), 6))


def stem_tokens(path: Column) -> Column:
    """Alphabetic runs of a file's stem."""
    return F.regexp_extract_all(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""), F.lit(r"([A-Za-z]+)"), 1)
