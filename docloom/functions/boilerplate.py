"""Removal of recurring header and footer sentences: a grouped array operator, native throughout.

A sentence is layout if it occurs on at least ``min_share`` of a document's segments (each segment
counts it once), has at least ``MIN_SENTENCE`` characters, and the document has at least
``MIN_SEGMENTS`` segments. A document without layout sentences is left exactly as it is; in any other
every segment is rebuilt from its remaining sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SEGMENTS = 3
MIN_SENTENCE = 12
MIN_SHARE = 0.6


def strip_whitespace(c: Column) -> Column:
    """Removes white space at the ends, by the Unicode definition (NBSP and separators included)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def sentences(c: Column | str) -> Column:
    """Parts between ``". "``, stripped, empty ones dropped; the last keeps its full stop."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(c, r"\. ", -1), strip_whitespace), lambda x: x != "")


def strip_boilerplate(df: DataFrame, document: str, text: str, min_share: float = MIN_SHARE) -> DataFrame:
    """``df`` with ``text`` cleaned per ``document``.

    One shuffle for the sentences, counted before it (partial aggregation); what is joined back
    is one small row per document that has layout at all. A document of any size is spread
    over tasks, because no group is ever collected.
    """
    sents = sentences(text)
    sized = df.groupBy(F.col(document).alias("__d")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= MIN_SEGMENTS)
    parts = df.select(F.col(document).alias("__d"), F.explode(F.array_distinct(F.filter(sents, lambda x: F.length(x) >= MIN_SENTENCE))).alias("__s"))
    counted = parts.groupBy("__d", "__s").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1")
    layout = counted.join(sized, "__d").where(F.col("__c") >= F.lit(min_share).cast("double") * F.col("__n"))
    # A sentence on 60 % of the segments leaves room for few others: the set is small by construction.
    per_doc = layout.groupBy("__d").agg(F.collect_set("__s").alias("__layout"))
    cleaned = strip_whitespace(F.array_join(F.filter(sents, lambda x: ~F.array_contains(F.col("__layout"), x)), ". "))
    joined = df.join(per_doc, F.col(document) == F.col("__d"), "left")
    return joined.withColumn(text, F.when(F.col("__layout").isNull(), F.col(text)).otherwise(cleaned)).drop("__d", "__layout")
