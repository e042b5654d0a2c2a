"""Same or near-same records across splits: an exact prefix-filter join on rare shingles (see ``prefix``).

The prefixes of the evaluation side are the index, those of the training side probe it. Texts are nodes by
their hash (see ``near``), so copies are indexed, probed and verified once and multiplied only in the result;
a report multiplies their numbers instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import bloom, near, prefix
from docloom.llm.prefix import EVAL, TRAIN
from docloom.session import materialize


def near_across(df: DataFrame, text: str, flags: str, threshold: float = 0.5, k: int = 3, texts: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: near texts by their key, ``a`` on the evaluation side and ``b`` on the training side.

    ``flags`` is 1 for the evaluation side, 2 for the training side, 3 for both, 0 for none. A text on both
    sides is a pair with itself. Null or short texts are near to nothing. ``texts`` is a table with
    at least the same texts that is cheaper to read than ``df`` (which may be the result of a join);
    frequencies are counted over it and the sets of candidates are fetched from it.
    """
    rows = df.where(F.col(text).isNotNull()).select(near.text_key(text).alias("id"), F.col(text).alias("text"), F.col(flags).cast("int").alias("flags"))
    texts = (df if texts is None else texts).where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    pairs = prefix.candidates(rows, texts, threshold, k)
    nodes = texts.select(near.text_key("text").alias("id"), "text")
    return materialize(near._compare(nodes, pairs, k, "set", near._exact(threshold)), "verified")


def split_value(split: str):
    """A split without blanks at the ends, in lower case; null is no split."""
    return F.lower(F.trim(F.col(split)))


def document_sides(documents: DataFrame, manifest: DataFrame, evaluation=("gold", "calib"), training=("train",)) -> DataFrame:
    """``(document_id, flags)`` of documents whose manifest record puts them on a side."""
    at = documents.select("document_id", "source_path").distinct()
    value = split_value("split")
    side = F.when(value.isin(*evaluation), EVAL).when(value.isin(*training), TRAIN)
    given = manifest.select("source_path", side.alias("side")).where("side is not null").distinct()
    return at.join(given, "source_path").groupBy("document_id").agg(F.bit_or("side").alias("flags"))


def members(segments: DataFrame) -> DataFrame:
    """``(segment_id, document_id, id)``: distinct segments with the key of their text."""
    return segments.where("segment_id is not null and text is not null").select("segment_id", "document_id", near.text_key("text").alias("id")).distinct()


def _sides(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    return materialize(document_sides(documents, manifest), "sides")


def overlapping_texts(segments: DataFrame, documents: DataFrame, manifest: DataFrame, threshold: float = 0.5, k: int = 3, sides: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: near texts by their key, ``a`` of the evaluation and ``b`` of the training side; a text on both sides with itself too.

    The side of a segment is read from filters of bounded size, so no text is shuffled for it. None is missed; what
    a false hit adds has no member on that side and goes in the join with those.
    """
    sides = _sides(documents, manifest) if sides is None else sides
    flags = F.lit(0)
    for side in (EVAL, TRAIN):
        own = sides.where(F.col("flags").bitwiseAND(F.lit(side)) > 0).select(F.xxhash64("document_id").alias("id"))
        flags = flags + F.when(bloom.build(own, "id", own.count()).column(F.xxhash64("document_id")), side).otherwise(0)
    rows = segments.where("segment_id is not null and text is not null").select("text", flags.alias("flags"))
    return near_across(rows, "text", "flags", threshold, k, segments.select("text"))


def overlapping_segments(segments: DataFrame, documents: DataFrame, manifest: DataFrame, threshold: float = 0.5, k: int = 3) -> DataFrame:
    """``(eval_segment, train_segment)``: all near pairs of distinct segments across the sides.

    Segments without id or text, and documents without a record or a split value, take no part;
    repeated rows count once; a document on both sides counts on both.
    """
    sides = _sides(documents, manifest)
    links = overlapping_texts(segments, documents, manifest, threshold, k, sides)
    member = members(segments).join(sides, "document_id").select("segment_id", "id", "flags").distinct()
    e = member.where("flags % 2 = 1").select(F.col("id").alias("a"), F.col("segment_id").alias("eval_segment"))
    t = member.where("flags > 1").select(F.col("id").alias("b"), F.col("segment_id").alias("train_segment"))
    return links.join(e, "a").join(t, "b").where("eval_segment <> train_segment").select("eval_segment", "train_segment").distinct()
