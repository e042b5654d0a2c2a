"""Fixed schemas; an empty table has the same types as a full one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, L, B, TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


DOCUMENTS = _struct(("document_id", S, False), ("source_path", S, False), ("file_name", S, False), ("media_type", S, False), ("content_sha256", S, False), ("size_bytes", L, False), ("parent_document_id", S, True), ("ingested_at", TS, False), ("needs_ocr", B, False), ("ocr_applied", B, False))
SEGMENTS = _struct(("segment_id", S, False), ("document_id", S, False), ("index", L, False), ("kind", S, False), ("locator", S, False), ("heading", S, True), ("text", S, False))
MANIFEST = _struct(("source_path", S, False), ("class_key", S, False), ("template_id", S, False), ("variant", L, False), ("split", S, False), ("format", S, False))
CLASSES = _struct(("key", S, False), ("name", S, False), ("description", S, False), ("not", S, False), ("residual", B, False))
SPLITS = _struct(("template_id", S, False), ("split", S, False))
LABEL_EVENTS = _struct(("event_id", L, False), ("document_id", S, False), ("class_key", S, False), ("source", S, False), ("actor", S, True), ("created_at", TS, False), ("note", S, True), ("supersedes", L, True))
TABLES = {"documents": DOCUMENTS, "segments": SEGMENTS, "manifest": MANIFEST, "classes": CLASSES, "splits": SPLITS, "label_events": LABEL_EVENTS}
KINDS = ("seite", "abschnitt", "blatt", "zeile", "mail_kopf", "mail_koerper")
SPLIT_VALUES = ("gold", "train", "calib")


def to_frame(spark: SparkSession, rows: list, name: str) -> DataFrame:
    """Rows (tuples or dicts) as a table of the fixed schema, also when there are none."""
    schema = TABLES[name]
    return spark.createDataFrame([tuple(r[f] for f in schema.fieldNames()) if isinstance(r, dict) else r for r in rows], schema)
