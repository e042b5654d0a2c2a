"""Raw files to typed tables, incrementally.

Every level of attachments is one DataFrame: detect, identify, leave out what is known, extract, clean.
Of the files of the folder only paths and identities are kept at first; what is new is read again by the
extractor, so contents of files never pass a shuffle nor are written anywhere. Attachments come out of the extractor with
their contents; those of one level are kept and joined with what is new among them. Known documents are dropped *before* the extractor runs (Catalyst would
not push a join below a Python stage).

Segments are written before documents, and those a run that died has left behind are not written again: a document
counts as known only when it is in ``documents``. One ingestion at a time writes to an archive.

Failed files leave no rows and are tried again by every run; a failed mail has no attachments.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import boilerplate, detect
from docloom.functions.text import derive_id, file_name
from docloom.session import materialize, setting, ship
from docloom.sources import mail, office, pdf, raw, schemas, tables, web

MIN_CHARS_PER_PAGE = 40
_EXTRACTED = "document_id string, error string, page_count int, segments array<struct<index:bigint,kind:string,locator:string,heading:string,text:string>>, attachments array<struct<ordinal:int,file_name:string,content:binary>>"


@dataclass
class IngestResult:
    """What a run has done. ``problems`` has a row ``(source_path, error, ord)`` per unreadable file (with the error) and per
    file without segments (error null)."""

    documents: int = 0
    skipped: int = 0
    segments: int = 0
    attachments: int = 0
    problems: DataFrame | None = field(default=None, repr=False)

    def _paths(self, condition: str) -> list[str]:
        return [] if self.problems is None else [r[0] for r in self.problems.where(condition).orderBy("ord").select("source_path").toLocalIterator()]

    @property
    def failed(self) -> list[str]:
        """Paths of unreadable files in depth-first order; as many as there are, so ask for few."""
        return self._paths("error is not null")

    @property
    def empty(self) -> list[str]:
        """Paths of documents without segments."""
        return self._paths("error is null")


def extract_one(fmt: str, data: bytes, html: bool = False):
    """Segments, attachments and page count of one file; an unsupported format is an error.

    HTML and CSV are read only if asked for: the archive counts them as unsupported.
    """
    if fmt == "eml":
        segments, attachments = mail.read_eml(data)
        return segments, attachments, 0
    if fmt == "pdf":
        segments, pages = pdf.read_pdf(data)
        return segments, [], pages
    if fmt == "docx":
        return office.read_docx(data), [], 0
    if fmt == "xlsx":
        return office.read_xlsx(data), [], 0
    if html and fmt == "html":
        return web.read_html(data), [], 0
    if html and fmt == "csv":
        return web.read_csv(data), [], 0
    raise ValueError(f"unsupported format {fmt}")


def extract(more: bool = False):
    """From ``(document_id, format, content)`` to ``_EXTRACTED``, one file at a time; texts as the readers give them."""
    kinds = pa.list_(pa.struct([("index", pa.int64()), ("kind", pa.string()), ("locator", pa.string()), ("heading", pa.string()), ("text", pa.string())]))
    files = pa.list_(pa.struct([("ordinal", pa.int32()), ("file_name", pa.string()), ("content", pa.binary())]))

    def run(batches):
        for b in batches:
            out = []
            for key, fmt, data in zip(*(c.to_pylist() for c in b.columns[:3])):
                try:
                    segments, attachments, pages = extract_one(fmt, data, more)
                    rows = [dict(zip(("index", "kind", "locator", "heading", "text"), (i, *s))) for i, s in enumerate(segments)]
                    out.append((key, None, pages, rows, [{"ordinal": i, "file_name": n, "content": c} for i, (n, c) in enumerate(attachments)]))
                except Exception as e:  # noqa: BLE001 - one broken file must not end the run
                    out.append((key, f"{type(e).__name__}: {e}", 0, [], []))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.string(), pa.string(), pa.int32(), kinds, files))], ["document_id", "error", "page_count", "segments", "attachments"])

    return run


def identify(files: DataFrame) -> DataFrame:
    """Adds identity, format and size to rows of ``source_path`` and ``content``; wholly in the JVM but for archives."""
    named = files.withColumn("file_name", file_name("source_path"))
    return named.withColumns(
        {
            "document_id": derive_id("source_path", "content"),
            "content_sha256": F.sha2("content", 256),
            "size_bytes": F.length("content").cast("bigint"),
            "format": detect.detect_format("content", "file_name"),
        }
    )


def needs_ocr(fmt, chars, pages, least: int = MIN_CHARS_PER_PAGE):
    """Too little text per physical page of a PDF speaks for a scan."""
    return F.when(fmt != "pdf", False).when(pages == 0, True).otherwise(chars / pages < least)


def cleaned(extracted: DataFrame) -> DataFrame:
    """The segments of extracted documents: layout sentences removed over all segments of a document, empty texts dropped."""
    rows = extracted.where("error is null").select("document_id", F.explode("segments").alias("s")).select("document_id", "s.*")
    kept = boilerplate.strip_boilerplate(rows, "document_id", "text").where("text <> ''")
    return kept.withColumn("segment_id", derive_id("document_id", F.col("index").cast("string"))).select(*schemas.SEGMENTS.fieldNames())


def process(rows: DataFrame, contents, known: DataFrame, now: datetime, least: int = MIN_CHARS_PER_PAGE) -> tuple[DataFrame, DataFrame, int]:
    """One level of identified files ``rows`` (without contents): its new documents as extracted, their segments, and the number skipped.

    ``rows`` has ``ord``, the place in depth-first order; of equal documents the first is kept. ``contents`` adds the column
    ``content`` to those rows that are new.
    """
    keys = rows.select("document_id", "ord").groupBy("document_id").agg(F.min("ord").alias("ord"))
    fresh = keys.join(known.select("document_id"), "document_id", "left_anti")
    todo = materialize(rows.join(fresh, ["document_id", "ord"], "left_semi"), "new-files")
    done = contents(todo).select("document_id", "format", "content").mapInArrow(extract(), _EXTRACTED)
    out = materialize(todo.join(done, "document_id"), "extracted")
    segments = materialize(cleaned(out), "segments")
    # A copy of a document that failed fails as well; any other copy is skipped.
    bad = out.where("error is not null").select("document_id")
    skipped = rows.count() - out.count() - rows.join(bad, "document_id", "left_semi").count() + bad.count()
    size = segments.groupBy("document_id").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))
    out = out.drop("segments").join(size, "document_id", "left").na.fill(0, ["chars", "n"])
    flags = {"media_type": detect.media_type("format"), "ingested_at": F.lit(now).cast("timestamp"), "needs_ocr": needs_ocr(F.col("format"), F.col("chars"), F.col("page_count"), least), "ocr_applied": F.lit(False)}
    return out.withColumns(flags), segments, skipped


def ingest(spark: SparkSession, raw_dir: str, parquet_dir: str, least: int | None = None) -> IngestResult:
    """Reads what is new below ``raw_dir`` and appends it to ``documents`` and ``segments``.

    ``least`` is the number of characters a page needs not to count as scanned; by default that of
    ``setting("min.chars.per.page")``, else 40.
    """
    ship(spark)
    least = int(setting(spark, "min.chars.per.page", MIN_CHARS_PER_PAGE)) if least is None else least
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", setting(spark, "extract.batch", "16"))
    try:
        return _ingest(spark, raw_dir, parquet_dir, least)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _ingest(spark: SparkSession, raw_dir: str, parquet_dir: str, least: int) -> IngestResult:
    now, result = datetime.now(UTC), IngestResult()
    known = tables.read_table(spark, parquet_dir, "documents").select("document_id")
    files = identify(raw.read_raw(spark, raw_dir)).drop("content")
    rows = files.withColumns({"parent_document_id": F.lit(None).cast("string"), "ord": F.split("source_path", "/")})

    contents = lambda todo: raw.read_contents(spark, raw_dir, raw.spread(todo).select("source_path", "document_id", "format"))
    documents, segments, problems = [], [], []
    while True:  # a level of attachments is smaller than the one that holds it
        rows = materialize(rows, "level")
        out, own, skipped = process(rows, contents, known, now, least)
        result.skipped += skipped
        good = out.where("error is null")
        segments.append(own)
        documents.append(good)
        problems.append(out.where("error is not null or n = 0").select("source_path", "error", "ord"))
        counts = good.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("attachments"))).first()
        result.documents += counts[0]
        result.segments += counts[1] or 0
        result.attachments += counts[2] or 0
        if not counts[2]:
            break
        known = known.unionByName(good.select("document_id"))
        child = good.select("document_id", "source_path", "ord", F.explode("attachments").alias("a"))
        child = child.select(F.concat("source_path", F.lit("!"), "a.file_name").alias("source_path"), F.col("a.content").alias("content"), F.col("document_id").alias("parent_document_id"), F.concat("ord", F.array(F.format_string("%06d", "a.ordinal"))).alias("ord"))
        named = materialize(identify(child), "attachments")
        rows, contents = named.drop("content"), lambda todo, named=named: todo.join(named.select("document_id", "ord", "content"), ["document_id", "ord"])
    all_segments, all_documents, all_problems = segments[0], documents[0], problems[0]
    for s, d, p in zip(segments[1:], documents[1:], problems[1:]):
        all_segments, all_documents, all_problems = all_segments.unionByName(s), all_documents.unionByName(d), all_problems.unionByName(p)
    result.problems = materialize(all_problems, "problems")
    left = tables.read_table(spark, parquet_dir, "segments").select("segment_id")
    tables.append_table(all_segments.join(left, "segment_id", "left_anti"), parquet_dir, "segments")
    tables.append_table(all_documents.select(*schemas.DOCUMENTS.fieldNames()), parquet_dir, "documents")
    return result


def report(spark: SparkSession, parquet_dir: str, result: IngestResult, most: int = 10) -> list[str]:
    """The lines a run prints: counters, the first problems, and the size of the archive."""
    docs = tables.read_table(spark, parquet_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_ocr").alias("ocr")).first()
    out = [f"new: {result.documents}  skipped: {result.skipped}  segments: {result.segments}  attachments: {result.attachments}"]
    for name, condition in (("unreadable", "error is not null"), ("without segments", "error is null")):
        rows = result.problems.where(condition) if result.problems is not None else None
        if rows is not None and (n := rows.count()):
            first = [r[0] for r in rows.orderBy("ord").limit(most).select("source_path").collect()]
            out.append(f"{name} ({n}): {', '.join(first)}")
    return [*out, f"archive: {docs['n']} documents, {docs['ocr']} probably scanned"]
