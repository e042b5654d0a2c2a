"""Queries over raw files: detection, extraction and ingestion.

Files are built here, by the writers or byte by byte; what has to come out is written down in the SQL
counterparts. The corpus queries build a file of every document of the whole table and read it again.
"""

from __future__ import annotations

import posixpath
import random
from email.message import EmailMessage

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import detect
from docloom.operators import ingest
from docloom.session import shared_path, ship, table
from docloom.sources import corpus, raw, tables, writers
from docloom.sources.writers import Block, Spec

MAIL = b"From: a@x.example\r\nTo: b@x.example\r\nSubject: Hallo\r\n\r\nText"
#: First bytes and names, and the format they stand for.
DETECTED = [
    (b"%PDF-1.7 x", "quartal.xlsx", "pdf"),
    (b"x%PDF-1.7", "kein.dat", "unknown"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "post.bin", "msg"),
    (b"\x89PNG\r\n\x1a\n..", "scan.bin", "image"),
    (b"\xff\xd8\xff..", "scan2.bin", "image"),
    (b"II*\x00", "scan3.bin", "image"),
    (b"MM\x00*", "scan4.bin", "image"),
    (b"<!DOCTYPE html><p>", "seite.bin", "html"),
    (b" \n\xef\xbb\xbf <HTML>", "seite2.bin", "html"),
    (b"<p>nur ein Teil</p>", "seite3.htm", "html"),
    (MAIL, "ohne_endung", "eml"),
    (b"\xef\xbb\xbf" + MAIL, "mit_marke", "eml"),
    (b"From jemand Mon Jan\nDate: x\nTo: y\n", "mbox", "eml"),
    (b"Received: a\nReceived: b\nReceived: c\n", "log.txt", "unknown"),
    (b"name: test\nwert: 1\n", "config.txt", "unknown"),
    (b"Notiz\nDate: morgen\nTo: alle\n", "notiz.txt", "unknown"),
    (b"nur Text", "nachricht.EML", "eml"),
    (b"a;b;c\n1;2;3", "daten.csv", "csv"),
    (b"a\tb", "daten.TSV", "csv"),
    (b"PK\x03\x04 kaputt", "archiv.html", "html"),
    (b"", "leer.pdf", "unknown"),
    (b"x", "ohne", "unknown"),
]


def _files() -> dict[str, bytes]:
    """One file of each kind an extractor has rules for."""
    p, t = writers.docx_paragraph, writers.docx_table
    inner = t([["innen", "7"]])
    word = p("Vorspann") + p("Titel", 1) + p("Abschnitt", 2) + p("vor") + t([["Pos", "Menge"], ["Teil", inner]]) + p("nach") + t([["", ""]]) + p("Ende", 2)
    cells = [["Name", "Summe"], ["A", '<c r="B2"><f>B1*2</f></c>'], ["B", '<c r="B3"><f>B1*2</f><v>750</v></c>'], ["C", '<c r="B4" t="b"><v>1</v></c>'], ["D", '<c r="B5"><v>1.50</v></c>']]
    pages = [[(24.0, "Große Überschrift"), *((10.0, f"Zeile {i} mit Text") for i in range(4))], [], [(10.0, "letzte Seite"), (11.0, "kaum größer")]]
    mail = EmailMessage()
    mail["Subject"], mail["From"], mail["To"], mail["Date"] = "Grüße", "Jörg <a@x.example>", "b@x.example", "Sun, 01 Mar 2026 12:00:00 +0000"
    mail.set_content("Guten  Tag\nText")
    mail.add_alternative("<p>html</p>", subtype="html")
    for content, name in ((b"eins", None), (b"", None), (writers.docx_bytes(p("gleich")), "g.docx")):
        mail.add_attachment(content, maintype="application", subtype="octet-stream", **({"filename": name} if name else {}))
    return {
        "a.docx": writers.docx_bytes(word),
        "b.xlsx": writers.xlsx_bytes([("Blatt1", cells), ("leer", []), ("frei", [["ein Wert"], [], ["noch einer"]])]),
        "c.pdf": writers.pdf_bytes(pages),
        "d.eml": mail.as_bytes(),
        "e.bin": writers.fixed_zip([("ppt/presentation.xml", b"x")]),
        "f.pdf": b"%PDF-1.4 kaputt",
    }


def _table(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    return ship(spark).createDataFrame([(n, bytearray(c)) for n, c in files.items()], "source_path string, content binary")


def _extracted(spark: SparkSession) -> DataFrame:
    rows = ingest.identify(_table(spark, _files()))
    done = rows.select(F.col("source_path").alias("document_id"), "format", "content").mapInArrow(ingest.extract(), ingest._EXTRACTED)
    return done.withColumnRenamed("document_id", "source_path")


def detect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of given first bytes and names, with their media types."""
    rows = _table(spark, {n: c for c, n, _ in DETECTED} | {n: c for n, c in _files().items() if n < "f"})
    return rows.select(F.col("source_path").alias("name"), detect.detect_format("content", "source_path").alias("format")).withColumn("media_type", detect.media_type("format"))


def extract_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of one file of each kind, as the readers give them."""
    rows = _extracted(spark).select("source_path", F.explode("segments").alias("s"))
    return rows.select("source_path", F.col("s.index").alias("position"), "s.kind", "s.locator", "s.heading", "s.text")


def extract_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of a mail: names by position, what is empty left out."""
    rows = _extracted(spark).select("source_path", F.explode("attachments").alias("a"))
    return rows.select("source_path", F.col("a.ordinal").alias("position"), "a.file_name")


def extract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: whether it could be read, its physical pages and segments."""
    return _extracted(spark).select("source_path", F.col("error").isNull().alias("readable"), "page_count", F.size("segments").alias("segments"))


def _ingested(spark: SparkSession):
    """A folder of files ingested, one file changed and one added, and ingested again."""
    root, out = shared_path(spark, "raw"), shared_path(spark, "archive")
    fs, base = pafs.FileSystem.from_uri(raw.address(spark, root))

    def put(name: str, content: bytes) -> None:
        path = posixpath.join(base, name)
        fs.create_dir(posixpath.dirname(path))
        with fs.open_output_stream(path) as f:
            f.write(content)

    for name, content in _files().items():
        put(name, content)
    foot = "Seite erzeugt von der Buchhaltung"
    put("unten/g.pdf", writers.pdf_bytes([[(10.0, f"Inhalt Nummer {i} ist lang genug fuer vierzig Zeichen. {foot}. Ende")] for i in range(3)]))
    put("unten/.versteckt.pdf", b"%PDF-1.4")
    put("unten/~$g.docx", b"x")
    put("leer.docx", writers.docx_bytes(""))
    first = ingest.ingest(ship(spark), root, out)
    put("a.docx", writers.docx_bytes(writers.docx_paragraph("neue Fassung")))
    put("unten/neu.pdf", writers.pdf_bytes([[(10.0, "wenig Text")]] * 2))
    return out, first, ingest.ingest(spark, root, out)


def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a first run and of one that finds one file new and one changed."""
    _, *runs = _ingested(spark)
    rows = [(i, r.documents, r.skipped, r.segments, r.attachments, ",".join(r.failed), ",".join(r.empty)) for i, r in enumerate(runs, 1)]
    return spark.createDataFrame(rows, "run int, documents int, skipped int, segments int, attachments int, failed string, without_segments string")


def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive after both runs: every version of every file, attachments under their mails."""
    out, *_ = _ingested(spark)
    d = tables.read_table(spark, out, "documents")
    s = tables.read_table(spark, out, "segments").groupBy("document_id").agg(F.count(F.lit(1)).alias("segments"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), "|")).alias("digest"))
    p = d.select(F.col("document_id").alias("parent_document_id"), F.col("source_path").alias("parent"))
    j = d.join(s, "document_id", "left").join(p, "parent_document_id", "left")
    return j.select("source_path", "file_name", "media_type", "parent", "needs_ocr", F.coalesce("segments", F.lit(0)).alias("segments"), "digest")


def _build(fmt: str):
    """A file of each text: paragraphs are its lines."""

    def run(batches):
        for b in batches:
            out = []
            for key, text in zip(*(c.to_pylist() for c in b.columns)):
                spec = Spec(f"Text {key}", (Block("", tuple(text.split("\n"))),), template_id=f"t{key}")
                out.append((f"{key}.{fmt}", writers.write_eml(spec) if fmt == "eml" else writers.docx_bytes("".join(map(writers.docx_paragraph, text.split("\n"))))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out]), pa.array([c for _, c in out], pa.binary())], ["source_path", "content"])

    return run


def _round_trip(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    # What XML cannot hold (control characters) has no place in a Word file.
    text = F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f\x7f]", " ")
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"))
    files = ingest.identify(docs.mapInArrow(_build(fmt), "source_path string, content binary"))
    done = files.select(F.col("source_path").alias("document_id"), "format", "content").mapInArrow(ingest.extract(), ingest._EXTRACTED)
    body = F.filter("segments", lambda s: s["kind"] != "mail_kopf")
    return done.select(F.substring_index("document_id", ".", 1).cast("long").alias("doc_id"), F.col("error").isNull().alias("readable"), F.size(body).alias("segments"), F.when(F.size(body) > 0, F.md5(F.regexp_replace(F.element_at(body, 1)["text"], r"[^a-zA-Z0-9]", ""))).alias("digest"))


def mail_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the corpus written as a mail, detected and read again; letters and digits of ASCII are compared."""
    return _round_trip(spark, sf_dir, "eml")


def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the corpus written as a Word file, detected and read again; letters and digits of ASCII are compared."""
    return _round_trip(spark, sf_dir, "docx")


def written_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document in every format: the segments its layout rules lead to."""
    blocks = (Block("Leistung", ("Wir liefern die Teile.",)), Block("Positionen", (), ("Leistung", "Menge"), (("Montage", "3"),)), Block("Hinweis", ("Zahlbar sofort.",)))
    spec = Spec("Angebot 17", blocks, template_id="angebot", groups=(2, 1))
    made = {"x.pdf": writers.write_pdf(spec), "x.docx": writers.write_docx(spec), "x.xlsx": writers.write_xlsx(spec), "x.eml": writers.write_eml(spec)}
    done = ingest.identify(_table(spark, made)).select(F.col("source_path").alias("document_id"), "format", "content").mapInArrow(ingest.extract(), ingest._EXTRACTED)
    rows = done.select(F.col("document_id").alias("source_path"), F.explode("segments").alias("s"))
    return rows.select("source_path", F.col("s.index").alias("position"), "s.locator", "s.text")


def amounts_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of the corpus writer over many seeds: tax and sum are those of the rounded net amount, texts keep their form."""
    rows = []
    for seed in range(200):
        net, tax, total = writers.amounts(random.Random(seed))
        rows.append((10 <= net <= 5000, abs(tax - net * 0.19) < 0.00501, abs(total - net - tax) < 0.001, writers.euro(net).endswith(" EUR")))
    return spark.createDataFrame(rows, "in_range boolean, tax boolean, total boolean, form boolean").groupBy("in_range", "tax", "total", "form").agg(F.count(F.lit(1)).alias("seeds"))


def generated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated letters: templates, variants and distinct letters per class and format, and how many carry the common foot."""
    foot = corpus.foot().paragraphs[0]
    rows = [(s.class_key, s.template_id, s.formats[0], repr((s.title, s.blocks)), s.blocks[-1].paragraphs[0] == foot) for s in corpus.build()]
    df = spark.createDataFrame(rows, "class_key string, template_id string, format string, letter string, foot boolean")
    return df.groupBy("class_key", "format").agg(F.count_distinct("template_id").alias("templates"), F.count(F.lit(1)).alias("letters"), F.count_distinct("letter").alias("distinct_letters"), F.count_if("foot").alias("with_foot"))


QUERIES = {f.__name__: f for f in (detect_files, extract_segments, extract_attachments, extract_status, ingest_runs, ingest_documents, mail_round_trip, docx_round_trip, written_layout, amounts_drawn, generated_corpus)}


def _values(names: str, rows: list[tuple]) -> str:
    def lit(v) -> str:
        if v is None:
            return "cast(null as varchar)"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) as t({names})"


_PDF, _DOCX, _XLSX, _EML = (detect.MEDIA_TYPES[f] for f in ("pdf", "docx", "xlsx", "eml"))
_HEAD = "From: Jörg <a@x.example> To: b@x.example Subject: Grüße Date: Sun, 01 Mar 2026 12:00:00 +0000"
_SHEET = "Name | Summe | Name: A, Summe: =B1*2 | Name: B, Summe: 750 | Name: C, Summe: True | Name: D, Summe: 1.5"
_SEGMENTS = [
    ("a.docx", 0, "abschnitt", "Abschnitt 1", None, "Vorspann"),
    ("a.docx", 1, "abschnitt", "Titel", "Titel", "Titel"),
    ("a.docx", 2, "abschnitt", "Tabelle 1", "Abschnitt", "Pos | Menge Teil | innen | 7"),
    ("a.docx", 3, "abschnitt", "Abschnitt", "Abschnitt", "vor nach"),
    ("a.docx", 4, "abschnitt", "Ende", "Ende", "Ende"),
    ("b.xlsx", 0, "blatt", "Blatt Blatt1", "Blatt1", _SHEET),
    ("b.xlsx", 1, "blatt", "Blatt frei", "frei", "ein Wert | noch einer"),
    ("c.pdf", 0, "seite", "S. 1", "Große Überschrift", "Große Überschrift Zeile 0 mit Text Zeile 1 mit Text Zeile 2 mit Text Zeile 3 mit Text"),
    ("c.pdf", 1, "seite", "S. 3", None, "letzte Seite kaum größer"),
    ("d.eml", 0, "mail_kopf", "Kopf", "Grüße", _HEAD),
    ("d.eml", 1, "mail_koerper", "Körper", None, "Guten Tag Text"),
]
_LAYOUT_TABLE = "Leistung | Menge Montage | 3"
_CLEAN = "text is not null"
_BARE = "regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')"


def _joined(name: str) -> str:
    return "md5('" + "|".join(s[5] for s in _SEGMENTS if s[0] == name).replace("'", "''") + "')"


def _archive_sql() -> str:
    rows = [
        ("a.docx", "a.docx", _DOCX, None, False, 5, _joined("a.docx")),
        ("a.docx", "a.docx", _DOCX, None, False, 1, "md5('neue Fassung')"),
        ("b.xlsx", "b.xlsx", _XLSX, None, False, 2, _joined("b.xlsx")),
        ("c.pdf", "c.pdf", _PDF, None, True, 2, _joined("c.pdf")),
        ("d.eml", "d.eml", _EML, None, False, 2, _joined("d.eml")),
        ("d.eml!g.docx", "d.eml!g.docx", _DOCX, "d.eml", False, 1, "md5('gleich')"),
        ("leer.docx", "leer.docx", _DOCX, None, False, 0, "cast(null as varchar)"),
        ("unten/g.pdf", "g.pdf", _PDF, None, False, 3, "md5('" + "|".join(f"Inhalt Nummer {i} ist lang genug fuer vierzig Zeichen. Ende" for i in range(3)) + "')"),
        ("unten/neu.pdf", "neu.pdf", _PDF, None, True, 2, "md5('wenig Text|wenig Text')"),
    ]
    lit = lambda v: "cast(null as varchar)" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return "select * from (values " + ", ".join("(" + ", ".join([*map(lit, r[:6]), r[6]]) + ")" for r in rows) + ") as t(source_path, file_name, media_type, parent, needs_ocr, segments, digest)"


def _round_trip_sql() -> str:
    from docloom.plans.unicode_sql import nfkc

    text = nfkc("regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', ' ', 'g')")
    return f"select doc_id, true as readable, case when trim(regexp_replace(t, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g')) = '' then 0 else 1 end as segments, case when trim(regexp_replace(t, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g')) <> '' then md5({_BARE.replace('text', 't')}) end as digest from (select doc_id, {text} as t from documents where {_CLEAN})"


ORACLE = {
    "detect_files": _values("name, format, media_type", [(n, f, detect.MEDIA_TYPES[f]) for _, n, f in DETECTED] + [(n, f, detect.MEDIA_TYPES[f]) for n, f in (("a.docx", "docx"), ("b.xlsx", "xlsx"), ("c.pdf", "pdf"), ("d.eml", "eml"), ("e.bin", "pptx"))]),
    "extract_segments": _values("source_path, position, kind, locator, heading, text", _SEGMENTS),
    "extract_attachments": _values("source_path, position, file_name", [("d.eml", 0, "anhang-1.bin"), ("d.eml", 1, "g.docx")]),
    "extract_status": _values("source_path, readable, page_count, segments", [("a.docx", True, 0, 5), ("b.xlsx", True, 0, 2), ("c.pdf", True, 3, 2), ("d.eml", True, 0, 2), ("e.bin", False, 0, 0), ("f.pdf", False, 0, 0)]),
    "ingest_runs": _values("run, documents, skipped, segments, attachments, failed, without_segments", [(1, 7, 0, 15, 2, "d.eml!anhang-1.bin,e.bin,f.pdf", "leer.docx"), (2, 2, 5, 3, 0, "e.bin,f.pdf", "")]),
    "ingest_documents": _archive_sql(),
    "mail_round_trip": _round_trip_sql(),
    "docx_round_trip": _round_trip_sql(),
    "written_layout": _values(
        "source_path, position, locator, text",
        [
            ("x.pdf", 0, "S. 1", f"Angebot 17 Leistung Wir liefern die Teile. Positionen {_LAYOUT_TABLE}"),
            ("x.pdf", 1, "S. 2", "Hinweis Zahlbar sofort."),
            ("x.docx", 0, "Angebot 17", "Angebot 17"),
            ("x.docx", 1, "Leistung", "Wir liefern die Teile."),
            ("x.docx", 2, "Tabelle 1", _LAYOUT_TABLE),
            ("x.docx", 3, "Positionen", "Positionen"),
            ("x.docx", 4, "Hinweis", "Zahlbar sofort."),
            ("x.xlsx", 0, "Blatt Dokument", "Angebot 17 | Leistung | Wir liefern die Teile. | Positionen"),
            ("x.xlsx", 1, "Blatt Positionen 1", "Leistung | Menge | Leistung: Montage, Menge: 3"),
            ("x.xlsx", 2, "Blatt Dokument 2", "Hinweis | Zahlbar sofort."),
            ("x.eml", 0, "Kopf", "From: absender@quelle.example To: eingang@ziel.example Subject: Angebot 17 Date: Sun, 01 Mar 2026 12:00:00 +0000"),
            ("x.eml", 1, "Körper", f"Leistung -------- Wir liefern die Teile. Positionen ---------- {_LAYOUT_TABLE} Hinweis ------- Zahlbar sofort."),
        ],
    ),
    "generated_corpus": "with c as (select unnest(['RECHNUNG', 'GUTSCHRIFT', 'VERTRAG', 'AGB', 'BERICHT', 'PROTOKOLL', 'SONSTIGES']) as class_key, unnest(range(7)) as i), f as (select class_key, 'pdf' as format, case when i < 2 then 4 else 3 end as templates from c union all select class_key, 'docx', case when i < 3 then 2 else 3 end from c union all select class_key, 'eml', case when i = 2 then 2 else 1 end from c union all select class_key, 'xlsx', 1 from c) select class_key, format, cast(templates as bigint) as templates, cast(10 * templates as bigint) as letters, cast(10 * templates as bigint) as distinct_letters, cast(10 * templates as bigint) as with_foot from f",
    "amounts_drawn": "select true as in_range, true as tax, true as total, true as form, 200::bigint as seeds",
}
