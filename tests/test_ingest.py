"""The pipeline over files made here: detection, extraction, attachments, increments."""

import random
from email.message import EmailMessage

import pytest

from docloom.functions.boilerplate import strip_boilerplate
from docloom.functions.detect import MEDIA_TYPES, detect_format
from docloom.functions.text import derive_id, normalize_native, normalize_python, normalize_text
from docloom.operators import ingest
from docloom.session import setting
from docloom.sources import corpus, mail, office, pdf, raw, tables, web, writers
from docloom.sources.writers import Block, Spec


def spec(title="Angebot 17", **kw):
    blocks = (
        Block("Leistung", ("Wir liefern die bestellten Teile in der kommenden Woche.", "Die Abnahme folgt danach im Werk.")),
        Block("Positionen", (), ("Leistung", "Menge"), (("Montage", "3"), ("Prüfung", "1"))),
    )
    return Spec(title, blocks, **kw)


# Text and identity


def test_derive_id_and_normalise(spark):
    import hashlib

    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("ä", "\x00")], "x string, y string")
    got = [r[0] for r in df.select(derive_id("x", "y")).collect()]
    want = [hashlib.sha256(a.encode() + b"\0" + b.encode() + b"\0").hexdigest()[:32] for a, b in (("ab", "c"), ("a", "bc"), ("ä", "\x00"))]
    assert got == want and got[0] != got[1]
    assert normalize_python("Rech-\nnung  über\n\n  100") == "Rechnung über 100"
    assert normalize_python("ﬁnal") == "final"
    texts = ["Rech-\nnung  über\n\n  100", " a\x1cb\x85c\xa0d ", "x - \n y", "", "ein-\n\n zwei-\ndrei"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    rows = df.select(normalize_text("t"), normalize_native("t")).collect()
    assert [r[0] for r in rows] == [normalize_python(t) for t in texts] + [None]
    assert [r[1] for r in rows] == [normalize_python(t) for t in texts] + [None]


# Detection

MAIL = b"From: a@x.example\r\nTo: b@x.example\r\nSubject: Hallo\r\n\r\nText"
CASES = [
    (b"%PDF-1.7 x", "quartal.xlsx", "pdf"),
    (writers.write_docx(spec()), "a.bin", "docx"),
    (writers.write_xlsx(spec()), "a.bin", "xlsx"),
    (writers.fixed_zip([("ppt/presentation.xml", b"x")]), "a.bin", "pptx"),
    (writers.fixed_zip([("other.txt", b"x")]), "a.csv", "csv"),
    (b"PK\x03\x04 broken", "a.html", "html"),
    (MAIL, "ohne_endung", "eml"),
    (MAIL, "a.eml", "eml"),
    (b"\xef\xbb\xbf" + MAIL, "ohne_endung", "eml"),
    (b"Delivered-To: x\nReceived: y\nDate: z\n", "a", "eml"),
    (b"From jemand Mon Jan\nDate: x\nTo: y\n", "a", "eml"),
    (b"Received: a\nReceived: b\nReceived: c\n", "log.txt", "unknown"),
    (b"name: test\nwert: 1\n", "config.txt", "unknown"),
    (b"Notiz\nDate: morgen\nTo: alle\n", "n.txt", "unknown"),
    (b"\x00\x01\x02\x03", "x.dat", "unknown"),
    (b"a;b;c\n1;2;3", "daten.csv", "csv"),
    (b"a\tb", "daten.TSV", "csv"),
    (b"<!DOCTYPE html><p>", "x.bin", "html"),
    (b" \n\xef\xbb\xbf <HTML>", "x.bin", "html"),
    (b"\x89PNG\r\n\x1a\n..", "scan.bin", "image"),
    (b"\xff\xd8\xff..", "scan.bin", "image"),
    (b"II*\x00", "scan.bin", "image"),
    (b"MM\x00*", "scan.bin", "image"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "post.bin", "msg"),
    (b"nur Text", "nachricht.eml", "eml"),
    (b"", "leer.pdf", "unknown"),
    (b"x", "ohne", "unknown"),
]


def test_detect_format(spark):
    df = spark.createDataFrame([(bytearray(c), n, w) for c, n, w in CASES], "c binary, n string, w string")
    rows = df.select("n", "w", detect_format("c", "n").alias("got")).collect()
    assert [(r.n, r.got) for r in rows] == [(r.n, r.w) for r in rows]
    assert len(MEDIA_TYPES) == 10


# Boilerplate

FOOT = "Seite erzeugt von der Buchhaltung"


def layout_free(texts, share=0.6):
    """The rule by its letter: every sentence is looked for on every segment."""
    split = [[s.strip() for s in t.split(". ") if s.strip()] for t in texts]
    known = {s for own in split for s in own if len(s) >= 12 and len(texts) >= 3 and sum(s in other for other in split) >= share * len(texts)}
    return texts if not known else [". ".join(s for s in own if s not in known).strip() for own in split]


def cleaned(spark, docs):
    df = spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "document_id string, i int, t string")
    got = {(r.document_id, r.i): r.t for r in strip_boilerplate(df, "document_id", "t").collect()}
    return {d: [got[d, i] for i in range(len(ts))] for d, ts in docs.items()}


def test_boilerplate_rules(spark):
    docs = {
        "five": [f"Inhalt Nummer {i} ist anders. {FOOT}. Ende {i}" for i in range(5)],
        "two": [f"Inhalt {i}" + (f". {FOOT}. x" if i < 2 else "") for i in range(5)],
        "three": [f"Inhalt {i}" + (f". {FOOT}. x" if i < 3 else "") for i in range(5)],
        "short": [f"Inhalt {i}. Danke. x" for i in range(5)],
        "few": [FOOT] * 2,
        "all": [FOOT] * 3,
    }
    got = cleaned(spark, docs)
    assert all(FOOT not in t and f"Nummer {i}" in t for i, t in enumerate(got["five"]))
    assert got["two"] == docs["two"] and got["short"] == docs["short"] and got["few"] == docs["few"]
    assert got["three"][0] == "Inhalt 0. x" and got["all"] == ["", "", ""]


def test_boilerplate_equals_the_letter_of_the_rule(spark):
    rnd = random.Random(3)
    pool = [f"Dies ist der wiederkehrende Satz {i}" for i in range(6)] + ["kurz", "\xa0auch mit Rand\xa0 "]
    docs = {f"d{d}": [". ".join(rnd.choices(pool, k=rnd.randint(0, 5))) + rnd.choice(["", ".", ". "]) for _ in range(rnd.randint(1, 8))] for d in range(60)}
    assert cleaned(spark, docs) == {d: layout_free(ts) for d, ts in docs.items()}


# Extractors


def test_docx_sections_and_tables():
    p, t = writers.docx_paragraph, writers.docx_table
    inner = t([["innen", "7"]])
    body = p("Vorspann") + p("Titel", 1) + p("Abschnitt", 2) + p("vor") + t([["Pos", "Menge"], ["Teil", inner]]) + p("nach") + t([["", ""], ["", ""]]) + p("Ende", 2)
    got = office.read_docx(writers.docx_bytes(body))
    assert got == [
        ("abschnitt", "Abschnitt 1", None, "Vorspann"),
        ("abschnitt", "Titel", "Titel", "Titel"),
        ("abschnitt", "Tabelle 1", "Abschnitt", "Pos | Menge Teil | innen | 7"),
        ("abschnitt", "Abschnitt", "Abschnitt", "vor nach"),
        ("abschnitt", "Ende", "Ende", "Ende"),
    ]
    assert office.read_docx(writers.docx_bytes("")) == []


def test_docx_merged_cells():
    """A cell over two rows or columns is there in each of them."""
    cell = lambda text, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{writers.docx_paragraph(text)}</w:tc>"
    rows = [cell("A", '<w:vMerge w:val="restart"/>') + cell("1"), cell("", "<w:vMerge/>") + cell("2"), cell("B", '<w:gridSpan w:val="2"/>')]
    body = "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
    assert office.read_docx(writers.docx_bytes(body)) == [("abschnitt", "Tabelle 1", None, "A | 1 A | 2 B | B")]


def test_html_and_csv():
    page = b"<html><title>t</title><body><p>Vor <b>spann</b><h1>Titel &amp; mehr</h1><p>eins<br>zwei<table><tr><th>Pos<td>Menge<tr><td>Teil<td><table><tr><td>innen</table></table><p>nach<script>x</script></html>"
    assert web.read_html(page) == [
        ("abschnitt", "Abschnitt 1", None, "Vor spann"),
        ("abschnitt", "Tabelle 1", "Titel & mehr", "Pos | Menge Teil | innen"),
        ("abschnitt", "Titel & mehr", "Titel & mehr", "eins zwei nach"),
    ]
    assert web.read_html(b"") == [] and web.read_csv(b"") == []
    assert web.read_csv("Name;Wert\n\"a;b\";1\nä;2\n".encode("cp1252")) == [("blatt", "Blatt 1", None, "Name | Wert | Name: a;b, Wert: 1 | Name: ä, Wert: 2")]


def test_xlsx_header_formula_and_dimension():
    rows = [["Leistung", "Menge"], ["Abnahme", "1", "10", "10"]]
    assert office.read_xlsx(writers.xlsx_bytes([("B", rows)], '<dimension ref="A1"/>'))[0][3] == "Leistung | Menge | Leistung: Abnahme, Menge: 1, : 10, : 10"
    cells = [["Name", "Summe"], ["A", '<c r="B2"><f>B1*2</f></c>'], ["B", '<c r="B3"><f>B1*2</f><v>750</v></c>'], ["C", '<c r="B4" t="b"><v>1</v></c>'], ["D", '<c r="B5"><v>1.50</v></c>']]
    got = office.read_xlsx(writers.xlsx_bytes([("Blatt1", cells), ("leer", []), ("nur", [["ein Wert"], [], ["noch einer"]])]))
    assert got[0] == ("blatt", "Blatt Blatt1", "Blatt1", "Name | Summe | Name: A, Summe: =B1*2 | Name: B, Summe: 750 | Name: C, Summe: True | Name: D, Summe: 1.5")
    assert got[1] == ("blatt", "Blatt nur", "nur", "ein Wert | noch einer")


def test_mail():
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Cc"], m["Date"] = "Grüße", "Jörg <a@x.example>", "b@x.example", "c@x.example", "Sun, 01 Mar 2026 12:00:00 +0000"
    m.set_content("Guten  Tag\nText")
    m.add_alternative("<p>html</p>", subtype="html")
    m.add_attachment(b"eins", maintype="application", subtype="octet-stream")
    m.add_attachment(b"", maintype="application", subtype="octet-stream")
    m.add_attachment(b"drei", maintype="application", subtype="octet-stream", filename="c.txt")
    segments, files = mail.read_eml(m.as_bytes())
    assert segments[0] == ("mail_kopf", "Kopf", "Grüße", "From: Jörg <a@x.example> To: b@x.example Cc: c@x.example Subject: Grüße Date: Sun, 01 Mar 2026 12:00:00 +0000")
    assert segments[1] == ("mail_koerper", "Körper", None, "Guten Tag Text")
    assert files == [("anhang-1.bin", b"eins"), ("c.txt", b"drei")]
    segments, _ = mail.read_eml(b"From: a@x.example\n\n")
    assert segments == [("mail_kopf", "Kopf", None, "From: a@x.example")]


def test_pdf():
    lines = [(24, "Große Überschrift (1)")] + [(10, f"Zeile {i} mit Text") for i in range(5)]
    segments, pages = pdf.read_pdf(writers.pdf_bytes([lines, [], [(10, "a\\b"), (11.3, "kaum größer")], [(20, "x" * 81), (10, "y"), (10, "z")]]))
    assert pages == 4 and [s[1] for s in segments] == ["S. 1", "S. 3", "S. 4"]
    assert segments[0][2] == "Große Überschrift (1)" and segments[0][3].endswith("Zeile 4 mit Text")
    assert segments[1][2:] == (None, "a\\b kaum größer") and segments[2][2] is None
    assert pdf.heading([(12, "erste"), (12, "zweite"), (10, "a"), (10, "b"), (10, "c")]) == "erste"
    for broken in (b"%PDF-1.4 nothing", b"%PDF-1.4 /Encrypt"):
        with pytest.raises(pdf.PdfError):
            pdf.read_pdf(broken)


def form_pdf(depth, font=True):
    """A page that draws a form that draws a form, ``depth`` times; the last one has the text."""
    use = "/Font<</F1 3 0 R>>" if font else ""
    objects = ["<</Type/Catalog/Pages 2 0 R>>", "<</Type/Pages/Count 1/Kids[4 0 R]>>", "<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", f"<</Type/Page/Parent 2 0 R/Resources<</XObject<</X 6 0 R>>{use}>>/Contents 5 0 R>>", "<</Length 5>>\nstream\n/X Do\nendstream"]
    for i in range(depth):
        n = len(objects) + 1
        last = i == depth - 1
        text = "BT /F1 10 Tf (ganz unten) Tj ET" if last else "/X Do"
        objects.append(f"<</Subtype/Form/Length {len(text)}/Resources<</XObject<</X {n + 1} 0 R>>{use}>>>>\nstream\n{text}\nendstream")
    return "%PDF-1.4\n" + "".join(f"{i} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects, 1))


def test_pdf_loses_no_text_silently():
    assert pdf.read_pdf(form_pdf(30).encode())[0][0][3] == "ganz unten"
    with pytest.raises(pdf.PdfError, match="font"):
        pdf.read_pdf(form_pdf(1, font=False).encode())
    with pytest.raises(pdf.PdfError, match="draws itself"):
        pdf.read_pdf(form_pdf(2).replace("/X 7 0 R", "/X 6 0 R").encode())


def test_writers_are_reproducible_and_complete():
    s = Spec("Titel", spec().blocks, groups=(1, 1))
    for make in (writers.write_pdf, writers.write_docx, writers.write_xlsx, writers.write_eml):
        assert make(s) == make(s)
    assert [x[1] for x in office.read_docx(writers.write_docx(s))] == ["Titel", "Leistung", "Tabelle 1", "Positionen"]
    assert [x[1] for x in office.read_xlsx(writers.write_xlsx(s))] == ["Blatt Dokument", "Blatt Positionen 1"]
    assert pdf.read_pdf(writers.write_pdf(s))[1] == 2
    assert writers.euro(-1234.5) == "-1.234,50 EUR"
    assert sum(writers.page_groups(random.Random(1), 9)) == 9
    with pytest.raises(ValueError):
        writers.pdf_bytes([[(10, "x")] * 200])


def test_corpus_invariants():
    from collections import Counter

    specs = corpus.build()
    assert specs == corpus.build() and len(specs) == 560
    assert Counter(corpus.formats().values()) == {"pdf": 23, "docx": 18, "eml": 8, "xlsx": 7}
    assert sum(s.template_id.endswith(corpus.ATTACHED) for s in specs) == 10
    assert len({(s.title, s.blocks) for s in specs}) == 560
    assert {n for n in Counter(s.class_key for s in specs).values()} == {80}
    shapes = {}
    for s in specs:
        shapes.setdefault(s.class_key, set()).add((len(s.blocks), sum(bool(b.header) for b in s.blocks)))
    assert len(set(map(frozenset, shapes.values()))) == 1  # the same structure in every class


def test_generate_and_ingest(spark, tmp_path):
    raw_dir, splits = str(tmp_path / "raw"), str(tmp_path / "splits.yaml")
    made, lines = corpus.generate(spark, raw_dir, splits, variants=1)
    rows = made.collect()
    assert len(rows) == 56 and "56 files" in lines[0] and "1 of them" in lines[0]
    assert {r.split for r in rows} == {"gold", "calib", "train"} and not any(r.class_key.lower() in r.source_path for r in rows)
    again, lines = corpus.generate(spark, raw_dir, splits, variants=1)
    assert len(lines) == 1 and [tuple(r) for r in again.collect()] == [tuple(r) for r in rows]
    r = ingest.ingest(spark, raw_dir, str(tmp_path / "out"))
    assert (r.documents, r.attachments, r.failed, r.empty) == (57, 1, [], [])


# Pipeline


@pytest.fixture()
def archive(tmp_path):
    root = tmp_path / "raw"
    s = spec()
    writers.write(str(root), "doc-1", s, "pdf")
    writers.write(str(root), "doc-2", s, "docx")
    writers.write(str(root), "doc-3", s, "xlsx")
    writers.write(str(root), "doc-4", s, "eml", ("x.pdf", writers.write_pdf(s)))
    return root, str(tmp_path / "parquet")


def test_ingest_increment_and_attachments(spark, archive):
    root, out = archive
    r = ingest.ingest(spark, str(root), out)
    assert (r.documents, r.attachments, r.skipped, r.failed, r.empty) == (5, 1, 0, [], [])
    docs = {d.source_path: d for d in tables.read_table(spark, out, "documents").collect()}
    child, parent = docs["eml/doc-4.eml!x.pdf"], docs["eml/doc-4.eml"]
    assert child.parent_document_id == parent.document_id and child.file_name == "doc-4.eml!x.pdf" and not child.needs_ocr
    segs = tables.read_table(spark, out, "segments")
    assert segs.join(tables.read_table(spark, out, "documents"), "document_id", "left_anti").count() == 0
    assert segs.count() == r.segments
    r = ingest.ingest(spark, str(root), out)
    assert (r.documents, r.skipped, r.attachments) == (0, 4, 0)
    (root / "pdf/doc-1.pdf").write_bytes(writers.write_pdf(spec("Neu")))
    assert ingest.ingest(spark, str(root), out).documents == 1
    assert tables.read_table(spark, out, "documents").count() == 6
    assert "archive: 6 documents" in ingest.report(spark, out, r)[-1]
    tables.register(spark, out)
    got = spark.sql("select media_type, count(*) n from documents where normalize_text(' a  b ') = 'a b' group by media_type").collect()
    assert sum(r.n for r in got) == 6 and spark.sql("select * from manifest").count() == 0


def test_ingest_problems(spark, tmp_path):
    root, out = tmp_path / "raw", str(tmp_path / "parquet")
    (root / ".versteckt").mkdir(parents=True)
    (root / "kaputt.dat").write_bytes(b"\x00\x01")
    (root / "leer.pdf").write_bytes(b"")
    (root / "~$x.docx").write_bytes(b"lock")
    (root / ".DS_Store").write_bytes(b"x")
    (root / "_unten.docx").write_bytes(writers.docx_bytes(""))
    (root / ".versteckt/a.pdf").write_bytes(writers.pdf_bytes([[]]))
    (root / "scan.pdf").write_bytes(writers.pdf_bytes([[(10, "ein kurzer Text auf der ersten Seite")]] + [[]] * 9))
    m = EmailMessage()
    m["From"], m["To"] = "a@x.example", "b@x.example"
    m.set_content("Text")
    for _ in range(2):
        m.add_attachment(writers.docx_bytes(writers.docx_paragraph("gleich")), maintype="application", subtype="octet-stream", filename="g.docx")
    m.add_attachment(b"\x00", maintype="application", subtype="octet-stream", filename="kaputt.bin")
    (root / "m.eml").write_bytes(m.as_bytes())
    outer = EmailMessage()
    outer["From"], outer["To"] = "a@x.example", "b@x.example"
    outer.add_attachment(m.as_bytes(), maintype="application", subtype="octet-stream", filename="innen.eml")
    (root / "z.eml").write_bytes(outer.as_bytes())
    assert sorted(r.source_path for r in raw.list_files(spark, str(root)).collect()) == [".versteckt/a.pdf", "_unten.docx", "kaputt.dat", "leer.pdf", "m.eml", "scan.pdf", "z.eml"]
    r = ingest.ingest(spark, str(root), out)
    assert sorted(r.failed) == ["kaputt.dat", "leer.pdf", "m.eml!kaputt.bin", "z.eml!innen.eml!kaputt.bin"]
    assert r.empty == [".versteckt/a.pdf", "_unten.docx"]
    assert (r.attachments, r.skipped) == (7, 2)
    docs = {d.source_path: d.needs_ocr for d in tables.read_table(spark, out, "documents").collect()}
    assert docs[".versteckt/a.pdf"] and docs["scan.pdf"] and not docs["_unten.docx"]
    assert "z.eml!innen.eml!g.docx" in docs


def test_empty_tables_and_strict_append(spark, tmp_path):
    empty = tables.read_table(spark, str(tmp_path), "segments")
    assert empty.count() == 0 and dict(empty.dtypes)["index"] == "bigint"
    tables.append_table(empty, str(tmp_path), "segments")
    with pytest.raises(ValueError):
        tables.append_table(empty.drop("kind"), str(tmp_path), "segments")
    assert ingest.ingest(spark, str(tmp_path / "none"), str(tmp_path / "out")).documents == 0


def test_config(spark, tmp_path):
    p = tmp_path / "splits.yaml"
    assert tables.load_splits(str(p)) == {}
    tables.save_splits({"b": "gold", "a": "train"}, str(p))
    assert list(tables.load_splits(str(p)).items()) == [("a", "train"), ("b", "gold")]
    p.write_text("splits: {a: falsch}")
    with pytest.raises(ValueError, match="falsch"):
        tables.load_splits(str(p))
    c = tmp_path / "classes.yaml"
    c.write_text("version: 1\nclasses:\n- {key: A, name: a, description: d, not: n}\n- {key: R, name: r, description: d, not: n, residual: true}\n")
    classes = tables.load_classes(spark, str(c))
    assert [r.key for r in tables.trainable(classes).collect()] == ["A"] and tables.get_class(classes, "R").residual
    with pytest.raises(KeyError):
        tables.get_class(classes, "X")
    c.write_text("version: 1\nclasses:\n- {key: A, name: a, description: d, not: n}\n- {key: A, name: b, description: d, not: n}\n")
    with pytest.raises(ValueError, match="A"):
        tables.load_classes(spark, str(c))


def test_segments_of_a_run_that_died_are_not_written_twice(spark, archive, monkeypatch):
    root, out = archive
    real = tables.append_table

    def dies(df, folder, name):
        if name == "documents":
            raise OSError("lost")
        real(df, folder, name)

    monkeypatch.setattr(tables, "append_table", dies)
    with pytest.raises(OSError):
        ingest.ingest(spark, str(root), out)
    monkeypatch.setattr(tables, "append_table", real)
    r = ingest.ingest(spark, str(root), out)
    segs = tables.read_table(spark, out, "segments")
    assert r.documents == 5 and segs.count() == segs.select("segment_id").distinct().count() == r.segments


def test_threshold_from_session_and_environment(spark, monkeypatch):
    assert setting(spark, "min.chars.per.page", 40) == 40
    monkeypatch.setenv("DOCLOOM_MIN_CHARS_PER_PAGE", "50")
    assert setting(spark, "min.chars.per.page", 40) == "50"
    spark.conf.set("docloom.min.chars.per.page", "60")
    assert setting(spark, "min.chars.per.page", 40) == "60"
    spark.conf.unset("docloom.min.chars.per.page")


def test_every_level_of_attachments(spark, tmp_path):
    data = writers.write_eml(spec("innen"))
    for n in range(3):
        data = writers.write_eml(spec(f"Ebene {n}"), (f"{n}.eml", data))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "m.eml").write_bytes(data)
    r = ingest.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert (r.documents, r.attachments, r.failed) == (4, 3, [])
    paths = {x.source_path for x in tables.read_table(spark, str(tmp_path / "out"), "documents").collect()}
    assert paths == {"m.eml", "m.eml!2.eml", "m.eml!2.eml!1.eml", "m.eml!2.eml!1.eml!0.eml"}
