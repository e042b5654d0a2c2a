"""Format detection from the first bytes; the file name decides only where bytes cannot.

The rules are expressions over a prefix of the content, so detection runs in the JVM and reads at
most 2 KiB of a file; only files that begin like a ZIP archive go through a Python function which
lists the members.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The formats and their media types.
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "eml": "message/rfc822",
    "msg": "application/vnd.ms-outlook",
    "html": "text/html",
    "csv": "text/csv",
    "image": "image/*",
    "unknown": "application/octet-stream",
}
# Members that name the kind of an office archive, the first hit decides.
ARCHIVE_MEMBERS = (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"))
# First bytes.
PDF_MAGIC = b"%PDF-"
ZIP_MAGIC = b"PK\x03\x04"
OLE2_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
IMAGE_MAGIC = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"II*\x00", b"MM\x00*")
# Mail headers of which two different ones must occur.
KNOWN_HEADERS = "from|to|cc|bcc|subject|date|message-id|received|return-path|mime-version|content-type"
HTML_WINDOW, MAIL_WINDOW, MAIL_LINES, MIN_HEADERS = 1024, 2048, 16, 2
_BLANK = r"[ \t\n\r\f\x0b]*"


def archive_kind(data: bytes) -> str | None:
    """docx, xlsx or pptx by the members of a ZIP archive; None if it is none of them or broken."""
    if not data.startswith(ZIP_MAGIC):
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
    except (zipfile.BadZipFile, OSError, ValueError, EOFError):
        return None
    return next((kind for member, kind in ARCHIVE_MEMBERS if member in names), None)


@F.pandas_udf(StringType())
def _archive_kind(s: pd.Series) -> pd.Series:
    # All rows come here, whatever branch asks for it; those that are no archive hold null.
    return s.map(lambda d: None if d is None else archive_kind(bytes(d)))


def without_bom(head: Column) -> Column:
    """A prefix, read as Latin-1, without leading blanks and one UTF-8 byte-order mark."""
    return F.regexp_replace(head, f"^{_BLANK}(ï»¿)?{_BLANK}", "")


def _head(content: Column, size: int) -> Column:
    return F.decode(F.substring(content, 1, size), "ISO-8859-1")


def looks_like_mail(content: Column) -> Column:
    """First line shaped like a header (or an mbox line), and two different known headers among the first lines."""
    lines = F.filter(F.slice(F.split(without_bom(_head(content, MAIL_WINDOW)), r"\r\n|\r|\n"), 1, MAIL_LINES), lambda x: F.length(F.regexp_replace(x, r"[ \t\f\x0b]+", "")) > 0)
    shaped = F.coalesce(F.element_at(lines, 1).rlike(r"^[A-Za-z][A-Za-z0-9-]*:[ \t]|^From \S+"), F.lit(False))
    names = F.transform(lines, lambda x: F.lower(F.regexp_extract(x, f"^(?i)({KNOWN_HEADERS}):", 1)))
    return (F.size(lines) > 0) & shaped & (F.size(F.array_distinct(F.filter(names, lambda x: x != ""))) >= MIN_HEADERS)


def extension(file_name: Column) -> Column:
    """Lower-case text behind the last dot; empty without a dot."""
    return F.when(file_name.contains("."), F.lower(F.substring_index(file_name, ".", -1))).otherwise("")


def detect_text_format(content: Column, file_name: Column) -> Column:
    """All rules but the archive rule."""
    starts = lambda magic: F.substring(content, 1, len(magic)) == F.lit(magic)
    html = F.lower(F.substring(without_bom(_head(content, HTML_WINDOW)), 1, 15)).rlike("^(<!doctype html|<html)")
    ext = extension(file_name)
    image = starts(IMAGE_MAGIC[0])
    for magic in IMAGE_MAGIC[1:]:
        image = image | starts(magic)
    return (
        F.when(starts(PDF_MAGIC), "pdf")
        .when(starts(OLE2_MAGIC), "msg")
        .when(image, "image")
        .when(html, "html")
        .when(looks_like_mail(content), "eml")
        .when(ext == "eml", "eml")
        .when(ext.isin("csv", "tsv"), "csv")
        .when(ext.isin("htm", "html"), "html")
        .otherwise("unknown")
    )


def detect_format(content: Column | str, file_name: Column | str) -> Column:
    """The format of a file. A broken archive, or one of another kind, falls through to the other rules."""
    content = F.col(content) if isinstance(content, str) else content
    file_name = F.col(file_name) if isinstance(file_name, str) else file_name
    zipped = F.substring(content, 1, 4) == F.lit(ZIP_MAGIC)
    return F.coalesce(_archive_kind(F.when(zipped, content)), detect_text_format(content, file_name))


def media_type(fmt: Column | str) -> Column:
    fmt = F.col(fmt) if isinstance(fmt, str) else fmt
    return F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))[fmt]
