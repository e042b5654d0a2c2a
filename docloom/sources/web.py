"""HTML and CSV files, read with the standard library.

A segment is ``(kind, locator, heading, text)`` as in Word and Excel files: an HTML heading opens a section, a
table is a segment of its own before the text of its section; a CSV file is one sheet.
"""

from __future__ import annotations

import csv
import io
from html.parser import HTMLParser

from docloom.functions.text import normalize_python
from docloom.sources.office import Segment, _sections, sheet_text

HEADINGS = {f"h{i}" for i in range(1, 7)}
#: Elements whose text is not shown.
HIDDEN = {"script", "style", "template", "noscript", "title"}
#: Elements that end a paragraph.
BREAKS = HEADINGS | {"p", "div", "br", "li", "ul", "ol", "section", "article", "header", "footer", "blockquote", "pre", "hr", "form", "body", "dd", "dt"}


def decoded(data: bytes) -> str:
    """UTF-8 (a byte-order mark is dropped), UTF-16 by its mark, else Windows-1252."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


class _Reader(HTMLParser):
    """Events ("heading" | "text" | "table", text) of a page; a table inside a table belongs to its cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events, self.text, self.hidden, self.heading = [], [], 0, False
        self.tables: list[list[list[list[str]]]] = []

    def _close(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.events.append(("heading" if self.heading else "text", text))

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "table":
            if not self.tables:
                self._close()
            self.tables.append([])
        elif self.tables:
            rows = self.tables[-1]
            if tag == "tr":
                rows.append([])
            elif tag in ("td", "th"):
                if not rows:
                    rows.append([])
                rows[-1].append([])
            elif tag in BREAKS:
                self._cell(" ")
        elif tag in BREAKS:
            self._close()
            self.heading = tag in HEADINGS

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.tables:
            rows = [[" ".join("".join(cell).split()) for cell in row] for row in self.tables.pop()]
            text = " ".join(" | ".join(row) for row in rows if any(row))
            if self.tables:
                self._cell(f" {text} ")
            else:
                self.events.append(("table", text))
        elif tag in BREAKS and not self.tables:
            self._close()
            self.heading = False

    def _cell(self, text: str) -> None:
        if self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1].append(text)

    def handle_data(self, data):
        if self.hidden:
            return
        if self.tables:
            self._cell(data)
        else:
            self.text.append(data)

    def close(self):
        super().close()
        while self.tables:
            self.handle_endtag("table")
        self._close()


def read_html(data: bytes) -> list[Segment]:
    reader = _Reader()
    reader.feed(decoded(data))
    reader.close()
    return list(_sections(iter(reader.events)))


def read_csv(data: bytes) -> list[Segment]:
    """One segment; the separator is the one of ``; , tab |`` that cuts the first line into most parts."""
    text = decoded(data)
    first = text.split("\n", 1)[0]
    separator = max(";,\t|", key=first.count)
    rows = [[value.strip() for value in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=separator)]
    written = normalize_python(sheet_text(rows))
    return [("blatt", "Blatt 1", None, written)] if written else []
