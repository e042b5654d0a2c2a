"""Text and identity functions.

Everything that the JVM can express stays in expressions. Unicode compatibility normalisation
(NFKC) has no built-in counterpart and runs in an Arrow UDF, which hands back rows that are
already normal unchanged.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ID_LENGTH = 32
HYPHENATION = re.compile(r"(\w)-\s*\n\s*(\w)")
WHITESPACE = re.compile(r"\s+")


def normalize_python(text: str) -> str:
    """NFKC, hyphens at line ends resolved, white space collapsed and stripped, in this order."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if "-" in text and "\n" in text:
        text = HYPHENATION.sub(r"\1\2", text)
    return WHITESPACE.sub(" ", text).strip()


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; null stays null."""
    return s.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def normalize_text(s: pd.Series) -> pd.Series:
    """``normalize_python`` for a column; null stays null."""
    return s.map(lambda t: t if t is None else normalize_python(t))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dehyphenate(c) -> Column:
    """Joins words hyphenated at a line end; JVM regex, equal to the Python one on Latin text."""
    return F.regexp_replace(_col(c), r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def collapse_whitespace(c) -> Column:
    """Runs of white space become one blank, ends are stripped; covers what Python calls white space."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_native(c) -> Column:
    """``normalize_text`` without NFKC, wholly in the JVM: exact for text that is NFKC already."""
    return collapse_whitespace(dehyphenate(c))


def derive_id(*parts) -> Column:
    """First 32 hex digits of the SHA-256 over all parts, each followed by a zero byte."""
    zero = F.lit(b"\x00")
    joined = [x for p in parts for x in (_as_bytes(p), zero)]
    return F.substring(F.sha2(F.concat(*joined), 256), 1, ID_LENGTH)


def _as_bytes(p) -> Column:
    # A binary column passes through the cast unchanged; a string becomes its UTF-8 bytes.
    return _col(p).cast("binary")


def normal_key(c, separator: str = "-") -> Column:
    """A name in one spelling: NFKC, lower case, each run of other characters than letters and
    digits one separator, none at the ends; null if nothing is left."""
    bare = F.regexp_replace(F.lower(nfkc(_col(c))), r"[^\p{L}\p{N}]+", separator)
    bare = F.regexp_replace(bare, f"^{separator}|{separator}$", "")
    return F.when(bare != "", bare)


def file_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)
