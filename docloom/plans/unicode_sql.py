"""NFKC for an engine that has only NFC: compatibility characters are spelled out first.

The replacements come from Python's Unicode tables, for the characters of ``RANGES``; single characters
by one ``translate``, longer ones by ``replace``. Text outside the ranges is composed only.
"""

from __future__ import annotations

import unicodedata

#: Latin, Greek, Cyrillic, punctuation, letter-like and number forms, arrows, ligatures, full-width forms.
RANGES = ((0xA0, 0x590), (0x2000, 0x2400), (0x2460, 0x2500), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))


def nfkc(column: str) -> str:
    single, longer = {}, {}
    for lo, hi in RANGES:
        for code in range(lo, hi):
            c = chr(code)
            to = unicodedata.normalize("NFKC", c)
            if to != unicodedata.normalize("NFC", c):
                (single if len(to) == 1 else longer)[c] = to
    quoted = lambda s: s.replace("'", "''")
    column = f"translate({column}, '{quoted(''.join(single))}', '{quoted(''.join(single.values()))}')"
    for c, to in longer.items():
        column = f"replace({column}, '{c}', '{quoted(to)}')"
    return f"nfc_normalize({column})"
