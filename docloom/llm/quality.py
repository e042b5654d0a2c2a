"""Text quality statistics per document, and whether it is running prose or a list, a table or junk.

A text is cut into *units*: sentences where they end with a mark, else items of a list, lines of a
table or what stands between blank lines; lines broken within a sentence are joined and quote marks
at line starts are dropped. Each unit has a distribution of its tokens over six classes (function
words, other words, fragments, numbers and codes, symbols, sentence marks). It gets the structural profile with the smallest
Jensen-Shannon divergence from it. A unit counts as running sentence if that profile is prose and it
either ends as a sentence or is long and varied enough to be part of one. The document's label is prose if half of
its characters, blanks at line ends not counted, belong to running sentences; else the profile with most characters.

Function words are those of six languages. A document that knows too few of them (``KNOWN``) is in another language or no
prose at all. It is measured against what prose has in common in any alphabetic language: the distribution of
its word lengths must be near ``WORD_LENGTHS``, its letters must be near ``LETTERS`` (vowels and consonants, in scripts
that write both), and its words of at most three letters, together with short ones that come again, stand for the function words. ``language`` is
null there.

Only words decide, not case, so texts in capitals or small letters are treated alike. The work is one
pass without a shuffle; memory is that of one Arrow batch.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common function words by language, the most frequent first.
FUNCTION_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wir ihr ihnen uns wenn soweit sofern ob weil kann können soll muss dieser diese dieses bereits wegen zwischen gegen ohne unter seit vom während statt davon dazu danach kein keine".split(),
    "en": "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our after before until please because must should while between under each during most".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se le ce il sont avec son aux cette ou mais comme nous vous être leur ont été sans entre".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha este sí porque esta entre cuando muy sin sobre también hasta".split(),
    "it": "di e il la che in un a per è una del con non sono da le si dei al come più nel della ma gli ha alla anche delle questo lo o se i dal nella sul tra essere".split(),
    "nl": "de van het een en in is dat op te zijn met die voor niet aan er om hij ook als dan maar bij uit nog naar of door over ze wordt worden heeft hebben tot deze kan".split(),
}
#: Token shares of the structural profiles: function words, other words, fragments, numbers, symbols, sentence marks.
PROFILES = {
    "prose": (0.40, 0.45, 0.00, 0.05, 0.02, 0.08),
    "prose with figures": (0.32, 0.38, 0.02, 0.15, 0.03, 0.10),
    "list": (0.03, 0.72, 0.02, 0.10, 0.07, 0.06),
    "table": (0.01, 0.25, 0.01, 0.38, 0.17, 0.18),
    "junk": (0.02, 0.08, 0.36, 0.10, 0.38, 0.06),
}
NAMES = list(PROFILES)
PROSE = 2  # so many of the profiles, from the first, are prose
#: In a language whose function words are not known, prose may also look like this.
FEW_FUNCTION_WORDS = (0.12, 0.74, 0.02, 0.03, 0.01, 0.08)
#: Share of words with 1, 2, ... 12 and more letters in prose of alphabetic languages, and how near a text must be.
WORD_LENGTHS = np.array([0.05, 0.14, 0.15, 0.12, 0.11, 0.10, 0.09, 0.08, 0.06, 0.04, 0.03, 0.03])
LENGTH_DISTANCE = 0.16
#: Vowels and consonants in prose, how near a text must be, and the vowels of the scripts that write them.
LETTERS = np.array([0.43, 0.57])
LETTER_DISTANCE = 0.03
VOWELS = frozenset("aeiouyıøæœαεηιουωаеёиоуыэюяіїєѣ")
#: Share of known function words below which a language is not known, and of short words that other prose needs.
KNOWN, SHORT = 0.3, 0.06
#: Symbols per word it may have at most, and words a line of a unit that does not end as a sentence needs there.
SYMBOLS, LINE_WORDS = 0.1, 5
#: Runs of letters and digits with what joins them, each one token; runs of symbols.
TOKEN = re.compile(r"[^\W_]+(?:[.,:/-][^\W_]+)*|[^\w\s]+|_+")
PART = re.compile(r"[^\W_]+")
OTHER = re.compile(r"[^\w\s]+|_+")
DIGIT = re.compile(r"\d")
#: Marks that end or part a sentence.
MARKS = frozenset(".,;:!?。！？؟।")
SENTENCE_END = re.compile(r"(?<=[.!?;؟।])[\"')\]»“”]*\s+|(?<=[。！？])")
ITEM = re.compile(r"^\s*(?:\d+(?:\.\d+)*[.)]?\s|[-–—*•·▪◦+]\s|\[[ xX]?\]|[^\W\d_]{1,12} \d+[.:)])")
QUOTE = re.compile(r"^[ \t]*(?:>[ \t]?)+", re.M)
END_MARKS = ".!?。！？؟।"
#: A unit that does not end as a sentence needs so many words and different function words.
OPEN_WORDS, OPEN_FUNCTION_WORDS = 6, 3


def _spellings(word: str) -> set[str]:
    plain = word
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        plain = plain.replace(a, b)
    return {word, plain}


def _tables():
    index: dict[str, int] = {}
    for words in FUNCTION_WORDS.values():
        for w in words:
            for s in _spellings(w):
                index.setdefault(s, len(index) if s == w or w not in index else index[w])
    size = max(index.values()) + 1
    langs = np.zeros((len(FUNCTION_WORDS), size))
    for i, words in enumerate(FUNCTION_WORDS.values()):
        for rank, w in enumerate(words):
            # Zipf's law with an offset, as usual for the commonest words.
            langs[i, index[w]] += 1 / (rank + 4)
    return index, langs / langs.sum(axis=1, keepdims=True)


INDEX, LANGUAGES = _tables()
_PROFILE = np.array([*PROFILES.values(), FEW_FUNCTION_WORDS])


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits, along the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return (a + b) / 2


def language_divergence(seen: dict[int, int]) -> np.ndarray:
    """Jensen-Shannon divergence of counted function words from each language's profile.

    Where only the profile has a word it adds half its share, so only counted words need a look.
    """
    p = np.fromiter(seen.values(), float, len(seen))
    p /= p.sum()
    q = LANGUAGES[:, np.fromiter(seen, np.int64, len(seen))]
    with np.errstate(divide="ignore", invalid="ignore"):
        both = p * np.log2(2 * p / (p + q)) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0)
    return (both.sum(axis=1) + 1 - q.sum(axis=1)) / 2


def units(text: str) -> list[tuple[str, bool]]:
    """Units of a text, each with whether it ends as a sentence."""
    if ">" in text:
        text = QUOTE.sub("", text)
    out: list[tuple[str, bool]] = []
    block: list[str] = []

    def close():
        if block:
            parts = SENTENCE_END.split("\n".join(block))
            out.extend((p, p.rstrip()[-1:] in END_MARKS + ";" and bool(p.strip())) for p in parts if p.strip())
            block.clear()

    for line in text.split("\n"):
        if not line.strip():
            close()
            continue
        if "\t" in line or "|" in line or ITEM.match(line):
            close()
        block.append(line)
        if "\t" in line or "|" in line:
            close()
    close()
    return out


def _tokens(unit: str):
    """Lower-case words; runs of symbols; and numbers and codes: tokens with a digit and what joins them, each one token."""
    unit = unit.lower()
    if not DIGIT.search(unit):
        return PART.findall(unit), OTHER.findall(unit), ()
    words, other, codes = [], [], []
    for t in TOKEN.findall(unit):
        if t.isalpha():
            words.append(t)
        elif not t[0].isalnum():
            other.append(t)
        elif DIGIT.search(t):
            codes.append(t)
        else:
            words += PART.findall(t)
            other += OTHER.findall(t)
    return words, other, codes


class _Text:
    """Counts of a text, and per unit: words, known function words, other token classes, length, whether it ends as a sentence, lines."""

    def __init__(self, text: str):
        if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        self.units, self.seen, known_all = [], {}, []
        self.words = self.letters = self.symbols = self.plain = 0
        known_word = INDEX.get
        for unit, ended in units(text):
            words, other, codes = _tokens(unit)
            known = [f for w in words if (f := known_word(w)) is not None]
            known_all += known
            size = sum(map(len, other))
            marks = sum(t in MARKS for t in other)
            for t in codes:
                parts = PART.findall(t)
                letters = sum(map(len, parts))
                self.words += len(parts)
                self.letters += letters
                self.symbols += len(t) - letters
            self.plain += len(words)
            self.letters += len("".join(words))
            self.symbols += size
            unit = unit.strip()
            self.units.append((words, known, [0, 0, 0, len(codes), size - marks, marks], len(unit), ended, unit.count("\n") + 1))
        self.words += self.plain
        for f in known_all:
            self.seen[f] = self.seen.get(f, 0) + 1

    def rows(self) -> tuple[list, list, bool]:
        """Token classes of each unit, whether it may be a sentence, and whether the language is another one."""
        other = sum(self.seen.values()) < KNOWN * self.plain and self._like_prose()
        common: dict[str, int] = {}
        if other:
            for words, *_ in self.units:
                for w in words:
                    if len(w) <= 5:
                        common[w] = common.get(w, 0) + 1
        rows, whole = [], []
        for words, known, row, _, ended, lines in self.units:
            row = list(row)
            if other:
                function = {w for w in words if len(w) <= 3 or common.get(w, 0) > 2}
                row[0], distinct = sum(w in function for w in words), len(function)
            else:
                row[0], distinct = len(known), len(set(known))
                row[2] = len([w for w in words if len(w) <= 2 and w not in INDEX])
            row[1] = len(words) - row[0] - row[2]
            rows.append(row)
            least = 3 if other else 2
            full = not other or len(words) >= LINE_WORDS * lines
            whole.append(ended and len(words) > least or len(words) >= OPEN_WORDS and distinct >= OPEN_FUNCTION_WORDS and full)
        return rows, whole, other

    def _like_prose(self) -> bool:
        """Whether word lengths and letters are those of prose in some alphabetic language."""
        words = [w for u in self.units for w in u[0]]
        marks = sum(u[2][4] for u in self.units)
        if not words or sum(len(w) <= 3 for w in words) < SHORT * len(words) or marks > SYMBOLS * len(words):
            return False
        lengths = np.bincount(np.minimum([len(w) for w in words], len(WORD_LENGTHS)), minlength=len(WORD_LENGTHS) + 1)[1:] / len(words)
        if divergence(lengths, WORD_LENGTHS) > LENGTH_DISTANCE:
            return False
        letters = [c for w in set(words) for c in unicodedata.normalize("NFD", w) if c.isalpha()]
        vowels = sum(c in VOWELS for c in letters)
        # A script without vowels of its own says nothing here.
        written = any("a" <= c <= "z" or "α" <= c <= "я" for c in letters)
        return not written or divergence(np.array([vowels, len(letters) - vowels]) / len(letters), LETTERS) <= LETTER_DISTANCE


def classify(texts: list[str | None]) -> list[tuple]:
    """The figures of each text, see ``SCHEMA``."""
    parts = [_Text(t or "") for t in texts]
    found = [p.rows() for p in parts]
    counts = np.array([r for rows, _, _ in found for r in rows], float).reshape(-1, 6)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    far = np.stack([divergence(share, q) for q in _PROFILE]) if len(share) else np.empty((len(_PROFILE), 0))
    nearest, out, at = far[:-1].argmin(axis=0) if len(share) else np.empty(0, np.int64), [], 0
    for text, p, (rows, whole, other) in zip(texts, parts, found):
        own, few = nearest[at : at + len(rows)], far[:, at : at + len(rows)].argmin(axis=0) == len(NAMES)
        at += len(rows)
        text = text or ""
        lines = [x.rstrip() for x in text.split("\n") if x.strip()]
        closed = sum(x[-1] in END_MARKS for x in lines)
        known = sum(r[0] for r in rows)
        base = (len(text), p.words, p.letters / p.words if p.words else 0.0, p.symbols / len(text) if text else 0.0, len(lines), closed / len(lines) if lines else 0.0, known / p.words if p.words else 0.0)
        language = distance = None
        if p.seen and not other:
            d = language_divergence(p.seen)
            language, distance = list(FUNCTION_WORDS)[int(d.argmin())], float(d.min())
        if not p.words:
            out.append((*base, 0.0, language, distance, "junk" if text.strip() else "empty"))
            continue
        size = np.array([u[3] for u in p.units], float)
        running = ((own < PROSE) | few & other) & np.array(whole)
        prose = float(size[running].sum() / size.sum())
        if prose >= 0.5:
            label = "prose"
        else:
            # What looks like a sentence but is none is an item of a list.
            rest = np.bincount(np.maximum(own, PROSE)[~running], size[~running], minlength=len(NAMES))
            label = NAMES[int(rest.argmax())]
        out.append((*base, prose, language, distance, label))
    return out


SCHEMA = "chars bigint, words bigint, mean_word_length double, symbol_share double, lines bigint, ended_lines_share double, common_words_share double, prose_share double, language string, language_distance double, profile string"


def text_quality(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of ``df``: ``key`` and the columns of ``SCHEMA``.

    Null and empty texts have zero figures and the profile "empty"; texts with characters but
    without any word are junk. Repeated rows give repeated rows; other columns play no part.
    """
    chosen = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    names = ["key", *(x.split()[0] for x in SCHEMA.split(", "))]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.string()]

    def run(batches):
        for b in batches:
            rows = list(zip(*classify(b.column(1).to_pylist()))) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(rows, types))], names)

    return chosen.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
