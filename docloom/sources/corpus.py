"""A small corpus of invented business letters with known classes, for tests of a whole archive.

Seven classes of eight templates, ten variants each. All letters share head and foot and the same kinds of blocks, so
neither names nor structure tell the class; credit notes are built as invoices are, but for their words.
A template is a row of its class's words, so a new one changes no other.
"""

from __future__ import annotations

import random
from pathlib import Path

from docloom.operators import manifest
from docloom.sources import writers
from docloom.sources.writers import Block, Spec

#: Templates of mails whose content is attached as PDF as well.
ATTACHED = "-anhang"
PER_CLASS = 8
FIRMS = ("Nordlicht Technik GmbH", "Talblick Bau AG", "Weber und Söhne KG", "Seehaus Logistik GmbH", "Mühlbach Energie eG")
GOODS = ("Montage", "Wartung", "Prüfung", "Lieferung", "Beratung", "Reinigung", "Miete", "Transport")
#: Per class: titles, headings and sentences; ``{}`` is filled with a firm, a number or a day.
CLASSES = {
    "RECHNUNG": (("Rechnung", "Schlussrechnung", "Abschlagsrechnung"), ("Leistungen", "Zahlung"), ("Für die erbrachten Leistungen berechnen wir die folgenden Beträge.", "Bitte überweisen Sie den Betrag bis zum {}. März unter Angabe der Nummer {}.", "Das Zahlungsziel beträgt {} Tage.")),
    "GUTSCHRIFT": (("Gutschrift", "Rechnungskorrektur", "Stornobeleg"), ("Leistungen", "Erstattung"), ("Zu den berechneten Leistungen schreiben wir die folgenden Beträge gut.", "Der Betrag wird bis zum {}. März unter der Nummer {} erstattet.", "Offene Forderungen werden vorher verrechnet, spätestens nach {} Tagen.")),
    "VERTRAG": (("Vertrag", "Rahmenvertrag", "Mietvertrag"), ("Gegenstand", "Laufzeit"), ("Die Vertragspartner vereinbaren die folgenden Leistungen.", "Der Vertrag beginnt am {}. März und trägt die Nummer {}.", "Die Kündigungsfrist beträgt {} Tage zum Ende eines Monats.")),
    "AGB": (("Geschäftsbedingungen", "Lieferbedingungen", "Nutzungsbedingungen"), ("Geltung", "Haftung"), ("Diese Bedingungen gelten für alle folgenden Leistungen.", "Sie treten am {}. März unter der Nummer {} in Kraft.", "Mängel sind innerhalb von {} Tagen anzuzeigen.")),
    "BERICHT": (("Statusbericht", "Monatsbericht", "Lagebericht"), ("Stand", "Ausblick"), ("Im Berichtszeitraum wurden die folgenden Leistungen erbracht.", "Der nächste Bericht folgt am {}. März unter der Nummer {}.", "Der Rückstand von {} Tagen soll aufgeholt werden.")),
    "PROTOKOLL": (("Protokoll", "Sitzungsniederschrift", "Besprechungsnotiz"), ("Anwesend", "Beschlüsse"), ("Besprochen wurden die folgenden Leistungen.", "Die nächste Sitzung ist am {}. März, Vorlage {}.", "Aufgaben sind innerhalb von {} Tagen zu erledigen.")),
    "SONSTIGES": (("Einladung", "Hinweis", "Anschreiben"), ("Anlass", "Ablauf"), ("Wir möchten Sie über die folgenden Leistungen unterrichten.", "Wir freuen uns auf Ihren Besuch am {}. März, Karte {}.", "Antworten erbitten wir in {} Tagen.")),
}


def head(rnd: random.Random) -> Block:
    return Block("", (f"{rnd.choice(FIRMS)}, Hauptstraße {rnd.randint(1, 99)}, 10115 Musterstadt",))


def foot() -> Block:
    return Block("", ("Amtsgericht Musterstadt, Geschäftsführung Kim Muster, erreichbar werktags von neun bis fünf Uhr.",))


def formats() -> dict[str, str]:
    """The format of each template: of a class's eight three are PDF, three Word, one a mail and one Excel; of
    two classes one Word file more is a PDF, and of a third one is the mail with an attachment."""
    out = {}
    for c, key in enumerate(CLASSES):
        kinds = ["pdf"] * 3 + ["docx"] * 3 + ["eml", "xlsx"]
        kinds[3] = ("pdf", "pdf", "eml")[c] if c < 3 else kinds[3]
        for n, kind in enumerate(kinds):
            out[f"{key.lower()}-{n:02d}" + (ATTACHED if c == 2 and n == 3 else "")] = kind
    return out


def _letter(key: str, template: str, fmt: str):
    """The builder of one template: draws from its generator in a fixed order."""
    titles, headings, sentences = CLASSES[key]
    number = int(template.removesuffix(ATTACHED)[-2:])

    def make(rnd: random.Random, variant: int) -> Spec:
        title = f"{titles[number % len(titles)]} {rnd.randint(1000, 9999)}-{number}{variant}"
        rows = []
        for _ in range(2 + (number + variant) % 3):
            net, tax, total = writers.amounts(rnd)
            rows.append((f"{rnd.choice(GOODS)} {rnd.randint(1, 40)}", writers.euro(net), writers.euro(tax), writers.euro(total)))
        texts = (sentences[0], sentences[1].format(rnd.randint(1, 28), rnd.randint(10_000, 99_999)), sentences[2].format(rnd.choice((7, 14, 30, 60))))
        order = rnd.sample(range(2), 2) if number % 2 else [0, 1]
        table = ("Leistung", "Netto", "Steuer", "Summe")
        parts = [Block(headings[0], texts[:1], table, tuple(rows)), Block(headings[1], texts[1:])]
        blocks = (head(rnd), *(parts[i] for i in order), foot())
        return Spec(title, blocks, key, template, variant, (fmt,), writers.page_groups(rnd, len(blocks)))

    return make


def templates() -> dict:
    """All builders by the name of the template."""
    kinds, out = formats(), {}
    for name, fmt in kinds.items():
        key = name.split("-")[0].upper()
        out[name] = _letter(key, name, fmt)
    return out


def build(seed: int = 42, variants: int = 10) -> list[Spec]:
    return writers.build_corpus(templates(), variants, seed)


def generate(spark, out: str, splits_path: str, seed: int = 42, variants: int = 10):
    """Writes all files below ``out``, assigns new templates to splits (frozen ones never change) and gives the manifest
    and the lines of a report. Names are neutral; mails of the ``ATTACHED`` templates carry their content as PDF too."""
    from docloom.sources import tables

    specs = build(seed, variants)
    frozen = tables.load_splits(splits_path)
    splits = manifest.assign_splits([(s.class_key, s.template_id) for s in specs], frozen)
    new, orphaned = sorted(splits.keys() - frozen.keys()), sorted(frozen.keys() - {s.template_id for s in specs})
    if new:
        tables.save_splits(splits, splits_path)
    # Names in an order that tells nothing of the classes.
    order = sorted(range(len(specs)), key=lambda i: random.Random(f"{seed}:{specs[i].template_id}:{specs[i].variant}:name").random())
    paths = [""] * len(specs)
    for place, i in enumerate(order, 1):
        spec, name = specs[i], f"doc-{place:04d}"
        attachment = (f"{name}.pdf", writers.write_pdf(spec)) if spec.template_id.endswith(ATTACHED) else None
        paths[i] = str(writers.write(out, name, spec, spec.formats[0], attachment).relative_to(Path(out)))
    mails = sum(s.template_id.endswith(ATTACHED) for s in specs)
    return manifest.manifest_frame(spark, specs, splits, paths), [f"{len(paths)} files written to {out}, {mails} of them mails with an attachment", *manifest.drift_report(new, orphaned)]
