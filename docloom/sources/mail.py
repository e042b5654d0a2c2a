"""Mails: header fields and body are segments, attachments are documents of their own.

Each part of a mail is read by a function of its own; a segment exists if its text is not empty after
normalisation. Encoded header words are decoded by the parser's policy.
"""

from __future__ import annotations

import email
from email.message import EmailMessage
from email.policy import default as POLICY

from docloom.functions.text import normalize_python

# Header fields of the header segment, in this order.
FIELDS = ("From", "To", "Cc", "Subject", "Date")


def header_text(message: EmailMessage) -> str:
    """The fields that are there, as ``name: value``."""
    present = {name: value for name in FIELDS if (value := str(message.get(name, "")))}
    return normalize_python(" ".join(map(": ".join, present.items())))


def body_text(message: EmailMessage) -> str:
    """The plain text; without one, the HTML with its markup."""
    for kind in ("plain", "html"):
        part = message.get_body((kind,))
        if part is not None:
            return normalize_python(part.get_content())
    return ""


def attachments(message: EmailMessage) -> list[tuple[str, bytes]]:
    """Names and contents. Parts are numbered as they come, which names those without a name; what has no content
    (an attached message has none of its own) is left out, but counted."""
    parts = [(part.get_filename(), part.get_payload(decode=True)) for part in message.iter_attachments()]
    return [(name or f"anhang-{place + 1}.bin", content) for place, (name, content) in enumerate(parts) if content]


def read_eml(data: bytes):
    """Segments ``(kind, locator, heading, text)`` and attachments ``(name, content)``."""
    message = email.message_from_bytes(data, policy=POLICY)
    subject = normalize_python(str(message.get("Subject", ""))) or None
    candidates = (("mail_kopf", "Kopf", subject, header_text(message)), ("mail_koerper", "Körper", None, body_text(message)))
    return [s for s in candidates if s[-1]], attachments(message)
