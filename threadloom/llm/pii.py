"""Personal data: regular expressions propose, checksums confirm, context scores.

``find_pii`` returns one row per document with the base spans (email, ip, card,
phone) and the spans that the method adds: bank account numbers (iban, of the length
that their country gives them, confirmed by mod-97) and national phone numbers
(phone_local, which only nearby context words can lift over the threshold). Every span
has a score, listed in the order of the spans: the kind's prior, raised by a passed
checksum and by context words within ``CONTEXT`` characters.

Edge cases: a null text counts as empty and has no spans; a null doc_id is kept;
repeated rows give repeated results; other columns are ignored. Time is linear in
the text's length, since no expression can start inside a run that it rejects.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .worker import map_arrow

KINDS = ("email", "ip", "card", "phone", "iban", "phone_local")
BASE = KINDS[:4]
CONTEXT = 40
THRESHOLD = 0.5
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "phone_local": 0.3}
CHECKSUM = {"card": 0.5, "iban": 0.6}
WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "telefon", "handy"),
}
_LOCAL = r"A-Za-z0-9._%+-"
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(rf"[^{_LOCAL}]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
_MORE = re.compile(r"\x20?[A-Z0-9]")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_PHONE_LOCAL = re.compile(r"(?<![0-9+A-Za-z.])\(?0[0-9]{1,4}\)?(?:[\x20/-][0-9]{2,5}){1,4}(?![0-9A-Za-z])")
SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
    "spans string, n_iban bigint, n_phone_local bigint, max_score double, scores string"
)


def luhn(digits: str) -> bool:
    """Luhn's check over a string of ASCII digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod-97-10 check of an account number without spaces."""
    value = 0
    for c in iban[4:] + iban[:4]:
        value = (value * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return value == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length, with single spaces anywhere, that pass mod-97."""
    for m in _IBAN.finditer(text):
        end, left = m.end(), IBAN_LENGTHS.get(m[1], 0) - 4
        while left > 0 and (more := _MORE.match(text, end)):
            end, left = more.end(), left - 1
        if left == 0 and not _ALNUM.match(text, end) and mod97(text[m.start() : end].replace(" ", "")):
            yield m.start(), end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, looked for around each ``@`` only."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        m = _EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans by kind whose own rules (ranges, digit counts, checksums) hold."""
    if "@" in text:
        for s, e in emails(text):
            yield "email", s, e
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    for s, e in ibans(text):
        yield "iban", s, e
    for m in _PHONE_LOCAL.finditer(text):
        if 7 <= sum(c.isdigit() for c in m[0]) <= 13:
            yield "phone_local", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    """Prior, plus the checksum's weight, plus 0.2 when a context word is near."""
    near = text[max(0, start - CONTEXT) : start].lower() + " " + text[end : end + CONTEXT].lower()
    value = PRIOR[kind] + CHECKSUM.get(kind, 0.0) + (0.2 if any(w in near for w in WORDS[kind]) else 0.0)
    return min(1.0, value)


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, int, float]]:
    """(kind number, start, end, score) of a text, by start, then kind.

    Base spans always stay; an added span stays from ``threshold`` on and only
    where it overlaps no base span.
    """
    text = text or ""
    found = [(KINDS.index(k), s, e, score(text, k, s, e)) for k, s, e in proposals(text)]
    base = sorted((s, e) for k, s, e, _ in found if k < 4)
    kept = []
    for k, s, e, p in found:
        if k < 4 or (p >= threshold and not any(s < y and x < e for x, y in base)):
            kept.append((k, s, e, p))
    return sorted(kept, key=lambda x: (x[1], x[0], x[2]))


def _joined(spans: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in spans)


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: counts of base kinds, digest of base spans, all spans with their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                spans = scan(text.as_py(), threshold)
                base = [x for x in spans if x[0] < 4]
                n = [sum(x[0] == k for x in spans) for k in range(6)]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((doc_id, *n[:4], digest, _joined(spans), n[4], n[5], max((x[3] for x in spans), default=0.0), ",".join(f"{x[3]:.2f}" for x in spans)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.float64(), pa.string()]
            cols = list(zip(*rows)) or [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
