"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "shortcard", "ssn", "secret")
CONTEXT = {
    "card": ("card", "credit", "visa", "mastercard", "karte", "carte", "tarjeta"),
    "shortcard": ("card", "credit", "amex", "karte", "carte", "tarjeta"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "teléfono", "téléphone"),
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "secret": ("token", "secret", "password", "key", "auth", "bearer"),
}
#: Lengths of the IBAN registry by country.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 "
    "ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 "
    "PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 "
    "YE30 "
).split()}
#: Secrets that their form alone tells, and assignments to a name that says secret.
SECRET_FORMS = (
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])xox[abprs]-[0-9A-Za-z-]{10,200}",
    r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[0-9A-Za-z]{16,100}",
    r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])",
    r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{5,4000}\.eyJ[A-Za-z0-9_-]{5,4000}\.[A-Za-z0-9_-]{5,4000}",
    r"-----BEGIN (?:[A-Z]{2,20} ){0,2}PRIVATE KEY-----",
)
SECRET_NAMES = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)"
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

# Possessive, so that a long run of one character is read once.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGIT = re.compile("[0-9]")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ A-Z0-9])")
FORMED = re.compile("|".join(SECRET_FORMS))
FORM_HINT = re.compile(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|[sr]k_(?:live|test)_|AIza|eyJ|PRIVATE KEY")
NAMED = re.compile(SECRET_NAMES + r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?(?P<value>[A-Za-z0-9+/_.=~-]{8,200})", re.IGNORECASE)
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once: what may stand before it reaches back to the last match or the last @."""
    at, free = text.find("@"), 0
    while at >= 0:
        run = text[free:at]
        start = free + len(run.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", free)


def entropy(value: str) -> float:
    """Bits a character, by the shares of the characters in ``value``."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def secrets(text: str) -> Iterator[tuple[int, int, float]]:
    """Values of secrets: known forms, and what a telling name is set to, where it has a digit and is as mixed as no word is (so a password of letters alone is no finding)."""
    formed = [m.span() for m in FORMED.finditer(text)] if FORM_HINT.search(text) else []
    yield from ((*span, 0.8) for span in formed)
    for m in NAMED.finditer(text) if ":" in text or "=" in text else ():
        value, span = m["value"], m.span("value")
        mixed = DIGIT.search(value) and entropy(value) >= 2.8
        if mixed and not any(a < span[1] and span[0] < b for a, b in formed):
            yield *span, 0.5


def iban_end(text: str, start: int) -> int:
    """Where an IBAN that begins at ``start`` ends, with single spaces allowed in it; 0 if there is none."""
    length = IBAN_LENGTHS.get(text[start : start + 2], 0)
    at, compact = start, ""
    while len(compact) < length and at < len(text):
        c = text[at]
        if "0" <= c <= "9" or "A" <= c <= "Z":
            compact += c
        elif c != " " or text[at - 1] == " ":
            return 0
        at += 1
    whole = length and len(compact) == length and not (at < len(text) and text[at].isalnum())
    return at if whole and mod97(compact) else 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _near(kind: str, text: str, start: int, end: int, reach: int) -> bool:
    around = f"{text[max(0, start - reach) : start]} {text[end : end + reach]}".lower()
    return any(w in around for w in CONTEXT[kind])


def _proposed(text: str) -> Iterator[tuple[str, int, int, float]]:
    """What patterns propose and checksums confirm, with a base score."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end, 0.6
    for start, end, base in secrets(text):
        yield "secret", start, end, base
    if not DIGIT.search(text):  # all other kinds have one
        return
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", *m.span(), 0.5
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card" if len(d) >= 16 else "shortcard", *m.span(), 0.6 if len(d) >= 16 else 0.2
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span(), 0.5
    for m in IBAN_START.finditer(text):
        if end := iban_end(text, m.start()):
            yield "iban", m.start(), end, 0.8
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span(), 0.2


def find(text: str, reach: int = 40, least: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of each span, in code points, by kind as listed, then start.

    A context word within ``reach`` characters adds 0.4 to the base score. The base kinds stay whatever they score; the
    others need ``least``: an IBAN has it by its checksum, a secret by its form or by a telling name and its entropy; an
    SSN and a 13- to 15-digit card need a context word.
    """
    out = []
    for kind, start, end, base in _proposed(text):
        score = min(1.0, base + 0.4 * _near(kind, text, start, end, reach))
        if kind in BASE_KINDS or score >= least:
            out.append((kind, start, end, round(score, 2)))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def _find_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        names = ("kind", "start", "end", "score")
        spans = [[dict(zip(names, s, strict=True)) for s in find(text or "")] for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row: spans are (kind, start, end, score), code points, end exclusive.

    A null or empty text has no spans; null and repeated ids pass through; an empty table gives an empty result; other
    columns are ignored. Every pattern reads a text once, however long.
    """
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_find_all, schema)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with each span replaced by its kind in angle brackets; of overlapping spans the first stands.

    A null text stays null; null and repeated ids pass through row by row; other columns are left out; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                parts, at = [], 0
                for kind, start, end, _ in sorted(find(text or ""), key=lambda s: (s[1], -s[2])):
                    if start >= at:
                        parts += [text[at:start], f"<{kind}>"]
                        at = end
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text string")
