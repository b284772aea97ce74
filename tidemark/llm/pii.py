"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds: email, ip, card (13 to 19 digits, Luhn), phone (9 to 15 digits), iban (mod 97), ssn. A span's
score starts from its kind; a word of the kind's own context within 48 characters raises it, a word
that speaks against it (version, order number, ...) lowers it. The first four kinds are always
reported, with their score; the last two only at MIN_SCORE or more.

Every pattern is bound so that it cannot rescan a long run of characters from each of its places:
a match can only begin where a run begins.

Edge cases: null is the empty text; positions are code points; spans of different kinds may overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import pieces

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
MIN_SCORE = 0.5
REACH = 48

# Scores before context, and the words of the context.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
FOR = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "pay", "cvv"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = {
    "email": ("example",),
    "ip": ("version", "release", "section", "build"),
    "card": ("order", "tracking", "isbn", "serial"),
    "phone": ("order", "version", "isbn"),
    "iban": ("serial", "part"),
    "ssn": ("order", "part", "serial", "isbn"),
}
UP, DOWN = 0.2, 0.3
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
        29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for country in countries.split()
}

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
GROUP = re.compile(r"[A-Z0-9]+")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# A text without any of these has no span.
ANY = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){12}|\+[0-9]|[A-Z]{2}[0-9]{2} ?[A-Z0-9]|[0-9]{3}-[0-9]{2}-[0-9]{4}"
_WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from their @: the part before it reaches back as far as its characters and the last match let it."""
    floor = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            floor = m.end()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Cut at the group end that has the country's length, else at the longest whose checksum holds: words may follow."""
    at = 0
    while m := IBAN.search(text, at):
        begin, at = m.start(), m.start() + 4  # no other begins in the first group
        ends = [begin + g.end() for g in GROUP.finditer(m[0])][::-1]
        sizes = {end: end - begin - text.count(" ", begin, end) for end in ends}
        for end in sorted(ends, key=lambda e: sizes[e] != IBAN_LENGTHS.get(text[begin : begin + 2])):  # noqa: B023
            if sizes[end] >= 15 and mod_97(text[begin:end].replace(" ", "")):
                yield begin, end
                at = end
                break


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose checks hold, by kind and start."""
    for span in emails(text):
        yield "email", *span
    for m in IP.finditer(text):
        parts = [part.lstrip("0") for part in m[0].split(".")]
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in parts):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()
    for span in ibans(text):
        yield "iban", *span
    for m in SSN.finditer(text):
        yield "ssn", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - REACH) : start]} {text[end : end + REACH]}".lower()
    words = set(_WORD.findall(near))
    value = START[kind] + UP * any(w in words for w in FOR[kind]) - DOWN * any(w in words for w in AGAINST[kind])
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str) -> list[Found]:
    """All spans of one text, by kind and start."""
    found = [Found(kind, start, end, score(text, kind, start, end)) for kind, start, end in proposals(text)]
    return [f for f in found if f.kind in BASE or f.score >= MIN_SCORE]


COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, n_ssn long, scored string"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, counts, digest of the base spans, all spans, and spans with scores."""
    empty = hashlib.sha256(b"").hexdigest()
    nothing = (0, 0, 0, 0, empty, "", 0, 0, "")

    def row(text: str) -> tuple:
        found = find(text)
        if not found:
            return nothing
        spans = [f"{f.kind}:{f.start}:{f.end}" for f in found]
        base = ",".join(s for f, s in zip(found, spans, strict=True) if f.kind in BASE)
        counts = [sum(f.kind == kind for f in found) for kind in KINDS]
        scored = ",".join(f"{s}:{f.score:.2f}" for f, s in zip(found, spans, strict=True))
        return (*counts[:4], hashlib.sha256(base.encode()).hexdigest(), ",".join(spans), *counts[4:], scored)

    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = pc.fill_null(piece.column("text"), "")
            hits = pc.match_substring_regex(texts, ANY).to_pylist()
            rows = [row(text.as_py()) if hit else nothing for text, hit in zip(texts, hits, strict=True)]
            columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {COLUMNS}")
