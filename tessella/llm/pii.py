"""Personal data: patterns propose spans, checksums confirm them, and nearby words adjust their score.

Base kinds are emails, IPv4 addresses, payment cards (Luhn) and international phone numbers. The method
adds IBANs (mod 97 over the length of their country) and US social security numbers, which need a word of
their context nearby. Every base span is kept whatever its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import sliced
from tessella.session import bounded_batches

#: Kinds in the order in which spans are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Scores before the context is read, and what a context word nearby adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT_BONUS, CONTEXT_CHARS, LEAST_ADDED = 0.3, 48, 0.5
#: Whole words.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "cards", "visa", "payment", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security", "taxpayer"),
}
_CONTEXT = {k: re.compile(rf"(?<!\w)(?:{'|'.join(words)})(?!\w)", re.I) for k, words in CONTEXT.items()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# possessive, and only at the first digit of a run: the same matches in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The characters of an IBAN by country: the registry's, then those in use without being registered.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items() | {
        25: "AO CV GW MZ", 26: "DZ IR", 27: "CF CG CM GA GQ KM MG TD", 28: "BF BJ CI MA ML NE SN TG",
    }.items()
    for c in countries.split()
}
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_OF = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in {*IBAN_LENGTHS.values()}}
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_HAS_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The checksum of payment card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of IBANs (ISO 7064): letters count from 10, the first four characters come last."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: the same matches as the pattern's, in linear time."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, end)):
            yield start, m.end()
            free = end = m.end()
        at = text.find("@", end)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each country code, as many characters as its IBANs have, single spaces between them not counted."""
    free = 0
    for m in _IBAN.finditer(text):
        if m.start() >= free and (n := IBAN_LENGTHS.get(m[1])) and (whole := _IBAN_OF[n].match(text, m.start())) and mod97(whole[0].replace(" ", "")):
            yield whole.span()
            free = whole.end()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find_pii(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed, then start; code points, ends exclusive."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _HAS_DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        found += [("iban", a, b) for a, b in _ibans(text)]
        if "-" in text:
            for m in _SSN.finditer(text):
                if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                    found.append(("ssn", *m.span()))
    out = []
    for kind, a, b in found:
        near = f"{text[max(0, a - CONTEXT_CHARS) : a]} {text[b : b + CONTEXT_CHARS]}"
        score = min(1.0, SCORES[kind] + CONTEXT_BONUS * bool(_CONTEXT[kind].search(near)))
        if kind in KINDS[:4] or score >= LEAST_ADDED:
            out.append((kind, a, b, score))
    return out


def redact(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first: <EMAIL>."""
    parts, here, end = [], 0, 0
    for kind, a, b, _ in sorted(find_pii(text), key=lambda x: (x[1], -x[2])):
        if a >= end:
            parts += [text[here:a], f"<{kind.upper()}>"]
        end = here = max(end, b)
    return "".join([*parts, text[here:]])


_SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``spans``: kind, place in code points, score.

    Null and empty texts have no spans. Rows that repeat each have a row; a null id is kept. Other columns
    of ``docs`` are not looked at. Whole texts are scanned, in time proportional to their length.
    """
    docs = bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            spans = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find_pii(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN_TYPE)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans {_SPANS}").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text; all rows and columns stay, null stays null."""
    docs = bounded_batches(docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            new = [t and redact(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
