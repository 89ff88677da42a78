"""Secret scans with structural confirmation.

Three simple patterns propose base spans. Beyond them, candidates of base64 (plain, URL-safe or wrapped)
or hexadecimal text are decoded, and reported only if what they hold has the structure of a private key: DER
with nested lengths that add up and the fields of PKCS#1, PKCS#8, SEC1 or DSA, an openssh-key-v1 file, an
OpenPGP secret key packet, an armoured key whose body is one of these, or a signed token whose header is JSON
that names an algorithm. Public keys and certificates are no secrets.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import sliced
from tessella.session import bounded_batches

#: Kinds in the order in which spans with the same start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "private_key", "encoded_key", "hex_key")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Where long encoded text can be: hexadecimal runs, base64 and signed tokens all lie in such a run.
_LONG = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{32,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}")
_URL_BASE64 = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}+={0,2}")
#: Base64 in lines of 64 or 76 characters.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/=])(?:(?:[A-Za-z0-9+/]{64}\r?\n)++|(?:[A-Za-z0-9+/]{76}\r?\n)++)(?:[A-Za-z0-9+/]{1,76}+={0,2})?")
_BEGIN, _LABEL = "-----BEGIN ", re.compile(r"((?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?)-----")
_BODY = re.compile(r"[A-Za-z0-9+/=\s:,.()_-]*+")
_DEK = re.compile(r"DEK-Info: *[A-Z0-9-]+,([0-9A-F]+)\s*$", re.M)

#: ASN.1 tags whose content is itself DER: SEQUENCE, SET and the context tags 0 to 3.
_NESTING_TAGS = {0x30, 0x31, 0xA0, 0xA1, 0xA2, 0xA3}
#: Object identifiers of password-based encryption (PKCS#5, PKCS#12), as DER begins them.
_ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))
_OPENSSH_MAGIC = b"openssh-key-v1\0"


def der_fields(data: bytes, at: int, end: int, depth: int = 0) -> int | None:
    """The number of DER fields that fill ``data[at:end]`` exactly, nested ones included; else None."""
    fields = 0
    while at < end:
        if end - at < 2 or depth > 12:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 0x80 or size >> (8 * (n - 1)) == 0:
                return None  # DER writes lengths in the shortest way
        if at + size > end:
            return None
        if tag in _NESTING_TAGS:
            inner = der_fields(data, at, at + size, depth + 1)
            if inner is None:
                return None
            fields += inner
        elif tag == 0 or (tag == 2 and not size):
            return None
        at += size
        fields += 1
    return fields


def ssh_fields(data: bytes) -> int | None:
    """The number of length-prefixed fields that fill ``data`` exactly; else None."""
    at = fields = 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        fields += 1
        if at > len(data):
            return None
    return fields


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """(tag, begin, end of the content) of the fields side by side in valid DER."""
    out = []
    while at < end:
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        out.append((tag, at, at + size))
        at += size
    return out


def _is_der_key(data: bytes) -> bool:
    if not der_fields(data, 0, len(data)):
        return False
    outer = _children(data, 0, len(data))
    if len(outer) != 1 or outer[0][0] != 0x30:
        return False
    fields = _children(data, *outer[0][1:])
    tags = [t for t, _, _ in fields]
    if tags[:2] == [0x30, 0x04] and len(tags) == 2:  # encrypted PKCS#8
        inner = _children(data, *fields[0][1:])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(_ENCRYPTIONS)
    if not tags or tags[0] != 0x02 or data[fields[0][1] : fields[0][2]] not in (b"\0", b"\1"):
        return False
    if set(tags) == {0x02} and len(tags) in (6, 9):  # DSA, and RSA by PKCS#1
        return True
    if tags[1:2] == [0x04]:  # SEC1, which names its curve or its public point
        return data[fields[0][1]] == 1 and len(tags) >= 3 and set(tags[2:]) <= {0xA0, 0xA1}
    if tags[1:3] == [0x30, 0x04]:  # PKCS#8
        inner = _children(data, *fields[1][1:])
        return bool(inner) and inner[0][0] == 0x06
    return False


def is_key(data: bytes) -> bool:
    """Whether these bytes are a private key in DER, in openssh-key-v1, or an OpenPGP packet of a secret key."""
    if data[:1] == b"\x30":
        return _is_der_key(data)
    if data.startswith(_OPENSSH_MAGIC):
        rest = data[len(_OPENSSH_MAGIC) :]
        for _ in range(3):  # cipher, key derivation and its options
            size = int.from_bytes(rest[:4], "big")
            if len(rest) < 4 + size:
                return False
            rest = rest[4 + size :]
        return len(rest) > 8 and 1 <= int.from_bytes(rest[:4], "big") <= 16 and ssh_fields(rest[4:]) is not None
    return False


def is_pgp_key(data: bytes) -> bool:
    """Whether these bytes begin with an OpenPGP secret key packet that is wholly there."""
    if len(data) < 8 or not data[0] & 0x80:
        return False
    if data[0] & 0x40:
        tag, first = data[0] & 0x3F, data[1]
        if first < 192:
            size, head = first, 2
        elif first < 224:
            size, head = ((first - 192) << 8) + data[2] + 192, 3
        else:
            size, head = int.from_bytes(data[2:6], "big"), 6
    else:
        tag, n = (data[0] >> 2) & 0x0F, 1 << (data[0] & 3)
        if n > 4:
            return False
        size, head = int.from_bytes(data[1 : 1 + n], "big"), 1 + n
    return tag == 5 and 0 < size <= len(data) - head and data[head] in (3, 4, 5, 6)


def _armoured(text: str) -> Iterator[tuple[int, int]]:
    """From each BEGIN to the END of the same label, if it comes before the next BEGIN. Line ends may be written as
    backslash and letter, as in JSON."""
    at = text.find(_BEGIN)
    while at >= 0:
        after = text.find(_BEGIN, at + 1)
        if m := _LABEL.match(text, at + len(_BEGIN)):
            end = text.find(f"-----END {m[1]}-----", m.end(), after if after >= 0 else len(text))
            if end >= 0:
                body = text[m.end() : end].replace("\\r", "").replace("\\n", "\n")
                if _BODY.fullmatch(body) and _is_body(body, m[1]):
                    yield at, end + len(m[1]) + 14
        at = after


def _is_body(body: str, label: str) -> bool:
    pgp = label.endswith("BLOCK")
    lines = [line.strip() for line in body.split("\n")]
    data = from_base64("".join("".join(line.split()) for line in lines if ":" not in line and not (pgp and line.startswith("="))))
    if not data:
        return False
    if pgp:
        return is_pgp_key(data)
    if is_key(data):
        return True
    # a traditional encrypted key: whole blocks of ciphertext, and the start vector that its header tells
    dek = _DEK.search(body)
    return "ENCRYPTED" in body and dek is not None and len(dek[1]) in (16, 32) and len(data) % (len(dek[1]) // 2) == 0


def from_base64(text: str) -> bytes | None:
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if "-" in body or "_" in body else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """A JSON header that names its algorithm, a JSON payload or a binary one, and a signature of whole bytes."""
    try:
        head = json.loads(from_base64(header) or b"")
    except (ValueError, RecursionError):
        return False
    signed = from_base64(signature)
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and bool(from_base64(payload)) and signed is not None and (len(signed) > 0 or head["alg"].lower() == "none")


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each secret, by start, then kind as listed; code points, ends exclusive."""
    found = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for run in _LONG.finditer(text):
        a, b = run.span()
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text, a, b)]
        found += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text, a, b) if is_signed_token(*m.groups())]
        for m in _ANY_HEX.finditer(text, a, b):
            if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
                found.append((m.start(), m.end(), "hex_key"))
        for m in (*_BASE64.finditer(text, a, b), *_URL_BASE64.finditer(text, a, b)):
            if (data := from_base64(m[0])) and is_key(data):
                found.append((m.start(), m.end(), "encoded_key"))
    if _BEGIN in text:
        found += [(a, b, "private_key") for a, b in _armoured(text)]
    if "\n" in text:
        inside = [(a, b) for a, b, k in found if k == "private_key"]
        for m in _WRAPPED.finditer(text):
            if (data := from_base64("".join(m[0].split()))) and is_key(data) and not any(a <= m.start() < b for a, b in inside):
                found.append((m.start(), m.start() + len(m[0].rstrip()), "encoded_key"))
    found = [*dict.fromkeys(found)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``spans``, each a kind with its place in code points.

    Null and empty texts have no spans. Rows that repeat each have a row; a null id is kept. Other columns
    of ``docs`` are not looked at. Whole texts are scanned, in time proportional to their length.
    """
    docs = bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in find_secrets(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN_TYPE)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans {_SPANS}").withColumnRenamed("id", id_col)
