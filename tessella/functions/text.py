"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of ASCII word characters or one CJK ideograph.
TOKEN = r"[A-Za-z0-9_]+|[\u4e00-\u9fff]"
WHITE = r"[\s\u00a0\u3000]+"


def tokens(text: Column) -> Column:
    """The lower-cased tokens of a text; none for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def tok_count(text: Column) -> Column:
    """Tokens of a text: at least 1 if anything but white space is in it, else 0."""
    text = F.coalesce(text, F.lit(""))
    blank = ~text.rlike(r"[^\s\u00a0\u3000]")
    return F.when(blank, 0).otherwise(F.greatest(F.lit(1), F.regexp_count(text, F.lit(TOKEN)))).cast("long")


def collapse(text: Column) -> Column:
    """White space at the ends removed, and each other run of it one space."""
    return F.regexp_replace(F.regexp_replace(text, WHITE, " "), "^ | $", "")


def entity_name(text: Column) -> Column:
    """The normal form under which entities are one: collapsed and lower-cased."""
    return F.lower(collapse(text))


def short_hash(*parts: Column, length: int = 32) -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def like_escape(term: str) -> str:
    """A LIKE pattern that finds ``term`` itself anywhere; the escape character is a backslash."""
    for c in "\\%_":
        term = term.replace(c, "\\" + c)
    return f"%{term}%"


def snippet(text: Column, term: str, around: int = 72, most: int = 180) -> Column:
    """What stands around the first place of ``term`` (any case), with ... where it was cut."""
    s = collapse(text)
    at = F.instr(F.lower(s), term.lower())
    a = F.greatest(F.lit(0), at - 1 - around)
    b = F.least(F.length(s), at - 1 + len(term) + around)
    cut = F.concat(F.when(a > 0, "...").otherwise(""), F.substring(s, a + 1, b - a), F.when(b < F.length(s), "...").otherwise(""))
    return F.substring(F.when(at == 0, s).otherwise(cut), 1, most)


def heading_level(text: Column) -> Column:
    """1 to 6 from a leading number like 1.2.3; 0 without one."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)", 1)
    return F.when(number == "", 0).otherwise(F.least(F.lit(6), F.size(F.split(number, r"\.")))).cast("int")


def probable_heading(line: Column) -> Column:
    """A short line of its own, without the end or the inner marks of a sentence."""
    s = collapse(line)
    return (F.length(s) > 0) & (F.length(s) <= 60) & ~s.rlike(r"[.!?;,:。！？；，：]$") & ~s.rlike(r"[。！？]|[.!?] ")


def lines(text: Column) -> Column:
    """The lines of a text, whatever ends them."""
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def utf8_cut(text: Column, most: int, marker: str = "...") -> Column:
    """The longest prefix within ``most`` bytes of UTF-8, with a marker if it was cut; of a character cut
    in two nothing stays."""
    raw = F.encode(text, "UTF-8")
    kept = F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, max(0, most - j)).cast("string")) for j in range(4)))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(kept, F.lit(marker)))
