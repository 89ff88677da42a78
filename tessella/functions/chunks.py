"""Chunking as column expressions: sections folded greedily to a limit of tokens, long ones cut where tokens start, places in
the text, and the vote on the family of a document's headings. No Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import TOKEN, probable_heading, tok_count

_INK = r"[^\s 　]"
_NO_TOKEN = r"[^A-Za-z0-9_一-鿿]"
_WHITE = " \t\n\x0b\f\r\u00a0\u3000"


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(text, F.lit(_WHITE))


def sections(text: Column, delimiter: str) -> Column:
    """What is between delimiters, other than blanks: delimiters in backticks are whole strings, others single characters."""
    marked = sorted(re.findall(r"`([^`]+)`", delimiter), key=len, reverse=True)
    each = marked or list(delimiter or "\n")
    parts = F.split(F.coalesce(text, F.lit("")), "|".join(rf"\Q{d}\E" for d in each), -1)
    return F.filter(parts, lambda s: s.rlike(_INK))


def _units(text: Column) -> Column:
    """Each token with what follows it up to the next; what comes before the first is not among them."""
    return F.regexp_extract_all(text, F.lit(f"(?:{TOKEN}){_NO_TOKEN}*"), F.lit(0))


def _before_tokens(text: Column) -> Column:
    return F.regexp_extract(text, f"^{_NO_TOKEN}*", 0)


def cut_at_tokens(text: Column, limit: int, hard: int = 0) -> Column:
    """Pieces of ``limit`` tokens, cut where a token starts. A tail that fits under ``hard`` with the piece before it stays there."""

    def pieces(units: Column) -> Column:
        n = F.size(units)
        full = F.ceil(n / limit).cast("int")
        tail_fits = (full > 1) & (n - limit * (full - 2) <= hard)
        count = F.when(tail_fits, full - 1).otherwise(full)
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.concat(
                F.when(i == 0, _before_tokens(text)).otherwise(""),
                F.array_join(F.slice(units, i * limit + 1, F.when(i == count - 1, n).otherwise(F.lit(limit))), ""),
            ),
        )

    whole = F.filter(F.array(text), lambda t: t.rlike(_INK))
    if limit <= 0:
        return whole
    many = F.regexp_count(text, F.lit(TOKEN)) > max(limit, hard)
    # the units are bound once, as the one element of an array
    return F.when(many, F.flatten(F.transform(F.array(_units(text)), pieces))).otherwise(whole)


def merged(parts: Column, limit: int, overlap_percent: int = 0) -> Column:
    """Sections put together, a line feed between: a chunk ends once it has more tokens than the limit less the overlap, and the
    next begins with that percentage of its end, whose tokens are not counted."""
    kept = 100 - overlap_percent
    state = F.struct(F.expr("cast(array() as array<int>)").alias("starts"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("i"))

    def step(a: Column, n: Column) -> Column:
        new = (F.size(a["starts"]) == 0) | (a["n"] * 100 > limit * kept)
        return F.struct(
            F.when(new, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"]).alias("starts"),
            F.when(new, n).otherwise(a["n"] + n).alias("n"),
            (a["i"] + 1).alias("i"),
        )

    starts = F.aggregate(F.transform(parts, tok_count), state, step, lambda a: a["starts"])
    bodies = F.flatten(
        F.transform(
            F.array(starts),
            lambda at: F.transform(at, lambda s, k: F.array_join(F.slice(parts, s + 1, F.coalesce(F.get(at, k + 1), F.size(parts)) - s), "\n")),
        )
    )
    if not overlap_percent:
        return bodies

    def overlapping(done: Column, body: Column) -> Column:
        last = F.element_at(done, -1)
        end = F.substring(last, (F.length(last) * kept / 100).cast("int") + 1, F.length(last))
        return F.concat(done, F.array(F.when(F.size(done) == 0, body).otherwise(F.concat(F.when(F.size(done) > 0, end), body))))

    return F.aggregate(bodies, F.expr("cast(array() as array<string>)"), overlapping)


def general(text: Column, limit: int, overlap_percent: int, delimiter: str, hard: float) -> Column:
    """Sections between delimiters, merged; what is above the hard limit is cut."""
    most = int(limit * hard)
    chunks = F.flatten(F.transform(F.array(sections(text, delimiter)), lambda parts: merged(parts, limit, overlap_percent)))
    return F.flatten(F.transform(chunks, lambda c: F.when(tok_count(c) > most, cut_at_tokens(c, limit, most)).otherwise(F.array(c))))


def separated(text: Column, limit: int, overlap_percent: int, delimiter: str) -> Column:
    """Strictly what is between delimiters; only a part above the limit is sliced, with an overlap in tokens."""
    step = max(1, limit - limit * overlap_percent // 100)

    def slices(part: Column) -> Column:
        def cut(units: Column) -> Column:
            last = F.ceil((F.size(units) - limit) / step).cast("int")
            return F.transform(
                F.sequence(F.lit(0), last),
                lambda i: strip(F.concat(F.when(i == 0, _before_tokens(part)).otherwise(""), F.array_join(F.slice(units, i * step + 1, F.lit(limit)), ""))),
            )

        # no text has more tokens than characters
        few = (F.length(part) <= limit) | (F.regexp_count(part, F.lit(TOKEN)) <= limit)
        return F.when(few, F.array(part)).otherwise(F.flatten(F.transform(F.array(_units(part)), cut)))

    return F.flatten(F.transform(F.transform(sections(text, delimiter), strip), slices))


def placed(text: Column, chunks: Column) -> Column:
    """(content, start, end) of each chunk: where it stands verbatim, searched forward from the one before; null where it does not."""
    # ``rest`` is the text from ``here`` on, so that a search never walks over what is behind it
    state = F.struct(
        F.expr("cast(array() as array<bigint>)").alias("starts"), F.lit(0).cast("long").alias("here"), F.coalesce(text, F.lit("")).alias("rest")
    )

    def step(a: Column, c: Column) -> Column:
        def moved(at: Column) -> Column:
            return F.struct(
                F.concat(a["starts"], F.array(F.when(at > 0, a["here"] + at - 1))).alias("starts"),
                (a["here"] + F.greatest(at - 1, F.lit(0))).alias("here"),
                F.when(at > 1, F.call_function("substring", a["rest"], at)).otherwise(a["rest"]).alias("rest"),
            )

        # the place is bound once, as the one element of an array
        return F.get(F.transform(F.array(F.call_function("locate", c, a["rest"])), moved), 0)

    def rows(found: Column) -> Column:
        starts = F.aggregate(found["c"], state, step, lambda a: a["starts"])
        pairs = F.arrays_zip(found["c"].alias("content"), starts.alias("start"))
        return F.transform(pairs, lambda x: F.struct(x["content"], x["start"], (x["start"] + F.length(x["content"])).alias("end")))

    return F.flatten(F.transform(F.array(F.struct(chunks.alias("c"))), rows))


#: Weights of a heading in the vote: by the number of its marks in markdown, else 1; less if a mark of a list stands within the
#: line, and if the line is no probable heading.
MARKDOWN_WEIGHTS = {1: 4.0, 2: 4.0, 3: 3.0, 4: 3.0, 5: 2.0, 6: 2.0}
WITHIN_LINE, UNLIKELY = 0.1, 0.2


def heading_vote(text: Column, families: list[list[str]], markdown: int, never: str, mark: str) -> Column:
    """The place of the family of patterns whose headings weigh most in a text, the first of equal ones; null if no line fits.
    Lines that begin like ``never`` have no vote. The markdown family gets the lines that begin with its marks, and only these."""

    def weight(family: int, patterns: list[str]):
        fits = "|".join(f"(?:{p.lstrip('^')})" for p in patterns)

        def of(line: Column) -> Column:
            if family == markdown:
                marks = F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))
                value = F.lit(0.0)
                for n, w in MARKDOWN_WEIGHTS.items():
                    value = F.when(marks == n, w).otherwise(value)
                return F.when(marks > 0, value).otherwise(F.when(line.rlike(f"^(?:{fits})"), 1.0).otherwise(0.0))
            within = F.when(line.rlike(rf"^[^\n]*[^#\n](?:{mark})") & ~line.rlike(f"^(?:{mark})"), WITHIN_LINE).otherwise(1.0)
            return F.when(line.rlike(f"^(?:{fits})"), within * F.when(probable_heading(line), 1.0).otherwise(UNLIKELY)).otherwise(0.0)

        return of

    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda s: (F.length(s) > 0) & ~s.rlike(f"^(?:{never})"))

    def vote(own: Column) -> Column:
        return F.array(*(F.aggregate(F.transform(own, weight(i, p)), F.lit(0.0), lambda s, w: s + w) for i, p in enumerate(families)))

    totals = F.element_at(F.transform(F.array(lines), vote), 1)
    best = F.element_at(F.transform(F.array(totals), lambda t: F.when(F.array_max(t) > 0, F.array_position(t, F.array_max(t)).cast("int") - 1)), 1)
    return best
