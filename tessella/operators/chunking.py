"""Chunking of documents: one row in, its chunks out.

The general and the separator preset are column expressions (``tessella.functions.chunks``). The presets that follow headings,
questions or meaning are small functions from a text to a list of chunks; ``chunked`` runs them over Arrow batches. Documents are
spread over tasks and no state passes between rows. Tokens are runs of ASCII word characters or single CJK ideographs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.chunks import general, heading_vote, placed, separated
from tessella.functions.text import tok_count

_TOKEN = re.compile(r"[A-Za-z0-9_]+|[一-鿿]")
_SENTENCE = re.compile(r"(?<=[。！？!?])[”’」』）)\"']*|(?<=[.])\s+(?=[A-ZÀ-Þ])|\n+")
_ABBREVIATION = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|St|vs|etc|e\.g|i\.e|No|Fig|[A-Z])\.$")


@dataclass(frozen=True)
class ChunkParams:
    """Limits in tokens. ``hard`` is the share of the limit that a chunk may reach before it is cut."""

    limit: int = 512
    overlap_percent: int = 0
    delimiter: str = "\n"
    hard: float = 1.5


def count_tokens(text: str) -> int:
    """At least 1 for a text that is not blank."""
    n = len(_TOKEN.findall(text))
    return n if n or not text.strip() else 1


def cut_at_tokens(text: str, limit: int, hard: int | None = None) -> list[str]:
    """Pieces of ``limit`` tokens, cut where a token starts; a tail that fits under ``hard`` stays with the last piece."""
    starts = [m.start() for m in _TOKEN.finditer(text)]
    if limit <= 0 or len(starts) <= max(limit, hard or 0):
        return [text] if text.strip() else []
    at = [0, *starts[limit::limit], len(text)]
    pieces = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
    if hard and len(pieces) > 1 and count_tokens(pieces[-2]) + count_tokens(pieces[-1]) <= hard:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    return [p for p in pieces if p.strip()]


def merge_sections(sections: list[str], limit: int, overlap_percent: int = 0) -> list[str]:
    """Sections put together: a new chunk begins once the one before has more than the limit less the overlap, and
    with that percentage of the end of the chunk before. The overlap's tokens are not counted."""
    chunks, counts = [], []
    for section in sections:
        if not section.strip():
            continue
        n = count_tokens(section)
        if not chunks or counts[-1] > limit * (100 - overlap_percent) / 100:
            kept = ""
            if chunks and overlap_percent:
                kept = chunks[-1][int(len(chunks[-1]) * (100 - overlap_percent) / 100) :]
            chunks.append(kept + section)
            counts.append(n)
        else:
            chunks[-1] += "\n" + section
            counts[-1] += n
    return chunks


# Families of headings, each from the highest level down; the first of equally heavy families wins.
HEADINGS = [
    [
        r"第[零一二三四五六七八九十百0-9]+(分?编|部分)",
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"第[零一二三四五六七八九十百0-9]+条",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
    ],
    [
        r"第[0-9]+章",
        r"第[0-9]+节",
        r"[0-9]{0,2}[\. 、]",
        r"[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]",
        r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}",
        r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}",
    ],
    [
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"[零一二三四五六七八九十百]+[ 、]",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
        r"[\(（][0-9]{0,2}[\)）]",
    ],
    [
        r"PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)",
        r"Chapter (I+V?|VI*|XI|IX|X)",
        r"Section [0-9]+",
        r"Article [0-9]+",
    ],
    [
        r"^#[^#]",
        r"^##[^#]",
        r"^###.*",
        r"^####.*",
        r"^#####.*",
        r"^######.*",
    ],
]
#: The place of the markdown family, and that of decimal numbers.
MARKDOWN, DECIMAL = 4, 1
_COMPILED = [[re.compile(x) for x in family] for family in HEADINGS]
# How lines begin that are no headings, and marks of lists; both for Python and Java.
NO_HEADING = r"0|[0-9]+ +[0-9~个只-]|[0-9]+\.{2,}"
LIST_MARK = r"[一二三四五六七八九十百]+、|[\(（][一二三四五六七八九十百]+[\)）]|[0-9]{1,2}[\.、]"
_NO_HEADING = re.compile(NO_HEADING)
# Titles of a table of contents, without spaces.
_CONTENTS = re.compile(r"#*(?:contents|目录|目次|tableofcontents|致谢|acknowledge)", re.I)


def heading_family(text: Column) -> Column:
    """The place in HEADINGS of the family that most headings of a text weigh for."""
    return heading_vote(text, HEADINGS, MARKDOWN, NO_HEADING, LIST_MARK)


def heading_depth(line: str, family: int | None) -> int | None:
    """The level of a heading, from 0; None for other lines."""
    line = line.strip()
    if family is None or _NO_HEADING.match(line):
        return None
    return next((level for level, pattern in enumerate(_COMPILED[family]) if pattern.match(line)), None)


def titled_sections(lines: list[str], family: int | None, depth: int = 5) -> list[tuple[list[str], str]]:
    """(titles above, text) in order: each run of lines under the headings that are open there."""
    open_, body, out = [], [], []

    def close() -> None:
        if any(x.strip() for x in body):
            out.append(([t for _, t in open_], "\n".join(body)))
        body.clear()

    for line in lines:
        level = heading_depth(line, family)
        if level is None or level >= depth:
            body.append(line)
            continue
        if not body and open_ and open_[-1][0] >= level:
            out.append(([t for _, t in open_[:-1]], open_[-1][1]))  # a heading without text of its own
        close()
        while open_ and open_[-1][0] >= level:
            open_.pop()
        open_.append((level, line.strip().lstrip("# ")))
    close()
    return out


def _lead(line: str, english: bool) -> str:
    """What an entry of a table of contents has in common with its heading: three characters, in English two words."""
    return " ".join(line.split()[:2]) if english else line.strip()[:3]


def without_contents(lines: list[str], english: bool = False, ahead: int = 128) -> list[str]:
    """Without tables of contents: the title and the first entry go, and with them what stands before the line, at most
    ``ahead`` further, that begins like this entry."""
    kept, i = [], 0
    while i < len(lines):
        if not _CONTENTS.fullmatch(re.sub(r"[ \u3000]+", "", lines[i].strip())):
            kept.append(lines[i])
            i += 1
            continue
        entry = next((j for j in range(i + 1, len(lines)) if lines[j].strip()), None)
        if entry is None:
            break
        begin = _lead(lines[entry], english)
        i = next((j for j in range(entry + 1, min(entry + 1 + ahead, len(lines))) if lines[j].strip().startswith(begin)), entry + 1)
    return kept


def _english(lines: list[str]) -> bool:
    """Over four fifths of the lines that are not blank are ASCII."""
    inked = [x for x in lines if x.strip()]
    return sum(x.isascii() for x in inked) > 0.8 * len(inked)


def book(text: str, p: ChunkParams, family: int | None) -> list[str]:
    """Sections under their titles, merged within a title up to the limit."""
    lines = text.split("\n")
    lines = without_contents(lines, _english(lines))
    if family is None:
        return [x for c in merge_sections(lines, p.limit) for x in cut_at_tokens(c, p.limit)]
    out = []
    for titles, body in titled_sections(lines, family):
        head = " ".join(titles)
        room = max(1, p.limit - count_tokens(head)) if head else p.limit
        out += [f"{head}\n{c}" if head else c for m in merge_sections(body.split("\n"), room) for c in cut_at_tokens(m, room)]
    return out


def laws(text: str, p: ChunkParams, family: int | None) -> list[str]:
    """An article is a chunk under the titles of its first three levels; an overlong one is cut."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    out = []
    for titles, body in titled_sections(lines, family, depth=3 if family != DECIMAL else 2):
        head = " ".join(titles)
        room = max(1, p.limit - count_tokens(head)) if head else p.limit
        articles, now = [], []
        for line in body.split("\n"):
            if heading_depth(line, family) is not None and now:
                articles.append("\n".join(now))
                now = []
            now.append(line)
        articles.append("\n".join(now))
        out += [f"{head}\n{c}" if head else c for a in articles for c in cut_at_tokens(a, room)]
    return out


def sentences(text: str) -> list[str]:
    """Sentences with their closing marks; a period after an abbreviation ends none."""
    parts, start = [], 0
    for m in _SENTENCE.finditer(text):
        if m.end() == start or (m.group().strip() == "" and "\n" not in m.group() and _ABBREVIATION.search(text[start : m.start()])):
            continue
        parts.append(text[start : m.end()])
        start = m.end()
    return [s for s in (x.strip() for x in [*parts, text[start:]]) if s]


#: Clusters whose distances from each other are kept in a table, of 8 MB at most.
KEPT = 1024


def chained_linkage(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Labels of agglomerative clustering by average cosine distance, merged until so many are left, in memory that grows with
    the vectors only (distances are kept once no more than KEPT clusters are left): the average distance of two clusters is that of their sums of unit vectors over their sizes. Mutual
    nearest neighbours at the end of a chain merge (of equal distances the one that the chain came from, then the first), which
    gives the tree of the plain algorithm, cut at its height. Where at least half of the vectors repeat the direction of another,
    those of one direction merge at height 0 when a chain comes to the first of them, as they would one by one."""
    n = len(vectors)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    long = unit.any(axis=1)
    twins: dict[object, list[int]] = {}
    for i, (row, has) in enumerate(zip(np.round(unit, 12) + 0.0, long.tolist(), strict=True)):
        twins.setdefault(row.tobytes() if has else i, []).append(i)
    waiting: dict[int, list[int]] = {}
    member, size = np.arange(n), np.ones(n)  # a sentence of the cluster in each row, and its sentences
    if 2 * sum(isinstance(x, bytes) for x in twins) <= int(long.sum()):
        waiting = {of[0]: of[1:] for of in twins.values()}
        member, size = np.array(list(waiting), int), np.array([len(of) for of in twins.values()], float)
    alive = np.ones(len(member), bool)
    # rows with a length, their sums, and where each row's sum is; a row without one is at distance 1 from all
    rows = np.flatnonzero(long[member])
    total = unit[member[rows]] * size[rows, None]
    place = np.full(len(member), -1)
    place[rows] = np.arange(len(rows))
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []

    def push(x: int) -> None:
        chain.append(x)
        first = int(member[x])
        merges.extend((0.0, first, i) for i in waiting.pop(first, ()))

    def from_row(x: int) -> np.ndarray:
        distance = np.ones(len(alive))
        if place[x] >= 0:
            distance[rows] = 1 - (total @ total[place[x]]) / (size[rows] * size[x])
        distance[~alive] = np.inf
        distance[x] = np.inf
        return distance

    left, kept = len(member), None
    while left > 1:
        if 2 * left <= len(alive) and not chain:
            kept = None if kept is None else kept[np.ix_(alive, alive)]
            here = alive[rows]
            total, rows = total[here], (np.cumsum(alive) - 1)[rows[here]]
            size, member, alive = size[alive], member[alive], np.ones(left, bool)
            place = np.full(left, -1)
            place[rows] = np.arange(len(rows))
        if kept is None and len(alive) <= KEPT:
            kept = np.ones((left, left))
            kept[np.ix_(rows, rows)] = 1 - np.matmul(total[None], total[:, :, None])[..., 0] / (size[rows, None] * size[rows])
            np.fill_diagonal(kept, np.inf)
        if not chain:
            push(int(np.argmax(alive)))
        while True:
            x = chain[-1]
            distance = from_row(x) if kept is None else kept[x]
            y = int(distance.argmin())
            # a tie goes back, and rounding is one, so that chains end
            if len(chain) > 1 and distance[chain[-2]] <= distance[y] + 1e-12:
                y = chain[-2]
                break
            push(y)
        merges.append((float(distance[y]), int(member[x]), int(member[y])))
        del chain[-2:]
        x, y = min(x, y), max(x, y)
        if place[x] < 0 <= place[y]:
            place[x] = place[y]
            rows[place[x]] = x
        elif place[y] >= 0:
            total[place[x]] += total[place[y]]
        size[x] += size[y]
        alive[y] = False
        left -= 1
        if kept is not None:
            kept[x] = kept[:, x] = from_row(x)
            kept[:, y] = np.inf
    if waiting:  # all have one direction
        push(0)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for _, x, y in sorted(merges, key=lambda m: m[0])[: max(0, n - max(1, clusters))]:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(n)])


def hashed_vectors(texts: list[str], dimension: int = 64) -> np.ndarray:
    """A stand-in for an embedding model: hashed token counts. Pass a model's function instead where there is one."""
    import zlib

    out = np.zeros((len(texts), dimension))
    for row, text in zip(out, texts, strict=True):
        for token in _TOKEN.findall(text.lower()):
            row[zlib.crc32(token.encode()) % dimension] += 1
    return out


def semantic(text: str, p: ChunkParams, embed: Callable[[list[str]], np.ndarray] = hashed_vectors) -> list[str]:
    """Markdown sections with their titles; tables, lists, code and formulas stay whole; a paragraph above the limit is
    cut where neighbouring sentences are in different clusters. All sentences of a paragraph cluster together."""
    out = []
    for titles, body in titled_sections(text.split("\n"), MARKDOWN):
        head = " > ".join(titles)
        room = max(1, p.limit - count_tokens(head))
        blocks = []
        for block in re.split(r"\n\s*\n", body):
            if count_tokens(block) <= room or re.match(r"\s*(?:\||[-*+]\s|\d+\.\s|```|\$\$|!\[)", block):
                blocks.append(block)
                continue
            parts = sentences(block)
            label = chained_linkage(embed(parts), -(-count_tokens(" ".join(parts)) // room))
            cut = np.flatnonzero(np.diff(label)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(parts)], strict=True):
                blocks += cut_at_tokens(" ".join(parts[a:b]), room)
        for chunk in merge_sections(blocks, room):
            out += [f"{head}\n{c}" if head else c for c in cut_at_tokens(chunk, room, int(room * p.hard))]
    return out


# How lines of questions and answers begin.
_QUESTION = re.compile(r"\s*(?:Q|Question|问|问题)\s*\d*\s*[:：]\s*", re.I)
_ANSWER = re.compile(r"\s*(?:A|Answer|答|答案)\s*\d*\s*[:：]\s*", re.I)


def qa_pairs(text: str) -> list[tuple[str, str]]:
    """Questions with their answers: by prefixes, else two-cell table rows, else headings with what is under them,
    else lines parted by a tab or comma (the more frequent; a line without continues the answer). In order, each once,
    none empty."""
    lines = text.split("\n")
    pairs: list[tuple[str, str]] = []
    if any(_QUESTION.match(x) for x in lines):
        fenced, part = False, ""
        for line in lines:
            fenced ^= line.lstrip().startswith("```")
            if not fenced and (m := _QUESTION.match(line)):
                pairs.append((line[m.end() :].strip(), ""))
                part = "q"
            elif not fenced and pairs and part and (m := _ANSWER.match(line)):
                pairs[-1] = (pairs[-1][0], line[m.end() :].strip())
                part = "a"
            elif part and line.strip():
                q, a = pairs[-1]
                pairs[-1] = (f"{q}\n{line}", a) if part == "q" else (q, f"{a}\n{line}")
    elif any(x.lstrip().startswith("|") for x in lines):
        for line in lines:
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if line.lstrip().startswith("|") and len(cells) >= 2 and not all(re.fullmatch(r":?-+:?", c) for c in cells):
                pairs.append((cells[0], cells[1]))
    elif any(re.match(r"#+\s", x) for x in lines):
        pairs = [(" ".join(titles), body.strip()) for titles, body in titled_sections(lines, MARKDOWN) if titles]
    else:
        tabs, commas = (sum(x.count(c) == 1 for x in lines) for c in "\t,")
        mark = "\t" if tabs >= commas else ","
        for line in lines:
            if line.count(mark) == 1:
                q, a = line.split(mark)
                pairs.append((q.strip(), a.strip()))
            elif pairs and line.strip():
                pairs[-1] = (pairs[-1][0], f"{pairs[-1][1]}\n{line.strip()}")
    return [x for x in dict.fromkeys(pairs) if x[0] and x[1]]


def qa(text: str, p: ChunkParams, most_chars: int = 4000) -> list[str]:
    """A chunk for each pair; a long answer is parted at paragraphs, lines or anywhere, and keeps its question."""
    out = []
    for q, a in qa_pairs(text):
        room = max(1, most_chars - len(q) - 1)
        while a:
            cut = len(a) if len(a) <= room else next((i for i in (a.rfind(s, 1, room) for s in ("\n\n", "\n")) if i > 0), room)
            out.append(f"{q}\t{a[:cut].strip()}")
            a = a[cut:].lstrip("\n")
    return out


#: Presets that are functions of a text, and of the family of its headings.
PRESETS: dict[str, Callable[[str, ChunkParams, int | None], list[str]]] = {
    "book": book, "laws": laws, "qa": lambda text, p, _: qa(text, p), "semantic": lambda text, p, _: semantic(text, p),
}


def spans(text: str, chunks: list[str]) -> list[tuple[int | None, int | None]]:
    """Where each chunk stands verbatim, searched forward only; none where it does not."""
    out, here = [], 0
    for chunk in chunks:
        at = text.find(chunk, here)
        out.append((at, at + len(chunk)) if at >= 0 else (None, None))
        here = max(here, at)
    return out


def native_chunks(name: str, text: Column, p: ChunkParams) -> Column:
    """The chunks of the separator preset, else those of the general one, of which an unknown preset is another name."""
    if name == "separator":
        return separated(text, p.limit, p.overlap_percent, p.delimiter)
    return general(text, p.limit, p.overlap_percent, p.delimiter, p.hard)


def chunked(docs: DataFrame, name: str, params: ChunkParams = ChunkParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, chunk_index, content, start, end, tokens) of each document; the index counts chunks that are not blank.
    A null or blank text has none."""
    make = PRESETS.get(name)
    if make is None:
        chunks = placed(F.col("text"), native_chunks(name, F.col("text"), params))
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", F.posexplode(chunks).alias("chunk_index", "c"))
        return rows.select(
            F.col("id").alias(id_col),
            F.concat(F.coalesce(F.col("id").cast("string"), F.lit("None")), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
            "chunk_index", "c.content", "c.start", "c.end", tok_count(F.col("c.content")).alias("tokens"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = []
                for i, text, family in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    found = [c for c in make(text or "", params, family) if c.strip()]
                    rows += [(i, f"{i}_chunk_{n}", n, c, a, b, count_tokens(c)) for n, (c, (a, b)) in enumerate(zip(found, spans(text or "", found), strict=True))]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (part.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "chunk_id", "chunk_index", "content", "start", "end", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    family = heading_family(F.col(text_col)) if name in ("book", "laws") else F.lit(None).cast("int")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), family.alias("family")).mapInArrow(
        run, f"id {kind}, chunk_id string, chunk_index int, content string, start long, end long, tokens long"
    )
    return found.withColumnRenamed("id", id_col)


class _Grid(HTMLParser):
    """The cells of the first table of a page, with their spans."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[tuple[str, int, int]]] = []
        self.cell: list[str] | None = None
        self.spans, self.depth, self.done = (1, 1), 0, False

    def _close(self) -> None:
        if self.cell is not None:
            self.rows[-1].append(("".join(self.cell), *self.spans))
            self.cell = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth and tag in ("tr", "td", "th"):
            self._close()
            if tag == "tr" or not self.rows:
                self.rows.append([])
            if tag != "tr":
                span = lambda name: int(x) if (x := dict(attrs).get(name) or "1").isdigit() and 0 < int(x) <= 1000 else 1
                self.cell, self.spans = [], (span("rowspan"), span("colspan"))

    def handle_endtag(self, tag: str) -> None:
        if self.depth and tag in ("td", "th", "tr", "table"):
            self._close()
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data: str) -> None:
        if self.cell is not None and not self.done:
            self.cell.append(data.strip())


def table_to_kv(html: str) -> list[str]:
    """Each row below the first of a page's first table as "header：value；" pairs. A cell that spans rows or columns
    counts in each of them; columns without a header are left out."""
    grid = _Grid()
    grid.feed(html or "")
    grid.close()
    placed: dict[tuple[int, int], str] = {}
    for r, cells in enumerate(grid.rows):
        c = 0
        for text, down, across in cells:
            while (r, c) in placed:
                c += 1
            placed |= {(r + i, c + j): text for i in range(down) for j in range(across)}
            c += across
    heads = {c: text for (r, c), text in placed.items() if r == 0 and text}
    out = []
    for r in range(1, max((r for r, _ in placed), default=0) + 1):
        last = max((c for q, c in placed if q == r), default=-1)
        pairs = [f"{head}：{placed.get((r, c), '')}" for c, head in sorted(heads.items()) if c <= last]
        if pairs:
            out.append("；".join(pairs) + "；")
    return out


def colon_titles(sections: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(text, layout) rows, with a title put before each whose text ends in a colon and whose last sentence is preceded by
    at least 32 more characters: that last sentence, as title."""
    out = []
    for text, layout in sections:
        line = text.split("@")[0].strip()
        if line and line[-1] in ":：":
            parts = re.split(r"[。？！!?;；]|\. ", line)
            if len(parts) > 1 and len(line) - len(parts[-1]) - 1 >= 32 and parts[-1]:
                out.append((parts[-1], "title"))
        out.append((text, layout))
    return out


def paragraphs_then_lines(text: str, p: ChunkParams, embed) -> list[str]:
    """Paragraphs up to the limit whole; longer ones as runs of lines up to it (a line feed counts one); a longer line by meaning."""
    out: list[str] = []
    for paragraph in (x.strip() for x in text.split("\n\n")):
        if not paragraph:
            continue
        if count_tokens(paragraph) <= p.limit:
            out.append(paragraph)
            continue
        run, size = [], 0
        for line in (x.strip() for x in paragraph.split("\n")):
            n = count_tokens(line)
            if not line:
                continue
            if run and (n > p.limit or size + n + 1 > p.limit):
                out.append("\n".join(run))
                run, size = [], 0
            if n > p.limit:
                out += semantic(line, p, embed)
            else:
                size += n + bool(run)
                run.append(line)
        if run:
            out.append("\n".join(run))
    return out
