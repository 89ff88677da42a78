"""Readers of documents: files become markdown rows (path, markdown), by extension; tables of links and JSON lines.

Formats whose parsers are not installed (PDF, office files, images) are gated: a row of theirs needs a parser that the
caller registers.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Parser = Callable[[bytes], str]
_PARSERS: dict[str, Parser] = {}
TEXT, HTML, JSON, ZIP = {".txt", ".md", ".markdown"}, {".html", ".htm"}, {".json"}, {".zip"}
BLOCKS = {"p", "div", "section", "article", "table", "tr", "ul", "ol", "br", "blockquote", "pre"}


def register_parser(extension: str, parser: Parser) -> None:
    """Parse files of an extension (".pdf") with a function from bytes to markdown."""
    _PARSERS[extension.lower()] = parser


class _Markdown(HTMLParser):
    """Headings, paragraphs, list items and links of a page; scripts and styles are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in BLOCKS:
            self.out.append("\n\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", "".join(parser.out))).strip()


def json_to_markdown(text: str) -> str:
    """Pretty JSON in a fence."""
    return f"```json\n{json.dumps(json.loads(text), indent=2, ensure_ascii=False)}\n```"


def zip_to_markdown(data: bytes, most: int = 64 << 20) -> str:
    """The archive's ``full.md``, or else its first markdown file, with links to its images below ``images/``. Absolute
    paths, paths that lead out, and archives that grow too large are errors."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if any(n.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", n) for n in names):
            raise ValueError("unsafe path in archive")
        if sum(i.file_size for i in z.infolist()) > most:
            raise ValueError("archive too large")
        found = sorted((n for n in names if n.lower().endswith(".md")), key=lambda n: (n.rsplit("/", 1)[-1] != "full.md", n))
        if not found:
            raise ValueError("no markdown in archive")
        folder = found[0].rpartition("/")[0]
        base = f"{folder}/images/" if folder else "images/"
        return re.sub(r"(!\[[^\]]*\]\()(?:\./)?images/", lambda m: m[1] + base, z.read(found[0]).decode("utf-8"))


def parse(path: str, data: bytes) -> str:
    """Markdown of a file, by its extension."""
    extension = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension in _PARSERS:
        return _PARSERS[extension](data)
    if extension in ZIP:
        return zip_to_markdown(data)
    text = data.decode("utf-8")
    if extension in HTML:
        return html_to_markdown(text)
    if extension in JSON:
        return json_to_markdown(text)
    if extension in TEXT:
        return text
    raise ValueError(f"no parser for {extension or 'files without extension'}")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown, error): every file below a folder, parsed in its task; what fails has an error instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[tuple[str | None, str | None]] = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    done.append((parse(name, data), None))
                except (ValueError, zipfile.BadZipFile) as e:
                    done.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=["path", "markdown", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, markdown string, error string")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_sheets(data: bytes, most: int = 256 << 20) -> dict[str, list[list[str]]]:
    """The rows of every sheet of an .xlsx workbook by its public format: all cells as text as they are stored, no header
    inferred; rows of a sheet are filled up to the same length."""
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > most:
            raise ValueError("workbook too large")
        text = lambda node: "".join(x.text or "" for x in node.iter(f"{_SHEET}t"))
        shared = [text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            target = targets[sheet.get(_RELATION)]
            rows: list[list[str]] = []
            for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_SHEET}row"):
                at = int(row.get("r") or len(rows) + 1) - 1
                rows += [[] for _ in range(at + 1 - len(rows))]
                for cell in row.iter(f"{_SHEET}c"):
                    letters = re.match("[A-Z]*", cell.get("r") or "")[0]
                    column = len(rows[at])
                    if letters:
                        column = 0
                        for letter in letters:
                            column = 26 * column + ord(letter) - 64
                        column -= 1
                    rows[at] += [""] * (column + 1 - len(rows[at]))
                    value = cell.find(f"{_SHEET}v")
                    raw = value.text or "" if value is not None else ""
                    rows[at][column] = shared[int(raw)] if cell.get("t") == "s" else text(cell) if cell.get("t") == "inlineStr" else raw
            width = max(map(len, rows), default=0)
            out[sheet.get("name")] = [r + [""] * (width - len(r)) for r in rows]
        return out


def workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """A minimal .xlsx workbook with these texts."""
    from xml.sax.saxutils import escape, quoteattr

    main, relations = _SHEET[1:-1], _RELATION[1:].split("}")[0]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{relations}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{''.join(f'<Relationship Id=\"r{i}\" Target=\"worksheets/sheet{i}.xml\"/>' for i, _ in enumerate(sheets, 1))}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            lines = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(x)}</t></is></c>' for x in row) + "</row>" for row in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


def sheet_rows(files: DataFrame) -> DataFrame:
    """(path, sheet, row, cells) of the workbooks in ``files`` (path, content), each opened in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, name, i, cells) for name, of in workbook_sheets(data).items() for i, cells in enumerate(of)]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInArrow(run, "path string, sheet string, row int, cells array<string>")


def row_as_table(columns: list[str]) -> Column:
    """A row as a markdown table of its own."""
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    return F.concat(F.lit(head + "| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))


def read_csv_tables(spark: SparkSession, path: str) -> DataFrame:
    """(markdown): each row of the CSV files as a table; all values are strings."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    return rows.select(row_as_table(rows.columns).alias("markdown"))


def read_questions(lines: DataFrame) -> DataFrame:
    """JSON lines (value) of an evaluation set: query, gold ids and answer, with flags; a line that is no JSON or has no
    query is an error in ``bad``."""
    parsed = lines.select("value", F.from_json("value", "query string, gold_chunk_ids array<string>, gold_answer string", {"mode": "PERMISSIVE"}).alias("q"))
    has = lambda c: F.coalesce(c, F.lit(False))
    return parsed.select(
        "q.*", has(F.size("q.gold_chunk_ids") > 0).alias("has_gold_chunks"), has(F.length(F.trim("q.gold_answer")) > 0).alias("has_gold_answer"),
        (~has(F.length(F.trim("q.query")) > 0)).alias("bad"),
    )


#: Readers of the kinds of knowledge bases; others can be added.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"files": read_files, "texts": read_texts, "csv": read_csv_tables}


def reader(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    if kind not in READERS:
        raise ValueError(f"unknown kind {kind}; known: {', '.join(sorted(READERS))}")
    return READERS[kind]
