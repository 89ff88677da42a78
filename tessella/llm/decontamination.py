"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, and a scan of the
word windows of each document. Hits of the hash are compared word by word before they count.

The benchmark is the stated query set. It is broadcast in blocks of bounded size, each built once on the driver and
unpacked once by each Python worker: normally one. A benchmark beyond the bound takes one more scan of the documents
for each block, one after the other, with whole results; texts longer than a piece are divided with overlaps, so that
every window is in some block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import ALNUM, Words, blocks, encoded, sliced, window_hashes
from tessella.session import bounded_batches, materialise

#: Bytes of benchmark text that are broadcast at once (about five times as many with the windows' hashes), and of one piece of an item.
BLOCK_BYTES, PIECE_BYTES = 8 << 20, 1 << 20


class Windows:
    """The windows of a block of items: by length, the sorted hashes, for each of these its distinct texts (nearly always one),
    each with one place where it stands, and for each text the items that have it."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.items = [i for i, _ in items]
        self.sources: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        raw = [(t or "").encode("utf-8") for _, t in items]
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for lo, hi in blocks(raw):
            found = Words(raw[lo:hi], ALNUM)
            counts = np.diff(found.offsets)
            for n in np.unique(np.minimum(counts, size)[counts > 0]).tolist():
                chosen = np.flatnonzero(np.minimum(counts, size) == n)
                per = counts[chosen] - n + 1
                at = np.repeat(found.offsets[chosen] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
                hashes = window_hashes(found.hashes, n)[at]
                parts.setdefault(n, []).append((hashes, np.full(len(at), len(self.sources), np.int32), at.astype(np.int32), np.repeat(lo + chosen, per).astype(np.int32)))
            self.sources.append((found.buffer, found.starts.astype(np.int32), found.ends.astype(np.int32)))
        #: by length: distinct hashes, where the texts of each begin (one more than hashes), a source and word for each text,
        #: where its items begin (one more than texts), and the items
        self.of: dict[int, tuple[np.ndarray, ...]] = {}
        for n, found_parts in parts.items():
            hashes, source, at, item = (np.concatenate(x) for x in zip(*found_parts, strict=True))
            order = np.lexsort((item, hashes))
            hashes, source, at, item = hashes[order], source[order], at[order], item[order]
            known, first, size_of = np.unique(hashes, return_index=True, return_counts=True)
            text = np.zeros(len(hashes), np.int32)  # which of the texts of its hash a row has
            for i in np.flatnonzero(size_of > 1).tolist():
                seen: dict[bytes, int] = {}
                for r in range(first[i], first[i] + size_of[i]):
                    text[r] = seen.setdefault(self._text(source[r], at[r], n), len(seen))
            if text.any():  # two texts with one hash
                order = np.lexsort((item, text, hashes))
                hashes, source, at, item, text = hashes[order], source[order], at[order], item[order], text[order]
            new_text = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]))
            fresh = np.flatnonzero(new_text | np.append(True, item[1:] != item[:-1]))
            hashes, source, at, item, new_text = hashes[fresh], source[fresh], at[fresh], item[fresh], new_text[fresh]
            starts = np.flatnonzero(new_text)
            self.of[n] = known, np.append(np.searchsorted(hashes[starts], known), len(starts)), source[starts], at[starts], np.append(starts, len(item)), item
        self._names: dict[frozenset[tuple[int, int]], list[str]] = {}

    def names(self, texts: frozenset[tuple[int, int]]) -> list[str]:
        """The sorted ids of the items that have one of these texts (length, number); those without an id are not listed."""
        found = self._names.get(texts)
        if found is None:
            rows = [self.of[n][5][self.of[n][4][v] : self.of[n][4][v + 1]] for n, v in texts]
            found = sorted({x for i in np.unique(np.concatenate(rows)).tolist() if (x := self.items[i]) is not None}) if rows else []
            if len(self._names) > 256:
                self._names.clear()
            self._names[texts] = found
        return found

    def _text(self, source: int, at: int, n: int) -> bytes:
        buffer, starts, ends = self.sources[source]
        return b" ".join(buffer[starts[j] : ends[j]] for j in range(at, at + n)).lower()

    def scan(self, texts: list[bytes]) -> Iterator[tuple[Words, int, int, list[tuple[int, int]], list[str]]]:
        """For each text: all words, its first and last offset in them, the hits (first word, length), the sorted items."""
        for lo, hi in blocks(texts):
            found = Words(texts[lo:hi], ALNUM)
            hits: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
            met: list[set[tuple[int, int]]] = [set() for _ in range(hi - lo)]
            for n, (known, first, source, word, _, _) in self.of.items():
                windows = window_hashes(found.hashes, n)
                if not len(windows):
                    continue
                at = np.minimum(np.searchsorted(known, windows), len(known) - 1)
                maybe = np.flatnonzero(known[at] == windows)
                owner = np.searchsorted(found.offsets, maybe, side="right") - 1
                for i, j, of in zip(maybe.tolist(), owner.tolist(), at[maybe].tolist(), strict=True):
                    if i + n > found.offsets[j + 1]:
                        continue
                    text = found.text(i, n)
                    for v in range(first[of], first[of + 1]):
                        if self._text(source[v], word[v], n) == text:
                            hits[j].append((i, n))
                            met[j].add((n, v))
            for j in range(hi - lo):
                yield found, int(found.offsets[j]), int(found.offsets[j + 1]), hits[j], self.names(frozenset(met[j]))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Words before A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)


def _pieces(size: int):
    """Items in pieces of about PIECE_BYTES; a piece begins with the last size - 1 words of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            items, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts: list[int] = []
                begin = 0
                for m in _WORD.finditer(text) if len(text) > PIECE_BYTES else ():
                    starts.append(m.start())
                    if m.end() - begin > PIECE_BYTES and len(starts) >= size:
                        items.append(item)
                        texts.append(text[begin : m.end()])
                        starts = starts[len(starts) - size + 1 :]
                        begin = starts[0] if starts else m.end()
                # what is left; of a divided item only if it has a window of its own
                if begin == 0 or len(starts) >= size:
                    items.append(item)
                    texts.append(text[begin:])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    return run


def benchmark_blocks(bench: DataFrame, item_col: str, text_col: str, size: int) -> Iterator[Broadcast]:
    """The benchmark's windows in blocks of about BLOCK_BYTES of text, each made when it is asked for, and given up after it."""
    rows = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    rows = rows.mapInArrow(_pieces(size), "item string, text string")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_BYTES))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else rows
        got = part.toArrow()
        windows = Windows(list(zip(got.column("item").to_pylist(), got.column("text").to_pylist(), strict=True)), size)
        yield bench.sparkSession.sparkContext.broadcast(windows)


_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_HITS = "n_words long, ranges array<struct<first:long,end:long>>, items array<string>"


def _scan(windows: Broadcast, others: bool):
    """A row for each text, its first column kept; without ``others`` only for texts with a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n_words, ranges, items = [], [], []
            for _, a, b, hits, of in windows.value.scan(encoded(batch.column("text"))):
                n_words.append(b - a)
                ranges.append([{"first": x, "end": y} for x, y in _merged([(i - a, i - a + n) for i, n in hits])])
                items.append(of)
            found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(ranges, _RANGES), pa.array(items, pa.list_(pa.string()))], names=["id", "n_words", "ranges", "items"])
            yield found if others else found.filter(pa.array([bool(r) for r in ranges], pa.bool_()))

    return run


def _key(text: str):
    """Texts of the same key are equal: what is hit in a text depends on it alone."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _hits_of_all(docs: DataFrame, parts: list[Broadcast] | Iterator[Broadcast], text_col: str) -> DataFrame:
    """(key, ranges, items) of the texts with a hit, over all blocks, which are scanned one after the other."""
    texts = docs.select(_key(text_col).alias("id"), F.col(text_col).alias("text"))
    found = None
    for windows in parts:
        hits = materialise(texts.mapInArrow(_scan(windows, False), f"id string, {_HITS}"), "hits")
        windows.destroy()
        found = hits if found is None else found.unionByName(hits)
    # equal texts have equal hits in a block
    once = found.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("ranges"))).alias("ranges"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return once.select(F.col("id").alias("_key"), F.array_sort("ranges").alias("ranges"), F.array_sort("items").alias("items"))


#: Ranges in order become one where they touch.
_MERGE = """aggregate(ranges, cast(array() as array<struct<first:bigint,end:bigint>>), (got, r) ->
    if(size(got) > 0 and r.first <= element_at(got, -1).end,
       concat(slice(got, 1, size(got) - 1), array(named_struct('first', element_at(got, -1).first, 'end', greatest(element_at(got, -1).end, r.end)))),
       concat(got, array(r))))"""


def _first_of(parts: Iterator[Broadcast]) -> tuple[Broadcast, Iterator[Broadcast] | None]:
    """The one block, or the first and an iterator over all of them."""
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return first, None

    def all_parts() -> Iterator[Broadcast]:
        yield first
        yield second
        yield from parts

    return first, all_parts()


def scan_contamination(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``ranges`` (merged hit words, ends exclusive) and
    ``items`` (sorted ids, as strings, of the items with a window in the text).

    Words are runs of ASCII letters (A-Z lowered), digits and non-ASCII characters. A window is ``size``
    consecutive words of an item; an item of fewer words, but not none, is one window. Null or empty
    texts have no words and no hits; items with a null or empty text have no windows; items with a null id
    hit words but are not listed. Repeated items count once. Other columns are not looked at.
    """
    docs = bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    only, parts = _first_of(benchmark_blocks(bench, item_col, item_text_col, size))
    if parts is None:
        return texts.mapInArrow(_scan(only, True), f"id {kind}, {_HITS}").withColumnRenamed("id", id_col)
    hits = _hits_of_all(docs, parts, text_col).withColumn("ranges", F.expr(_MERGE))
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    counted = texts.select(F.col("id").alias(id_col), words.cast("long").alias("n_words"), _key("text").alias("_key"))
    none = "cast(array() as array<struct<first:bigint,end:bigint>>)"
    return counted.join(hits, "_key", "left").select(
        id_col, "n_words", F.coalesce("ranges", F.expr(none)).alias("ranges"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
    )


def _clean(windows: Broadcast, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            yield batch.filter(pa.array([not h for _, _, _, h, _ in windows.value.scan(encoded(batch.column(at)))], pa.bool_()))

    return run


def _cut(at: int, names: list[str], windows: Broadcast | None):
    """The texts without their hit words: those of the one block, or those in the last column."""

    def hits_of(texts: list[bytes], batch: pa.RecordBatch) -> Iterator[tuple[Words, int, list[tuple[int, int]]]]:
        if windows is not None:
            for found, a, _, h, _ in windows.value.scan(texts):
                yield found, a, _merged([(i - a, i - a + n) for i, n in h])
            return
        known = batch.column(len(names)).to_pylist()
        for lo, hi in blocks(texts):
            found = Words(texts[lo:hi], ALNUM)
            for j in range(hi - lo):
                yield found, int(found.offsets[j]), [(r["first"], r["end"]) for r in known[lo + j] or []]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            texts, new = encoded(batch.column(at)), batch.column(at).to_pylist()
            start, of = 0, None
            for i, (found, first, h) in enumerate(hits_of(texts, batch)):
                start = 0 if found is not of else start
                of = found
                if h:
                    kept, here = [], start
                    for a, b in h:
                        kept.append(found.buffer[here : found.starts[first + a]])
                        here = int(found.ends[first + b - 1])
                    new[i] = b" ".join([*kept, found.buffer[here : start + len(texts[i])]]).decode("utf-8")
                start += len(texts[i]) + 1
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def decontaminated(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, spans: bool = False
) -> DataFrame:
    """``docs`` without contaminated rows; with ``spans``, with all rows but without the hit words (each
    run of hit words, with what stands between them, becomes one space). Columns stay as they are. Hits of all
    blocks of the benchmark are gathered on the whole texts, which are cut once. Null and empty texts stay."""
    docs = bounded_batches(docs)
    at = docs.columns.index(text_col)
    only, parts = _first_of(benchmark_blocks(bench, item_col, item_text_col, size))
    if parts is None:
        return docs.mapInArrow(_cut(at, docs.columns, only) if spans else _clean(only, at), docs.schema)
    hits = _hits_of_all(docs, parts, text_col)
    mine = "_".join(["key", *docs.columns])
    keyed = docs.withColumn(mine, _key(text_col))
    if not spans:
        return keyed.join(hits, keyed[mine] == hits["_key"], "left_anti").drop(mine)
    ranges = hits.select(F.col("_key").alias(mine), F.expr(_MERGE).alias("_".join(["ranges", *docs.columns])))
    return keyed.join(ranges, mine, "left").drop(mine).mapInArrow(_cut(at, docs.columns, None), docs.schema)
