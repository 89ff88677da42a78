"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that are not known yet are written one after the other; a suffix array indexes that
text; binary search finds for each piece of the vocabulary the range of suffixes that begin with it; each
occurrence is an edge from its start to its end. Edges are sorted by position, and relaxed: in each word, again
and again, the best edge that joins two neighbouring symbols does so (score, then leftmost), which is
what a byte-pair model of the sentencepiece library does. What no edge covers falls back to bytes.

White space is a visible mark at the begin of each word; that no piece has a mark behind another
character is checked, so words can be encoded alone, and each once while it is in the cache.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import sliced, trimmed
from tessella.session import bounded_batches

MARK = "▁"
#: Words that a task keeps encoded.
CACHE = 150_000
#: Longer words are joined with a queue of edges, as rounds over all symbols would take long.
LONG = 64
#: Bytes of text whose new words are indexed together, and characters in one suffix array.
TOGETHER, INDEXED = 1 << 20, 1 << 21
_WORD = re.compile(f"{MARK}*[^{MARK}]*")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a message in the public protocol-buffer wire format: number, and an integer or the bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


def check_model(path: str) -> None:
    """Raise unless the model is a byte-pair one that leaves texts as they are but for a space before the first word."""
    with open(path, "rb") as f:
        model = list(_fields(f.read()))
    trainer = dict(x for n, v in model if n == 2 for x in _fields(v))
    normaliser = dict(x for n, v in model if n == 3 for x in _fields(v))
    if trainer.get(3, 1) != 2:
        raise ValueError("a byte-pair model is needed")
    # 2: table of replaced characters, 3: space put first, 4: spaces removed, 5: spaces as marks; by default 3 to 5 are on
    if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
        raise ValueError("a model that does not normalise texts is needed")


class Vocabulary:
    """The pieces of a byte-pair model with byte fallback, and the checks that words can be encoded alone."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        check_model(path)
        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        if n > 1 << 15 or any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a model of up to 32768 pieces, with marks only at the begin of pieces, is needed")
        self.bytes = np.full(256, model.unk_id(), np.int64)
        self.text = [b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        if model.unk_id() >= 0:
            self.text[model.unk_id()] = " ⁇ ".encode()
        for i in range(n):
            if model.is_byte(i):
                value = int(pieces[i][1:-1], 16)
                self.bytes[value] = i
                self.text[i] = bytes([value])
        plain = [i for i in range(n) if not special[i] and not model.is_byte(i)]
        self.ids = np.array(plain, np.int64)
        self.pieces = [pieces[i] for i in plain]
        self.scores = np.full(n + 1, -np.inf)
        self.scores[plain] = [model.get_score(i) for i in plain]
        self.longest = max(map(len, self.pieces))
        self.chars = np.unique(np.frombuffer("".join(self.pieces).encode("utf-32-le"), np.uint32))
        width = self.longest
        self.codes = np.zeros((len(plain), width), np.uint16)  # the rank of each character; 0 beyond the end
        for row, p in zip(self.codes, self.pieces, strict=True):
            row[: len(p)] = self.rank(p)
        self.lens = np.array([len(p) for p in self.pieces], np.int64)
        self.cache: dict[str, bytes] = {}

    def rank(self, text: str) -> np.ndarray:
        """1 and up for the characters of pieces, one more than all for any other."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[at] == codes, at + 1, len(self.chars) + 1).astype(np.uint16)


def _keys(codes: np.ndarray, width: int, bits: int, fill: int | np.ndarray = 0) -> list[np.ndarray]:
    """``width`` neighbouring columns of ``codes`` (last axis) packed in order into as few integers as hold them."""
    per = 63 // bits
    out = []
    for j in range(0, width, per):
        key = np.zeros(codes.shape[:-1], np.uint64)
        for t in range(j, j + per):
            key = (key << np.uint64(bits)) | (codes[..., t] if t < width else np.uint64(fill))
        out.append(key)
    return out


def edge_table(v: Vocabulary, text: str) -> np.ndarray:
    """For each position of ``text`` and each length: the id of the piece there, or -1. Words in ``text`` are
    parted by a zero character, which no piece has. A long text is indexed in pieces, which reach into the next by
    the longest piece."""
    if len(text) <= INDEXED:
        return _edge_table(v, text)
    return np.concatenate([_edge_table(v, text[a : a + INDEXED + v.longest])[:INDEXED] for a in range(0, len(text), INDEXED)])


def _edge_table(v: Vocabulary, text: str) -> np.ndarray:
    codes = v.rank(text)
    codes[np.frombuffer(text.encode("utf-32-le"), np.uint32) == 0] = 0
    n, width = len(codes), v.longest
    # the characters that occur, numbered from 1 in as few bits as they need; the highest is kept free
    dense = np.zeros(len(v.chars) + 2, np.uint64)
    dense[codes] = 1
    dense[0] = 0
    here = dense.astype(bool)
    dense = np.cumsum(dense, dtype=np.uint64)
    bits = int(dense[-1] + np.uint64(1)).bit_length()
    top = np.uint64((1 << bits) - 1)
    # the suffix array, sorted as far as the longest piece reaches
    padded = np.concatenate([np.where(codes > 0, dense[codes], np.uint64(0)), np.zeros(width, np.uint64)])
    suffixes = np.lib.stride_tricks.as_strided(padded, (n, width), (8, 8))
    keys = _keys(suffixes, width, bits)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    # for each piece whose characters occur, the range of suffixes that begin with it, by binary search
    present = (here[v.codes] | (v.codes == 0)).all(axis=1)
    lens, ids = v.lens[present], v.ids[present]
    beyond = np.arange(width) >= lens[:, None]
    pieces = np.where(beyond, np.uint64(0), dense[v.codes[present]])
    low, high = _keys(pieces, width, bits), _keys(np.where(beyond, top, pieces), width, bits, top)
    lo, hi = np.searchsorted(keys[0], low[0], side="left"), np.searchsorted(keys[0], high[0], side="right")
    for level in range(1, len(keys)):
        for i in np.flatnonzero((lens > level * (63 // bits)) & (hi > lo)).tolist():
            within = keys[level][lo[i] : hi[i]]
            a = lo[i]
            lo[i], hi[i] = a + np.searchsorted(within, low[level][i], side="left"), a + np.searchsorted(within, high[level][i], side="right")
    counts = hi - lo
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    position = order[np.repeat(lo, counts) + within]
    # sorted by position and length by counting: each edge has a place of its own
    table = np.full(n * (width + 1), -1, np.int16)
    table[position * (width + 1) + np.repeat(lens, counts)] = np.repeat(ids, counts)
    return table.reshape(n, width + 1)


def _relax_all(v: Vocabulary, table: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Rounds over all words: in each, the best edge of each word joins two symbols. Symbols are given and
    returned as start, end and word; words without an edge left are put aside."""
    done = []
    while len(start):
        size = end[1:] - start[:-1]
        ok = (word[1:] == word[:-1]) & (size <= v.longest)
        score = np.append(np.where(ok, v.scores[table[start[:-1], np.where(ok, size, 0)]], -np.inf), -np.inf)
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        counts = np.diff(np.append(heads, len(word)))
        best = np.maximum.reduceat(score, heads)
        over = np.repeat(best == -np.inf, counts)
        if over.any():
            done.append((start[over], end[over], word[over]))
            start, end, word, score, best = start[~over], end[~over], word[~over], score[~over], best[best > -np.inf]
            if not len(start):
                break
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(heads, len(word)))
        at = np.flatnonzero(score == np.repeat(best, counts))
        at = at[np.append(True, word[at[1:]] != word[at[:-1]])]  # the leftmost of each word
        end[at] = end[at + 1]
        keep = np.ones(len(start), bool)
        keep[at + 1] = False
        start, end, word = start[keep], end[keep], word[keep]
    return done


def _relax_long(v: Vocabulary, table: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    """One word from a to b, with a queue of the edges that join neighbours."""
    after = list(range(1, b - a + 1))  # the end of the symbol that starts here
    before = list(range(-1, b - a - 1))
    alive = [True] * (b - a)
    queue: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j < b - a and after[j] - i <= v.longest and (p := table[a + i, after[j] - i]) >= 0:
            heapq.heappush(queue, (-v.scores[p], i, after[j]))

    for i in range(b - a - 1):
        offer(i)
    while queue:
        _, i, end = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or j >= b - a or not alive[j] or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < b - a:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [(a + i, a + after[i]) for i in range(b - a) if alive[i]]


def encode_words(v: Vocabulary, words: list[str]) -> list[bytes]:
    """The ids of each word (marks included) as little-endian uint16."""
    if not words:
        return []
    # a zero character inside a word has no piece, so it may look like a border to edges
    text = "\0".join(words) + "\0"
    table = edge_table(v, text)
    lens = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(lens + 1) - lens - 1
    short = np.flatnonzero(lens <= LONG)
    word = np.repeat(short, lens[short])
    start = np.repeat(first[short], lens[short]) + np.arange(len(word)) - np.repeat(np.cumsum(lens[short]) - lens[short], lens[short])
    done = _relax_all(v, table, start, start + 1, word)
    for i in np.flatnonzero(lens > LONG).tolist():
        symbols = np.array(_relax_long(v, table, int(first[i]), int(first[i] + lens[i])), np.int64)
        done.append((symbols[:, 0], symbols[:, 1], np.full(len(symbols), i)))
    start, end, word = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
    by = np.argsort(start, kind="stable")
    start, end, word = start[by], end[by], word[by]
    ids = table[start, np.minimum(end - start, v.longest)].astype(np.int64)
    # a symbol without a piece is one character: its bytes
    counts = np.ones(len(ids), np.int64)
    missing = np.flatnonzero(ids < 0)
    spelt = [v.bytes[np.frombuffer(text[i].encode("utf-8"), np.uint8)] for i in start[missing].tolist()]
    counts[missing] = [len(s) for s in spelt]
    flat = np.repeat(ids, counts)
    if len(missing):
        at = np.cumsum(counts) - counts
        for m, s in zip(missing.tolist(), spelt, strict=True):
            flat[at[m] : at[m] + len(s)] = s
    raw = flat.astype("<u2").tobytes()
    ends = np.cumsum(np.bincount(np.repeat(word, counts), minlength=len(words))) * 2
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _words(text: str) -> list[str]:
    """A text's words with their marks; a mark goes before the first."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts:
        return [MARK + p for p in parts]
    return [w for w in _WORD.findall(MARK + text.replace(" ", MARK)) if w]


def encode(v: Vocabulary, texts: list[str]) -> list[bytes]:
    """The ids of each text as little-endian uint16, equal to those of the sentencepiece library."""
    if len(v.cache) > CACHE:
        v.cache.clear()
    words = [_words(t) for t in texts]
    missing = list({w for of in words for w in of} - v.cache.keys())
    v.cache.update(zip(missing, encode_words(v, missing), strict=True))
    get = v.cache.__getitem__
    return [b"".join(map(get, of)) for of in words]


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of these ids: pieces, bytes of the fallback, and without the space put before the first word."""
    text = b"".join([v.text[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array<int>) for each row of ``docs``. Null and empty texts have no ids; rows that repeat each
    have a row; a null id is kept. The model's path is a parameter: the file is on each machine."""
    docs = bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in sliced(batches, 1, TOGETHER):
            raw = encode(v, [t or "" for t in batch.column(1).to_pylist()])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) // 2 for r in raw])]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raw), "<u2").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decoded_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of ids as ``encoded_documents`` gives them. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [decode(v, of or []) for of in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(trimmed(run), f"id {kind}, text string").withColumnRenamed("id", id_col)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: id, ``n_pieces``, ``n_bytes`` (pieces of the byte fallback), ``ids_crc32`` (of
    the ids as little-endian uint32), and ``round_trip``: whether decoding gives the text again (as it does
    unless the text holds the mark itself)."""
    docs = bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        is_byte = np.zeros(len(v.text), bool)
        is_byte[v.bytes] = True
        for batch in sliced(batches, 1, TOGETHER):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns: list[list] = [[], [], [], []]
            for t, raw in zip(texts, encode(v, texts), strict=True):
                ids = np.frombuffer(raw, "<u2")
                values = len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), decode(v, ids.tolist()) == t
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())],
                names=["id", "n_pieces", "n_bytes", "ids_crc32", "round_trip"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), schema).withColumnRenamed("id", id_col)
