"""Word and shingle hashes of many texts at once, with numpy over their UTF-8 bytes.

Both word classes used here separate words by ASCII characters only, so words can be found in
the encoded bytes, and lower-casing A-Z is a table lookup. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessella.functions.batches import sliced, trimmed  # noqa: F401

SPACE_BYTES = {0x20, *range(0x09, 0x0E)}
PUNCT_BYTES = {*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)}
#: Bytes of text handled at a time; bounds the memory of the eight-byte arrays below.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(separators: set[int]) -> np.ndarray:
    """A 64-bit value for each byte, the same for A-Z and a-z; 0 for separators."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    values[sorted(separators)] = 0
    return values


#: Words divided by white space: everything but 0x20 and 0x09-0x0D. A-Z are lowered before.
SPACED = byte_table(SPACE_BYTES)
#: Words of ASCII letters, digits and all that is not ASCII. A-Z count as the letters they lower to.
ALNUM = byte_table(PUNCT_BYTES - set(range(ord("A"), ord("Z") + 1)))

_BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def encoded(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """All words of some texts: ``hashes``, byte ranges ``starts`` to ``ends`` in ``buffer``, and where
    each text's words begin and end (``offsets``: one more than texts)."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        self.buffer = b" ".join(texts) + b" "
        self.text_ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        value = table[np.frombuffer(self.buffer, dtype=np.uint8)]
        inside = value != 0
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.offsets = np.concatenate([[0], np.searchsorted(self.starts, self.text_ends)])
        self.hashes = np.zeros(0, np.uint64)
        if len(self.starts):
            lens = self.ends - self.starts
            first = np.cumsum(lens) - lens
            within = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
            scaled = value[inside] * powers(_BASE, int(lens.max()))[within]
            self.hashes = mix(np.add.reduceat(scaled, first) + lens.astype(np.uint64))

    def text(self, i: int, n: int) -> bytes:
        """``n`` words from the ``i``-th, A-Z lowered, with a space between."""
        return b" ".join(self.buffer[self.starts[j] : self.ends[j]] for j in range(i, i + n)).lower()


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each ``k`` consecutive words, by the place of the first; across texts too."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    scale = powers(np.uint64(0xD6E8FEB86659FD93), k)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * scale[j]
    return mix(total + np.uint64(k))


def shingles(texts: list[bytes], k: int, table: np.ndarray = SPACED) -> Iterator[np.ndarray]:
    """The sorted distinct ``k``-word shingle hashes of each text. A text of fewer words, but not
    none, has its whole sequence as its one shingle; one without words has none."""
    for lo, hi in blocks(texts):
        found = Words(texts[lo:hi], table)
        words, offsets = found.hashes, found.offsets
        full = window_hashes(words, k)
        for i in range(hi - lo):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if b - a >= k:
                yield np.unique(full[a : b - k + 1])
            elif b > a:
                yield window_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of numpy arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
