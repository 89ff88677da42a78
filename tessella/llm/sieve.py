"""A table of bits for a set of long keys: rows that cannot have one of these keys are left out before a shuffle.

The table has BITS_EACH bits for each expected key, at least SLOTS and at most MOST_SLOTS, so that about one row in BITS_EACH
passes without a key up to 32 million keys. Beyond, more rows pass (1 in 8 at 64 million, 6 in 7 at a thousand million), and never is
one lost: the plan stays the same, as rows that pass meet the keys in an exact join, whose cost then nears that of the join alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.words import mix

#: Bits of a table (8 to 64 MB), and how many of them reach the driver in one row.
SLOTS, MOST_SLOTS, BITS_EACH, PART = 1 << 26, 1 << 29, 16, 1 << 15


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _parts(pick: Callable[[pa.RecordBatch], np.ndarray], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(_slots(pick(batch), size))
            yield pa.RecordBatch.from_arrays([pa.array(slots // PART, pa.int64()), pa.array(slots, pa.int64())], names=["part", "slot"])

    return run


def _first(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).drop_null().to_numpy()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each part with a bit; a partition has all slots of its parts."""
    rows: dict[int, np.ndarray] = {}
    for batch in batches:
        slots = batch.column("slot").to_numpy()
        parts = slots // PART
        order = np.argsort(parts, kind="stable")
        slots, parts = slots[order] % PART, parts[order]
        first = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
        for part, mine in zip(parts[first].tolist(), np.split(slots, first[1:]), strict=True):
            bits = rows.setdefault(part, np.zeros(PART // 8, np.uint8))
            np.bitwise_or.at(bits, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([x.tobytes() for x in rows.values()], pa.binary())], names=["part", "bits"])


def sieve(keys: DataFrame, pick: Callable[[pa.RecordBatch], np.ndarray] = _first, expected: int = 0) -> np.ndarray:
    """The bit table of the keys that ``pick`` finds in each batch (by default those of the first, long, column, without
    nulls), of which about ``expected`` are expected."""
    size = SLOTS
    while size < min(MOST_SLOTS, BITS_EACH * expected):
        size *= 2
    packed = keys.mapInArrow(_parts(pick, size), "part long, slot long").repartition("part").mapInArrow(_packed, "part long, bits binary")
    table = np.zeros((size // PART, PART // 8), np.uint8)
    got = packed.toArrow()
    for part, bits in zip(got.column("part").to_pylist(), got.column("bits").to_pylist(), strict=True):
        table[part] = np.frombuffer(bits, np.uint8)
    return table.ravel()


def held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the table has each key (true for all of its keys, and for few others)."""
    slots = _slots(keys, 8 * len(table))
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def passing(df: DataFrame, table: np.ndarray, key: str, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose key (a long) the table has, or, with ``inside`` false, has not. A null key is in none."""
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(at)
            found = held(table, keys.fill_null(0).to_numpy()) & keys.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(found == inside, pa.bool_()))

    return df.mapInArrow(run, df.schema)
