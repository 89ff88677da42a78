"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest of a document's distinct shingle hashes (40 bits each, sorted). Sketches of
parts merge into the sketch of the whole; two of them estimate resemblance and containment, and one the
number of distinct shingles. Below k shingles all of these are exact, up to hash collisions.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.words import encoded, mix, shingles, sliced
from tessella.session import bounded_batches

K = 128
BITS = 40


def sketches(texts: list[bytes], k: int = K, size: int = 5) -> list[np.ndarray]:
    """The bottom-k sketch of each text's ``size``-word shingles (white-space words, A-Z lowered)."""
    out = []
    for s in shingles(texts, size):
        low = mix(s) >> np.uint64(64 - BITS)
        if len(low) > 4 * k:
            low = np.partition(low, 2 * k)[: 2 * k]  # twice as many: equal values are one
        out.append(np.unique(low)[:k].astype(np.int64))
    return out


def to_text(sketch: np.ndarray) -> str:
    """Ten hexadecimal digits for each hash."""
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 5)
    return np.pad(raw, ((0, 0), (3, 0))).copy().view(">u8").ravel().astype(np.int64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * 2.0**BITS / float(sketch[k - 1] + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated Jaccard similarity, 0 to 1; 1 for two documents without shingles."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = merge(a, b, k)
    return float(len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), least, assume_unique=True))) / len(least)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b has too; 1 if a has none."""
    if not len(a):
        return 1.0
    r, na, nb = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return min(1.0, r / (1 + r) * (na + nb) / na)


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = 5) -> DataFrame:
    """(id, sketch: array<long>) of each row of ``docs``. Null and empty texts have an empty sketch."""
    docs = bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = sketches(encoded(batch.column(1)), k, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], names=["id", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, sketch array<long>").withColumnRenamed("id", id_col)


def merged_sketches(table: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """The sketch of all parts of each group. Groups are salted and ranked within the salt, which Spark cuts before
    and after the shuffle, so that a large one meets in one task only as at most k hashes of each of ``salts``."""
    parts = table.select(*by, F.explode(sketch_col).alias("h")).withColumn("salt", F.pmod("h", F.lit(salts))).distinct()
    rank = F.row_number().over(Window.partitionBy(*by, "salt").orderBy("h"))
    small = parts.withColumn("rank", rank).filter(F.col("rank") <= k)
    return small.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("h")), 1, k).alias(sketch_col))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, own, id, text): the rows in ranges of (id descending, hash of the text), one range a partition, in this order,
    each range followed by the row that comes next (own = false). After the last row comes the first one again.

    Rows of one id, or of none, are dealt to several ranges by their texts; only rows equal in both stay together. A range's
    first row reaches the one before it once, however often it is repeated. Only the ranges' first keys, one for each
    partition, reach the driver. A null id counts as less than all others.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.bitwise_not(order).alias("a"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("b"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ranged = rows.select("a", "b").repartitionByRange(n, "a", "b").groupBy(F.spark_partition_id()).agg(F.min(F.struct("a", "b")).alias("first"))
    firsts = sorted((r["first"]["a"], r["first"]["b"]) for r in ranged.collect())

    @F.pandas_udf("int")
    def bucket(a, b):
        import pandas as pd

        return pd.Series([bisect_right(firsts, key) - 1 for key in zip(a.tolist(), b.tolist(), strict=True)], dtype="int32")

    @F.pandas_udf("int")
    def follows(a, b):
        import pandas as pd

        place = {key: (i - 1) % len(firsts) for i, key in enumerate(firsts)}
        return pd.Series([place.get(key, -1) for key in zip(a.tolist(), b.tolist(), strict=True)], dtype="int32")

    own = rows.select(bucket("a", "b").alias("bucket"), F.lit(True).alias("own"), "a", "b", "id", "text")
    next_rows = rows.withColumn("bucket", follows("a", "b")).filter("bucket >= 0").groupBy("bucket", "a", "b").agg(F.min("id").alias("id"), F.min("text").alias("text"))
    dealt = own.unionByName(next_rows.withColumn("own", F.lit(False)))
    return dealt.repartitionById(max(n, len(firsts)), F.col("bucket")).sortWithinPartitions(F.desc("own"), "a", "b", "text").select("bucket", "own", "id", "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: its fingerprint, and that of its edited text, whose last floor(n/2)
    code points are replaced by the first as many (or all) of the next document's (descending id, then
    by a hash of the text; the first follows the last; a single row follows itself).

    Null texts count as empty; they have an empty fingerprint, which is like another empty one (1.0)
    and unlike any other (0.0). Rows that repeat each have a row. A null id sorts below all others.
    """
    docs = bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, str]] = []
        size = 0

        def done(rows: list[tuple[object, str]]) -> pa.RecordBatch:
            """All but the last row, which the one before needs."""
            texts = [t for _, t in rows]
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:], strict=False)]
            raw = [t.encode("utf-8") for t in edited]
            own, changed = sketches([t.encode("utf-8") for t in texts]), sketches(raw)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in rows[:-1]]).cast(id_type),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
                    pa.array([to_text(x) for x in own[:-1]], pa.string()),
                    pa.array([to_text(x) for x in changed], pa.string()),
                    pa.array([resemblance(a, b) for a, b in zip(own, changed, strict=False)], pa.float64()),
                    pa.array([resemblance(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
                    pa.array([distinct(a) for a in own[:-1]], pa.float64()),
                ],
                names=names,
            )

        id_type, ended = pa.int64(), False
        for batch in batches:
            id_type = batch.schema.field("id").type
            for mine, i, t in zip(batch.column("own").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if ended:
                    continue
                held.append((i, t or ""))
                size += len(t or "")
                ended = not mine
                if size > 4 << 20 and len(held) > 1:
                    yield done(held)
                    held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield done(held)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct"]
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
