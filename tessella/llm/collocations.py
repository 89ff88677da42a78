"""Phrase collocations by contiguous pattern growth (PrefixSpan with no gaps).

A pattern grows only from frequent prefixes. Single words are counted first; then pairs of frequent words; then every
occurrence of a frequent pair is projected, as a pointer with the words that follow it in its piece, to the task of its prefix,
which extends the pattern to the right depth-first. Occurrences are summed in the task that reads them, then in Spark,
before they are dealt out, and a prefix is dealt by its next word too, so a very common one is spread over tasks.

Words are 64-bit keys of (language, word) between the passes; two words with one key are detected exactly, over all words, and
another seed is taken. Which words and pairs are frequent reaches the scans as tables of bits of fixed size (``sieve``), which
let a few infrequent ones pass and lose none: all counts are of whole, exact patterns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.sieve import held, sieve
from tessella.llm.words import Words, byte_table, encoded, mix, sliced
from tessella.session import bounded_batches, materialise, release

#: What ends a piece, and what only divides words.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = byte_table({0x20, 0x09, *BREAKS})
_IS_BREAK = np.zeros(256, np.int32)
_IS_BREAK[list(BREAKS)] = 1
#: Bytes of text handled at a time.
SLICE = 2 << 20
#: Parts of a language whose candidates are ranked apart before they meet.
SALTS = 64
#: The language of rows that have none.
NO_LANG = "und"


class _Chain:
    """The words of some texts as ``keys``, and whether each and the next stand in one piece (``joined``)."""

    def __init__(self, langs: list[str], texts: list[bytes], seed: int):
        self.words = found = Words(texts, _TABLE)
        salts = {x: np.frombuffer(hashlib.blake2b(x.encode(), digest_size=8, salt=seed.to_bytes(8, "big")).digest(), np.uint64)[0] for x in set(langs)}
        per_text = np.array([salts[x] for x in langs], np.uint64)
        keys = mix(found.hashes ^ np.repeat(per_text, np.diff(found.offsets)))
        self.keys = np.where(keys == 0, np.uint64(1), keys)  # 0 stands for no word
        pieces = np.cumsum(_IS_BREAK[np.frombuffer(found.buffer, np.uint8)], dtype=np.int32)[found.starts]
        self.joined = pieces[1:] == pieces[:-1]
        inner = found.offsets[1:-1]
        self.joined[inner[(inner > 0) & (inner < len(keys))] - 1] = False

    def owner(self, i: np.ndarray) -> np.ndarray:
        """The text that each of these words is in."""
        return np.searchsorted(self.words.offsets, i, side="right") - 1


def _chains(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[pa.Array, _Chain]]:
    for batch in sliced(batches, "text", SLICE):
        langs = batch.column("lang")
        chain = _Chain(langs.to_pylist(), encoded(batch.column("text")), seed)
        if len(chain.keys):
            yield langs, chain


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, chain in _chains(batches, seed):
            keys, first, n = np.unique(chain.keys, return_index=True, return_counts=True)
            w = chain.words
            lowered = w.buffer.lower()
            words = [lowered[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [_long(keys), langs.take(pa.array(chain.owner(first))), pa.array(words, pa.binary()).cast(pa.string()), _long(n)], names=["key", "lang", "word", "n"]
            )

    return run


def _count_pairs(seed: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chain in _chains(batches, seed):
            known = held(frequent, chain.keys)
            at = np.flatnonzero(known[:-1] & known[1:] & chain.joined)
            distinct, code = np.unique(chain.keys, return_inverse=True)
            pairs, n = np.unique(code[at] * len(distinct) + code[at + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([_long(distinct[pairs // len(distinct)]), _long(distinct[pairs % len(distinct)]), _long(n)], names=["a", "b", "n"])

    return run


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b))


def _project(seed: int, pairs: np.ndarray, further: int):
    """Each occurrence of a frequent pair that a frequent pair follows: the pair, and at most ``further`` words that follow
    it as long as each two that meet are a frequent pair (then 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chain in _chains(batches, seed):
            keys = chain.keys
            ok = np.zeros(len(keys), bool)
            ok[:-1] = chain.joined & held(pairs, _pair_key(keys[:-1], keys[1:]))
            at = np.flatnonzero(ok[:-1] & ok[1:])
            if not len(at):
                continue
            distinct, code = np.unique(keys, return_inverse=True)
            columns, alive = [code[at], code[at + 1]], np.ones(len(at), bool)
            for j in range(further):
                place = np.minimum(at + 1 + j, len(keys) - 1)
                alive = alive & ok[place]
                columns.append(np.where(alive, code[np.minimum(place + 1, len(keys) - 1)], len(distinct)))
            group = columns[0]
            for column in columns[1:]:  # equal rows get equal numbers, exactly
                group = np.unique(group * (len(distinct) + 1) + column, return_inverse=True)[1]
            _, first, n = np.unique(group, return_index=True, return_counts=True)
            full = np.append(distinct, np.uint64(0))
            rest = np.stack([full[c[first]] for c in columns[2:]], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * further), _long(rest.ravel()))
            yield pa.RecordBatch.from_arrays([_long(full[columns[0][first]]), _long(full[columns[1][first]]), lists, _long(n)], names=["a", "b", "rest", "n"])

    return run


def grow(rows: np.ndarray, n: np.ndarray, prefix: int, least: int) -> Iterator[tuple[list[int], int]]:
    """The patterns longer than ``prefix`` with at least ``least`` occurrences, depth-first. ``rows`` has a row for each
    projected suffix (0 after its end), ``n`` how often it occurs; all rows of a pattern of ``prefix`` + 1 words are here."""
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    stack = [(0, len(rows), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if depth == 0:  # the prefix and the next word at once
            part, width = rows[lo:hi, : prefix + 1], prefix + 1
        else:
            part, width = rows[lo:hi, depth : depth + 1], depth + 1
        starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]).any(axis=1)])) + lo if hi > lo else np.zeros(0, np.int64)
        if not len(starts):
            continue
        sums = np.add.reduceat(n[:hi], starts)
        ends = np.append(starts[1:], hi)
        for i in np.flatnonzero((sums >= least) & (rows[starts, width - 1] != 0))[::-1].tolist():
            a = int(starts[i])
            yield rows[a, :width].tolist(), int(sums[i])
            if width < rows.shape[1]:
                stack.append((a, int(ends[i]), width))


def _grown(least: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rest = table.column("rest").combine_chunks()
        flat = rest.flatten().to_numpy().reshape(table.num_rows, -1)
        rows = np.concatenate([table.column("a").to_numpy()[:, None], table.column("b").to_numpy()[:, None], flat], axis=1)
        found = list(grow(rows, table.column("n").to_numpy(), 2, least))
        return pa.table({"keys": pa.array([k for k, _ in found], pa.list_(pa.int64())), "f": pa.array([f for _, f in found], pa.int64())})

    return run


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    most_words: int = 3,
    least: int = 10,
    inside: int = 50,
    top: int = 2000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of 2 to ``most_words`` words of each language.

    Texts are cut into pieces at BREAKS and those into words at spaces and tabs; A-Z are lowered. ``a`` is how often the
    phrase occurs (at least ``least``, overlaps included), ``l`` and ``r`` how often the two parts of its worst cut do, ``n`` the
    words of the language, and ``score`` floor(10^6 a a / (l r)). A phrase goes if it stands in a longer candidate with at
    least ``inside`` percent of its occurrences. Ranks go by score, then a (descending), then the phrase's bytes.

    A null text has no words, a null language is ``und``, rows that repeat count each, and other columns are not looked at.
    No text, or none with a candidate, gives no row. Counts must be below 10^13 for squares to be exact (else an error).
    """
    if most_words < 2:
        raise ValueError("a phrase has two words at least")
    rows = bounded_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for seed in count():
        words = materialise(rows.mapInArrow(_count_words(seed), "key long, lang string, word string, n long").groupBy("key", "lang", "word").agg(F.sum("n").alias("f")), "words")
        if not words.groupBy("key").count().filter("count > 1").limit(1).count():  # else two words have one key
            break
        release(words)
    frequent = words.filter(F.col("f") >= least)
    pairs = rows.mapInArrow(_count_pairs(seed, sieve(frequent.select("key"), expected=frequent.count())), "a long, b long, n long")
    pairs = materialise(pairs.groupBy("a", "b").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), "pairs")
    phrases = pairs.select(F.array("a", "b").alias("keys"), "f")
    if most_words > 2:
        bits = sieve(pairs.select("a", "b"), lambda b: _pair_key(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64)), pairs.count())
        projected = rows.mapInArrow(_project(seed, bits, most_words - 2), "a long, b long, rest array<long>, n long").groupBy("a", "b", "rest").agg(F.sum("n").alias("n"))
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = projected.withColumn("task", F.pmod(F.xxhash64("a", "b", F.col("rest")[0]), F.lit(tasks)))
        phrases = phrases.unionByName(dealt.groupBy("task").applyInArrow(_grown(least), "keys array<long>, f long"))
    phrases = materialise(phrases, "phrases")

    # the worst cut: the lowest score, then the shortest first part
    parts = frequent.select(F.array("key").alias("keys"), "f", "lang").unionByName(phrases.withColumn("lang", F.lit(None).cast("string")))
    cuts = phrases.select("keys", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("keys") - 1)).alias("k")).select(
        "keys", "a", "k", F.slice("keys", F.lit(1), F.col("k")).alias("first"), F.expr("slice(keys, k + 1, size(keys))").alias("second")
    )
    cut = (
        cuts.join(parts.select(F.col("keys").alias("first"), F.col("f").alias("l"), "lang"), "first")
        .join(parts.select(F.col("keys").alias("second"), F.col("f").alias("r")), "second")
        .withColumn("score", F.expr("(cast(a as decimal(13,0)) * cast(a as decimal(13,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(13,0)) * cast(r as decimal(13,0)))"))
    )
    scored = cut.groupBy("keys", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"), F.max("lang").alias("lang"))

    longer = (
        phrases.filter(F.size("keys") > 2)
        .select("keys", "f", F.explode(F.expr("sequence(2, size(keys) - 1)")).alias("size"))
        .select("f", F.explode(F.expr("transform(sequence(1, size(keys) - size + 1), i -> slice(keys, i, size))")).alias("keys"))
        .groupBy("keys")
        .agg(F.max("f").alias("longer"))
    )
    kept = scored.join(longer, "keys", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).select("keys", "lang", "a", "worst.*")
    # texts are looked up only for what can be among the first; ties at the end stay until the phrases are known. A language is
    # ranked in SALTS parts first, as it may have most of the candidates
    best = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"))
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(SALTS))).withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place", "salt")
    spelled = (
        kept.select("keys", F.posexplode("keys").alias("pos", "key"))
        .join(frequent.select("key", "word"), "key")
        .groupBy("keys")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(spelled, "keys").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
