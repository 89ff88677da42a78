"""Token ids in a content-addressed store.

Documents are encoded, and a rolling hash over their ids cuts each stream into chunks, so that equal
passages give equal chunks wherever they stand. A chunk is stored once, under the hash of its bytes. A
document's recipe lists its chunks; a Merkle root over them verifies that what is read back is what was
written. The manifest holds the recipes in ascending order of the document ids, and the store's root, over
all documents' roots, tells a manifest that lacks a part.

``store/kind=chunk`` has key, n and the ids as little-endian integers of ``WIDTH`` bytes; ``manifest``
has, for each document, start, n_tokens, the chunk keys and the root; ``root`` has one row: the store's root,
its documents and its tokens. All are Parquet files.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.words import mix, sliced, window_hashes
from tessella.session import bounded_batches, materialise, new_path, release

_WHITE = re.compile(r"\s")
KEY = 16
#: A chunk ends where the hash of the last WINDOW ids is 0 modulo MEAN, and after MOST ids.
WINDOW, MEAN, MOST = 8, 256, 4096
#: Encodings of words that a worker keeps (some 200 bytes each), and chunk keys that a task knows it has sent already.
CACHE, SHORT, SENT = 1_000_000, 8, 500_000
#: Bytes of text whose words are looked up together.
SLICE = 4 << 20
#: New words in one string.
TOGETHER = 200


class Encoder:
    """Ids of whole texts with a byte-level BPE of the tokenizers library, as little-endian uint32.

    Its pattern begins a new word at each single space, and parts a single line feed, and a comma or period
    behind a letter, from what is around it. So what lies between these can be encoded apart, and is only
    once while it stays in the cache: new words are encoded together, one string for all, and come apart
    where a token begins with the space before a word. Texts with white space next to white space or at
    an end, where this does not hold, are encoded whole. Strings of special tokens are read as the library reads them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words are encoded once: its own cache only takes time
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = {mark: np.zeros(max(tokens.values()) + 1, bool) for mark in " \n"}
        (space,), (line,) = (self._encode([mark])[0].view("<u4") for mark in " \n")
        # the written form of a space is what the token of a lone space is
        mark = self.tokenizer.id_to_token(int(space))
        self.begins[" "][[i for t, i in tokens.items() if t.startswith(mark)]] = True
        self.begins["\n"][int(line)] = True
        self.marks = {c: self._encode([c])[0].tobytes() for c in ".,"}
        self.cache: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str], mark: str) -> None:
        """New words, which the mark stood before; none has white space at its end. The cache has words after a
        space as they are, and others with their line feed."""
        key = (lambda w: w) if mark == " " else (lambda w: f"\n{w}")
        ended = [w for w in new if w and w[-1] in ".," and w[-2:-1].isalpha() and w[-2] < "\u0250"]
        todo = list((new - set(ended)) | {w for w in (x[:-1] for x in ended) if key(w) not in self.cache})
        if todo:
            ids = np.concatenate(self._encode([mark + mark.join(todo[i : i + TOGETHER]) for i in range(0, len(todo), TOGETHER)]))
            at = np.append(np.flatnonzero(self.begins[mark][ids]), len(ids)) * 4
            raw = ids.tobytes()
            if len(at) != len(todo) + 1:
                raise ValueError("the tokenizer does not begin a word at each mark")
            ends = at.tolist()
            self.cache.update(zip(map(key, todo), (raw[a:b] for a, b in zip(ends, ends[1:], strict=False)), strict=True))
        for w in ended:
            self.cache[key(w)] = self.cache[key(w[:-1])] + self.marks[w[-1]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE:  # short words come again more often
            self.cache = {w: x for w, x in self.cache.items() if len(w) <= SHORT}
            if len(self.cache) > CACHE // 2:
                self.cache.clear()
        if not texts:
            return []
        # a line feed begins a word of its own; every other word has lost its space, also at a text's begin
        parts = pc.split_pattern(pa.array([f"\n{t}".replace("\n", " \n") for t in texts]), " ")
        offsets, coded = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        met = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [*map(self.cache.get, met), b""]
        absent = [i for i, x in enumerate(found) if x is None]
        new = {met[i] for i in absent}
        # white space next to white space, or at an end: such texts have words that are not learnt
        led = {w for w in new if w[:1] == "\n"}
        for words, mark in ((new - led, " "), ({w[1:] for w in led}, "\n")):
            words.discard("")
            if _WHITE.search("".join(words)):
                words = {w for w in words if w.strip() == w}
            self._learn(words, mark)
        unknown = np.zeros(len(found), bool)
        for i in absent:
            found[i] = self.cache.get(met[i], b"")
            unknown[i] = not found[i]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = coded.indices.to_numpy().copy()
        codes[offsets[:-1]] = len(met)  # nothing stands before the first line feed
        alone = np.unique(np.searchsorted(offsets, np.flatnonzero(unknown[codes]), side="right") - 1).tolist()
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        # each word's ids stand in a row at its place
        of_word = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], n)
        ids = np.frombuffer(b"".join(found), "<u4")[of_word + np.arange(len(of_word))]
        bounds = ends[offsets].tolist()
        out = [ids[a + 1 : b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]  # without the line feed put first
        for i, whole in zip(alone, self._encode([texts[i] for i in alone]), strict=True):
            out[i] = whole.tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def cuts(ids: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """Where the chunks of each stream end, counted from its begin. ``ids`` has the streams one after the other,
    parted by ``offsets``; what a stream's chunks are depends on itself alone."""
    ends = np.flatnonzero(window_hashes(mix(ids.astype(np.uint64) + np.uint64(1)), WINDOW) % np.uint64(MEAN) == 0) + WINDOW
    low, high = np.searchsorted(ends, offsets[:-1] + WINDOW), np.searchsorted(ends, offsets[1:], side="right")
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), low.tolist(), high.tolist(), strict=True):
        out, last = [], 0
        for end in [*(ends[i:j] - a).tolist(), b - a]:
            while end - last > MOST:
                last += MOST
                out.append(last)
            if end > last:
                out.append(end)
                last = end
        yield out


def key_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=KEY).digest()


def merkle(keys: list[bytes]) -> bytes:
    """The root over chunk keys: pairs are hashed level by level, a last odd one goes up as it is."""
    level = [key_of(b"leaf" + k) for k in keys]
    while len(level) > 1:
        level = [key_of(b"node" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else key_of(b"empty")


def _cut_all(path: str, end_id: int, width: int):
    """Recipe rows and chunk rows of documents; a chunk that the task has just sent is not sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        sent: set[bytes] = set()
        tail = np.array([end_id], "<u4").tobytes()
        for batch in sliced(batches, 1, SLICE):
            ids = batch.column(0).to_pylist()
            kinds, keys, owners, ns, data = [], [], [], [], []
            streams = [raw + tail for raw in encode([t or "" for t in batch.column(1).to_pylist()])]
            flat = np.frombuffer(b"".join(streams), "<u4")
            if len(flat) and int(flat.max()) >> (8 * width):
                raise ValueError(f"id {int(flat.max())} does not fit in {width} bytes: take a larger width")
            stored = flat.astype(f"<u{width}").tobytes()
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in streams])])
            for i, a, b, ends in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), cuts(flat, offsets), strict=True):
                recipe, last = [], 0
                for end in ends:
                    chunk = stored[(a + last) * width : (a + end) * width]
                    key = key_of(chunk)
                    recipe.append(key)
                    if key not in sent:
                        sent.add(key)
                        kinds.append("chunk")
                        keys.append(key)
                        owners.append(None)
                        ns.append(end - last)
                        data.append(chunk)
                    last = end
                joined = b"".join(recipe)
                kinds.append("recipe")
                keys.append(key_of(joined + repr(i).encode()))
                owners.append(i)
                ns.append(b - a)
                data.append(joined)
            if len(sent) > SENT:
                sent.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(keys, pa.binary()), pa.array(owners, pa.int64()), pa.array(ns, pa.int64()), pa.array(data, pa.binary())],
                names=["kind", "key", "id", "n", "data"],
            )

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of the rows of each chunk: a partition has all of them, next to each other, so only the last key is held."""
    last = None
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), strict=True):
            keep.append(kind != "chunk" or key != last)
            if kind == "chunk":
                last = key
        yield batch.filter(pa.array(keep, pa.bool_()))


_ROW = "kind string, key binary, id long, n long, data binary"


def write_store(docs: DataFrame, tokenizer_path: str, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, width: int = 2) -> str:
    """Encode ``docs`` with the tokenizer at that path (a parameter; the file is on each machine), append
    ``end_id`` to each and write the store; its path is returned (by default one in the shared folder).

    A null or empty text has the end id alone. Rows that repeat are documents of their own; equal ids are
    ordered by length and content. A null id comes first. Other columns are not looked at. ``width`` is the
    bytes of an id in the files: 2 for vocabularies of up to 65,536 ids, else 4; an id that does not fit is a ValueError.
    """
    docs = bounded_batches(docs)
    spark = docs.sparkSession
    out = out or new_path(spark, "token-store")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_cut_all(tokenizer_path, end_id, width), _ROW)
    once = rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_once, _ROW)
    # two folders, both open in a task: no sort by folder before they are written
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "2")
    try:
        once.write.partitionBy("kind").option("compression", "snappy").parquet(f"{out}/store")
    finally:
        spark.conf.set(writers, before)

    recipes = spark.read.schema("key binary, id long, n long, data binary, kind string").parquet(f"{out}/store").filter("kind = 'recipe'").select("id", "n", "data")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = ordinal = 0
        for batch in batches:
            starts, roots = [], []
            for size, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                starts.append(start)
                start += size
                roots.append(merkle([data[i : i + KEY] for i in range(0, len(data), KEY)]))
            places = pa.array(range(ordinal, ordinal + len(starts)), pa.int64())
            ordinal += len(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), places, batch.column("id"), pa.array(starts, pa.int64()), batch.column("n"), batch.column("data"), pa.array(roots, pa.binary())],
                names=["part", "ordinal", "id", "start", "n_tokens", "recipe", "root"],
            )

    ordered = recipes.repartitionByRange(n, F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), "n", "data")
    local = materialise(
        ordered.select("id", "n", "data", F.spark_partition_id().alias("part")).mapInArrow(
            placed, "part int, ordinal long, id long, start long, n_tokens long, recipe binary, root binary"
        ),
        "recipes",
    )
    # one number for each partition
    sizes = {r["part"]: r["n"] for r in local.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    offsets = spark.createDataFrame(offsets, "part int, before long")
    local.join(F.broadcast(offsets), "part").withColumn("start", F.col("start") + F.col("before")).drop("before").write.option("compression", "zstd").parquet(f"{out}/manifest")
    release(local)
    root = _store_root(read_manifest(spark, out))
    spark.createDataFrame([root], "root binary, documents long, n_tokens long").coalesce(1).write.parquet(f"{out}/root")
    return out


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part of the manifest: a hash over its documents' roots in their order. Documents must be
    numbered from 0, and each must start where the one before ends."""
    rows: list[list] = []
    for batch in batches:
        for part, ordinal, start, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "ordinal", "start", "n_tokens", "root")), strict=True):
            if not rows or rows[-1][0] != part:
                rows.append([part, start, start, 0, hashlib.blake2b(b"part", digest_size=KEY)])
            last = rows[-1]
            if ordinal != last[3] or start != last[2]:
                raise ValueError(f"the manifest lacks a document in part {part}")
            last[2], last[3] = start + n, ordinal + 1
            last[4].update(root)
    columns = list(zip(*rows, strict=True)) or [()] * 5
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array([h.digest() for h in columns[4]], pa.binary())],
        names=["part", "start", "end", "documents", "root"],
    )


def _store_root(manifest: DataFrame) -> tuple[bytes, int, int]:
    """(root, documents, tokens) of the manifest; one row for each of its parts reaches the driver."""
    rows = manifest.select("part", "ordinal", "start", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "ordinal")
    parts = sorted(tuple(r) for r in rows.mapInArrow(_part_roots, "part int, start long, end long, documents long, root binary").collect())
    at = documents = 0
    for part, start, end, n, _ in parts:
        if start != at:
            raise ValueError(f"the manifest lacks what comes before part {part}")
        at, documents = end, documents + n
    return merkle([bytes(p[4]) for p in parts]), documents, at


def _checked(width: int):
    """(key, n, crc) of each chunk: its bytes must have the hash that it is stored under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, ns = [], []
            for key, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if key_of(data) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
                ns.append(len(data) // width)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], names=["key", "n", "crc"])

    return run


_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of polynomials modulo that of the public CRC-32, lowest bit first."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint64)
    b = b.astype(np.uint64).copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ _POLY, b >> np.uint64(1))
    return out


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """For n up to MOST: the factor by which n more ids, of 32 bits each, shift a CRC."""
    one = np.array([1 << 31], np.uint64)
    word = one
    x = np.array([1 << 30], np.uint64)
    for _ in range(32):
        word = _times(word, x)
    out = one
    while len(out) <= MOST:  # word is the factor of as many ids as out has
        out = np.concatenate([out, _times(out, word)])
        word = _times(word, word)
    return out


def joined_crcs(crcs: np.ndarray, ns: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The CRC-32 of each document from those of its chunks, one more chunk of all documents at a time."""
    total = np.zeros(len(offsets) - 1, np.uint64)
    counts = np.diff(offsets)
    for j in range(int(counts.max(initial=0))):
        has = np.flatnonzero(counts > j)
        at = offsets[has] + j
        total[has] = _times(_shifts()[ns[at]], total[has]) ^ crcs[at].astype(np.uint64)
    return total


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks = batch.column("chunks")
        offsets = chunks.offsets.to_numpy().astype(np.int64)
        flat = chunks.values
        keys, ns, crcs = flat.field("key").to_pylist(), flat.field("n"), flat.field("crc")
        if ns.null_count:
            raise ValueError("a chunk is missing")
        ns, crcs = ns.to_numpy(), crcs.to_numpy()
        before = np.concatenate([[0], np.cumsum(ns)])
        sizes = before[offsets[1:]] - before[offsets[:-1]]
        ends = offsets.tolist()
        for i, root, size, want, a, b in zip(batch.column("id").to_pylist(), batch.column("root").to_pylist(), sizes.tolist(), batch.column("n_tokens").to_pylist(), ends, ends[1:], strict=False):
            if size != want or merkle(keys[a:b]) != root:
                raise ValueError(f"document {i} is not what was written")
        found = joined_crcs(crcs, ns, offsets)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("id", "start", "n_tokens")), pa.array(found.astype(np.int64), pa.int64()), pa.array(np.diff(offsets), pa.int64())],
            names=["id", "start", "n_tokens", "ids_crc32", "n_chunks"],
        )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, ordinal long, id long, start long, n_tokens long, recipe binary, root binary").parquet(f"{path}/manifest")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, id long, n long, data binary, kind string").parquet(f"{path}/store").filter("kind = 'chunk'").select("key", "n", "data")


def _references(manifest: DataFrame) -> DataFrame:
    """(part, ordinal, id, start, n_tokens, root, pos, key): one row for each chunk of each document."""
    pos = F.explode(F.sequence(F.lit(0), (F.octet_length("recipe") / KEY).cast("int") - 1))
    return manifest.select("*", pos.alias("pos")).withColumn("key", F.expr(f"substring(recipe, pos * {KEY} + 1, {KEY})")).drop("recipe")


def verify_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, n_chunks) of each document, from the files: the store's root, the number of
    documents and their starts are compared at once, then each chunk is read and its hash compared; then recipes,
    lengths and roots. Anything that does not fit raises an error. A chunk of very many documents is one key of
    the join; adaptive execution splits its references, as only they are many."""
    root, documents, tokens = _store_root(read_manifest(spark, path))
    want = spark.read.schema("root binary, documents long, n_tokens long").parquet(f"{path}/root").collect()
    if [(bytes(r["root"]), r["documents"], r["n_tokens"]) for r in want] != [(root, documents, tokens)]:
        raise ValueError("the manifest is not what was written")
    chunks = read_chunks(spark, path).select("key", "data").mapInArrow(_checked(width), "key binary, n long, crc long")
    doc = ["part", "ordinal", "id", "start", "n_tokens", "root"]
    joined = _references(read_manifest(spark, path)).join(chunks, "key", "left")
    by_doc = joined.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "n", "crc"))).alias("chunks"))
    return by_doc.mapInArrow(_verified, "id long, start long, n_tokens long, ids_crc32 long, n_chunks long")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(id, ids): the documents' ids, put together from their chunks. Filter the manifest's ids after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(c["data"] for c in sorted(of, key=lambda c: c["pos"])), f"<u{width}").tolist() for of in batch.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int64()))], names=["id", "ids"])

    joined = _references(read_manifest(spark, path)).join(read_chunks(spark, path).select("key", "data"), "key")
    return joined.groupBy("part", "ordinal", "id").agg(F.collect_list(F.struct("pos", "data")).alias("chunks")).select("id", "chunks").mapInArrow(run, "id long, ids array<long>")
