"""Retrieval: vector, keyword, hybrid and graph-weighted ranking over DataFrames."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.batches import sliced, trimmed
from tessella.session import bounded_batches, materialise, new_path, release

#: Query vectors that are compared with all rows in one scan.
QUERY_BLOCK = 4096
#: Scores that a task holds at once: 8 MB, and a few times that while they are made.
SCORES = 1 << 20


@dataclass(frozen=True)
class RetrievalConfig:
    """What a search does. An unknown mode is ``vector``; more candidates are recalled only if a later step
    (reranking, graph) chooses among them."""

    mode: str = "vector"
    recall_top_k: int = 50
    final_top_k: int = 10
    similarity_threshold: float = 0.0
    vector_weight: float = 0.7
    bm25_weight: float = 0.3
    graph_weight: float = 1.0
    use_rerank: bool = False
    use_graph: bool = False

    def search_mode(self) -> str:
        return self.mode if self.mode in ("vector", "keyword", "hybrid") else "vector"

    def recall_k(self) -> int:
        return max(self.recall_top_k, self.final_top_k) if self.use_rerank or self.use_graph else self.final_top_k


def top_k(scored: DataFrame, k: int, by: list[str], score: str, tie: str) -> DataFrame:
    """The k best of each group with their ``rank``, scores compared at nine places, then by ``tie``."""
    order = Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrix(ids: list[int], embeddings: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(ids, np.int64), np.array(embeddings, float).reshape(len(ids), -1)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of all rows of ``x`` with all rows of ``y``; NaN for a vector without length."""
    with np.errstate(all="ignore"):
        return (x @ y.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :])


def _best_pairs(own: np.ndarray, x: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, threshold: float = -1.0) -> Iterator[pa.RecordBatch]:
    """(query_id, id, score): the k best of some rows for each query, SCORES of rows and queries at a time."""
    step = max(1, SCORES // max(1, len(x)))
    if len(ids) > step:
        for at in range(0, len(ids), step):
            yield from _best_pairs(own, x, ids[at : at + step], matrix[at : at + step], k, threshold)
        return
    scores, found = _cosines(x, matrix), []
    for j, query in enumerate(ids):
        ok = np.flatnonzero(~np.isnan(scores[:, j]) & (scores[:, j] >= threshold))
        best = ok[np.lexsort((own[ok], -np.round(scores[ok, j], 9)))[:k]]
        found.append((np.full(len(best), query, np.int64), own[best], scores[best, j]))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_id", "id", "score"])


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = -1.0) -> DataFrame:
    """(query_id, id, score, rank): the k most cosine-similar of ``vectors`` (id, embedding) for each of
    ``queries``. A vector without length is like none. Queries, a stated set, go in blocks to every task,
    which keeps k rows of each batch; so what is shuffled does not grow with the vectors' dimension."""

    def block(ids: np.ndarray, matrix: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own, x = _matrix(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    yield from _best_pairs(own, x, ids, matrix, k, threshold)

        return run

    asked = queries.select("id", "embedding").filter("embedding is not null").orderBy("id").collect()
    rows = vectors.select("id", "embedding").filter("embedding is not null")
    if not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    found = None
    for at in range(0, len(asked), QUERY_BLOCK):
        part = asked[at : at + QUERY_BLOCK]
        one = rows.mapInArrow(block(*_matrix([r["id"] for r in part], [r["embedding"] for r in part])), "query_id long, id long, score double")
        found = one if found is None else found.unionByName(one)
    return top_k(found, k, ["query_id"], "score", "id")


_TERM = re.compile(r"[a-z0-9_]+|[\u4e00-\u9fff]")
#: Documents of a block of the keyword index, on average; bytes of text whose terms are counted together.
SEGMENT, SLICE = 256, 1 << 20


def terms_of(text: str | None) -> list[str]:
    """Words of ASCII letters, digits and ``_`` with A-Z lowered, and single CJK characters."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dl, terms, tfs) of each text: its length in terms, and its distinct terms with their counts. A task has the terms of
    about SLICE bytes of text at a time."""
    for batch in sliced(batches, 1, SLICE):
        lengths, terms, tfs = [], [], []
        for text in batch.column(1).to_pylist():
            words = terms_of(text)
            own = Counter(words)
            lengths.append(len(words))
            terms.append(list(own))
            tfs.append(list(own.values()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32()))], names=["id", "dl", "terms", "tfs"]
        )


@dataclass(frozen=True)
class KeywordIndex:
    """An inverted index in blocks of documents: a row has a block's ``ids``, its ``terms``, the ``best`` weight of each there, and
    where each term's postings (``docs``: places in ids, ``weights``) ``stop``. ``terms``: the number of documents of each."""

    blocks: DataFrame
    terms: DataFrame
    n: int
    id_type: str


def _block(avgdl: float, k1: float, b: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = pc.list_flatten(table.column("terms")).combine_chunks().dictionary_encode()
        doc = np.repeat(np.arange(table.num_rows), pc.list_value_length(table.column("terms")).to_numpy())
        tf, dl = pc.list_flatten(table.column("tfs")).to_numpy().astype(float), table.column("dl").to_numpy().astype(float)
        weights = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / (avgdl or 1.0)))
        order = np.argsort(flat.indices.to_numpy(), kind="stable")
        sizes = np.bincount(flat.indices.to_numpy(), minlength=len(flat.dictionary))
        stop = np.cumsum(sizes)
        best = np.maximum.reduceat(weights[order], stop - sizes) if len(order) else np.zeros(0)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.table(
            {
                "ids": pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type)),
                "terms": pa.array([flat.dictionary.to_pylist()], pa.list_(pa.string())),
                "best": one(best, pa.float64()),
                "stop": one(stop.astype(np.int32), pa.int32()),
                "docs": one(doc[order].astype(np.int32), pa.int32()),
                "weights": one(weights[order], pa.float64()),
            }
        )

    return run


def keyword_index(docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> KeywordIndex:
    """The inverted index of the documents (id, text), written to the shared folder once. Documents are dealt to blocks of about
    SEGMENT by a hash of the id (rows that share an id, by their text too); null and empty texts count for lengths alone."""
    kind = docs.schema["id"].dataType.simpleString()
    texts = bounded_batches(docs).select("id", "text")
    counted = materialise(texts.mapInArrow(trimmed(_counted), f"id {kind}, dl long, terms array<string>, tfs array<int>"), "counted")
    n, avgdl = counted.agg(F.count("*"), F.avg("dl")).first()
    dealt = counted.withColumn("block", F.pmod(F.xxhash64("id", "terms"), F.lit(max(1, -(-n // SEGMENT)))))
    shape = f"ids array<{kind}>, terms array<string>, best array<double>, stop array<int>, docs array<int>, weights array<double>"
    blocks = materialise(dealt.groupBy("block").applyInArrow(_block(avgdl or 0.0, k1, b), shape), "keyword-index")
    size = F.col("stop")[F.col("i")] - F.when(F.col("i") == 0, 0).otherwise(F.col("stop")[F.col("i") - 1])
    terms = blocks.select("stop", F.posexplode("terms").alias("i", "term")).select("term", size.alias("df")).groupBy("term").agg(F.sum("df").alias("df"))
    terms = materialise(terms, "keyword-terms")
    release(counted)
    return KeywordIndex(blocks, terms, n, kind)


def _search(asked: pa.Array, ids: list, idf: np.ndarray, queries: np.ndarray, first: np.ndarray, k: int):
    """The k best rows of each query in a task. The queries that ask for term c are ``queries[first[c]:first[c + 1]]``. A query is
    left out of a block whose best weights cannot reach its k-th row so far."""

    def expand(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of these terms, its queries; and which of the terms that is."""
        per = first[terms + 1] - first[terms]
        which = np.repeat(np.arange(len(terms)), per)
        return queries[np.repeat(first[terms] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))], which

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_of, s_of, r_of, d_of = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, object)
        least, kind = np.full(len(ids), -1.0), None
        for batch in batches:
            kind = batch.column("ids").type.value_type
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                code = pc.index_in(part.column("terms").flatten(), value_set=asked)
                at = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                if not len(at):
                    continue
                terms = code.take(pa.array(at)).to_numpy()
                q, which = expand(terms)
                most = np.bincount(q, (idf[terms] * part.column("best").flatten().to_numpy()[at])[which], len(ids))
                active = (most > 0) & (np.round(most, 9) + 1e-9 >= least)
                if not active.any():
                    continue
                row_of = np.cumsum(active) - 1
                alive = active[q]
                q, which = row_of[q[alive]], which[alive]
                used = np.unique(which)  # terms with a query left
                stop = part.column("stop").flatten().to_numpy()
                start = np.concatenate([[0], stop[:-1]])[at[used]].astype(np.int64)
                sizes = stop[at[used]] - start
                where = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                docs, owner = part.column("docs").flatten().to_numpy()[where], np.repeat(used, sizes)
                weight = part.column("weights").flatten().to_numpy()[where] * idf[terms[owner]]
                own = part.column("ids").flatten()
                scores = np.zeros((int(active.sum()), len(own)))
                # each query adds its terms' postings: postings of a term are next to each other
                begin = np.searchsorted(owner, which)
                size = np.searchsorted(owner, which, side="right") - begin
                src = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                scores.ravel()[:] = np.bincount(np.repeat(q, size) * len(own) + docs[src], weight[src], scores.size)
                rounded = np.round(scores, 9)
                here = np.flatnonzero(active)
                bar = least[here]
                if len(own) > k:
                    bar = np.maximum(bar, np.partition(rounded, -k, axis=1)[:, -k])
                row, col = np.nonzero((scores > 0) & (rounded >= bar[:, None]))
                if not len(row):
                    continue
                names = np.array(own.to_pylist(), object)
                q_of, s_of = np.concatenate([q_of, here[row]]), np.concatenate([s_of, scores[row, col]])
                r_of, d_of = np.concatenate([r_of, rounded[row, col]]), np.concatenate([d_of, names[col]])
                keep = _first_k(q_of, r_of, d_of, k)
                q_of, s_of, r_of, d_of = q_of[keep], s_of[keep], r_of[keep], d_of[keep]
                full = np.bincount(q_of, minlength=len(ids)) >= k
                last = np.append(np.flatnonzero(np.diff(q_of)), len(q_of) - 1)
                least[q_of[last]] = np.where(full[q_of[last]], r_of[last], -1.0)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[q_of]), pa.array(d_of.tolist(), kind), pa.array(s_of)], names=["query_id", "id", "score"])

    return run


def _first_k(q: np.ndarray, rounded: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k first rows by score, then by id, in that order. A null id comes first."""
    by_name = np.array(sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] if names[i] is not None else 0)), np.int64)
    order = by_name[np.lexsort((-rounded[by_name], q[by_name]))]
    sorted_q = q[order]
    begin = np.searchsorted(sorted_q, sorted_q)
    return order[np.arange(len(order)) - begin < k]


def keyword_top_k(index: KeywordIndex, queries: DataFrame, k: int, drop_ratio: float = 0.0) -> DataFrame:
    """(query_id, id, score, rank): the k best documents by BM25 that have a term of a query (query_id, text).

    Of a query's terms that occur at all, the floor(``drop_ratio`` times their number) with the least weight are left out (ties: the
    first by name). Queries, a stated set, go in blocks with their terms to every task, which reads its blocks of the index
    once, skips what cannot be among the k best, and passes on k rows of a query. The numbers of documents of the asked terms
    are all that comes back before. No score threshold applies to keyword search."""
    spark = queries.sparkSession
    stated = queries.select("query_id", "text").orderBy("query_id").collect()
    found = None
    for at in range(0, len(stated), QUERY_BLOCK):
        part = stated[at : at + QUERY_BLOCK]
        wanted = [sorted(set(terms_of(r["text"]))) for r in part]
        names = spark.createDataFrame([(w,) for w in sorted({w for of in wanted for w in of})], "term string")
        df = {r["term"]: r["df"] for r in index.terms.join(names, "term").collect()}  # asked terms only
        for q, of in enumerate(wanted):
            known = [w for w in of if w in df]
            dropped = set(sorted(known, key=lambda w: (-df[w], w))[: int(drop_ratio * len(known))])
            wanted[q] = [w for w in known if w not in dropped]
        asked = sorted({w for of in wanted for w in of})
        codes = {w: c for c, w in enumerate(asked)}
        pairs = sorted((codes[w], q) for q, of in enumerate(wanted) for w in of)
        first = np.searchsorted(np.array([c for c, _ in pairs], np.int64), np.arange(len(asked) + 1))
        counts = np.array([df[w] for w in asked], float)
        idf = np.log(1 + (index.n - counts + 0.5) / (counts + 0.5))
        search = _search(pa.array(asked, pa.string()), [r["query_id"] for r in part], idf, np.array([q for _, q in pairs], np.int64), first, k)
        one = index.blocks.mapInArrow(trimmed(search), f"query_id long, id {index.id_type}, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], f"query_id long, id {index.id_type}, score double, rank int")
    return top_k(found, k, ["query_id"], "score", "id")


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, drop_ratio: float = 0.0) -> DataFrame:
    """``keyword_top_k`` over an index of ``docs`` (id, text) made for it."""
    return keyword_top_k(keyword_index(docs, k1, b), queries, k, drop_ratio)


def min_max(scored: DataFrame) -> DataFrame:
    """Scores of each query scaled to 0..1; all 1 where they are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def weighted_hybrid(vector: DataFrame, keyword: DataFrame, config: RetrievalConfig) -> DataFrame:
    """(query_id, id, score) of two candidate lists: the weighted sum of scaled scores, 0 where a list lacks the
    row, not below the threshold."""
    v = min_max(vector.select("query_id", "id", "score")).withColumnRenamed("score", "v")
    w = min_max(keyword.select("query_id", "id", "score")).withColumnRenamed("score", "w")
    both = v.join(w, ["query_id", "id"], "full_outer")
    score = config.vector_weight * F.coalesce("v", F.lit(0.0)) + config.bm25_weight * F.coalesce("w", F.lit(0.0))
    return both.select("query_id", "id", score.alias("score")).filter(F.col("score") >= config.similarity_threshold)


def reciprocal_rank_fusion(lists: list[tuple[str, float, DataFrame]], constant: int = 60) -> DataFrame:
    """(query_id, id, score, sources) of named, weighted lists with ranks from 1: the sum of weight / (60 + rank).
    Sources are in the order of the lists; negative weights count as 0."""
    parts = None
    for i, (name, weight, ranked) in enumerate(lists):
        one = ranked.select("query_id", "id", F.lit(i).alias("list"), F.lit(name).alias("name"), (F.lit(max(0.0, weight)) / (constant + F.col("rank"))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    names = F.transform(F.array_sort(F.collect_set(F.struct("list", "name"))), lambda x: x["name"])
    return parts.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.array_join(names, ",").alias("sources"), F.min("list").alias("first_list"))


def seed_weights(entity_hits: DataFrame, triple_hits: DataFrame, chunk_entities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, entity_id, weight) that sum to 1 (for each query, with ``by``): 1.0 of each entity hit's score, 0.8 of a triple's for
    both of its ends, 0.3 of a chunk's for the entities in it; negative scores count as 0. Empty if all are 0."""
    by = by or []
    at_least_0 = lambda c: F.greatest(F.lit(0.0), F.col(c))
    parts = (
        entity_hits.select(*by, "entity_id", at_least_0("score").alias("w"))
        .unionByName(triple_hits.select(*by, F.explode(F.array("source_id", "target_id")).alias("entity_id"), (0.8 * at_least_0("score")).alias("w")))
        .unionByName(chunk_entities.select(*by, "entity_id", (0.3 * at_least_0("score")).alias("w")))
    )
    sums = parts.groupBy(*by, "entity_id").agg(F.sum("w").alias("w"))
    total = sums.groupBy(*by).agg(F.sum("w").alias("total")).filter("total > 0")
    joined = sums.join(total, by) if by else sums.join(F.broadcast(total))
    return joined.select(*by, "entity_id", (F.col("w") / F.col("total")).alias("weight"))


def rerank_order(found: DataFrame, config: RetrievalConfig) -> DataFrame:
    """The final rows of each query by rerank score, where there is one, else by score; then by id."""
    order = Window.partitionBy("query_id").orderBy(F.coalesce("rerank_score", "score").desc(), "id")
    return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= config.final_top_k)


def hydrate(found: DataFrame, files: DataFrame) -> DataFrame:
    """Each row with its file's name and chunk count; rows whose file is gone are dropped."""
    return found.join(files.select("file_id", "filename", "chunk_count"), "file_id")


@dataclass(frozen=True)
class CoarseIndex:
    """Vectors by list (the nearest center within the nearest cell), written by cell and sorted by list; and how many lists to read."""

    centers: np.ndarray  # of all lists
    cell_of: np.ndarray  # of each list
    rows: DataFrame  # id, embedding, list, cell
    probes: int


def probes_for(centers: np.ndarray, sample: np.ndarray, k: int, recall: float, tried: int = 256, lists: np.ndarray | None = None) -> int:
    """The fewest lists to read so that, within the sample, the mean share of the k nearest vectors that are found is at least
    ``recall``; the first ``tried`` vectors are the queries. ``lists`` has the list of each, by default that of the nearest center."""
    lists = _by_distance(centers, sample)[:, 0] if lists is None else lists
    scores = np.nan_to_num(_cosines(sample[:tried], sample), nan=-2.0)
    nearest = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    place = np.argsort(_by_distance(centers, sample[:tried]), axis=1)  # of each list in the query's order
    needed = np.sort(np.take_along_axis(place, lists[nearest], axis=1), axis=None)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1.0)


def _by_distance(centers: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The centers from the nearest on, for each row."""
    return np.argsort((centers * centers).sum(axis=1)[None, :] - 2 * _unit(x) @ centers.T, axis=1, kind="stable")


def _means(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """At most k centers of the rows by k-means: the first ones drawn far apart, then means of the nearest."""
    rng, centers = np.random.default_rng(seed), x[:1]
    far = ((x - centers[0]) ** 2).sum(axis=1)
    while len(centers) < min(k, len(x)) and far.sum() > 0:
        centers = np.concatenate([centers, x[rng.choice(len(x), p=far / far.sum())][None]])
        far = np.minimum(far, ((x - centers[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = np.argmin((centers * centers).sum(axis=1)[None, :] - 2 * x @ centers.T, axis=1)
        sizes = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    return centers


def _lists_of(x: np.ndarray, cells: np.ndarray, centers: np.ndarray, cell_of: np.ndarray) -> np.ndarray:
    """The list of each vector: the nearest cell, then the nearest of its lists."""
    out, own = np.zeros(len(x), np.int64), _by_distance(cells, x)[:, 0]
    for c in np.unique(own):
        here, lists = own == c, np.flatnonzero(cell_of == c)
        out[here] = lists[_by_distance(centers[lists], x[here])[:, 0]]
    return out


def coarse_index(vectors: DataFrame, k: int = 10, recall: float = 0.95, lists: int | None = None, sample_rows: int = 10_000, list_rows: int = 40, seed: int = 7) -> CoarseIndex:
    """A partition of the vectors by direction on two levels, with about the square root of their number of lists if not given,
    dealt to cells, of which there are the square root of the lists.

    The cells' centers are fitted on at most ``sample_rows`` vectors, by a hash of the id; those of a cell's lists in one task
    a cell, on about ``list_rows`` of its vectors for each list, by a hash too. Centers of all lists reach the driver (at a thousand
    million vectors 32,000). The lists to read are as many as find ``recall`` of the k nearest within the sample. Every vector
    that is not null is written, by cell, so that a search reads the cells of its lists only, and sorted by list within."""
    spark = vectors.sparkSession
    points = vectors.filter("embedding is not null").select("id", "embedding")
    own = np.array([r["embedding"] for r in points.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("embedding").collect()], float)
    if not len(own):
        return CoarseIndex(np.zeros((0, 0)), np.zeros(0, np.int64), points.filter("false").select("id", "embedding", F.lit(0).alias("list"), F.lit(0).alias("cell")), 0)
    n = points.count()
    lists = lists or max(1, min(int(np.sqrt(n)), n // list_rows))
    cells = _means(_unit(own), max(1, int(np.sqrt(lists))), seed)
    kind, wide = (points.schema[c].dataType.simpleString() for c in ("id", "embedding"))

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            cell = _by_distance(cells, x)[:, 0] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "embedding", "cell"])

    celled = materialise(points.mapInArrow(in_cells, f"id {kind}, embedding {wide}, cell int"), "cells")
    sizes = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}
    share = {c: max(1, round(lists * size / n)) for c, size in sizes.items()}
    part = F.create_map(*(F.lit(v) for c, m in share.items() for v in (c, min(1.0, list_rows * m / sizes[c]))))
    sample = celled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (1 << 20) * part[F.col("cell")])

    def split(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        found = _means(_unit(np.array(table.column("embedding").to_pylist(), float)), share[cell], seed)
        return pa.table({"cell": pa.array([cell] * len(found), pa.int32()), "center": pa.array(list(found), pa.list_(pa.float64()))})

    made = sorted((r["cell"], tuple(r["center"])) for r in sample.groupBy("cell").applyInArrow(split, "cell int, center array<double>").collect())
    for c in sizes.keys() - {c for c, _ in made}:  # none of a small cell was drawn
        made.append((c, tuple(cells[c])))
    cell_of, centers = np.array([c for c, _ in made], np.int64), np.array([x for _, x in made])

    def in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cell = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1), batch.column(2).to_numpy()
            found = np.zeros(batch.num_rows, np.int32)
            for c in np.unique(cell):
                mine = np.flatnonzero(cell_of == c)
                found[cell == c] = mine[_by_distance(centers[mine], x[cell == c])[:, 0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), batch.column(2)], names=["id", "embedding", "list", "cell"])

    shape = f"id {kind}, embedding {wide}, list int, cell int"
    path = new_path(spark, "vector-index")
    dealt = celled.mapInArrow(in_lists, shape).repartition("list").sortWithinPartitions("cell", "list")
    dealt.write.partitionBy("cell").option("compression", "zstd").parquet(path)
    release(celled)
    rows = spark.read.schema(shape).parquet(path).select("id", "embedding", "list", "cell")
    return CoarseIndex(centers, cell_of, rows, probes_for(centers, own, k, recall, lists=_lists_of(own, cells, centers, cell_of)))


def indexed_top_k(index: CoarseIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """As ``vector_top_k``, with only the ``probes`` nearest lists of each query compared (if not given, the index's number)."""

    def block(ids: np.ndarray, matrix: np.ndarray, of_list: dict[int, np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, x = _matrix(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                lists = batch.column(2).to_numpy()
                for c in np.unique(lists):
                    if len(asking := of_list.get(int(c), ())):
                        here = lists == c
                        yield from _best_pairs(own[here], x[here], ids[asking], matrix[asking], k)

        return run

    asked = queries.select("id", "embedding").filter("embedding is not null").orderBy("id").collect()
    found = None
    for at in range(0, len(asked), QUERY_BLOCK):
        part = asked[at : at + QUERY_BLOCK]
        ids, matrix = _matrix([r["id"] for r in part], [r["embedding"] for r in part])
        if not len(index.centers):
            break
        near = _by_distance(index.centers, matrix)[:, : probes or index.probes]
        of_list = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        wanted = sorted({int(index.cell_of[c]) for c in of_list})  # folders that are not read at all
        rows = index.rows.filter(F.col("cell").isin(wanted) & F.col("list").isin([*of_list])).select("id", "embedding", "list")
        one = rows.mapInArrow(block(ids, matrix, of_list), "query_id long, id long, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    return top_k(found, k, ["query_id"], "score", "id")
