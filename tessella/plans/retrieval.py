"""Retrieval queries: chunks are ``documents``, vectors ``embeddings``, questions ``benchmark``.

The query vectors are those whose id is divisible by 100, a stated query set against all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import graph as G
from tessella.operators import models as M
from tessella.operators import retrieval as R
from tessella.plans.registry import Registry, Tables, push_sql
from tessella.session import materialise

query = Registry()
QUERIES, SQL = query.queries, query.sql

TOKEN_SQL = r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]"

_BM25 = rf"""
    d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}'), lambda x: lower(x)) AS ws FROM documents),
    st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d),
    q AS (SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}'), lambda x: lower(x))) AS term FROM benchmark),
    p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    bm AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM q JOIN p USING (term) JOIN f USING (term), st GROUP BY item_id, doc_id),
    bmr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)"""

_FILTERED = _BM25.replace("FROM documents)", "FROM documents WHERE contains(lower(source), 'src1'))")


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


def asked(t: Tables) -> DataFrame:
    return vectors(t).filter("id % 100 = 0")


def texts(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


_VEC = """
    v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    cs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label AS ql, v.label AS vl,
        list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)) AS score
      FROM v q, v WHERE q.vec_id % 100 = 0),
    vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM cs)"""


@query("vec_topk", f"WITH {_VEC} SELECT query_id, id, round(score, 6) AS score, rank FROM vr WHERE rank <= 10")
def vec_topk(t: Tables) -> DataFrame:
    return R.vector_top_k(vectors(t), asked(t), 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("vec_threshold", f"WITH {_VEC} SELECT query_id, id, round(score, 6) AS score FROM vr WHERE rank <= 50 AND score >= 0.2")
def vec_threshold(t: Tables) -> DataFrame:
    return R.vector_top_k(vectors(t), asked(t), 50, threshold=0.2).select("query_id", "id", F.round("score", 6).alias("score"))


@query("vec_ivf")
def vec_ivf(t: Tables) -> DataFrame:
    return R.indexed_top_k(R.coarse_index(vectors(t)), asked(t), 10)


@query("bm25_topk", f"WITH {_BM25} SELECT item_id AS query_id, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    found = R.bm25_top_k(texts(t), questions(t), 10)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(
    "bm25_drop_ratio",
    f"""
    WITH {_BM25.split("bm AS (")[0]}
    w AS (SELECT item_id, term, df, row_number() OVER (PARTITION BY item_id ORDER BY df DESC, term) AS place, count(*) OVER (PARTITION BY item_id) AS terms FROM q JOIN f USING (term)),
    bm AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM (SELECT * FROM w WHERE place > floor(0.4 * terms)) JOIN p USING (term), st GROUP BY item_id, doc_id),
    bmr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
    SELECT item_id AS query_id, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10""",
)
def bm25_drop_ratio(t: Tables) -> DataFrame:
    """The two fifths of each question's terms that weigh least are left out."""
    found = R.bm25_top_k(texts(t), questions(t), 10, drop_ratio=0.4)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def chunks(t: Tables) -> DataFrame:
    """(id, text, embedding): the documents that have a vector of the same id."""
    return t.documents.select(F.col("doc_id").alias("id"), "text").join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id")


def question_vectors(t: Tables) -> DataFrame:
    """A question's vector is that of its id."""
    return vectors(t).join(t.benchmark.select(F.col("item_id").alias("id")), "id", "left_semi")


_CHUNKS = rf"""
    ch AS (SELECT doc_id, text, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM documents JOIN embeddings ON doc_id = vec_id),
    qv AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
    cs AS (SELECT q.vec_id AS query_id, c.doc_id AS id, list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(c.e, c.e)) AS score FROM qv q, ch c),
    vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM cs),
    {_BM25.replace("FROM documents)", "FROM ch)")},
    kr AS (SELECT item_id AS query_id, doc_id AS id, score, rank FROM bmr)"""


@query(
    "hybrid",
    f"""
    WITH {_CHUNKS},
    a AS (SELECT query_id, id, score, min(score) OVER w AS lo, max(score) OVER w AS hi FROM vr WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)),
    b AS (SELECT query_id, id, score, min(score) OVER w AS lo, max(score) OVER w AS hi FROM kr WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)),
    x AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id,
        0.7 * coalesce(CASE WHEN a.hi = a.lo THEN 1.0 ELSE (a.score - a.lo) / (a.hi - a.lo) END, 0)
        + 0.3 * coalesce(CASE WHEN b.hi = b.lo THEN 1.0 ELSE (b.score - b.lo) / (b.hi - b.lo) END, 0) AS score
      FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id)
    SELECT query_id, id, round(score, 6) AS score FROM x WHERE score >= 0.2001
    """,
)
def hybrid(t: Tables) -> DataFrame:
    """Vector and keyword search over the same chunks, for each question."""
    config = R.RetrievalConfig(mode="hybrid", similarity_threshold=0.2001)
    of = chunks(t)
    found = R.weighted_hybrid(R.vector_top_k(of, question_vectors(t), 50), R.bm25_top_k(of, questions(t), 50), config)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


#: The push stops at this share of a node's degree; the SQL unrolls as many rounds as end it on these tables, and some more.
_RESIDUAL, _PUSH_ROUNDS = 5e-4, 30


#: The graph: chunks mention their source and their words of over six letters, and each two of these that follow each other in
#: a chunk are a triple. A question's seeds are the entities and triples that it holds, the rarest ten of each, and the entities
#: of the five chunks that keyword search finds.
_GRAPH = rf"""
    {_CHUNKS},
    cw AS MATERIALIZED (SELECT doc_id AS chunk_id, source, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{7,}}') AS ws FROM documents WHERE doc_id IN (SELECT doc_id FROM ch)),
    men AS MATERIALIZED (SELECT DISTINCT chunk_id, unnest(list_concat(['source ' || source], ws)) AS entity FROM cw),
    tri AS MATERIALIZED (SELECT p.a AS a, p.b AS b, count(DISTINCT chunk_id) AS n FROM (SELECT chunk_id, unnest(list_transform(range(1, len(ws)), lambda i: {{'a': ws[i], 'b': ws[i + 1]}})) AS p FROM cw) WHERE p.a <> p.b GROUP BY ALL),
    df AS MATERIALIZED (SELECT entity, count(*) AS n FROM men GROUP BY entity),
    qw AS MATERIALIZED (SELECT item_id AS q, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{7,}}') AS ws FROM benchmark),
    eh AS (SELECT q, entity, 1 / (1 + ln(n)) AS score FROM (SELECT DISTINCT q, unnest(ws) AS entity FROM qw) JOIN df USING (entity)
      QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(1 / (1 + ln(n)), 9) DESC, entity) <= 10),
    th AS (SELECT q, a, b, 1 / (1 + ln(n)) AS score FROM (SELECT DISTINCT q, p.a AS a, p.b AS b FROM (SELECT q, unnest(list_transform(range(1, len(ws)), lambda i: {{'a': ws[i], 'b': ws[i + 1]}})) AS p FROM qw)) JOIN tri USING (a, b)
      QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(1 / (1 + ln(n)), 9) DESC, a, b) <= 10),
    kc AS (SELECT query_id AS q, id, score / max(score) OVER (PARTITION BY query_id) AS score FROM kr WHERE rank <= 5),
    hit AS (SELECT q, entity AS id, score AS w FROM eh UNION ALL SELECT q, unnest([a, b]), 0.8 * score FROM th
      UNION ALL SELECT q, entity, 0.3 * score FROM kc JOIN men ON chunk_id = id),
    seed AS MATERIALIZED (SELECT q, id, sum(w) / any_value(t) AS w FROM (SELECT *, sum(w) OVER (PARTITION BY q) AS t FROM hit) GROUP BY q, id),
    ways AS MATERIALIZED (SELECT 'chunk ' || chunk_id AS src, entity AS dst FROM men UNION SELECT entity, 'chunk ' || chunk_id FROM men UNION SELECT a, b FROM tri UNION SELECT b, a FROM tri),
    deg AS MATERIALIZED (SELECT src, count(*) AS d FROM ways GROUP BY src),
    {push_sql(_PUSH_ROUNDS, _RESIDUAL)},
    gr AS (SELECT q AS query_id, CAST(substr(id, 7) AS BIGINT) AS id, p + 0.15 * r AS score, row_number() OVER (PARTITION BY q ORDER BY round(p + 0.15 * r, 9) DESC, CAST(substr(id, 7) AS BIGINT)) AS rank
      FROM s{_PUSH_ROUNDS} WHERE id LIKE 'chunk %' AND p + r > 0)"""


def _long_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{7,}"), F.lit(0))


def _neighbours(words: str) -> Column:
    """(a, b) of each two words that follow each other and differ."""
    return F.expr(f"filter(transform(sequence(1, size({words}) - 1), i -> struct({words}[i - 1] as a, {words}[i] as b)), p -> p.a <> p.b)")


def _pairs(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.filter(F.size("ws") > 1).select(*keep, F.explode(_neighbours("ws")).alias("p")).select(*keep, "p.a", "p.b")


def _graph_chunks(t: Tables, k: int) -> DataFrame:
    """(query_id, id, score, rank) for each question: its entities, triples and chunks give weight to entities, these seed a
    walk over the whole graph, and the chunks where it stays most are found."""
    of = materialise(chunks(t), "chunks")
    words = t.documents.select(F.col("doc_id").alias("chunk_id"), "source", _long_words(F.col("text")).alias("ws"))
    words = materialise(words.join(of.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"), "chunk-words")
    mentions = materialise(words.select("chunk_id", F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("source "), "source")), "ws"))).alias("entity_id")), "mentions")
    triples = materialise(_pairs(words, "chunk_id").distinct().groupBy("a", "b").agg(F.count("*").alias("n")), "triples")
    rarity = (1 / (1 + F.log("n"))).alias("score")
    asked_words = t.benchmark.select(F.col("item_id").alias("query_id"), _long_words(F.col("text")).alias("ws"))
    found_entities = asked_words.select("query_id", F.explode(F.array_distinct("ws")).alias("entity_id")).join(mentions.groupBy("entity_id").agg(F.count("*").alias("n")), "entity_id")
    entities = R.top_k(found_entities.select("query_id", "entity_id", rarity), 10, ["query_id"], "score", "entity_id")
    found_triples = _pairs(asked_words, "query_id").distinct().join(triples, ["a", "b"]).select("query_id", F.col("a").alias("source_id"), F.col("b").alias("target_id"), rarity)
    by_ends = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "source_id", "target_id")
    found_triples = found_triples.withColumn("rank", F.row_number().over(by_ends)).filter("rank <= 10")
    hits = R.bm25_top_k(of, questions(t), 5).withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    in_chunks = hits.select("query_id", F.col("id").alias("chunk_id"), "score").join(mentions, "chunk_id").select("query_id", "entity_id", "score")
    seeds = R.seed_weights(entities, found_triples, in_chunks, by=["query_id"])
    edges = mentions.select(F.concat(F.lit("chunk "), "chunk_id").alias("src"), F.col("entity_id").alias("dst")).unionByName(triples.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    ways = G.PushWays(edges, _RESIDUAL, asked=F.col("id").startswith("chunk "))
    scores = G.pushed_pagerank(None, seeds.withColumnRenamed("entity_id", "id"), ways=ways)
    ways.release()
    ranked = scores.filter(F.col("id").startswith("chunk ")).select("query_id", F.substring("id", 7, 20).cast("long").alias("id"), "score")
    return R.top_k(ranked, k, ["query_id"], "score", "id")


@query("graph_retrieve", f"WITH {_GRAPH} SELECT query_id, id, round(score, 8) AS score, rank FROM gr WHERE rank <= 20")
def graph_retrieve(t: Tables) -> DataFrame:
    return _graph_chunks(t, 20).select("query_id", "id", F.round("score", 8).alias("score"), F.col("rank").cast("long"))


@query(
    "rrf_fuse",
    f"""
    WITH {_GRAPH},
    u AS (SELECT query_id, id, rank, 'chunk' AS src, 1.0 AS w FROM vr WHERE rank <= 20 UNION ALL SELECT query_id, id, rank, 'graph', 0.5 FROM gr WHERE rank <= 20)
    SELECT query_id, id, round(sum(w / (60 + rank)), 9) AS score, string_agg(src, ',' ORDER BY src) AS sources FROM u GROUP BY query_id, id
    """,
)
def rrf_fuse(t: Tables) -> DataFrame:
    """The vector and the graph results of each question."""
    by_vector = R.vector_top_k(chunks(t), question_vectors(t), 20)
    found = R.reciprocal_rank_fusion([("chunk", 1.0, by_vector), ("graph", 0.5, _graph_chunks(t, 20))])
    return found.select("query_id", "id", F.round("score", 9).alias("score"), "sources")


def files(t: Tables) -> DataFrame:
    """Files of the knowledge base: those documents that have a label, with a chunk for each line."""
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    own = t.documents.select(F.col("doc_id").alias("file_id"), name.alias("filename"), lines.cast("long").alias("chunk_count"))
    return own.join(t.labels.select(F.col("doc_id").alias("file_id")).distinct(), "file_id", "left_semi")


@query(
    "hydrate",
    f"""
    WITH {_BM25}
    SELECT item_id AS query_id, doc_id AS file_id, round(score, 6) AS score, source || '/' || doc_id || '.md' AS filename, len(string_split(coalesce(text, ''), chr(10))) AS chunk_count
    FROM bmr JOIN documents USING (doc_id) WHERE rank <= 10 AND doc_id IN (SELECT doc_id FROM labels)
    """,
)
def hydrate(t: Tables) -> DataFrame:
    found = R.bm25_top_k(texts(t), questions(t), 10)
    return R.hydrate(found.select("query_id", F.col("id").alias("file_id"), F.round("score", 6).alias("score")), files(t))


@query(
    "file_filter",
    f"WITH {_FILTERED} SELECT item_id AS query_id, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10",
)
def file_filter(t: Tables) -> DataFrame:
    """The filter on file names comes before scoring: other files count neither for n nor for df."""
    wanted = t.documents.filter(F.lower("source").contains("src1")).select(F.col("doc_id").alias("id"))
    found = R.bm25_top_k(texts(t).join(wanted, "id", "left_semi"), questions(t), 10)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(
    "rerank_sort",
    f"""
    WITH {_VEC}, x AS (SELECT *, CASE WHEN ql = vl THEN 1 / (1 + exp(-(score * 4 - 1))) END AS rr FROM vr WHERE rank <= 20),
    y AS (SELECT query_id, id, round(rr, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(round(rr, 6), round(score, 6)) DESC, id) AS position FROM x)
    SELECT * FROM y WHERE position <= 10
    """,
)
def rerank_sort(t: Tables) -> DataFrame:
    """A reranker scores rows of the query's label (a sigmoid of its output); others keep their own score."""
    label = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    found = R.vector_top_k(vectors(t), asked(t), 20).join(label, "id").join(label.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    sigmoid = F.round(1 / (1 + F.exp(-(F.col("score") * 4 - 1))), 6)
    scored = found.select("query_id", "id", F.round("score", 6).alias("score"), F.when(F.col("label") == F.col("ql"), sigmoid).alias("rerank_score"))
    out = R.rerank_order(scored, R.RetrievalConfig(use_rerank=True))
    return out.select("query_id", "id", "rerank_score", F.col("position").cast("long"))


@query(
    "rerank",
    f"""
    WITH {_BM25}, x AS (SELECT item_id, doc_id, CAST(floor((row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1) / 32) AS BIGINT) AS batch FROM bmr WHERE rank <= 40),
    y AS (SELECT item_id, doc_id, length(coalesce(text, '')) AS n, max(CASE WHEN length(coalesce(text, '')) = 0 OR doc_id % 50 = 7 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id, batch) AS failed FROM x JOIN documents USING (doc_id))
    SELECT item_id AS query_id, doc_id, round(1 / (1 + exp(-CASE WHEN failed = 1 THEN 0.5 ELSE n / 10000 END)), 9) AS score FROM y
    """,
)
def rerank(t: Tables) -> DataFrame:
    """Batches of a question and 32 texts; the rule in place of a model scores by length, and fails for texts that some ids have."""
    found = R.bm25_top_k(texts(t), questions(t), 40).select("query_id", F.col("id").alias("doc_id"))
    joined = found.join(t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").withColumn("text", F.concat(F.col("doc_id").cast("string"), F.lit("|"), "text"))

    def by_length(pairs: list[tuple]) -> list[tuple[int, float]]:
        split = [text.partition("|") for _, text in pairs]
        if any(not body or int(i) % 50 == 7 for i, _, body in split):
            raise ConnectionError("no answer")
        return [(n, len(body) / 10000) for n, (_, _, body) in enumerate(split)][::-1]

    M.register("by_length", by_length)
    scored = M.reranked(joined.select("query_id", "doc_id", "text"), "by_length", "query_id", "text", order_col="doc_id")
    return scored.select("query_id", "doc_id", F.round("rerank_score", 9).alias("score"))


@query(
    "rerank_sigmoid",
    "SELECT event_id, round(1 / (1 + exp(-value / 100)), 9) AS score FROM events",
)
def rerank_sigmoid(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(1 / (1 + F.exp(-F.col("value") / 100)), 9).alias("score"))


@query(
    "final_topk",
    f"WITH {_BM25} SELECT item_id AS query_id, doc_id FROM bmr WHERE rank <= 3",
)
def final_topk(t: Tables) -> DataFrame:
    return R.bm25_top_k(texts(t), questions(t), R.RetrievalConfig(final_top_k=3).final_top_k).select("query_id", F.col("id").alias("doc_id"))


_SEEDS = """
    e AS (SELECT o_custkey AS entity_id, o_totalprice / 1e6 AS s FROM orders WHERE o_orderpriority = '1-URGENT'),
    tr AS (SELECT l_partkey AS a, l_suppkey AS b, l_discount - 0.05 AS s FROM lineitem WHERE l_returnflag = 'R'),
    c AS (SELECT o_custkey AS entity_id, o_totalprice / 1e6 AS s FROM orders WHERE o_orderstatus = 'F'),
    u AS (SELECT entity_id, greatest(0, s) AS w FROM e UNION ALL SELECT unnest([a, b]), 0.8 * greatest(0, s) FROM tr UNION ALL SELECT entity_id, 0.3 * greatest(0, s) FROM c)"""


@query("graph_seed", f"WITH {_SEEDS} SELECT entity_id, round(sum(w) / (SELECT sum(w) FROM u), 9) AS weight FROM u GROUP BY entity_id")
def graph_seed(t: Tables) -> DataFrame:
    score = (F.col("o_totalprice") / 1e6).alias("score")
    entities = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("entity_id"), score)
    triples = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), (F.col("l_discount") - 0.05).alias("score"))
    chunks = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("entity_id"), score)
    return R.seed_weights(entities, triples, chunks).select("entity_id", F.round("weight", 9).alias("weight"))


@query(
    "search_output",
    f"""WITH {_BM25} SELECT item_id AS query_id, doc_id || ':' || rank AS result_id, source AS origin, n_chars AS size
    FROM bmr JOIN documents USING (doc_id) WHERE rank <= 10""",
)
def search_output(t: Tables) -> DataFrame:
    """The public shape of a result: an id made of file and place, and no internal keys."""
    found = R.bm25_top_k(texts(t), questions(t), 10)
    joined = found.join(t.documents.select(F.col("doc_id").alias("id"), "source", "n_chars"), "id")
    return joined.select("query_id", F.concat_ws(":", "id", "rank").alias("result_id"), F.col("source").alias("origin"), F.col("n_chars").alias("size"))


@query(
    "page_rank_ext",
    """
    SELECT page_id, CAST(CASE WHEN contains(lower(html), 'the') THEN 2 ELSE 0 END
      + 5 * (CASE WHEN contains(lower(url), 'src1') THEN 1 ELSE 0 END + CASE WHEN contains(lower(url), 'page') THEN 1 ELSE 0 END)
      + 2 * (CASE WHEN contains(lower(html), 'src1') THEN 1 ELSE 0 END + CASE WHEN contains(lower(html), 'page') THEN 1 ELSE 0 END) AS BIGINT) AS score
    FROM pages
    """,
)
def page_rank_ext(t: Tables) -> DataFrame:
    """External candidates: 2 for a search hit, 5 for each term in the title, 2 for each in the properties."""
    terms = F.array(F.lit("src1"), F.lit("page"))
    hits = lambda c: F.size(F.filter(terms, lambda x: F.lower(c).contains(x)))
    hit = F.lower("html").contains("the").cast("int") * 2
    return t.pages.select("page_id", (hit + 5 * hits(F.col("url")) + 2 * hits(F.col("html"))).cast("long").alias("score"))


@query(
    "page_score_ext",
    r"""
    SELECT doc_id, CAST(CASE WHEN contains(lower(source), 'src1') THEN 5 ELSE 0 END + CASE WHEN lang = 'en' THEN 3 ELSE 0 END
      + len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: contains(lower(x), 'the'))) AS BIGINT) AS score FROM documents
    """,
)
def page_score_ext(t: Tables) -> DataFrame:
    """5 for the title, 3 for a property, and 1 for each line that matches."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.lower(x).contains("the"))
    score = F.when(F.lower("source").contains("src1"), 5).otherwise(0) + F.when(F.col("lang") == "en", 3).otherwise(0) + F.size(lines)
    return t.documents.select("doc_id", score.cast("long").alias("score"))


@query("src_notion", "SELECT page_id, min(priority) AS priority FROM (SELECT page_id, 1 AS priority FROM pages WHERE contains(lower(html), 'the') UNION ALL SELECT page_id, 2 FROM pages) GROUP BY page_id")
def src_notion(t: Tables) -> DataFrame:
    """Candidates of a search and of a scan, once each, the search's first."""
    searched = t.pages.filter(F.lower("html").contains("the")).select("page_id", F.lit(1).alias("priority"))
    scanned = t.pages.select("page_id", F.lit(2).alias("priority"))
    return searched.unionByName(scanned).groupBy("page_id").agg(F.min("priority").alias("priority"))
