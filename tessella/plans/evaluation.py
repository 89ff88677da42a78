"""Evaluation queries: the vectors of a query's label are its gold, its nearest vectors what was retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import evaluation as V
from tessella.operators.retrieval import vector_top_k
from tessella.plans.registry import Registry, Tables, push_sql
from tessella.plans.retrieval import _VEC, asked, vectors

query = Registry()
QUERIES, SQL = query.queries, query.sql

K = 10


def runs(t: Tables) -> DataFrame:
    """(query_id, ids in order, gold among them, n_gold): one row for each query."""
    return V.judged_runs(vector_top_k(vectors(t), asked(t), K), t.embeddings.select(F.col("vec_id").alias("id"), "label"))


_RUNS = f"""{_VEC},
    runs AS (SELECT query_id, list(id ORDER BY rank) AS ids, any_value(gold) AS gold FROM vr
      JOIN (SELECT label, list(vec_id) AS gold FROM embeddings GROUP BY label) g ON g.label = vr.ql WHERE rank <= {K} GROUP BY query_id)"""


def _r(k: int) -> str:
    return f"len(list_intersect(ids[1:{k}], gold))::DOUBLE / len(gold)"


def _p(k: int) -> str:
    return f"len(list_intersect(ids[1:{k}], gold))::DOUBLE / {k}"


def _f(k: int) -> str:
    return f"CASE WHEN len(list_intersect(ids[1:{k}], gold)) > 0 THEN 2 * {_p(k)} * ({_r(k)}) / ({_p(k)} + {_r(k)}) ELSE 0 END"


def _rounded(c, name: str):
    return F.round(c, 9).alias(name)


@query("precision_k", f"WITH {_RUNS} SELECT query_id, round({_p(5)}, 9) AS precision_5 FROM runs")
def precision_k(t: Tables) -> DataFrame:
    return runs(t).select("query_id", _rounded(V.precision_at(F.col("ids"), F.col("gold"), 5), "precision_5"))


@query("recall_k", f"WITH {_RUNS} SELECT query_id, round({_r(5)}, 9) AS recall_5 FROM runs")
def recall_k(t: Tables) -> DataFrame:
    return runs(t).select("query_id", _rounded(V.recall_at(F.col("ids"), F.col("gold"), 5, F.col("n_gold")), "recall_5"))


@query("f1_k", f"WITH {_RUNS} SELECT query_id, round({_f(5)}, 9) AS f1_5 FROM runs")
def f1_k(t: Tables) -> DataFrame:
    return runs(t).select("query_id", _rounded(V.f1_at(F.col("ids"), F.col("gold"), 5, F.col("n_gold")), "f1_5"))


_ROWS = " UNION ALL ".join(f"SELECT query_id, '{m}@{k}' AS metric, round({f(k)}, 9) AS value FROM runs" for k in V.KS for m, f in (("recall", _r), ("f1", _f)))


@query("metrics_row", f"WITH {_RUNS} {_ROWS}")
def metrics_row(t: Tables) -> DataFrame:
    return V.question_metrics(runs(t)).select("query_id", F.explode("metrics").alias("metric", "value")).withColumn("value", F.round("value", 9))


@query("metrics_agg", f"WITH {_RUNS}, m AS ({_ROWS}) SELECT metric, round(avg(value), 8) AS mean FROM m GROUP BY metric")
def metrics_agg(t: Tables) -> DataFrame:
    return V.macro_means(V.question_metrics(runs(t))).select("metric", F.round("mean", 8).alias("mean"))


def items(t: Tables) -> DataFrame:
    """Questions with metrics and, for those of some labels, the score of a judge."""
    label = t.embeddings.select(F.col("vec_id").alias("query_id"), "label")
    judged = F.when(F.col("label") < 5, F.col("label") / 4.0)
    return V.question_metrics(runs(t)).join(label, "query_id").select("query_id", "metrics", judged.alias("score"))


_ITEMS = f"{_RUNS}, items AS (SELECT query_id, {_r(10)} AS r10, least({', '.join(_r(k) + ', ' + _f(k) for k in V.KS)}) AS low, CASE WHEN label < 5 THEN label / 4.0 END AS score FROM runs JOIN embeddings ON vec_id = query_id)"


@query("overall_score", f"WITH {_ITEMS} SELECT coalesce(avg(score), avg(r10)) AS overall FROM items")
def overall_score(t: Tables) -> DataFrame:
    return V.overall_score(items(t))


_KINDS = {
    "all": "true",
    "answer_errors": "coalesce(score, 1) <= 0.5",
    "legacy_errors": "(coalesce(score, 1) <= 0.5 OR low < 0.3)",
    "errors": "(coalesce(score, 1) <= 0.5 OR r10 < 1)",
}


@query("result_filter", f"WITH {_ITEMS} " + " UNION ALL ".join(f"SELECT '{k}' AS view_name, query_id FROM items WHERE {c}" for k, c in _KINDS.items()))
def result_filter(t: Tables) -> DataFrame:
    """The filter is before any paging."""
    found = items(t)
    parts = [found.filter(V.failed(k)).select(F.lit(k).alias("view_name"), "query_id") for k in _KINDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("bench_neighbors", f"WITH {_VEC} SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM vr WHERE id <> query_id AND rank <= 8) WHERE n <= 5")
def bench_neighbors(t: Tables) -> DataFrame:
    """Five neighbours of each anchor among three more than that, without itself."""
    from pyspark.sql.window import Window

    found = vector_top_k(vectors(t), asked(t), 8).filter("id <> query_id")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("n <= 5").select("query_id", "id")


@query(
    "bench_validate",
    f"WITH {_RUNS} SELECT query_id AS item_id, list_aggregate(list_sort(list_intersect(ids, gold)), 'string_agg', ',') AS gold FROM runs WHERE len(list_intersect(ids, gold)) > 0 ORDER BY query_id LIMIT 4",
)
def bench_validate(t: Tables) -> DataFrame:
    found = runs(t).withColumnRenamed("query_id", "item_id")
    valid = V.valid_items(found.select("item_id", "gold"), found.select("item_id", "ids"), 4)
    return valid.select("item_id", F.array_join(F.array_sort("gold"), ",").alias("gold"))


_CONTEXT, _RESIDUAL, _PUSHES = 3, 5e-4, 30


def _contexts_sql() -> str:
    """Contexts of the anchors, round by round."""
    ctes = [
        """men AS MATERIALIZED (SELECT DISTINCT doc_id AS chunk, unnest(list_concat(['source ' || source], regexp_extract_all(lower(coalesce(text, '')), '[a-z]{7,}'))) AS entity FROM documents)""",
        "ways AS MATERIALIZED (SELECT 'chunk ' || chunk AS src, 'entity ' || entity AS dst FROM men UNION SELECT 'entity ' || entity, 'chunk ' || chunk FROM men)",
        "deg AS MATERIALIZED (SELECT src, count(*) AS d FROM ways GROUP BY src)",
        "t0 AS (SELECT doc_id AS anchor, 0 AS position, doc_id AS chunk FROM documents WHERE doc_id % 100 = 0)",
    ]
    for r in range(_CONTEXT - 1):
        ctes += [
            f"m{r} AS (SELECT anchor, 'entity ' || entity AS id, max(power(0.9, position)) AS w FROM t{r} JOIN men USING (chunk) GROUP BY ALL)",
            f"seed{r} AS MATERIALIZED (SELECT anchor AS q, id, w / sum(w) OVER (PARTITION BY anchor) AS w FROM m{r})",
            push_sql(_PUSHES, _RESIDUAL, f"seed{r}", f"p{r}_"),
            f"""b{r} AS (SELECT q AS anchor, CAST(substr(id, 7) AS BIGINT) AS chunk, p + 0.15 * r AS score FROM p{r}_{_PUSHES} WHERE id LIKE 'chunk %' AND p + r > 0
              AND NOT EXISTS (SELECT 1 FROM t{r} WHERE t{r}.anchor = q AND t{r}.chunk = CAST(substr(id, 7) AS BIGINT)) QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(p + 0.15 * r, 9) DESC, CAST(substr(id, 7) AS BIGINT)) = 1)""",
            f"t{r + 1} AS MATERIALIZED (SELECT anchor, position, chunk FROM t{r} UNION ALL SELECT anchor, {r + 1}, chunk FROM b{r})",
        ]
    last = f"t{_CONTEXT - 1}"
    return f"WITH {', '.join(ctes)} SELECT anchor, position, chunk FROM {last} WHERE anchor IN (SELECT anchor FROM {last} GROUP BY anchor HAVING count(*) = {_CONTEXT})"


@query("bench_graph", _contexts_sql())
def bench_graph(t: Tables) -> DataFrame:
    """The context of each document whose id is divisible by 100, grown over the graph of all documents, their sources and their
    words of over six letters."""
    from tessella.operators.graph import expanded_contexts

    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{7,}"), F.lit(0))
    entities = F.array_distinct(F.concat(F.array(F.concat(F.lit("source "), "source")), words))
    # rows of one id meet as lists: pairs of their own would be many times as many rows to deal
    listed = t.documents.select(F.col("doc_id").alias("chunk"), entities.alias("of")).groupBy("chunk").agg(F.array_distinct(F.flatten(F.collect_list("of"))).alias("of"))
    anchors = t.documents.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("anchor"))
    return expanded_contexts(listed.select("chunk", F.explode("of").alias("entity")), anchors, _CONTEXT, _RESIDUAL, simple=True)
