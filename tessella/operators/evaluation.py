"""Retrieval metrics: hits among the first k ids, against gold ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def hits(ids: Column, gold: Column, k: int | Column) -> Column:
    """Distinct gold ids among the first k."""
    return F.size(F.array_intersect(F.slice(ids, F.lit(1), F.lit(k) if isinstance(k, int) else k), gold))


def precision_at(ids: Column, gold: Column, k: int) -> Column:
    """Hits by k, even if fewer were retrieved."""
    return hits(ids, gold, k) / F.lit(float(k))


def recall_at(ids: Column, gold: Column, k: int, n_gold: Column | None = None) -> Column:
    """Hits by distinct gold ids; 0 without gold. With ``n_gold``, their number, ``gold`` need only hold those retrieved."""
    n = F.size(F.array_distinct(gold)) if n_gold is None else n_gold
    return F.when(n > 0, hits(ids, gold, k) / n).otherwise(0.0)


def f1_at(ids: Column, gold: Column, k: int, n_gold: Column | None = None) -> Column:
    p, r = precision_at(ids, gold, k), recall_at(ids, gold, k, n_gold)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def judged_runs(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, ids, gold, n_gold) of ranked results (query_id, id, rank), where the rows of the query's own label in
    ``labels`` (id, label) are its gold: the ids in order, those of them that are gold, and how many gold ids there are.

    Labels are counted by a group-by and met by joins, so no label's ids are gathered however many it has. Results and
    queries without a label are left out; each id has one label."""
    sizes = labels.filter("label is not null").groupBy("label").agg(F.count_distinct("id").alias("n_gold"))
    of_query = labels.join(sizes, "label").select(F.col("id").alias("query_id"), F.col("label").alias("asked"), "n_gold")
    rows = found.join(of_query, "query_id").join(labels, "id", "left")
    listed = F.array_sort(F.collect_list(F.struct("rank", "id", F.coalesce(F.col("label") == F.col("asked"), F.lit(False)).alias("is_gold"))))
    runs = rows.groupBy("query_id", "n_gold").agg(listed.alias("found"))
    gold = F.transform(F.filter("found", lambda x: x["is_gold"]), lambda x: x["id"])
    return runs.select("query_id", F.transform("found", lambda x: x["id"]).alias("ids"), gold.alias("gold"), "n_gold")


def question_metrics(runs: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(query_id, metrics: map of recall@k and f1@k) for runs (query_id, ids, gold, and n_gold if the gold ids are only those
    retrieved); an empty map where nothing was retrieved or there is no gold."""
    ids, gold = F.col("ids"), F.col("gold")
    n = F.col("n_gold") if "n_gold" in runs.columns else F.size(F.array_distinct(gold))
    pairs = [x for k in ks for x in (F.lit(f"recall@{k}"), recall_at(ids, gold, k, n), F.lit(f"f1@{k}"), f1_at(ids, gold, k, n))]
    nothing = F.expr("cast(map() as map<string,double>)")
    return runs.select("query_id", F.when((F.size("ids") > 0) & (n > 0), F.create_map(*pairs)).otherwise(nothing).alias("metrics"))


def macro_means(metrics: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(metric, mean) over all questions; a metric that a question lacks counts as 0."""
    names = [f"{m}@{k}" for k in ks for m in ("recall", "f1")]
    means = metrics.agg(*(F.avg(F.coalesce(F.col("metrics")[n], F.lit(0.0))).alias(n) for n in names))
    return means.unpivot([], names, "metric", "mean")


def overall_score(items: DataFrame) -> DataFrame:
    """The mean judge score; without any, the mean recall@10 over the questions that have one."""
    return items.agg(F.coalesce(F.avg("score"), F.avg(F.col("metrics")["recall@10"])).alias("overall"))


def failed(kind: str) -> Column:
    """Which items a view of a run shows; a missing metric counts as passed."""
    score = F.coalesce("score", F.lit(1.0))
    recall = F.coalesce(F.col("metrics")["recall@10"], F.lit(1.0))
    low = F.exists(F.map_values("metrics"), lambda v: v < 0.3)
    return {"all": F.lit(True), "answer_errors": score <= 0.5, "legacy_errors": (score <= 0.5) | low}.get(kind, (score <= 0.5) | (recall < 1))


def valid_items(items: DataFrame, context: DataFrame, most: int) -> DataFrame:
    """Generated items (item_id, gold) whose gold ids, kept only if in the item's context (item_id, ids), are not
    all gone; the first ``most`` of them by id."""
    kept = items.join(context, "item_id").withColumn("gold", F.array_intersect("gold", "ids")).filter(F.size("gold") > 0)
    return kept.drop("ids").orderBy("item_id").limit(most)
