"""Functions of models (embedding, reranking, extraction, judging) over Arrow batches, registered by name."""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise, release

MODELS: dict[str, Callable[[list[str]], list]] = {}


def register(name: str, fn: Callable[[list[str]], list]) -> None:
    """A model is a function from a batch of texts to as many results."""
    MODELS[name] = fn


def delay(attempt: int, retry_after: float | None = None, most: float = 30.0) -> float:
    """Seconds before the next attempt: what the service asks for, else 1, 2, 4, ... up to a bound."""
    return min(most, retry_after if retry_after is not None else 2.0 ** (attempt - 1))


def with_retries(fn: Callable[[list[str]], list], texts: list[str], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> list:
    for attempt in range(1, attempts + 1):
        try:
            return fn(texts)
        except (ConnectionError, TimeoutError) as e:
            if attempt == attempts:
                raise
            sleep(delay(attempt, getattr(e, "retry_after", None)))
    return []


def applied(df: DataFrame, name: str, text_col: str, out_col: str, kind: str, size: int = 200) -> DataFrame:
    """``df`` with the model's results of a text column, in batches of ``size``, in order."""
    fn = MODELS[name]
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
                results = with_retries(fn, [t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(results)], names=[*part.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{out_col}` {kind}")


def _attempted(fn: Callable[[list[str]], list], size: int, attempts: int, sleep: Callable[[float], None]):
    """(key, result, error) of each (key, text): a batch that fails is asked again text by text, so that one does not spoil others."""

    def one(text: str) -> tuple[str | None, str | None]:
        error = None
        for attempt in range(1, attempts + 1):
            try:
                return fn([text])[0], None
            except Exception as e:  # whatever a remote model fails with
                error = f"{type(e).__name__}: {e}"
                if attempt < attempts:
                    sleep(delay(attempt, getattr(e, "retry_after", None)))
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
                texts = part.column(1).to_pylist()
                try:
                    results = [(x, None) for x in fn(texts)]
                    if len(results) != len(texts):
                        raise ValueError("a model must give a result for each text")
                except Exception:
                    results = [one(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r for r, _ in results], pa.string()), pa.array([e for _, e in results], pa.string())], names=["key", "result", "error"])

    return run


def memoised(df: DataFrame, name: str, text_col: str, out_col: str, store: str, size: int = 20, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``df`` with the model's result (a string) of a text column, and ``status``: ``done``, or ``failed`` where it failed ``attempts``
    times. Results are kept in the folder ``store`` by a hash of the model's name and the text: the model is asked only for texts
    without one, each once however many rows have it; failures are kept apart in ``store``/failed with their error, and tried
    again in the next call. Null texts count as empty. Results are appended, so a call that is cut off loses only those of
    files not yet written."""
    spark = df.sparkSession
    key = F.sha2(F.concat(F.lit(name), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))), 256)
    shape = "key string, result string"

    def kept() -> DataFrame:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/done")
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        # a text that two calls asked for at once has two rows
        return spark.read.schema(shape).parquet(f"{store}/done").dropDuplicates(["key"]) if there else spark.createDataFrame([], shape)

    asked = df.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    new = asked.join(kept(), "key", "left_anti").mapInArrow(_attempted(MODELS[name], size, attempts, sleep), "key string, result string, error string")
    new = materialise(new, "asked")
    new.filter("error is null").select("key", "result").write.mode("append").parquet(f"{store}/done")
    new.filter("error is not null").select("key", "error", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{store}/failed")
    release(new)
    mine = "_".join(["key", *df.columns])
    found = df.withColumn(mine, key).join(kept().select(F.col("key").alias(mine), F.col("result").alias(out_col), F.lit("done").alias("status")), mine, "left")
    return found.withColumn("status", F.coalesce("status", F.lit("failed"))).drop(mine)


def checked_scores(results: list, n: int) -> list[float]:
    """The scores of a reranker's reply, (index, score) for each of ``n`` texts in any order; an index that is missing,
    repeated or out of range, or a score that is no finite number, is a ValueError."""
    scores = dict(results)
    if len(results) != n or any(type(i) is not int for i in scores) or scores.keys() != set(range(n)):
        raise ValueError("a reranker must give one score for each text")
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in scores.values()):
        raise ValueError("a reranker must give finite numbers")
    return [float(scores[i]) for i in range(n)]


def reranked(found: DataFrame, name: str, query_col: str, text_col: str, size: int = 32, normalise: bool = True, order_col: str | None = None) -> DataFrame:
    """``found`` with ``rerank_score``. The model gets a list of (query, text), in batches of one query and at most ``size``
    texts, in the order of ``order_col`` if given, and gives (index, score) of each; a batch that fails or whose reply is not valid counts 0.5 for each text. Scores
    pass a sigmoid, those of failed batches too."""
    fn = MODELS[name]
    q, t = found.columns.index(query_col), found.columns.index(text_col)

    def scores_of(pairs: list[tuple]) -> list[float]:
        try:
            raw = checked_scores(fn(pairs), len(pairs))
        except Exception:  # whatever a remote model fails with
            raw = [0.5] * len(pairs)
        return [1 / (1 + math.exp(-min(700.0, max(-700.0, x)))) if normalise else x for x in raw]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list[tuple]]] = []

        def done() -> pa.RecordBatch:
            """The rows held, which are one batch of the model, though they may come from two of Spark's."""
            rows = pa.Table.from_batches([b for b, _ in held]).combine_chunks().to_batches()[0]
            scores = scores_of([x for _, own in held for x in own])
            held.clear()
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64())], names=[*rows.schema.names, "rerank_score"])

        for batch in batches:
            pairs = [(a, b or "") for a, b in zip(batch.column(q).to_pylist(), batch.column(t).to_pylist(), strict=True)]
            at = 0
            while at < len(pairs):
                if held and (held[0][1][0][0] != pairs[at][0] or sum(len(x) for _, x in held) == size):
                    yield done()
                room = size - sum(len(x) for _, x in held)
                end = next((i for i in range(at, min(at + room, len(pairs))) if pairs[i][0] != pairs[at][0]), min(at + room, len(pairs)))
                held.append((batch.slice(at, end - at), pairs[at:end]))
                at = end
        if held:
            yield done()

    dealt = found.repartition(query_col).sortWithinPartitions(query_col, *([order_col] if order_col else []))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return dealt.mapInArrow(run, f"{fields}, rerank_score double")


def fenced_json(reply: Column) -> Column:
    """What is in the fence of a model's reply, or between its outer braces, or the reply; trimmed."""
    fence = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.trim(F.when(fence != "", fence).when(braces != "", braces).otherwise(reply))


def capitalised_entities(texts: list[str]) -> list[str]:
    """A rule in place of a model for tests: words with a capital inside a sentence, as JSON."""
    return [json.dumps({"entities": sorted(set(re.findall(r"(?<=[a-z,;] )[A-Z][a-z]{3,}", t)))}) for t in texts]


register("capitalised_entities", capitalised_entities)


def judged(answer: Column, gold: Column, verdict: Column) -> Column:
    """A judge's 0 or 1; an empty answer or gold is 0 without asking."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(answer) | blank(gold), 0.0).otherwise(F.coalesce(verdict.cast("double"), F.lit(0.0)))
