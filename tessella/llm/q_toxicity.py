"""op12: toxicity of ``documents``, learned from ``labels.toxic``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.toxicity import Model, scored, train
from tessella.session import table

ACCEPT = 0.7


def held_out() -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return train(table(spark, sf_dir, "documents"), labels)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spans`` has the start and end of each run of toxic words."""
    found = scored(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"), spans.alias("spans"))


QUERIES = {"op12_toxicity": op12_toxicity}
SQL: dict[str, str] = {}
