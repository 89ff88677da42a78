"""op2: quality scores of ``documents``, learned from ``labels.quality``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.quality import Model, scored, train
from tessella.session import table

ACCEPT = 0.7


def held_out() -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return train(table(spark, sf_dir, "documents"), labels)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}
