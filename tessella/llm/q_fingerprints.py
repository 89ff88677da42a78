"""op5: fingerprints of ``documents`` and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.fingerprints import fingerprint_edits
from tessella.session import table


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op5_fingerprints": op5_fingerprints}
SQL: dict[str, str] = {}
