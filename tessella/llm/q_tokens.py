"""op7: ``documents`` as token ids in a content-addressed store, read back and verified."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.token_store import verify_store, write_store
from tessella.session import table


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return verify_store(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "n_chunks")


QUERIES = {"op7_token_store": op7_token_store}
SQL: dict[str, str] = {}
