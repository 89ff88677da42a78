"""op10: ``documents`` as SentencePiece ids and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.sentence_pieces import piece_digests
from tessella.session import table

MODEL = "piece_bpe_32k.model"


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


QUERIES = {"op10_sentence_pieces": op10_sentence_pieces}
SQL: dict[str, str] = {}
