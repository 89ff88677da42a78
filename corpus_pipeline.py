"""The training-data pipeline over ``documents``: five operators, one after the other.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and gives a DataFrame that
is written as Parquet and read again. All but the last give the columns of ``documents``.

Rows are never made up and, but for the rows that a stage says it drops, never lost: rows with a null id or text, repeated
rows and further columns pass with the others, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, jaccard_join, pii, quality, sentence_pieces
from tessella.llm.q_pieces import MODEL
from tessella.llm.q_quality import ACCEPT, held_out
from tessella.session import materialise, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; learned from the labels not held out. Null and empty texts
    are scored by their features; rows that share an id are scored each by its own text."""
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return quality.accepted(docs, quality.train(docs, labels), ACCEPT)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the smallest id of each component of near duplicates. Null and empty texts have no links and stay, as do rows with
    a null id and all rows of an id that stays."""
    return jaccard_join.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item. Null and empty texts stay."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind, and ``n_chars`` of the new text. Null stays null, and all rows stay."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces) of each row left; a null or empty text has no ids."""
    found = sentence_pieces.encoded_documents(docs, public_tokenizers.path(MODEL))
    return found.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("sentence_pieces", encode_pieces),
]

#: The first and the last stage are no SQL; tests/llm/test_queries.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
