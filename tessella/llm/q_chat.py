"""op4: chat formatting of ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.chat_format import rendered
from tessella.session import table


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


QUERIES = {"op4_chat_format": op4_chat_format}

SQL = {
    "op4_chat_format": r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns, count(*) AS n FROM t GROUP BY conv_id),
k AS (
  SELECT * FROM c a WHERE NOT EXISTS (
    SELECT 1 FROM c b WHERE a.conv_id <> b.conv_id AND b.n >= a.n AND b.turns[1:a.n] = a.turns AND (b.n > a.n OR b.conv_id < a.conv_id)))
SELECT conv_id, n AS n_turns, CAST(length(rendered) AS BIGINT) AS n_chars, rendered FROM (
  SELECT conv_id, n, array_to_string(list_transform(turns, lambda x: '<|im_start|>' || coalesce(x.role, 'user') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), '') AS rendered FROM k)
"""
}
