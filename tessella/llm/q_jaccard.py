"""op1: the n-gram Jaccard join over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.jaccard_join import near_duplicates
from tessella.session import table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUERIES = {"op1_jaccard_join": op1_jaccard_join}

SQL = {
    "op1_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5
      THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS ss
  FROM w),
e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM s JOIN reach ON node = s.doc_id GROUP BY s.doc_id, len(ss)
"""
}
