"""op6: licenses named in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import license_scan as L
from tessella.session import table


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["phrase"])
    starts = F.transform(base, lambda p: p["first"].cast("long"))
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op6_licenses": op6_licenses}


def _values() -> str:
    return ", ".join(f"({t}, '{label}', {str(phrase).lower()}, {words!r})" for t, label, phrase, words in L.templates())


SQL = {
    "op6_licenses": rf"""
WITH t(t, label, phrase, ws) AS (VALUES {_values()}),
g AS (SELECT t, label, phrase, len(ws) AS n, i - 1 AS tp, ws[i] AS w, ws[i + 1] AS x FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM t)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{L.UPPER}', '{L.LOWER}'), '{L.WORD}') AS ws FROM documents),
p AS (SELECT doc_id, i - 1 AS pos, ws[i] AS w, ws[i + 1] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM d)),
v AS (
  SELECT doc_id, t, label, phrase, n, pos - tp AS diagonal, list(DISTINCT tp) AS places, min(tp) AS low, max(tp) AS high
  FROM p JOIN g USING (w, x) GROUP BY ALL),
r AS (
  SELECT *, sum(CASE WHEN apart > {L.NEIGHBOURS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS run
  FROM (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS apart FROM v WHERE NOT phrase AND len(places) >= {L.LEAST_VOTES})),
s AS (
  SELECT doc_id, t, label, phrase, diagonal AS first, diagonal AS lo, diagonal AS hi FROM v WHERE phrase AND len(places) = n - 1
  UNION ALL
  SELECT doc_id, t, label, phrase, min(diagonal + low), min(diagonal) - {L.NEIGHBOURS}, max(diagonal) + {L.NEIGHBOURS} FROM r
  GROUP BY doc_id, t, label, phrase, n, run HAVING len(list_distinct(flatten(list(places)))) >= {L.VOTED} * (n - 1)),
c AS (
  SELECT s.doc_id, s.label, s.phrase, s.first, len(t.ws) AS n, CASE WHEN s.phrase THEN 1.0::DOUBLE
    ELSE len(list_filter(range(len(t.ws)), lambda i: list_contains(d.ws[greatest(i + lo, 0) + 1:greatest(i + hi + 1, 0)], t.ws[i + 1])))::DOUBLE / len(t.ws) END AS score
  FROM s JOIN t ON t.t = s.t JOIN d ON d.doc_id = s.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(count(*) FILTER (phrase) AS BIGINT) AS n_base,
  CAST(min(first) FILTER (phrase) AS BIGINT) AS first_word, CAST(max(first) FILTER (phrase) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (score IS NOT NULL), '') AS labels, coalesce(max(score), 0.0) AS score
FROM d LEFT JOIN c ON c.doc_id = d.doc_id AND score >= CASE WHEN n < {L.WHOLE} THEN 1 ELSE {L.WORDS_FOUND} END GROUP BY d.doc_id, len(ws)
"""
}
