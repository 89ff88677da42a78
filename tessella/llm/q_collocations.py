"""op13: collocations of the languages of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.collocations import collocations
from tessella.llm.q_jaccard import LOWER, UPPER
from tessella.session import table


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op13_collocations": op13_collocations}

SQL = {
    "op13_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(ws) AS g FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' '))) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) FROM w),
f AS MATERIALIZED (SELECT lang, size, g, count(*) AS f FROM grams GROUP BY lang, size, g HAVING count(*) >= 10),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
cand AS (SELECT lang, size, g, string_split(g, ' ') AS ws, f AS a FROM f WHERE size > 1),
cut AS (
  SELECT c.lang, c.size, c.g, a, k, l.f AS l, r.f AS r,
    CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.g = array_to_string(ws[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.g = array_to_string(ws[k + 1:], ' ')),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS g, a AS longer FROM cand WHERE size = 3),
most AS (SELECT lang, g, max(longer) AS longer FROM inner_ GROUP BY lang, g),
ranked AS (
  SELECT worst.lang, worst.g AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY worst.lang ORDER BY score DESC, a DESC, worst.g) AS rank
  FROM worst LEFT JOIN most ON most.lang = worst.lang AND most.g = worst.g WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
}
