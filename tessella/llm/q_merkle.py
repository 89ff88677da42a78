"""op11: the Merkle manifest of ``documents``, checked against tampered texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import merkle
from tessella.llm.q_jaccard import LOWER, UPPER
from tessella.session import table


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = merkle.leaf("doc_id", "source", "lang", "n_chars", "text")
    other = merkle.leaf("doc_id", "source", "lang", "n_chars", F.translate("text", UPPER, LOWER))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select("doc_id", "lang", own.alias("leaf"), F.when(tampered, other).alias("other")).withColumn("claimed", F.coalesce("other", "leaf"))
    found = merkle.proofs(merkle.build(leaves, claimed_col="claimed"))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


QUERIES = {"op11_merkle": op11_merkle}

#: Levels that the SQL unrolls: 8^8 rows of a language, 64 languages.
LEVELS, TOP_LEVELS = 8, 2


def _field(c: str) -> str:
    return f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), '-')"


def _sql() -> str:
    plain = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    crc = (
        "xor(list_reduce(list_transform(range(1, strlen(d) + 1), lambda i: CAST(ascii(d[i]) AS BIGINT)), lambda c, b: list_reduce(CAST(range(8) AS BIGINT[]), "
        "lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295)"
    )
    ctes = [
        f"""leaves AS MATERIALIZED (
  SELECT doc_id, lang, sha256(concat({", ".join([*plain, _field("text")])})) AS leaf,
    CASE WHEN coalesce({crc} % 3 = 0, false) THEN sha256(concat({", ".join([*plain, _field(f"translate(text, '{UPPER}', '{LOWER}')")])})) END AS other
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS d FROM documents))""",
        """placed AS MATERIALIZED (
  SELECT doc_id, lang, leaf, coalesce(other, leaf) AS mine, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves)""",
        "l0 AS MATERIALIZED (SELECT lang, i, leaf AS h, n FROM placed)",
        "w0 AS (SELECT doc_id, lang, leaf, i, mine, '' AS proof FROM placed)",
    ]

    def level(k: int, nodes: str, walk: str, by: str, same: str) -> None:
        ctes.append(f"r{nodes}{k} AS MATERIALIZED (SELECT {by} i // 8 AS r, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {nodes}{k} WHERE n > 1 GROUP BY ALL)")
        ctes.append(
            f"{nodes}{k + 1} AS MATERIALIZED (SELECT {by} r AS i, sha256(array_to_string(hs, '')) AS h, (n + 7) // 8 AS n FROM r{nodes}{k} "
            f"UNION ALL SELECT {by} i, h, n FROM {nodes}{k} WHERE n = 1)"
        )
        left, right = "hs[1:x.i % 8]", "hs[x.i % 8 + 2:]"
        ctes.append(
            f"{walk}{k + 1} AS MATERIALIZED (SELECT doc_id, x.lang, leaf, x.i // 8 AS i, "
            f"CASE WHEN hs IS NULL THEN mine ELSE sha256(concat(array_to_string({left}, ''), mine, array_to_string({right}, ''))) END AS mine, "
            f"CASE WHEN hs IS NULL THEN proof ELSE concat(proof, array_to_string({left}, ''), array_to_string({right}, '')) END AS proof "
            f"FROM {walk}{k} x LEFT JOIN r{nodes}{k} y ON {same} y.r = x.i // 8)"
        )

    for k in range(LEVELS):
        level(k, "l", "w", "lang,", "y.lang IS NOT DISTINCT FROM x.lang AND")
    ctes.append(f"t0 AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM l{LEVELS})")
    ctes.append(f"v0 AS MATERIALIZED (SELECT doc_id, t0.lang, leaf, t0.i, mine, proof FROM w{LEVELS} w JOIN t0 ON t0.lang IS NOT DISTINCT FROM w.lang)")
    for k in range(TOP_LEVELS):
        level(k, "t", "v", "", "")
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, t0.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, mine AS folded_root, mine = top.h AS verified
FROM v{TOP_LEVELS} v JOIN t0 ON t0.lang IS NOT DISTINCT FROM v.lang, t{TOP_LEVELS} top"""


SQL = {"op11_merkle": _sql()}
