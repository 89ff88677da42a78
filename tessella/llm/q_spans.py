"""op3 and op9: secrets and personal data in ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.pii import KINDS as PII_KINDS
from tessella.llm.pii import scan_pii
from tessella.llm.secrets import KINDS as SECRET_KINDS
from tessella.llm.secrets import scan_secrets
from tessella.session import table


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _digest(found: DataFrame, kinds: tuple[str, ...], base: int, *more: Column) -> DataFrame:
    """The counts and the hash of the base spans, and all spans; they come in the order wanted."""
    plain = F.filter("spans", lambda s: s["kind"].isin(*kinds[:base]))
    return found.select(
        "doc_id", *(_count(k) for k in kinds[:base]), F.sha2(_joined(plain), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), *more
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(scan_secrets(table(spark, sf_dir, "documents")), SECRET_KINDS, 3)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scores`` has the score of each span, in their order."""
    found = scan_pii(table(spark, sf_dir, "documents"))
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",")
    return _digest(found, PII_KINDS, 4, scores.alias("scores"))


QUERIES = {"op3_secrets": op3_secrets, "op9_pii": op9_pii}
SQL: dict[str, str] = {}
