"""How plan modules register their queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from tessella.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables below a folder, as attributes: ``t.documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        """Register a function of ``Tables`` as a query, with its DuckDB SQL if there is one."""

        def add(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[name] = dedent(sql)
            return f

        return add


def rounds_sql(rounds: int) -> str:
    """The scores of personalised PageRank after so many rounds, from ``begin_at`` (id, w, dangling), ``ways`` (src, dst) and ``deg`` (src, d)."""
    steps = ["s0 AS MATERIALIZED (SELECT id, w, dangling, w AS score FROM begin_at)"]
    for i in range(rounds):
        steps.append(
            f"g{i} AS MATERIALIZED (SELECT dst AS id, sum(score / d) AS got FROM s{i} JOIN ways ON src = id JOIN deg USING (src) GROUP BY dst), "
            f"l{i} AS MATERIALIZED (SELECT coalesce(sum(score) FILTER (dangling), 0) AS lost FROM s{i}), "
            f"s{i + 1} AS MATERIALIZED (SELECT begin_at.id, w, dangling, 0.85 * (coalesce(got, 0) + lost * w) + 0.15 * w AS score FROM begin_at LEFT JOIN g{i} USING (id), l{i})"
        )
    return ", ".join(steps)


def push_sql(rounds: int, residual: float, seed: str = "seed", name: str = "s") -> str:
    """Personalised PageRank of many queries by forward push: ``{name}{rounds}`` (q, id, d, p, r), from ``seed`` (q, id, w), ``ways`` (src, dst) and ``deg`` (src, d)."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT q, id, d, 0.0::DOUBLE AS p, w AS r FROM {seed} JOIN deg ON src = id)"]
    for i in range(rounds):
        steps.append(
            f"{name}g{i} AS (SELECT q, dst AS id, sum(0.85 * r / d) AS r FROM {name}{i} JOIN ways ON src = id WHERE r > {residual} * d GROUP BY q, dst), "
            f"{name}{i + 1} AS MATERIALIZED (SELECT q, id, d, p, r FROM (SELECT q, id, sum(p) AS p, sum(r) AS r FROM ("
            f"SELECT q, id, CASE WHEN r > {residual} * d THEN p + 0.15 * r ELSE p END AS p, CASE WHEN r > {residual} * d THEN 0 ELSE r END AS r FROM {name}{i} "
            f"UNION ALL SELECT q, id, 0, r FROM {name}g{i}) GROUP BY q, id) JOIN deg ON src = id)"
        )
    return ", ".join(steps)
