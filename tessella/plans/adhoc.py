"""Ad-hoc SQL over the star schema through the read-only SQL tool. The same text is the oracle's, but for a few functions
that have other names there."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import sqltool
from tessella.plans.registry import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _ask(statement: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    sqltool.attach(spark, sf_dir)
    return sqltool.run(spark, statement)


def ask(name: str, statement: str, duckdb: str | None = None) -> None:
    QUERIES[name] = partial(_ask, statement)
    SQL[name] = duckdb or statement


ask(
    "sql_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
ask(
    "sql_shipping_priority",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
ask(
    "sql_local_supplier",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
)
ask("sql_forecast_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
ask(
    "sql_priority_counts",
    """SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""",
)
ask("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
ask("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
ask("sql_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
ask("sql_except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
ask("sql_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
@query(
    "sql_rank",
    """SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (ORDER BY o_totalprice, o_orderkey) AS quartile FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""",
)
def sql_rank(t: Tables) -> DataFrame:
    """Ranks within customers, and quartiles of all orders, which Spark's ``ntile`` would number in one task."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from tessella.operators.windows import with_ntile

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    tiled = with_ntile(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), 4, ["o_totalprice", "o_orderkey"], "quartile")
    return tiled.select("o_custkey", "o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), "quartile")
ask(
    "sql_frames",
    """SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events""",
)
ask("sql_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT sum(n) AS total, count(*) AS n FROM t", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS n FROM t")
ask("sql_full_outer", "SELECT c_nationkey AS c, s_nationkey AS s, count(*) AS n FROM customer FULL JOIN supplier ON c_custkey = s_suppkey GROUP BY c_nationkey, s_nationkey")
ask(
    "sql_range_join",
    """SELECT a.o_orderkey, count(b.o_orderkey) AS n FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL '90' DAY GROUP BY a.o_orderkey""",
)
ask("sql_percentile", "SELECT event_type, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS p90, max(value) AS most FROM events GROUP BY event_type")
ask("sql_subquery", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
ask("sql_distinct_counts", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
ask("sql_case_pivot", "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY o_custkey", "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM orders GROUP BY o_custkey")


@query("sql_tables", "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name")
def sql_tables(t: Tables) -> DataFrame:
    sqltool.attach(t.spark, t.sf_dir)
    return t.spark.createDataFrame([(x.name,) for x in t.spark.catalog.listTables() if x.name in sqltool.TABLES], "name string")


@query("sql_describe", "SELECT 'n_nationkey' AS name, 'int' AS type UNION ALL SELECT 'n_name', 'string' UNION ALL SELECT 'n_regionkey', 'int'")
def sql_describe(t: Tables) -> DataFrame:
    sqltool.attach(t.spark, t.sf_dir)
    return sqltool.describe(t.spark, "nation").select("name", "type")


@query("as_of_join", "SELECT o_orderkey, (SELECT max(p.o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate) AS before FROM orders o")
def as_of_join(t: Tables) -> DataFrame:
    """The latest earlier row of the same key: a window instead of a range join."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    days = t.orders.select("o_custkey", "o_orderdate").distinct()
    before = days.withColumn("before", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate")))
    return t.orders.join(before, ["o_custkey", "o_orderdate"]).select("o_orderkey", "before")
