"""Ranking and paging queries: runs of a conversation are the line items of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import windows as W
from tessella.plans.registry import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("latest_per_group", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_group(t: Tables) -> DataFrame:
    return W.newest_per_group(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(
    "topn_per_group",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o
    ON o_custkey = c_custkey AND n <= 3""",
)
def topn_per_group(t: Tables) -> DataFrame:
    """The latest three of each customer; a customer without any stays."""
    top = W.newest_per_group(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    return t.customer.join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("topk_recent", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def topk_recent(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "event_type")


@query("page_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_offset(t: Tables) -> DataFrame:
    return W.page(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 100, 50).select("o_orderkey", "o_totalprice")


@query("page_keyset", "SELECT event_id, value FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def page_keyset(t: Tables) -> DataFrame:
    return W.page_after(t.events, "event_id", 500, 100).select("event_id", "value")


@query("page_hasmore", "SELECT event_id, true AS has_more FROM events ORDER BY ts DESC, event_id LIMIT 30")
def page_hasmore(t: Tables) -> DataFrame:
    return W.page_with_more(t.events, [F.desc("ts"), F.asc("event_id")], 30).select("event_id", "has_more")


@query(
    "pinned_first",
    """SELECT o_orderkey, pinned FROM (SELECT o_orderkey, true AS pinned FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL
    SELECT o_orderkey, false FROM (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 40))""",
)
def pinned_first(t: Tables) -> DataFrame:
    """All pinned rows, and a page of the others."""
    pinned = t.orders.filter("o_orderpriority = '1-URGENT'").withColumn("pinned", F.lit(True))
    rest = W.page(t.orders.filter("o_orderpriority <> '1-URGENT'"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 0, 40).withColumn("pinned", F.lit(False))
    return pinned.unionByName(rest).orderBy(F.desc("pinned"), F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "pinned")


@query("active_first", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 60")
def active_first(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return t.orders.orderBy(rank, F.desc("o_orderdate"), "o_orderkey").limit(60).select("o_orderkey", "o_orderstatus")


@query("around_anchor", "SELECT event_id FROM (SELECT event_id FROM events WHERE event_id <= 400 ORDER BY event_id DESC LIMIT 11) UNION ALL SELECT event_id FROM (SELECT event_id FROM events WHERE event_id > 400 ORDER BY event_id LIMIT 10)")
def around_anchor(t: Tables) -> DataFrame:
    return W.around(t.events.select("event_id"), "event_id", 400, 21)


@query("tail_truncated", "SELECT event_id, true AS truncated FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 50) ORDER BY event_id")
def tail_truncated(t: Tables) -> DataFrame:
    return W.tail(t.events.select("event_id"), "event_id", 50)


@query("prune_keep", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('error', 'purchase')) WHERE n > 5")
def prune_keep(t: Tables) -> DataFrame:
    """Only finished rows are pruned, all but the newest five of each user."""
    done = t.events.filter(F.col("event_type").isin("error", "purchase"))
    return W.all_but_newest(done, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("byte_budget", "SELECT source, doc_id FROM (SELECT *, sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 50000")
def byte_budget(t: Tables) -> DataFrame:
    return W.within_budget(t.documents, ["source"], [F.asc("doc_id")], F.octet_length(F.coalesce("text", F.lit(""))), 50_000).select("source", "doc_id")
