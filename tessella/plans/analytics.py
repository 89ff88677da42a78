"""Dashboard queries. Tool calls are events (an error is a failed call), users customers (one with a negative balance
is deleted), agents nations, conversations orders (a pending one is deleted), feedback labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import tok_count
from tessella.operators import analytics as A
from tessella.plans.registry import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql

NOW = "2024-01-31 00:00:00"


def valid_conversations(t: Tables) -> DataFrame:
    """Not deleted, with a user who is not, and an agent that exists."""
    users = t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    return t.orders.filter("o_orderstatus <> 'P'").join(users, "o_custkey").join(t.nation, "n_nationkey")


_VALID = """valid AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
    WHERE o_orderstatus <> 'P' AND c_acctbal >= 0)"""


@query(
    "dash_basic",
    f"""WITH {_VALID} SELECT (SELECT count(*) FROM valid) AS conversations, (SELECT count(DISTINCT o_custkey) FROM valid) AS users,
    count(*) AS feedback, 100.0 * sum(quality) / count(*) AS satisfaction FROM labels""",
)
def dash_basic(t: Tables) -> DataFrame:
    counts = valid_conversations(t).agg(F.count("*").alias("conversations"), F.count_distinct("o_custkey").alias("users"))
    rated = t.labels.agg(F.count("*").alias("feedback"), F.coalesce(F.sum("quality"), F.lit(0)).alias("likes"))
    return counts.join(rated).select("conversations", "users", "feedback", A.satisfaction(F.col("likes"), F.col("feedback")).alias("satisfaction"))


@query(
    "dash_dau",
    """SELECT d::DATE AS day, count(DISTINCT user_id) AS users FROM range(DATE '2024-01-31' - 119, DATE '2024-02-01', INTERVAL 1 DAY) r(d)
    LEFT JOIN events ON (ts + INTERVAL 8 HOUR)::DATE = d::DATE GROUP BY 1""",
)
def dash_dau(t: Tables) -> DataFrame:
    return A.daily_active(t.events, "ts", "user_id", "2024-01-31", 120)


@query(
    "dash_active",
    """SELECT count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR) AS active_24h,
    count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY) AS active_30d FROM events""",
)
def dash_active(t: Tables) -> DataFrame:
    since = lambda i: F.count_distinct(F.when(F.col("ts") >= F.expr(f"timestamp_ntz'{NOW}' - interval {i}"), F.col("user_id")))
    return t.events.agg(since("24 hours").alias("active_24h"), since("30 days").alias("active_30d"))


@query("dash_tools", "SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed, 100.0 * count(*) FILTER (event_type <> 'error') / count(*) AS rate FROM events")
def dash_tools(t: Tables) -> DataFrame:
    sums = t.events.agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("success"))
    return sums.select("total", "success", (F.col("total") - F.col("success")).alias("failed"), A.success_rate(F.col("success"), F.col("total")).alias("rate"))


@query("dash_tools_top", "SELECT CAST(props->>'k' AS INTEGER) AS tool, count(*) AS calls FROM events GROUP BY 1 ORDER BY calls DESC, tool LIMIT 10")
def dash_tools_top(t: Tables) -> DataFrame:
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("int").alias("tool")).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool").limit(10)


@query("dash_tools_errors", "SELECT CAST(props->>'k' AS INTEGER) AS tool, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1")
def dash_tools_errors(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'error'").groupBy(F.get_json_object("props", "$.k").cast("int").alias("tool")).agg(F.count("*").alias("errors"))


@query(
    "dash_tools_daily",
    """SELECT CAST(i AS INTEGER) AS bucket, (TIMESTAMP '2024-01-31' - (i + 1) * INTERVAL 1 DAY)::DATE AS start, count(event_id) AS calls FROM range(7) r(i)
    LEFT JOIN events ON ts >= TIMESTAMP '2024-01-31' - (i + 1) * INTERVAL 1 DAY AND ts < TIMESTAMP '2024-01-31' - i * INTERVAL 1 DAY GROUP BY i""",
)
def dash_tools_daily(t: Tables) -> DataFrame:
    return A.rolling_days(t.events, "ts", NOW, 7)


@query(
    "dash_agents",
    f"""WITH {_VALID}, c AS (SELECT n_nationkey, count(*) AS n FROM valid GROUP BY 1),
    f AS (SELECT n_nationkey, count(*) AS n, sum(quality) AS likes FROM labels JOIN customer ON doc_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    e AS (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY 1)
    SELECT n_name AS agent, coalesce(c.n, 0) AS conversations, CASE WHEN f.n > 0 THEN 100.0 * likes / f.n ELSE 100.0 END AS satisfaction, coalesce(e.n, 0) AS tool_calls
    FROM nation LEFT JOIN c USING (n_nationkey) LEFT JOIN f USING (n_nationkey) LEFT JOIN e USING (n_nationkey)""",
)
def dash_agents(t: Tables) -> DataFrame:
    """Each arm is counted before it is joined, so that none multiplies another."""
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey"))
    conversations = valid_conversations(t).groupBy("n_nationkey").agg(F.count("*").alias("c"))
    rated = t.labels.withColumnRenamed("doc_id", "user_id").join(users, "user_id").groupBy("n_nationkey").agg(F.count("*").alias("f"), F.sum("quality").alias("likes"))
    calls = t.events.join(users, "user_id").groupBy("n_nationkey").agg(F.count("*").alias("e"))
    joined = t.nation.join(conversations, "n_nationkey", "left").join(rated, "n_nationkey", "left").join(calls, "n_nationkey", "left").na.fill(0, ["c", "f", "likes", "e"])
    return joined.select(F.col("n_name").alias("agent"), F.col("c").alias("conversations"), A.satisfaction(F.col("likes"), F.col("f")).alias("satisfaction"), F.col("e").alias("tool_calls"))


@query(
    "dash_feedback",
    """SELECT doc_id, quality, source, lang, c_name, n_name FROM labels JOIN documents USING (doc_id) JOIN customer ON doc_id = c_custkey
    JOIN nation ON c_nationkey = n_nationkey WHERE quality = 0""",
)
def dash_feedback(t: Tables) -> DataFrame:
    rated = t.labels.filter("quality = 0").join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    users = t.customer.select(F.col("c_custkey").alias("doc_id"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return rated.join(users, "doc_id").join(t.nation, "n_nationkey").select("doc_id", "quality", "source", "lang", "c_name", "n_name").orderBy(F.desc("doc_id"))


@query(
    "dash_series",
    """WITH p AS (SELECT d::DATE AS day FROM range(DATE '2024-01-18', DATE '2024-02-01', INTERVAL 1 DAY) r(d)), k AS (SELECT DISTINCT event_type FROM events)
    SELECT day, k.event_type, count(event_id) AS calls FROM p CROSS JOIN k LEFT JOIN events e ON (ts + INTERVAL 8 HOUR)::DATE = day AND e.event_type = k.event_type GROUP BY ALL""",
)
def dash_series(t: Tables) -> DataFrame:
    """14 days by category, every cell filled."""
    kinds = t.events.select("event_type").distinct()
    frame = A.calendar(t.spark, "2024-01-31", 14).join(F.broadcast(kinds))
    counts = t.events.groupBy(A.local_day(F.col("ts")).alias("day"), "event_type").agg(F.count("*").alias("calls"))
    return A.zero_filled(counts, frame, ["day", "event_type"], "calls")


@query(
    "dash_series_hours",
    """SELECT h AS hour, count(event_id) AS calls FROM range(TIMESTAMP '2024-01-30 18:00', TIMESTAMP '2024-01-31 08:00', INTERVAL 1 HOUR) r(h)
    LEFT JOIN events ON date_trunc('hour', ts + INTERVAL 8 HOUR) = h GROUP BY h""",
)
def dash_series_hours(t: Tables) -> DataFrame:
    frame = t.spark.range(1).select(F.explode(F.expr("sequence(timestamp_ntz'2024-01-30 18:00:00', timestamp_ntz'2024-01-31 07:00:00', interval 1 hour)")).alias("hour"))
    counts = t.events.groupBy(F.date_trunc("hour", F.col("ts") + F.expr("interval 8 hours")).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("calls"))
    return A.zero_filled(counts, frame, ["hour"], "calls")


@query("dash_series_weeks", "SELECT CAST(isoyear(ts + INTERVAL 8 HOUR) AS INTEGER) AS year, CAST(week(ts + INTERVAL 8 HOUR) AS INTEGER) AS week, count(*) AS calls FROM events GROUP BY ALL")
def dash_series_weeks(t: Tables) -> DataFrame:
    """True ISO years and weeks."""
    local = F.col("ts") + F.expr("interval 8 hours")
    return t.events.groupBy(F.extract(F.lit("YEAROFWEEK"), local).alias("year"), F.extract(F.lit("WEEK"), local).alias("week")).agg(F.count("*").alias("calls"))


@query(
    "dash_series_summary",
    """WITH d AS (SELECT (ts + INTERVAL 8 HOUR)::DATE AS day, count(*) AS n FROM events GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS total, avg(n) AS average, max(n) AS peak, (SELECT day FROM d ORDER BY n DESC, day LIMIT 1) AS peak_period FROM d""",
)
def dash_series_summary(t: Tables) -> DataFrame:
    counts = t.events.groupBy(A.local_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))
    return A.series_summary(counts, "day", "n")


@query("dash_tokens_json", "SELECT 'tokens' AS metric, CAST(sum(CAST(props->>'k' AS INTEGER)) AS BIGINT) AS value FROM events UNION ALL SELECT 'calls', count(*) FROM events WHERE props->>'k' IS NOT NULL")
def dash_tokens_json(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.agg(F.sum(k).alias("tokens"), F.count(k).alias("calls")).unpivot([], ["tokens", "calls"], "metric", "value")


@query(
    "dash_threads_summary",
    f"""WITH {_VALID} SELECT count(*) AS threads, count(DISTINCT o_custkey) AS users, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'O') AS open_users,
    count(*) FILTER (o_orderdate >= DATE '2000-01-01') AS recent FROM valid""",
)
def dash_threads_summary(t: Tables) -> DataFrame:
    return valid_conversations(t).agg(
        F.count("*").alias("threads"),
        F.count_distinct("o_custkey").alias("users"),
        F.count_distinct(F.when(F.col("o_orderstatus") == "O", F.col("o_custkey"))).alias("open_users"),
        F.count_if(F.col("o_orderdate") >= F.expr("timestamp_ntz'2000-01-01'")).alias("recent"),
    )


@query("dash_threads_status", f"WITH {_VALID} SELECT o_orderstatus AS status, count(*) AS n FROM valid GROUP BY 1")
def dash_threads_status(t: Tables) -> DataFrame:
    return valid_conversations(t).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("dash_threads_daily", f"WITH {_VALID} SELECT o_orderdate::DATE AS day, count(*) AS threads, count(DISTINCT o_custkey) AS users FROM valid GROUP BY 1")
def dash_threads_daily(t: Tables) -> DataFrame:
    return valid_conversations(t).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("threads"), F.count_distinct("o_custkey").alias("users"))


@query("dash_threads_agents", f"WITH {_VALID} SELECT n_name AS agent, count(*) AS threads FROM valid GROUP BY 1 ORDER BY threads DESC, agent LIMIT 10")
def dash_threads_agents(t: Tables) -> DataFrame:
    return valid_conversations(t).groupBy(F.col("n_name").alias("agent")).agg(F.count("*").alias("threads")).orderBy(F.desc("threads"), "agent").limit(10)


@query("dash_threads_users", f"WITH {_VALID} SELECT o_custkey AS user_id, count(*) AS threads, round(sum(o_totalprice), 2) AS tokens FROM valid GROUP BY 1 ORDER BY threads DESC, user_id LIMIT 10")
def dash_threads_users(t: Tables) -> DataFrame:
    found = valid_conversations(t).groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("threads"), F.round(F.sum("o_totalprice"), 2).alias("tokens"))
    return found.orderBy(F.desc("threads"), "user_id").limit(10)


@query(
    "depth_hist",
    """WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '20+' END AS bin, count(*) AS n FROM c GROUP BY 1""",
)
def depth_hist(t: Tables) -> DataFrame:
    depth = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("depth"))
    return t.orders.select("o_orderkey").join(depth, "o_orderkey", "left").groupBy(A.depth_bin(F.col("depth")).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "token_totals",
    """WITH r AS (SELECT l_orderkey AS id, sum(l_quantity) AS own, bool_and(l_linestatus = 'F') AS complete FROM lineitem WHERE l_returnflag = 'N' OR l_linestatus = 'F' GROUP BY 1)
    SELECT o_orderkey AS conversation_id, coalesce(own, nullif(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END, 0)) AS tokens, coalesce(complete, false) AS complete
    FROM orders LEFT JOIN r ON id = o_orderkey""",
)
def token_totals(t: Tables) -> DataFrame:
    runs = t.lineitem.select(F.col("l_orderkey").alias("conversation_id"), F.col("l_quantity").alias("tokens"), (F.col("l_returnflag") == "N").cast("int").alias("reported"), (F.col("l_linestatus") == "F").alias("complete"))
    orders = t.orders.withColumnRenamed("o_orderkey", "conversation_id")
    legacy = orders.select("conversation_id", F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice")).alias("total"))
    return A.conversation_tokens(orders, runs, legacy)


@query(
    "dash_conv_list",
    f"""WITH {_VALID} SELECT o_orderkey, c_name, n_name, count(*) OVER () AS total FROM valid
    WHERE c_name ILIKE '%00%' OR n_name ILIKE '%00%' OR o_orderpriority ILIKE '%00%' OR c_mktsegment ILIKE '%00%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20""",
)
def dash_conv_list(t: Tables) -> DataFrame:
    rows = valid_conversations(t).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey")
    any_of = F.lit(False)
    for c in ("c_name", "n_name", "o_orderpriority", "c_mktsegment"):
        any_of = any_of | F.col(c).ilike("%00%")
    found = rows.filter(any_of)
    page = found.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(20).select("o_orderkey", "c_name", "n_name")
    return page.join(F.broadcast(found.agg(F.count("*").alias("total"))))


@query("dash_options", "SELECT DISTINCT c_mktsegment AS option, 'segment' AS kind FROM customer UNION SELECT n_name, 'agent' FROM nation")
def dash_options(t: Tables) -> DataFrame:
    segments = t.customer.select(F.col("c_mktsegment").alias("option"), F.lit("segment").alias("kind"))
    return segments.unionByName(t.nation.select(F.col("n_name").alias("option"), F.lit("agent").alias("kind"))).distinct().orderBy("kind", "option")


@query(
    "kb_stats",
    """SELECT count(*) AS files, count(DISTINCT source) AS folders, CAST(sum(n_chars) AS BIGINT) AS size, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr,
    count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (n_chars > 1000) AS large, count(*) FILTER (text IS NULL) AS pending FROM documents""",
)
def kb_stats(t: Tables) -> DataFrame:
    return t.documents.agg(
        F.count("*").alias("files"), F.count_distinct("source").alias("folders"), F.sum("n_chars").alias("size"),
        *(F.count_if(F.col("lang") == x).alias(x) for x in ("en", "fr", "de", "es")), F.count_if(F.col("n_chars") > 1000).alias("large"), F.count_if(F.col("text").isNull()).alias("pending"),
    )


@query(
    "file_types",
    """SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE upper(lang) END AS label, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1""",
)
def file_types(t: Tables) -> DataFrame:
    """Types mapped to labels; an unknown one is written in capitals."""
    labels = t.spark.createDataFrame([("en", "English"), ("de", "German")], "lang string, known string")
    named = t.documents.select("lang", "n_chars").join(F.broadcast(labels), "lang", "left")
    return named.groupBy(F.coalesce("known", F.upper("lang")).alias("label")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"))


@query(
    "kb_types",
    "SELECT CASE source WHEN 'src0' THEN 'Milvus' WHEN 'src1' THEN 'Notion' ELSE upper(coalesce(source, '')) END AS type, count(*) AS bases, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1",
)
def kb_types(t: Tables) -> DataFrame:
    """Bases by the label of their type; one without a label is written in capitals."""
    labels = t.spark.createDataFrame([("src0", "Milvus"), ("src1", "Notion")], "source string, known string")
    named = t.documents.select("source", "n_chars").join(F.broadcast(labels), "source", "left")
    return named.groupBy(F.coalesce("known", F.upper(F.coalesce("source", F.lit("")))).alias("type")).agg(F.count("*").alias("bases"), F.sum("n_chars").alias("size"))


@query("children_count", "SELECT c_nationkey AS parent_id, count(*) AS children FROM customer GROUP BY 1")
def children_count(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_nationkey").alias("parent_id")).agg(F.count("*").alias("children"))


@query("chunk_counts", r"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS BIGINT) AS chunks FROM documents")
def chunk_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))).cast("long").alias("chunks"))


@query(
    "repair_stats",
    """WITH a AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN CAST(length(o_orderpriority) AS BIGINT) END AS old FROM orders)
    SELECT id, coalesce(n, 0) AS n FROM s LEFT JOIN a USING (id) WHERE old IS DISTINCT FROM coalesce(n, 0)""",
)
def repair_stats(t: Tables) -> DataFrame:
    stored = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.length("o_orderpriority").cast("long")).alias("n"))
    return A.changed_counts(stored, t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n")), "id", "n")


@query("extract_status", "SELECT coalesce(CASE quality WHEN 1 THEN 'done' WHEN 0 THEN 'failed' END, 'pending') AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def extract_status(t: Tables) -> DataFrame:
    status = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "failed")
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").groupBy(F.coalesce(status, F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


@query("task_summary", "SELECT o_orderstatus AS status, o_orderpriority AS type, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def task_summary(t: Tables) -> DataFrame:
    return t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("type"), "n")


@query(
    "token_usage",
    """SELECT event_type AS model, count(*) AS calls, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS input, sum(value) AS output, CAST(sum(CASE WHEN value > 10 THEN CAST(props->>'k' AS BIGINT) ELSE 0 END) AS BIGINT) AS cached,
    bool_and(value > 0.02) AS complete, round(sum(CASE WHEN value > 10 THEN CAST(props->>'k' AS BIGINT) ELSE 0 END) / sum(CAST(props->>'k' AS BIGINT)), 4) AS hit_ratio FROM events GROUP BY ROLLUP (event_type)""",
)
def token_usage(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    calls = t.events.select(F.col("event_type").alias("model"), k.alias("input"), F.col("value").alias("output"), F.when(F.col("value") > 10, k).otherwise(0).alias("cached"), (F.col("value") > 0.02).alias("reported"))
    return A.usage_by_model(calls)


@query(
    "latencies",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate >= o_orderdate THEN epoch_ms(l_shipdate) - epoch_ms(o_orderdate) END AS ms FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def latencies(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", A.milliseconds(F.col("o_orderdate"), F.col("l_shipdate")).cast("long").alias("ms"))


@query("percentiles", "SELECT event_type, count(value) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM events GROUP BY 1")
def percentiles(t: Tables) -> DataFrame:
    return A.nearest_rank(t.events, ["event_type"], "value")


@query(
    "stage_phases",
    """WITH p AS (SELECT event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type)) - epoch_us(ts) AS us FROM events)
    SELECT event_type, count(us) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY us / 1000) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY us / 1000) AS p95 FROM p WHERE us IS NOT NULL GROUP BY 1""",
)
def stage_phases(t: Tables) -> DataFrame:
    phases = A.phase_times(t.events, "user_id", "event_type", "ts")
    return A.nearest_rank(phases, ["event_type"], "ms")


@query(
    "span_totals",
    """WITH s AS (SELECT l_orderkey AS request, sum(greatest(0, epoch_ms(least(l_shipdate, TIMESTAMP '2000-01-01')) - epoch_ms(TIMESTAMP '1995-01-01'))) AS ms FROM lineitem GROUP BY 1)
    SELECT round(avg(coalesce(ms, 0)), 3) AS mean_ms FROM orders LEFT JOIN s ON request = o_orderkey""",
)
def span_totals(t: Tables) -> DataFrame:
    spans = t.lineitem.select(F.col("l_orderkey").alias("request"), F.expr("timestamp_ntz'1995-01-01 00:00:00'").alias("start"), F.col("l_shipdate").alias("finish"))
    return A.span_means(spans, t.orders.select(F.col("o_orderkey").alias("request")), "2000-01-01 00:00:00").select(F.round("mean_ms", 3).alias("mean_ms"))


@query("chunk_stats", r"SELECT source, count(*) AS files, CAST(sum(CASE WHEN regexp_matches(coalesce(text, ''), '[^\s\x{a0}\x{3000}]') THEN greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]'))) ELSE 0 END) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def chunk_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("files"), F.sum(tok_count(F.col("text"))).alias("tokens"))
