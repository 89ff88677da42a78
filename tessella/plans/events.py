"""Event-log, model, source and sink queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import models as M
from tessella.plans.registry import Registry, Tables
from tessella.session import new_path
from tessella.sources import readers as R
from tessella.sources import sinks as K
from tessella.streaming import events as E
from tessella.streaming import stateful as T

query = Registry()
QUERIES, SQL = query.queries, query.sql

NOW = "2024-01-31 00:00:00"


def _seq(t: Tables) -> DataFrame:
    return t.events.withColumn("seq", F.concat_ws("-", F.unix_millis(F.col("ts").cast("timestamp")), "event_id"))


@query("ev_read", "SELECT event_id FROM events WHERE (epoch_ms(ts), event_id) > (1704700000000, 0) ORDER BY epoch_ms(ts), event_id LIMIT 200")
def ev_read(t: Tables) -> DataFrame:
    return E.after_cursor(_seq(t), "seq", "1704700000000-0", 200).select("event_id")


@query("ev_recent", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def ev_recent(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id")


@query(
    "ev_append",
    """WITH a AS (SELECT 1704067200000 + CASE WHEN event_id < 500 THEN 0 ELSE 1000 END AS ms, event_id AS n, event_type FROM events)
    SELECT ms || '-' || n AS seq, '{"v":1,"run_id":"r","kind":"' || event_type || '"}' AS envelope, ms + 7200000 AS drop_after FROM a ORDER BY ms DESC, n DESC LIMIT 300""",
)
def ev_append(t: Tables) -> DataFrame:
    """Two batches appended to a log; the latest 300 are kept."""
    log = new_path(t.spark, "log")
    rows = t.events.select(F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("payload"), F.col("event_id").alias("n"))
    for part, second in (("n < 500", 0), ("n >= 500", 1)):
        E.appended(t.spark, log, "r", rows.filter(part), F.lit(f"2024-01-01 00:00:0{second}").cast("timestamp"), 0)
    return E.retained(t.spark.read.parquet(log), 1704067200000, 300).select("seq", "envelope", "drop_after")


@query("ev_last", "SELECT user_id, arg_max(event_id, ts) AS last_id FROM events GROUP BY 1")
def ev_last(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


@query("ev_decode", "SELECT event_id, CAST(CASE WHEN event_type <> 'view' THEN props->>'k' END AS INTEGER) AS k, CASE WHEN event_type = 'view' THEN 'old ' || props END AS raw FROM events")
def ev_decode(t: Tables) -> DataFrame:
    """Payloads of one type are not JSON: they are kept as they are."""
    payload = F.when(F.col("event_type") == "view", F.concat(F.lit("old "), "props")).otherwise(F.col("props"))
    return t.events.select("event_id", E.decoded(payload, "k int").alias("p")).select("event_id", "p.k", "p.raw")


def tasks(t: Tables) -> DataFrame:
    """Events as tasks: errors are running with a lease of a day, views pending."""
    status = F.when(F.col("event_type") == "error", "running").when(F.col("event_type") == "view", "pending").otherwise("done")
    lease = F.col("ts") + F.expr("interval 1 day")
    return t.events.select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 7 days")).alias("due_at"), lease.alias("lease_until"), (F.col("user_id") % 3).cast("int").alias("attempt"))


_TASKS = """tasks AS (SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'done' END AS status,
    ts + INTERVAL 7 DAY AS due_at, ts + INTERVAL 1 DAY AS lease_until, CAST(user_id % 3 AS INTEGER) AS attempt FROM events)"""


@query("lease_claim", f"WITH {_TASKS} SELECT id, attempt + 1 AS attempt FROM tasks WHERE (status = 'pending' AND due_at <= TIMESTAMP '{NOW}') OR (status = 'running' AND lease_until < TIMESTAMP '{NOW}')")
def lease_claim(t: Tables) -> DataFrame:
    return E.claimable(tasks(t), F.expr(f"timestamp_ntz'{NOW}'")).select("id", "attempt")


@query("retry_policy", f"WITH {_TASKS} SELECT id, CASE WHEN attempt > 2 THEN 'failed' ELSE 'pending' END AS status, CASE attempt WHEN 1 THEN 5 WHEN 2 THEN 30 END AS wait FROM tasks")
def retry_policy(t: Tables) -> DataFrame:
    status, wait = E.after_failure(F.col("attempt"))
    return tasks(t).select("id", status.alias("status"), wait.alias("wait"))


@query("reconcile", f"WITH {_TASKS} SELECT CASE WHEN status = 'running' AND lease_until < TIMESTAMP '{NOW}' THEN 'failed' ELSE status END AS status, count(*) AS n FROM tasks GROUP BY 1")
def reconcile(t: Tables) -> DataFrame:
    over = (F.col("status") == "running") & (F.col("lease_until") < F.expr(f"timestamp_ntz'{NOW}'"))
    return tasks(t).groupBy(F.when(over, "failed").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


@query("cas_status", f"WITH {_TASKS} SELECT id, CASE WHEN status IN ('pending', 'running') THEN 'done' ELSE status END AS status, status IN ('pending', 'running') AS changed FROM tasks")
def cas_status(t: Tables) -> DataFrame:
    return E.changed_if(tasks(t), "status", ["pending", "running"], F.lit("done")).select("id", "status", "changed")


@query("fail_files", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'error_parsing' WHEN 'O' THEN 'error_indexing' ELSE o_orderstatus END AS status FROM orders")
def fail_files(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "error_parsing").when(F.col("o_orderstatus") == "O", "error_indexing").otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", status.alias("status"))


@query(
    "cancel_tree",
    """WITH RECURSIVE r AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent, 'running' AS status FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, 'done' FROM region
      UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_acctbal < 0 THEN 'done' ELSE 'pending' END FROM customer),
    b(id) AS (SELECT 'r3' UNION SELECT r.id FROM b JOIN r ON r.parent = b.id) SELECT id FROM r WHERE id IN (SELECT id FROM b) AND status <> 'done'""",
)
def cancel_tree(t: Tables) -> DataFrame:
    runs = (
        t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("done").alias("status"))
        .unionByName(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit("running").alias("status")))
        .unionByName(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.when(F.col("c_acctbal") < 0, "done").otherwise("pending").alias("status")))
    )
    return E.cancelled_tree(runs, "r3", ["done"])


@query("dispatch_scopes", f"WITH {_TASKS} SELECT DISTINCT user_id FROM tasks JOIN events ON event_id = id WHERE status = 'pending' UNION SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'")
def dispatch_scopes(t: Tables) -> DataFrame:
    of = lambda kind: t.events.filter(F.col("event_type") == kind).select("user_id")
    return of("view").union(of("signup")).distinct()


_LEASE_SQL = """
    WITH e AS (SELECT user_id AS id, event_id AS seq, epoch_ms(ts) AS t, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'beat' WHEN 'purchase' THEN 'done' ELSE 'error' END AS k FROM events),
    x AS (SELECT id, t, seq, 0 AS o, 'tick' AS k FROM e UNION ALL SELECT id, t, seq, 1, k FROM e UNION ALL SELECT DISTINCT id, (SELECT max(t) - 600000 FROM e), 9223372036854775807, 2, 'tick' FROM e),
    l AS (SELECT id, list({'s': 'none', 'a': 0, 'due': 0::BIGINT, 'lease': 0::BIGINT, 'k': k, 't': t} ORDER BY o = 2, t, seq, o) AS es FROM x GROUP BY id),
    f AS (SELECT id, list_reduce(es, lambda c, e:
      CASE WHEN e.k = 'submit' AND c.s IN ('none', 'done', 'failed') THEN {'s': 'pending', 'a': 0, 'due': e.t, 'lease': 0, 'k': '', 't': 0}
        WHEN e.k = 'claim' AND c.s = 'pending' AND c.due <= e.t THEN {'s': 'running', 'a': c.a + 1, 'due': 0, 'lease': e.t + 86400000, 'k': '', 't': 0}
        WHEN e.k = 'beat' AND c.s = 'running' THEN {'s': 'running', 'a': c.a, 'due': 0, 'lease': e.t + 86400000, 'k': '', 't': 0}
        WHEN e.k = 'done' AND c.s = 'running' THEN {'s': 'done', 'a': c.a, 'due': 0, 'lease': 0, 'k': '', 't': 0}
        WHEN c.s = 'running' AND (e.k = 'error' OR (e.k = 'tick' AND c.lease < e.t)) THEN
          CASE WHEN c.a > 2 THEN {'s': 'failed', 'a': c.a, 'due': 0, 'lease': 0, 'k': '', 't': 0}
            ELSE {'s': 'pending', 'a': c.a, 'due': CASE WHEN e.k = 'tick' THEN c.lease ELSE e.t END + CASE c.a WHEN 1 THEN 5000 ELSE 30000 END, 'lease': 0, 'k': '', 't': 0} END
        ELSE c END, {'s': 'none', 'a': 0, 'due': 0::BIGINT, 'lease': 0::BIGINT, 'k': '', 't': 0::BIGINT}) AS c FROM l)
    SELECT id, c.s AS status, CAST(c.a AS INTEGER) AS attempt FROM f"""


def task_events(events: DataFrame) -> DataFrame:
    """Events of users as those of a task each."""
    kind = F.create_map(*(F.lit(x) for x in ("signup", "submit", "click", "claim", "view", "beat", "purchase", "done", "error", "error")))
    return events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kind[F.col("event_type")].alias("kind"), F.col("ts").cast("timestamp").alias("at"))


@query("lease_states", _LEASE_SQL)
def lease_states(t: Tables) -> DataFrame:
    """Claims, leases and retries of all tasks at the end of the watermark, as one fold a task."""
    end = t.events.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))) - 600_000).first()[0] or 0
    return T.task_states(task_events(t.events), end)


@query("lease_stream", _LEASE_SQL.replace("FROM f", "FROM f WHERE c.s <> 'none'"))
def lease_stream(t: Tables) -> DataFrame:
    """The same out of a stream with a timer for each lease; tasks without a transition give no row."""
    stream = task_events(E.stream_of(t.spark, t.sf_dir, t.events.schema, "events.parquet"))
    return T.latest_states(E.run_once(T.task_transitions(stream), new_path(t.spark, "transitions"), new_path(t.spark, "transitions-checkpoint")))


_HOURS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL"


@query("window_batch", _HOURS)
def window_batch(t: Tables) -> DataFrame:
    found = E.windowed(t.events, F.col("ts").cast("timestamp"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 6).alias("value"))


@query(
    "window_stream",
    """SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def window_stream(t: Tables) -> DataFrame:
    """The windows that the watermark has closed, out of a file stream. Time must be an instant for a watermark."""
    stream = E.stream_of(t.spark, t.sf_dir, t.events.schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    out = E.run_once(E.windowed(stream, F.col("ts")), new_path(t.spark, "windows"), new_path(t.spark, "windows-checkpoint"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("dedup_stream", "SELECT DISTINCT event_id FROM events")
def dedup_stream(t: Tables) -> DataFrame:
    """Replays within the watermark are dropped."""
    stream = E.stream_of(t.spark, t.sf_dir, t.events.schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    twice = stream.select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    kept = twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id")
    return E.run_once(kept, new_path(t.spark, "dedup"), new_path(t.spark, "dedup-checkpoint"))


@query(
    "session_windows",
    """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""",
)
def session_windows(t: Tables) -> DataFrame:
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    found = rows.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


_ENTITIES = """SELECT doc_id, unnest(list_distinct(list_filter(list_transform(range(2, len(ws) + 1), lambda i: CASE WHEN regexp_matches(ws[i - 1], '[a-z,;]$') THEN regexp_extract(ws[i], '^[A-Z][a-z]{3,}') ELSE '' END), lambda x: x <> ''))) AS entity
    FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS ws FROM documents)"""


@query("graph_build", f"SELECT entity, count(*) AS mentions FROM ({_ENTITIES}) GROUP BY entity")
def graph_build(t: Tables) -> DataFrame:
    """A resumable pipeline in stages of tables: documents to extracted entities to mentions, each file once."""
    store, out = new_path(t.spark, "extracted"), new_path(t.spark, "graph")

    def extract(df: DataFrame) -> DataFrame:
        found = M.memoised(df.select("doc_id", "text"), "capitalised_entities", "text", "reply", store)
        return found.select("doc_id", "status", F.from_json(M.fenced_json(F.col("reply")), "entities array<string>").getField("entities").alias("entities"))

    def mentions(df: DataFrame) -> DataFrame:
        return df.filter("status = 'done'").select("doc_id", F.explode("entities").alias("entity"))

    stream = E.stream_of(t.spark, t.sf_dir, t.documents.schema, "documents.parquet")
    T.run_stages(stream, [("extracted", extract), ("mentions", mentions)], out, new_path(t.spark, "graph-checkpoint"))
    return t.spark.read.parquet(f"{out}/mentions").groupBy("entity").agg(F.count("*").alias("mentions"))


#: CRC-32 of a token, bit by bit.
_CRC = """xor(list_reduce(list_transform(range(1, strlen(w) + 1), lambda i: CAST(ascii(w[i]) AS BIGINT)), lambda c, b: list_reduce(CAST(range(8) AS BIGINT[]),
    lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""


_EMBEDDINGS = rf"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]')) AS w FROM documents),
    h AS (SELECT w, {_CRC} % 64 AS slot FROM (SELECT DISTINCT w FROM t)),
    n AS (SELECT doc_id, slot, count(*) AS n FROM t JOIN h USING (w) GROUP BY ALL),
    m AS (SELECT doc_id, map_from_entries(list({{'k': slot, 'v': n}})) AS m FROM n GROUP BY doc_id)
    SELECT doc_id, list_transform(range(64), lambda i: coalesce(m[i], 0)::DOUBLE) AS embedding FROM documents LEFT JOIN m USING (doc_id)"""


@query("embed_index", _EMBEDDINGS)
def embed_index(t: Tables) -> DataFrame:
    """Half of the documents are indexed, then all: the second call embeds the others only."""
    from tessella.operators.chunking import hashed_vectors

    M.register("hashed", lambda texts: hashed_vectors(texts).tolist())
    docs, name = t.documents.select(F.col("doc_id").alias("id"), "text"), "embeddings_" + new_path(t.spark, "t").rsplit("-", 1)[-1]
    K.index_embeddings(docs.filter("id % 2 = 0"), name, "hashed", 8)
    K.index_embeddings(docs, name, "hashed", 8)
    return t.spark.table(name).select(F.col("id").alias("doc_id"), "embedding")


_CRON_ZONES = ["UTC", "Etc/GMT-8", "Etc/GMT+5"]


@query(
    "cron_next",
    """
    WITH e AS (SELECT event_id, ts, event_id % 60 AS m, user_id % 24 AS h, event_id % 7 AS d, [0, 8, -5][event_id % 3 + 1] AS shift FROM events),
    l AS (SELECT *, ts + shift * INTERVAL 1 HOUR AS here FROM e),
    c AS (SELECT *, date_trunc('day', here) + ((d - dayofweek(here) + 7) % 7) * INTERVAL 1 DAY + h * INTERVAL 1 HOUR + m * INTERVAL 1 MINUTE AS first FROM l)
    SELECT event_id, CASE WHEN first > here THEN first ELSE first + INTERVAL 7 DAY END - shift * INTERVAL 1 HOUR AS next_run FROM c""",
)
def cron_next(t: Tables) -> DataFrame:
    """Each event as a schedule: a minute and hour of a weekday, in one of three zones."""
    zones = F.array(*(F.lit(z) for z in _CRON_ZONES))
    text = F.format_string("%d %d * * %d", F.col("event_id") % 60, F.col("user_id") % 24, F.col("event_id") % 7)
    rows = t.events.select("event_id", "ts", text.alias("cron"), F.element_at(zones, (F.col("event_id") % 3 + 1).cast("int")).alias("zone"))
    return E.with_next_run(rows, "cron", "zone", "ts").select("event_id", "next_run")


@query("src_html")
def src_html(t: Tables) -> DataFrame:
    M.register("html", lambda texts: [R.html_to_markdown(x) for x in texts])
    return M.applied(t.pages.select("page_id", "html"), "html", "html", "markdown", "string").select("page_id", "markdown")


@query("src_csv", "SELECT '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' AS markdown FROM nation")
def src_csv(t: Tables) -> DataFrame:
    """A CSV file with a header, and each of its rows as a table of its own."""
    path = new_path(t.spark, "csv")
    t.nation.select("n_nationkey", "n_name").write.csv(path, header=True)
    return R.reader("csv")(t.spark, path)


@query("src_text", "SELECT n_nationkey, n_name || chr(10) || 'in region ' || n_regionkey || chr(10) AS text FROM nation")
def src_text(t: Tables) -> DataFrame:
    """Text files, each read whole as one row."""
    path = new_path(t.spark, "texts")
    t.nation.select("n_nationkey", F.concat("n_name", F.lit("\nin region "), "n_regionkey").alias("value")).write.partitionBy("n_nationkey").text(path)
    found = R.reader("texts")(t.spark, path)
    return found.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("value").alias("text"))


@query("src_json", "SELECT n_nationkey, '```json' || chr(10) || '{' || chr(10) || '  \"n_nationkey\": ' || n_nationkey || ',' || chr(10) || '  \"n_name\": \"' || n_name || '\"' || chr(10) || '}' || chr(10) || '```' AS markdown FROM nation")
def src_json(t: Tables) -> DataFrame:
    """JSON files as indented JSON in a fence."""
    path = new_path(t.spark, "json")
    record = F.to_json(F.struct("n_nationkey", "n_name"))
    t.nation.select(F.col("n_nationkey").alias("k"), record.alias("value")).write.partitionBy("k").text(path)
    found = t.spark.read.text(path, wholetext=True)
    M.register("json", lambda texts: [R.json_to_markdown(x) for x in texts])
    return M.applied(found.select(F.col("k").cast("int").alias("n_nationkey"), "value"), "json", "value", "markdown", "string").select("n_nationkey", "markdown")


@query(
    "src_xls",
    """WITH r AS (SELECT s_nationkey AS book, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier)
    SELECT book, 'names' AS sheet, n AS row, [CAST(s_suppkey AS VARCHAR), s_name] AS cells FROM r UNION ALL SELECT book, 'keys', n, [CAST(s_suppkey AS VARCHAR)] FROM r""",
)
def src_xls(t: Tables) -> DataFrame:
    """A workbook of two sheets for each nation's suppliers, read back: every cell as text, without a header."""
    books = K.workbooks(t.supplier, "s_nationkey", {"names": ["s_suppkey", "s_name"], "keys": ["s_suppkey"]}, "s_suppkey")
    found = R.sheet_rows(books.select(F.concat(F.col("s_nationkey").cast("string"), F.lit(".xlsx")).alias("path"), "content"))
    return found.select(F.split_part("path", F.lit("."), F.lit(1)).cast("int").alias("book"), "sheet", "row", "cells")


@query("src_jsonl", "SELECT 'item ' || item_id AS query, item_id > 5 AS has_gold_chunks, item_id <> 7 AS has_gold_answer, false AS bad FROM benchmark")
def src_jsonl(t: Tables) -> DataFrame:
    record = F.to_json(F.struct(F.concat_ws(" ", F.lit("item"), "item_id").alias("query"), F.when(F.col("item_id") > 5, F.array(F.col("item_id").cast("string"))).alias("gold_chunk_ids"), F.when(F.col("item_id") != 7, F.lit("yes")).alias("gold_answer")))
    return R.read_questions(t.benchmark.select(record.alias("value"))).select("query", "has_gold_chunks", "has_gold_answer", "bad")


@query("snk_jsonl", "SELECT CASE WHEN quality = 1 THEN '{\"doc_id\":' || doc_id || ',\"good\":true}' ELSE '{\"doc_id\":' || doc_id || '}' END AS value FROM labels")
def snk_jsonl(t: Tables) -> DataFrame:
    """The lines of the file that is written."""
    path = new_path(t.spark, "jsonl")
    K.write_json_lines(t.labels.select("doc_id", F.when(F.col("quality") == 1, True).alias("good")), "doc_id", path)
    return t.spark.read.text(path)


@query("snk_upsert_chunks", "SELECT o_orderkey AS chunk_id, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS value FROM orders")
def snk_upsert_chunks(t: Tables) -> DataFrame:
    old = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("value"), F.lit(0).alias("seq"))
    new = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("chunk_id"), F.explode(F.array(F.col("o_totalprice"), F.col("o_totalprice") * 2)).alias("value"))
    numbered = new.withColumn("seq", F.row_number().over(Window.partitionBy("chunk_id").orderBy("value")))
    return K.merged(old, numbered, "chunk_id", F.col("seq")).select("chunk_id", "value")


@query("embed_batch", _EMBEDDINGS)
def embed_batch(t: Tables) -> DataFrame:
    from tessella.operators.chunking import hashed_vectors

    M.register("hashed", lambda texts: hashed_vectors(texts).tolist())
    return M.applied(t.documents.select("doc_id", "text"), "hashed", "text", "embedding", "array<double>").select("doc_id", "embedding")


@query("llm_extract", _ENTITIES)
def llm_extract(t: Tables) -> DataFrame:
    """The second call takes what the first has stored."""
    store, docs = new_path(t.spark, "extracted"), t.documents.select("doc_id", "text")
    M.memoised(docs.filter("doc_id % 2 = 0"), "capitalised_entities", "text", "reply", store)
    found = M.memoised(docs, "capitalised_entities", "text", "reply", store).filter("status = 'done'")
    return found.select("doc_id", F.explode(F.from_json(M.fenced_json(F.col("reply")), "entities array<string>").getField("entities")).alias("entity"))


@query("llm_judge", "SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 0.0 ELSE coalesce(quality, 0) END::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id)")
def llm_judge(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left")
    return joined.select("doc_id", M.judged(F.col("text"), F.lit("gold"), F.col("quality")).alias("score"))


@query("strip_fence_json", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def strip_fence_json(t: Tables) -> DataFrame:
    reply = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return t.events.select("event_id", F.from_json(M.fenced_json(reply), "k int").getField("k").alias("k"))
