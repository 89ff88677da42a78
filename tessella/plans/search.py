"""Search, file and tree queries: a file's path is ``lang/source/doc_id.md``; the tree is region, nation, customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import collapse, heading_level, like_escape, probable_heading, snippet, utf8_cut
from tessella.operators import search as S
from tessella.plans.registry import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql


def paths(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))


_PATHS = "paths AS (SELECT doc_id, doc_id || '.md' AS name, lang || '/' || source || '/' || doc_id || '.md' AS path FROM documents)"


@query("like_escape", r"SELECT doc_id FROM documents WHERE text ILIKE '%100\%\_%' ESCAPE '\' OR source ILIKE '%src1%'")
def like_escape_(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("text").ilike(like_escape("100%_")) | F.col("source").ilike(like_escape("SRC1"))).select("doc_id")


_SNIP = r"""s AS (SELECT *, regexp_replace(regexp_replace(text, '[\s\x{a0}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g') AS c FROM documents),
    a AS (SELECT *, instr(lower(c), 'the') AS i FROM s), b AS (SELECT *, greatest(0, i - 73) AS lo, least(length(c), i + 74) AS hi FROM a)"""


@query("snippet", f"WITH {_SNIP} SELECT doc_id, substr(CASE WHEN i = 0 THEN c ELSE CASE WHEN lo > 0 THEN '...' ELSE '' END || substr(c, lo + 1, hi - lo) || CASE WHEN hi < length(c) THEN '...' ELSE '' END END, 1, 180) AS snippet FROM b")
def snippet_(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", snippet(F.col("text"), "the").alias("snippet"))


@query(
    "msg_search",
    """WITH f AS (SELECT * FROM conversations WHERE contains(lower(text), 'with')),
    r AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS matches, max(turn) OVER (PARTITION BY conv_id) AS latest, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM f)
    SELECT conv_id, matches, latest, place FROM r WHERE place <= 2""",
)
def msg_search(t: Tables) -> DataFrame:
    return S.message_search(t.conversations, "conv_id", "turn", "text", "with").select("conv_id", "matches", "latest", F.col("place").cast("long"))


@query("memory_search", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def memory_search(t: Tables) -> DataFrame:
    """Active and own threads that are no child of another."""
    own = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    children = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.filter("o_orderstatus <> 'P'").join(own, "o_custkey", "left_semi").join(children, "o_orderkey", "left_anti").select("o_orderkey")


@query("exclude_source", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality NOT IN (0)")
def exclude_source(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.filter(S.not_in_or_null(F.col("quality").cast("string"), ["0"])).select("doc_id")


@query("file_search", f"WITH {_PATHS} SELECT doc_id, path FROM paths JOIN labels USING (doc_id) WHERE contains(lower(path), 'src1') AND quality = 1 ORDER BY path")
def file_search(t: Tables) -> DataFrame:
    """Names with the term, of files in the wanted states."""
    return paths(t).filter(F.lower("path").contains("src1")).join(t.labels.filter("quality = 1"), "doc_id").orderBy("path").select("doc_id", "path")


@query("same_name", "SELECT DISTINCT a.p_partkey FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND a.p_partkey <> b.p_partkey")
def same_name(t: Tables) -> DataFrame:
    """Rows whose name, in any case, another row has."""
    twice = t.part.groupBy(F.lower("p_name").alias("n")).count().filter("count > 1")
    return t.part.join(twice, F.lower("p_name") == F.col("n"), "left_semi").select("p_partkey")


@query("exists_hash", "SELECT doc_id, EXISTS (SELECT 1 FROM documents o LEFT JOIN labels USING (doc_id) WHERE o.text = d.text AND o.doc_id <> d.doc_id AND (quality IS NULL OR quality <> 0)) AS known FROM documents d")
def exists_hash(t: Tables) -> DataFrame:
    """Whether another file has the same content hash, failed ones (quality 0) not counted. Counts of a hash are gathered
    first, so many equal files make no pairs."""
    files = t.documents.select("doc_id", F.sha2("text", 256).alias("hash")).join(t.labels, "doc_id", "left").withColumn("ok", F.coalesce(F.col("quality") != 0, F.lit(True)))
    counts = files.groupBy("hash").agg(F.count_if("ok").alias("n"))
    own = files.join(counts, "hash", "left")
    return own.select("doc_id", F.coalesce(F.col("n") - F.col("ok").cast("int") > 0, F.lit(False)).alias("known"))


@query("dup_content", "SELECT sha256(text) AS hash, count(*) AS files, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_content(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("files"), F.min("doc_id").alias("first_id")).filter("files > 1")


@query("dir_listing", f"WITH {_PATHS} SELECT split_part(substr(path, 4), '/', 1) AS name, true AS is_folder, count(*) AS files FROM paths WHERE path LIKE 'en/%' GROUP BY 1")
def dir_listing(t: Tables) -> DataFrame:
    return S.directory(paths(t), "path", "en/")


@query("dir_listing_leaf", f"WITH {_PATHS} SELECT name, false AS is_folder, CAST(1 AS BIGINT) AS files FROM paths WHERE path LIKE 'en/src1/%'")
def dir_listing_leaf(t: Tables) -> DataFrame:
    return S.directory(paths(t), "path", "en/src1/")


@query("path_norm", "SELECT page_id, CASE WHEN NOT (url LIKE '/%') AND NOT list_contains(string_split(url, '/'), '..') THEN array_to_string(list_filter(string_split(url, '/'), lambda x: x NOT IN ('', '.')), '/') END AS path FROM pages")
def path_norm(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.normal_path(F.col("url")).alias("path"))


@query("slash_count", "SELECT page_id, CAST(length(url) - length(replace(url, '/', '')) AS BIGINT) AS depth FROM pages")
def slash_count(t: Tables) -> DataFrame:
    return t.pages.select("page_id", (F.length("url") - F.length(F.replace("url", F.lit("/"), F.lit("")))).cast("long").alias("depth"))


@query("open_window", r"SELECT doc_id, array_to_string(list_transform(range(2, least(len(l), 4) + 1), lambda i: format('{:6d}', i) || chr(9) || l[i]), chr(10)) AS lines FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def open_window(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.numbered_window(F.col("text"), 2, 3).alias("lines"))


@query(
    "find_windows",
    r"""
    WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    m AS (SELECT doc_id, len(ls) AS n, list_filter(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '(?i)token\s*=|@|licen[cs]e') THEN i - 1 ELSE -1 END), lambda i: i >= 0) AS hits FROM l),
    f AS (SELECT doc_id, list_reduce(list_transform(hits, lambda i: {'m': i, 'n': n, 'covered': 0, 'f': CAST([] AS STRUCT(a INT, b INT)[])}), lambda s, x:
      CASE WHEN x.m < s.covered THEN s ELSE {'m': x.m, 'n': x.n, 'covered': least(greatest(x.m - 2, 0) + 5, x.n),
        'f': list_append(s.f, {'a': greatest(least(greatest(x.m - 2, 0) + 5, x.n) - 5, 0), 'b': least(greatest(x.m - 2, 0) + 5, x.n)})} END,
      {'m': 0, 'n': 0, 'covered': 0, 'f': CAST([] AS STRUCT(a INT, b INT)[])}).f AS f FROM m WHERE len(hits) > 0),
    w AS (SELECT doc_id, unnest(f[1:20]) AS w FROM f)
    SELECT doc_id, CAST(w.a AS INTEGER) AS start, CAST(w.b AS INTEGER) AS "end" FROM w""",
)
def find_windows(t: Tables) -> DataFrame:
    """Greedy windows of five lines around lines that match any of the patterns."""
    wanted = lambda x: x.rlike(r"(?i)token\s*=|@|licen[cs]e")
    found = S.line_windows(F.split(F.coalesce("text", F.lit("")), "\n"), wanted, 5, 20)
    return t.documents.select("doc_id", F.explode(found).alias("w")).select("doc_id", "w.*")


@query(
    "path_rank",
    f"""WITH {_PATHS}, s AS (SELECT path, CASE WHEN name = '12' THEN 1000.0 WHEN contains(name, '12') THEN 500.0 + CASE WHEN starts_with(name, '12') THEN 50 ELSE 0 END
      + CASE WHEN ends_with(name, '12') THEN 20 ELSE 0 END - least(instr(name, '12') - 1, 30) - least(length(name) * 0.5, 50) WHEN contains(path, '12') THEN 0.0 END AS score FROM paths)
    SELECT path, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, length(path), path LIMIT 50""",
)
def path_rank(t: Tables) -> DataFrame:
    found = paths(t).select("path", S.path_score(F.col("name"), F.col("path"), "12").alias("score")).filter("score is not null")
    return found.orderBy(F.desc("score"), F.length("path"), "path").limit(50)


@query("diff_sets", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O') b ON a.id = b.id")
def diff_sets(t: Tables) -> DataFrame:
    of = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return S.differences(of("F"), of("O"), "id")


def tree(t: Tables) -> DataFrame:
    """(id, parent, name)"""
    node = lambda df, kind, c, parent, name: df.select(F.concat_ws(":", F.lit(kind), c).alias("id"), parent.alias("parent"), F.col(name).alias("name"))
    return (
        node(t.region, "region", "r_regionkey", F.lit("root"), "r_name")
        .unionByName(node(t.nation, "nation", "n_nationkey", F.concat_ws(":", F.lit("region"), "n_regionkey"), "n_name"))
        .unionByName(node(t.customer, "customer", "c_custkey", F.concat_ws(":", F.lit("nation"), "c_nationkey"), "c_name"))
    )


_TREE = """tree AS (SELECT 'region:' || r_regionkey AS id, 'root' AS parent, r_name AS name FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, c_name FROM customer)"""
_BELOW = "below(id, depth) AS (SELECT 'region:2', 0 UNION ALL SELECT tree.id, depth + 1 FROM below JOIN tree ON parent = below.id)"


@query("tree_list", f"WITH RECURSIVE {_TREE}, {_BELOW} SELECT id, CAST(depth AS INTEGER) AS depth, name FROM below JOIN tree USING (id)")
def tree_list(t: Tables) -> DataFrame:
    whole = tree(t)
    found = S.descendants(whole, t.spark.createDataFrame([("region:2",)], "id string"))
    return found.join(whole.select("id", "name"), "id").orderBy("depth", F.lower("name"))


@query("tree_delete", f"WITH RECURSIVE {_TREE}, {_BELOW} SELECT id FROM tree WHERE id NOT IN (SELECT id FROM below)")
def tree_delete(t: Tables) -> DataFrame:
    """What is left after a folder and all below it are deleted."""
    whole = tree(t)
    return whole.join(S.descendants(whole, t.spark.createDataFrame([("region:2",)], "id string")), "id", "left_anti").select("id")


@query("tree_prune", f"WITH {_TREE} SELECT id FROM tree t WHERE NOT (id LIKE 'customer%' AND id IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_nationkey < 5)) AND id NOT IN ('nation:0', 'nation:1', 'nation:2', 'nation:3', 'nation:4')")
def tree_prune(t: Tables) -> DataFrame:
    """Without the customers of five nations, and then without these nations."""
    gone = t.customer.filter("c_nationkey < 5").select(F.concat_ws(":", F.lit("customer"), "c_custkey").alias("id"))
    return S.pruned(tree(t), gone, "root").select("id")


@query("tree_move_check", f"WITH RECURSIVE {_TREE}, {_BELOW} SELECT id, id NOT IN (SELECT id FROM below) AND id NOT LIKE 'customer%' AS allowed FROM tree")
def tree_move_check(t: Tables) -> DataFrame:
    """Where a folder may move: not to itself or below, nor into a file."""
    whole = tree(t)
    own = S.descendants(whole, t.spark.createDataFrame([("region:2",)], "id string")).select("id", F.lit(True).alias("own"))
    return whole.join(own, "id", "left").select("id", (F.col("own").isNull() & ~F.col("id").startswith("customer")).alias("allowed"))


@query("tree_materialise", f"WITH {_PATHS} SELECT DISTINCT '' AS parent, split_part(path, '/', 1) AS name FROM paths UNION SELECT DISTINCT split_part(path, '/', 1), split_part(path, '/', 2) FROM paths")
def tree_materialise(t: Tables) -> DataFrame:
    return S.folders_of(paths(t), "path")


@query(
    "access_filter",
    """SELECT o_orderkey, CASE WHEN CAST(o_custkey AS VARCHAR) = '7' OR o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS level FROM orders
    WHERE CAST(o_custkey AS VARCHAR) = '7' OR o_orderpriority = '1-URGENT' OR o_orderstatus = 'O'""",
)
def access_filter(t: Tables) -> DataFrame:
    """A plain user: owners and managers, too, are held to reading."""
    me = F.array(F.lit("7"))
    level = S.access(F.col("o_custkey").cast("string"), F.when(F.col("o_orderstatus") == "O", me), F.when(F.col("o_orderpriority") == "1-URGENT", me), "7", "user")
    return t.orders.select("o_orderkey", level.alias("level")).filter("level > 0")


@query("user_list", "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_name ILIKE '%11%' ORDER BY c_custkey LIMIT 20")
def user_list(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").filter(F.col("c_name").ilike("%11%"))
    return joined.orderBy("c_custkey").limit(20).select("c_custkey", "c_name", "n_name")


@query("dept_counts", "SELECT n_name, count(c_custkey) AS users FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal >= 9900 GROUP BY 1")
def dept_counts(t: Tables) -> DataFrame:
    """Departments with their users, without any, too; one query for all."""
    counts = t.customer.filter("c_acctbal >= 9900").groupBy("c_nationkey").agg(F.count("*").alias("users"))
    return t.nation.join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_name", F.coalesce("users", F.lit(0)).alias("users"))


@query(
    "compaction_trigger",
    r"""WITH c AS (SELECT conv_id, count(*) AS messages, sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]'))) AS tokens FROM conversations GROUP BY 1)
    SELECT conv_id, (messages >= 6 AND tokens >= 500) OR tokens >= 0.8 * 2000 AS compact FROM c""",
)
def compaction_trigger(t: Tables) -> DataFrame:
    """Any of: enough messages and tokens, or most of the context full."""
    sums = t.conversations.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9_]+|[一-鿿]"))).alias("tokens"))
    return sums.select("conv_id", (((F.col("messages") >= 6) & (F.col("tokens") >= 500)) | (F.col("tokens") >= 0.8 * 2000)).alias("compact"))


@query("consistency", "SELECT 'customer without orders' AS problem, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'order without items', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def consistency(t: Tables) -> DataFrame:
    idle = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.lit("customer without orders").alias("problem"), F.count("*").alias("n"))
    bare = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.lit("order without items").alias("problem"), F.count("*").alias("n"))
    return idle.unionByName(bare)


@query(
    "utf8_truncate",
    "SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE concat(left(text, list_max(list_filter(range(0, 201), lambda n: strlen(left(text, n)) <= 200))), '...') END AS text FROM documents",
)
def utf8_truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", utf8_cut(F.col("text"), 200).alias("text"))


@query("redact", "SELECT event_id, props->>'k' AS k, NULL::VARCHAR AS gone FROM events")
def redact(t: Tables) -> DataFrame:
    values = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("Api_Key_2"), F.lit("x"), F.lit("my_TOKEN"), F.lit("y"))
    return t.events.select("event_id", S.redacted(values).alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.coalesce(F.col("m")["Api_Key_2"], F.col("m")["my_TOKEN"]).alias("gone"))


@query("heading_level", r"SELECT doc_id, CASE WHEN regexp_extract(text, '^\s*(\d+(?:\.\d+)*)', 1) = '' THEN 0 ELSE least(6, len(string_split(regexp_extract(text, '^\s*(\d+(?:\.\d+)*)', 1), '.'))) END AS level FROM documents")
def heading_level_(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", heading_level(F.col("text")).alias("level"))


_C = r"regexp_replace(regexp_replace(l, '[\s\x{a0}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g')"


@query("heading_test", rf"SELECT doc_id, count(*) AS headings FROM (SELECT doc_id, {_C} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE length(s) BETWEEN 1 AND 60 AND NOT regexp_matches(s, '[.!?;,:。！？；，：]$') AND NOT regexp_matches(s, '[。！？]|[.!?] ') GROUP BY 1")
def heading_test(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).filter(probable_heading(F.col("l"))).groupBy("doc_id").agg(F.count("*").alias("headings"))


@query("collapse", rf"SELECT doc_id, {_C.replace('(l,', '(text,')} AS text FROM documents")
def collapse_(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", collapse(F.col("text")).alias("text"))
