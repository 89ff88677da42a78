"""Graph queries: chunks are orders, entities parts and suppliers, mentions line items; the tree of places is a
graph, too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import entity_name, short_hash
from tessella.operators import graph as G
from tessella.operators.retrieval import vector_top_k
from tessella.plans.registry import Registry, Tables, rounds_sql

query = Registry()
QUERIES, SQL = query.queries, query.sql

_NORM = r"lower(regexp_replace(regexp_replace({}, '[\s\x{{a0}}\x{{3000}}]+', ' ', 'g'), '^ | $', '', 'g'))"
_ID = "substr(sha256('kb:' || {}), 1, 32)"


@query("ent_norm", rf"SELECT doc_id, {_NORM.format('text')} AS name FROM documents")
def ent_norm(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", entity_name(F.col("text")).alias("name"))


@query("ent_id", f"SELECT p_partkey, {_ID.format(_NORM.format('p_name') + chr(32) + '||' + chr(32) + repr(':') + ' || p_type')} AS entity_id FROM part")
def ent_id(t: Tables) -> DataFrame:
    return G.with_entity_id(t.part, "kb", "p_name", "p_type").select("p_partkey", "entity_id")


def _triples(t: Tables) -> DataFrame:
    """supplier - supplies - part, with the order as the chunk."""
    ends = t.lineitem.select(F.col("l_orderkey").alias("chunk_id"), "l_suppkey", "l_partkey")
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), entity_name(F.col("s_name")).alias("name"))
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), entity_name(F.col("p_name")).alias("other_name"))
    return ends.join(s, "l_suppkey").join(p, "l_partkey").select("chunk_id", "name", F.lit("supplier").alias("label"), F.lit("supplies").alias("relation"), "other_name", F.lit("part").alias("other_label"))


_TR = f"""tr AS (SELECT DISTINCT l_orderkey AS chunk_id, {_NORM.format('s_name')} AS name, {_NORM.format('p_name')} AS other_name
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


@query("triple_id", f"WITH {_TR} SELECT DISTINCT {_ID.format(chr(110) + 'ame || ' + repr(':supplier:supplies:') + ' || other_name || ' + repr(':part'))} AS triple_id, name, other_name FROM tr")
def triple_id(t: Tables) -> DataFrame:
    return _triples(t).select("name", "label", "relation", "other_name", "other_label").distinct().select(G.triple_id("kb").alias("triple_id"), "name", "other_name")


@query("ent_records", f"WITH {_TR} SELECT chunk_id, name || ' ' || chr(8594) || ' supplies ' || chr(8594) || ' ' || other_name AS content FROM tr")
def ent_records(t: Tables) -> DataFrame:
    """A triple's text, once for each chunk."""
    return _triples(t).distinct().select("chunk_id", F.concat_ws(" → ", "name", "relation", "other_name").alias("content"))


@query(
    "ext_normalize",
    f"""
    WITH e AS (SELECT DISTINCT o_orderkey AS chunk_id, 'c' || o_custkey AS ref, {_NORM.format('o_orderpriority')} AS name FROM orders),
    r AS (SELECT DISTINCT l_orderkey AS chunk_id, {_NORM.format("p_type")} AS other, l_returnflag AS relation FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT r.chunk_id, e.name, 'Entity' AS label, relation, other AS other_name, 'part' AS other_label FROM r JOIN e USING (chunk_id)
    """,
)
def ext_normalize(t: Tables) -> DataFrame:
    """Entities without labels get one; relations to what is no entity of the chunk are dropped."""
    customers = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.lit("customer").alias("ref"), F.col("o_orderpriority").alias("name"), F.lit(" ").alias("label"))
    items = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    parts = items.select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("p"), "l_partkey").alias("ref"), F.col("p_type").alias("name"), F.lit("part").alias("label"))
    known = items.select(F.col("l_orderkey").alias("chunk_id"), F.lit("customer").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_returnflag").alias("relation"))
    dangling = known.withColumn("target", F.lit("nobody"))
    return G.normalised_relations(customers.unionByName(parts), known.unionByName(dangling))[1]


@query(
    "graph_payload",
    "SELECT p_brand AS name, p_type AS label, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS attributes FROM part GROUP BY ALL",
)
def graph_payload(t: Tables) -> DataFrame:
    found = G.merged_payload(t.part.select(F.col("p_brand").alias("name"), F.col("p_type").alias("label"), F.array(F.col("p_size").cast("string")).alias("attributes")))
    return found.withColumn("attributes", F.array_join("attributes", ","))


@query(
    "g_upsert",
    """SELECT l_partkey AS entity_id, arg_max(l_returnflag, seq) AS name, arg_max(l_suppkey, seq) AS source
    FROM (SELECT *, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) GROUP BY l_partkey""",
)
def g_upsert(t: Tables) -> DataFrame:
    """Line items in two deliveries: the last name and source of an entity win."""
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = t.lineitem.select(F.col("l_partkey").alias("entity_id"), F.col("l_returnflag").alias("name"), F.col("l_suppkey").alias("source"), seq.alias("seq"), "l_linestatus")
    old, new = rows.filter("l_linestatus = 'F'").drop("l_linestatus"), rows.filter("l_linestatus <> 'F'").drop("l_linestatus")
    return G.upsert_last(old, new, ["entity_id"], "seq", ["name", "source"])


@query(
    "g_mentions",
    "SELECT DISTINCT l_orderkey AS chunk_id, l_partkey AS entity_id FROM lineitem",
)
def g_mentions(t: Tables) -> DataFrame:
    """Mentions are inserted only where they are absent."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id"), "l_linestatus")
    old = rows.filter("l_linestatus = 'F'").drop("l_linestatus").distinct()
    return G.insert_absent(old, rows.drop("l_linestatus"), ["chunk_id", "entity_id"])


@query("g_merge", "SELECT DISTINCT 'part:' || l_partkey AS id, 'part' AS label FROM lineitem UNION SELECT DISTINCT 'supplier:' || l_suppkey, 'supplier' FROM lineitem")
def g_merge(t: Tables) -> DataFrame:
    """Merging relations makes each node once."""
    parts = t.lineitem.select(F.concat_ws(":", F.lit("part"), "l_partkey").alias("id"), F.lit("part").alias("label"))
    return parts.unionByName(t.lineitem.select(F.concat_ws(":", F.lit("supplier"), "l_suppkey").alias("id"), F.lit("supplier").alias("label"))).distinct()


@query(
    "g_delete_file",
    """
    WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
    m AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone))
    SELECT 'part' AS kind, p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM m)
    UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM m)
    """,
)
def g_delete_file(t: Tables) -> DataFrame:
    """Deleting finished orders leaves the entities that open ones still mention or relate."""
    part, supplier = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    mentions = t.lineitem.select(F.col("l_orderkey").alias("chunk_id"), part.alias("entity_id"))
    tid = F.concat_ws("-", supplier, part)
    triples = t.lineitem.select(tid.alias("triple_id"), supplier.alias("source_id"), part.alias("target_id")).distinct()
    triple_mentions = t.lineitem.select(F.col("l_orderkey").alias("chunk_id"), tid.alias("triple_id"))
    entities = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.concat(F.lit("p"), "p_partkey").alias("entity_id")).unionByName(
        t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), "s_suppkey").alias("entity_id"))
    )
    gone = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("chunk_id"))
    return G.delete_file(mentions, triples, triple_mentions, entities, gone)["entities"].select("kind", "id")


@query(
    "g_finalize",
    "SELECT o_orderkey AS chunk_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus <> 'F') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')",
)
def g_finalize(t: Tables) -> DataFrame:
    indexed = lambda c, v: F.when(F.col(c) == v, "indexed")
    entities = t.lineitem.select(F.col("l_orderkey").alias("chunk_id"), indexed("l_linestatus", "F").alias("status"))
    triples = t.lineitem.select(F.col("l_orderkey").alias("chunk_id"), F.when(F.col("l_returnflag") != "N", "indexed").alias("status"))
    return G.finished_chunks(t.orders.select(F.col("o_orderkey").alias("chunk_id")), entities, triples)


@query("g_status", "SELECT status, count(*) AS n FROM (SELECT l_linestatus AS status FROM lineitem UNION ALL SELECT o_orderstatus FROM orders) GROUP BY status")
def g_status(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_linestatus").alias("status")).unionByName(t.orders.select(F.col("o_orderstatus").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


@query("g_search_nodes", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an') ORDER BY p_partkey LIMIT 100")
def g_search_nodes(t: Tables) -> DataFrame:
    return t.part.filter(F.lower("p_name").contains("an") | F.lower("p_type").contains("an")).orderBy("p_partkey").limit(100).select("p_partkey", "p_name")


def places(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers and suppliers as nodes, and who belongs to whom as edges."""
    id_of = lambda kind, c: F.concat_ws(":", F.lit(kind), c)
    node = lambda df, kind, c: df.select(id_of(kind, c).alias("id"), F.lit(kind).alias("label"))
    edge = lambda df, kind, c, other, d: df.select(id_of(kind, c).alias("src"), id_of(other, d).alias("dst"))
    nodes = node(t.region, "region", "r_regionkey").unionByName(node(t.nation, "nation", "n_nationkey")).unionByName(node(t.customer, "customer", "c_custkey")).unionByName(node(t.supplier, "supplier", "s_suppkey"))
    edges = (
        edge(t.nation, "nation", "n_nationkey", "region", "n_regionkey")
        .unionByName(edge(t.customer, "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(edge(t.supplier, "supplier", "s_suppkey", "nation", "s_nationkey"))
    )
    return nodes, edges


_PLACES = """
    nodes AS (SELECT 'region:' || r_regionkey AS id, 'region' AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation
      UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier),
    edges AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
      UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier),
    ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""
_REACH = """reach(id, hops) AS (SELECT 'region:1', 0 UNION SELECT dst, hops + 1 FROM reach JOIN ways ON src = id WHERE hops < {}),
    met AS (SELECT id, min(hops) AS hops FROM reach GROUP BY id)"""


@query("g_expand", f"WITH RECURSIVE {_PLACES}, {_REACH.format(3)} SELECT id, CAST(hops AS INTEGER) AS hops FROM met")
def g_expand(t: Tables) -> DataFrame:
    nodes, edges = places(t)
    return G.expand(edges, nodes.filter("id = 'region:1'"), 3)


@query("g_expand_allowed", f"WITH RECURSIVE {_PLACES.replace('ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)', 'ways AS (SELECT * FROM (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) WHERE dst NOT LIKE ' + repr('customer%') + ')')}, {_REACH.format(3)} SELECT id, CAST(hops AS INTEGER) AS hops FROM met")
def g_expand_allowed(t: Tables) -> DataFrame:
    """Paths that avoid some nodes altogether."""
    nodes, edges = places(t)
    return G.expand(edges, nodes.filter("id = 'region:1'"), 3, allowed=nodes.filter("label <> 'customer'"))


@query("g_seed_subgraph", f"WITH RECURSIVE {_PLACES}, {_REACH.format(2)} SELECT src, dst FROM edges WHERE src IN (SELECT id FROM met) AND dst IN (SELECT id FROM met)")
def g_seed_subgraph(t: Tables) -> DataFrame:
    """The edges among the nodes within two steps of a seed."""
    nodes, edges = places(t)
    near = G.expand(edges, nodes.filter("id = 'region:1'"), 2).select("id")
    return edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@query(
    "g_cap",
    f"""WITH RECURSIVE {_PLACES}, {_REACH.format(3)}, k AS (SELECT id FROM met ORDER BY hops, id LIMIT 40)
    SELECT src, dst FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) ORDER BY src, dst LIMIT 80""",
)
def g_cap(t: Tables) -> DataFrame:
    nodes, edges = places(t)
    return G.capped(G.expand(edges, nodes.filter("id = 'region:1'"), 3), edges, 40)[1]


#: As many rounds as leave a change of 0.0003 in sum; what the SQL unrolls.
_PPR_ROUNDS = 50
_PPR_SQL = f"""
    WITH {_PLACES}, deg AS MATERIALIZED (SELECT src, count(*) AS d FROM ways GROUP BY src),
    begin_at AS MATERIALIZED (SELECT id, CASE WHEN id = 'nation:1' THEN 0.75 WHEN id = 'customer:1' THEN 0.25 ELSE 0.0 END::DOUBLE AS w, id NOT IN (SELECT src FROM ways) AS dangling FROM nodes),
    {rounds_sql(_PPR_ROUNDS)} SELECT id, round(score, 9) AS score FROM s{_PPR_ROUNDS}"""


def _restart(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("nation:1", 0.75), ("customer:1", 0.25)], "id string, weight double")


@query("g_ppr", _PPR_SQL)
def g_ppr(t: Tables) -> DataFrame:
    nodes, edges = places(t)
    return G.personalised_pagerank(nodes, edges, _restart(t), rounds=_PPR_ROUNDS, cut_every=10, tolerance=0.0).select("id", F.round("score", 9).alias("score"))


@query("g_labels", "SELECT DISTINCT p_type AS label FROM part WHERE p_type NOT IN ('Chunk', 'Entity')")
def g_labels(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_type").alias("label")).distinct().filter(~F.col("label").isin("Chunk", "Entity")).orderBy("label")


@query("g_stats", f"WITH {_PLACES} SELECT label, count(*) AS nodes, (SELECT count(*) FROM nodes) AS all_nodes, (SELECT count(*) FROM edges) AS all_edges FROM nodes GROUP BY label")
def g_stats(t: Tables) -> DataFrame:
    return G.graph_stats(*places(t))


@query(
    "g_vec_search",
    """
    WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    c AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)) AS s FROM v q, v WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM c)
    SELECT query_id, label AS entity, round(sum(s), 6) AS score FROM r WHERE rank <= 20 GROUP BY query_id, label
    """,
)
def g_vec_search(t: Tables) -> DataFrame:
    """Vectors of mentions found, and their scores summed by entity."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    found = vector_top_k(rows, rows.filter("id % 100 = 0"), 20).join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id")
    return found.groupBy("query_id", F.col("label").alias("entity")).agg(F.round(F.sum("score"), 6).alias("score"))


@query("chunk_hash", "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 32) AS content_id FROM documents")
def chunk_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", short_hash(F.coalesce("text", F.lit(""))).alias("content_id"))
