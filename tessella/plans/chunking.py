"""Chunking queries over ``documents``; those that SQL can express are window or array operations of Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.chunks import cut_at_tokens, merged, sections
from tessella.functions.text import tok_count, tokens
from tessella.operators import chunking as C
from tessella.plans.registry import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql

_TOK = r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]"
_COUNT = rf"CASE WHEN regexp_matches(coalesce({{0}}, ''), '[^\s\x{{{{a0}}}}\x{{{{3000}}}}]') THEN greatest(1, len(regexp_extract_all({{0}}, '{_TOK.replace('{', '{{').replace('}', '}}')}'))) ELSE 0 END"


@query("tok_count", f"SELECT doc_id, CAST({_COUNT.format('text')} AS BIGINT) AS tokens FROM documents")
def tok_count_(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tok_count(F.col("text")).alias("tokens"))


def _chunks(t: Tables, name: str, limit: int = 128, **options) -> DataFrame:
    return C.chunked(t.documents, name, C.ChunkParams(limit=limit, **options))


_INK, _UNIT = r"[^\s\x{a0}\x{3000}]", rf"(?:{_TOK})[^A-Za-z0-9_\x{{4e00}}-\x{{9fff}}]*"


def _general_sql(limit: int, overlap: int, hard: int) -> list[str]:
    """Steps from documents to ``chunks`` (doc_id, text, cs): split at line feeds, folded, and cut above the hard limit."""
    return [
        f"sections AS (SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '{_INK}')) AS ss FROM documents)",
        rf"""starts AS (SELECT *, list_reduce(list_transform(ss, lambda s, i: {{'b': CAST([] AS BIGINT[]), 'n': {_COUNT.format('s')}, 'i': i}}),
            lambda a, x: {{'b': CASE WHEN len(a.b) = 0 OR a.n * 100 > {limit * (100 - overlap)} THEN list_append(a.b, x.i) ELSE a.b END,
                'n': CASE WHEN len(a.b) = 0 OR a.n * 100 > {limit * (100 - overlap)} THEN x.n ELSE a.n + x.n END, 'i': x.i}},
            {{'b': CAST([] AS BIGINT[]), 'n': 0, 'i': 0}}).b AS begins FROM sections)""",
        "merged AS (SELECT doc_id, text, list_transform(begins, lambda b, k: array_to_string(ss[b:coalesce(begins[k + 1] - 1, len(ss))], chr(10))) AS bodies FROM starts)",
        rf"""laid AS (SELECT doc_id, text, list_reduce(list_transform(bodies, lambda b: [b]), lambda a, x: list_append(a, substr(a[-1], CAST(floor(length(a[-1]) * {100 - overlap} / 100) AS INT) + 1) || x[1])) AS bodies
            FROM merged WHERE len(bodies) > 0)""" if overlap else "laid AS (SELECT * FROM merged WHERE len(bodies) > 0)",
        rf"""units AS (SELECT doc_id, text, list_transform(bodies, lambda b: {{'b': b, 'u': regexp_extract_all(b, '{_UNIT}')}}) AS bs FROM laid)""",
        rf"""sized AS (SELECT doc_id, text, list_transform(bs, lambda x: {{'b': x.b, 'u': x.u, 'n': len(x.u), 'k': CAST(ceil(len(x.u) / {limit}) AS BIGINT)
            - CASE WHEN ceil(len(x.u) / {limit}) > 1 AND len(x.u) - {limit} * (ceil(len(x.u) / {limit}) - 2) <= {hard} THEN 1 ELSE 0 END}}) AS bs FROM units)""",
        rf"""chunks AS (SELECT doc_id, text, flatten(list_transform(bs, lambda x: CASE WHEN x.n <= {hard} THEN [x.b] ELSE list_transform(range(0, x.k),
            lambda i: concat(CASE WHEN i = 0 THEN regexp_extract(x.b, '^[^A-Za-z0-9_\x{{4e00}}-\x{{9fff}}]*') ELSE '' END,
                array_to_string(x.u[i * {limit} + 1:CASE WHEN i = x.k - 1 THEN x.n ELSE (i + 1) * {limit} END], ''))) END)) AS cs FROM sized)""",
    ]


#: Where each chunk stands, searched forward, a row each.
_PLACED = rf"""
    found AS (SELECT doc_id, list_reduce(list_transform(cs, lambda c: {{'rows': CAST([] AS STRUCT(c VARCHAR, a BIGINT)[]), 'here': 0, 'c': c, 'text': coalesce(text, '')}}),
      lambda a, x: {{'rows': list_append(a.rows, {{'c': x.c, 'a': CASE WHEN strpos(substr(x.text, a.here + 1), x.c) > 0 THEN a.here + strpos(substr(x.text, a.here + 1), x.c) - 1 END}}),
        'here': CASE WHEN strpos(substr(x.text, a.here + 1), x.c) > 0 THEN a.here + strpos(substr(x.text, a.here + 1), x.c) - 1 ELSE a.here END, 'c': x.c, 'text': x.text}},
      {{'rows': CAST([] AS STRUCT(c VARCHAR, a BIGINT)[]), 'here': 0, 'c': '', 'text': ''}}).rows AS rows FROM chunks WHERE len(cs) > 0),
    flat AS (SELECT doc_id, generate_subscripts(rows, 1) - 1 AS i, unnest(rows) AS r FROM found)
    SELECT doc_id, concat(doc_id, '_chunk_', i) AS chunk_id, CAST(i AS INT) AS chunk_index, r.c AS content, r.a AS start, r.a + length(r.c) AS "end", CAST({_COUNT.format('r.c')} AS BIGINT) AS tokens FROM flat"""


@query("chunk_general", f"WITH {', '.join(_general_sql(128, 0, 192))}, {_PLACED}")
def chunk_general(t: Tables) -> DataFrame:
    return _chunks(t, "general")


@query("chunk_overlap", f"WITH {', '.join(_general_sql(128, 20, 192))}, {_PLACED}")
def chunk_overlap(t: Tables) -> DataFrame:
    return _chunks(t, "naive", overlap_percent=20)


@query("naive_merge", f"WITH {', '.join(_general_sql(64, 0, 96)[:3])} SELECT doc_id, unnest(bodies) AS content FROM merged")
def naive_merge(t: Tables) -> DataFrame:
    """Lines folded to 64 tokens, without the cut."""
    return t.documents.select("doc_id", F.explode(merged(sections(F.col("text"), "\n"), 64)).alias("content"))


@query(
    "hard_split",
    rf"""
    WITH u AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u FROM documents),
    k AS (SELECT *, CAST(ceil(len(u) / 100) AS BIGINT) - CASE WHEN ceil(len(u) / 100) > 1 AND len(u) - 100 * (ceil(len(u) / 100) - 2) <= 130 THEN 1 ELSE 0 END AS k FROM u)
    SELECT doc_id, unnest(CASE WHEN len(u) <= 130 THEN [text] ELSE list_transform(range(0, k), lambda i: concat(
      CASE WHEN i = 0 THEN regexp_extract(text, '^[^A-Za-z0-9_\x{{4e00}}-\x{{9fff}}]*') ELSE '' END, array_to_string(u[i * 100 + 1:CASE WHEN i = k - 1 THEN len(u) ELSE (i + 1) * 100 END], ''))) END) AS content
    FROM k WHERE regexp_matches(coalesce(text, ''), '{_INK}')""",
)
def hard_split(t: Tables) -> DataFrame:
    """Texts cut each 100 tokens; a tail that makes no more than 130 with the piece before it stays there."""
    return t.documents.select("doc_id", F.explode(cut_at_tokens(F.col("text"), 100, 130)).alias("content"))


@query(
    "chunk_separator",
    rf"""
    WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), '. '), lambda s: regexp_replace(s, '^[\s\x{{a0}}\x{{3000}}]+|[\s\x{{a0}}\x{{3000}}]+$', '', 'g')), lambda s: s <> '') AS ss FROM documents),
    u AS (SELECT doc_id, text, list_transform(ss, lambda s: {{'s': s, 'u': regexp_extract_all(s, '{_UNIT}')}}) AS us FROM s),
    chunks AS (SELECT doc_id, text, flatten(list_transform(us, lambda x: CASE WHEN len(x.u) <= 128 THEN [x.s] ELSE list_transform(range(0, CAST(ceil((len(x.u) - 128) / 116) AS BIGINT) + 1),
      lambda i: regexp_replace(concat(CASE WHEN i = 0 THEN regexp_extract(x.s, '^[^A-Za-z0-9_\x{{4e00}}-\x{{9fff}}]*') ELSE '' END, array_to_string(x.u[i * 116 + 1:i * 116 + 128], '')), '^[\s\x{{a0}}\x{{3000}}]+|[\s\x{{a0}}\x{{3000}}]+$', '', 'g')) END)) AS cs FROM u),
    {_PLACED}""",
)
def chunk_separator(t: Tables) -> DataFrame:
    return _chunks(t, "separator", delimiter="`. `", overlap_percent=10)


@query("chunk_book")
def chunk_book(t: Tables) -> DataFrame:
    return _chunks(t, "book")


@query("chunk_laws")
def chunk_laws(t: Tables) -> DataFrame:
    return _chunks(t, "laws")


@query("chunk_qa")
def chunk_qa(t: Tables) -> DataFrame:
    return _chunks(t, "qa")


@query("chunk_semantic")
def chunk_semantic(t: Tables) -> DataFrame:
    return _chunks(t, "semantic")


@query("chunk_tokens", f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{_TOK}')) AS BIGINT) AS tokens FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '{_TOK}')) > 0")
def chunk_tokens(t: Tables) -> DataFrame:
    """General chunks hold every token of their document once: their numbers add up."""
    found = _chunks(t, "general")
    n = F.size(tokens(F.col("content"))).cast("long")
    return found.groupBy("doc_id").agg(F.sum(n).alias("tokens")).filter("tokens > 0")


@query(
    "chunk_params",
    "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 256 END, CASE WHEN o_orderpriority = '1-URGENT' THEN 128 END, 512) AS chunk_token_num FROM orders",
)
def chunk_params(t: Tables) -> DataFrame:
    """A request's settings are before its file's, and these before the knowledge base's."""
    setting = lambda when, n: F.when(when, F.create_map(F.lit("chunk_token_num"), F.lit(n))).otherwise(F.expr("cast(map() as map<string,int>)"))
    request, file = setting(F.col("o_orderstatus") == "F", 256), setting(F.col("o_orderpriority") == "1-URGENT", 128)
    base = F.create_map(F.lit("chunk_token_num"), F.lit(512))
    merged = F.coalesce(request["chunk_token_num"], file["chunk_token_num"], base["chunk_token_num"])
    return t.orders.select("o_orderkey", merged.alias("chunk_token_num"))


@query(
    "line_windows",
    f"""WITH l AS (SELECT doc_id, pos, line, {_COUNT.format('line')} AS n FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
    c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS before FROM l)
    SELECT doc_id, CAST(floor(before / 128) AS BIGINT) AS bucket, count(*) AS lines, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY ALL""",
)
def line_windows(t: Tables) -> DataFrame:
    """Lines by the tokens before them, in steps of 128: a chunker that SQL can express (not the greedy merge)."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("n", tok_count(F.col("line")))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("pos")) - F.col("n")
    return lines.withColumn("bucket", F.floor(before / 128)).groupBy("doc_id", "bucket").agg(F.count("*").alias("lines"), F.sum("n").alias("tokens"))


@query(
    "lang_detect",
    r"""SELECT doc_id, avg(CASE WHEN regexp_full_match(l, '[\x20-\x7E]*') THEN 1.0 ELSE 0.0 END) > 0.8 AS english FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '\S') GROUP BY 1""",
)
def lang_detect(t: Tables) -> DataFrame:
    """English if over 80 % of the lines are ASCII; all lines count."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).filter(F.col("l").rlike(r"\S"))
    return lines.groupBy("doc_id").agg((F.avg(F.col("l").rlike(r"^[\x20-\x7E]*$").cast("double")) > 0.8).alias("english"))


@query(
    "qa_table",
    r"""SELECT doc_id, pos, trim(split_part(l, '|', 1)) AS question, trim(split_part(l, '|', 2)) AS answer FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS l
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE contains(l, '|') AND NOT regexp_matches(l, '^[\s|:-]*$')""",
)
def qa_table(t: Tables) -> DataFrame:
    """The first two cells of each row."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "l")).filter(F.col("l").contains("|") & ~F.col("l").rlike(r"^[\s|:-]*$"))
    cell = lambda i: F.trim(F.split_part("l", F.lit("|"), F.lit(i)))
    return lines.select("doc_id", "pos", cell(1).alias("question"), cell(2).alias("answer"))


@query(
    "qa_prefix",
    """WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations)
    SELECT conv_id, CAST(g AS BIGINT) AS pair, min(CASE WHEN role = 'user' THEN text END) AS question, string_agg(CASE WHEN role <> 'user' THEN text END, chr(10) ORDER BY turn) AS answer FROM m WHERE g > 0 GROUP BY ALL
    HAVING answer IS NOT NULL""",
)
def qa_prefix(t: Tables) -> DataFrame:
    """Gaps and islands: a question begins an island; answers before the first question are dropped."""
    ask = F.col("role") == "user"
    rows = t.conversations.withColumn("pair", F.sum(ask.cast("int")).over(Window.partitionBy("conv_id").orderBy("turn"))).filter("pair > 0")
    answers = F.array_sort(F.collect_list(F.when(~ask, F.struct("turn", "text"))))
    found = rows.groupBy("conv_id", "pair").agg(F.min(F.when(ask, F.col("text"))).alias("question"), answers.alias("a")).filter(F.size("a") > 0)
    return found.select("conv_id", "pair", "question", F.array_join(F.transform("a", lambda x: x["text"]), "\n").alias("answer"))


@query("qa_dedup", "SELECT role, text, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS n FROM conversations WHERE text <> '') WHERE n = 1")
def qa_dedup(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("role", "text").orderBy("conv_id", "turn"))
    return t.conversations.filter("text <> ''").withColumn("n", n).filter("n = 1").select("role", "text", "conv_id", "turn")


@query(
    "tree_build",
    r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    m AS (SELECT *, CASE WHEN line LIKE '# %' THEN substr(line, 3) END AS h FROM l)
    SELECT doc_id, pos, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS title FROM m""",
)
def tree_build(t: Tables) -> DataFrame:
    """The heading that is open at each line."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heading = F.when(F.col("line").startswith("# "), F.substring("line", 3, 2**31 - 1))
    return lines.select("doc_id", "pos", F.last(heading, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos")).alias("title"))


@query("sentence_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[.!?]+')) AS BIGINT) AS sentences FROM documents")
def sentence_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[.!?]+")).cast("long").alias("sentences"))


@query("sample", "SELECT doc_id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def sample(t: Tables) -> DataFrame:
    """A sampling operator: a hundred rows without replacement, by a hash, so always the same."""
    return t.documents.orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id").limit(100).select("doc_id")
