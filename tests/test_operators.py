"""Operators on literal rows, with results worked out by hand."""

import hashlib
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.text import snippet, tok_count, utf8_cut
from tessella.operators import chunking as C
from tessella.operators import evaluation as V
from tessella.operators import graph as G
from tessella.operators import models as M
from tessella.operators import search as S
from tessella.operators import sqltool
from tessella.operators.retrieval import RetrievalConfig, reciprocal_rank_fusion, seed_weights, vector_top_k, weighted_hybrid
from tessella.sources import readers as R
from tessella.sources import sinks as K
from tessella.streaming import events as E


def test_tokens_and_text(spark):
    df = spark.createDataFrame([("a_b 中文 x",), ("  ",), (None,), ("!!",)], "t string")
    assert [r[0] for r in df.select(tok_count(F.col("t"))).collect()] == [4, 0, 0, 1]
    assert spark.createDataFrame([("one two",)], "t string").select(snippet(F.col("t"), "TWO")).first()[0] == "one two"
    cut = spark.createDataFrame([("aé日本",)], "t string").select(utf8_cut(F.col("t"), 5, "")).first()[0]
    assert cut == "aé"


def test_fusion_keeps_rank_order_and_sources(spark):
    base = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, id string, rank int")
    graph = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id long, id string, rank int")
    got = {r["id"]: (r["score"], r["sources"]) for r in reciprocal_rank_fusion([("chunk", 1.0, base), ("graph", 0.5, graph)]).collect()}
    assert got["b"] == (pytest.approx(1 / 62 + 0.5 / 61), "chunk,graph")
    assert got["b"][0] > got["a"][0] > got["c"][0]


def test_hybrid_threshold_and_config(spark):
    v = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1)], "query_id long, id long, score double")
    w = spark.createDataFrame([(1, 2, 5.0)], "query_id long, id long, score double")
    got = {r["id"]: r["score"] for r in weighted_hybrid(v, w, RetrievalConfig(similarity_threshold=0.3)).collect()}
    assert got == {1: pytest.approx(0.7), 2: pytest.approx(0.3)}
    assert RetrievalConfig(mode="odd").search_mode() == "vector"
    assert (RetrievalConfig().recall_k(), RetrievalConfig(use_rerank=True).recall_k()) == (10, 50)


def test_vector_search_skips_null_and_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "id long, embedding array<double>")
    got = vector_top_k(rows, rows.filter("id = 1"), 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 4]
    assert vector_top_k(rows, rows.filter("id = 9"), 5).count() == 0


def test_seed_weights_sum_to_one(spark):
    e = spark.createDataFrame([("x", 1.0), ("y", -3.0)], "entity_id string, score double")
    t = spark.createDataFrame([("x", "z", 1.0)], "source_id string, target_id string, score double")
    c = spark.createDataFrame([("z", 1.0)], "entity_id string, score double")
    got = {r["entity_id"]: r["weight"] for r in seed_weights(e, t, c).collect()}
    assert got == {"x": pytest.approx(1.8 / 2.9), "y": 0.0, "z": pytest.approx(1.1 / 2.9)}
    assert seed_weights(e.filter("score < 0"), t.filter("false"), c.filter("false")).count() == 0


def test_metrics(spark):
    runs = spark.createDataFrame([(1, ["a", "b", "b"], ["b", "c", "b"]), (2, [], ["a"])], "query_id long, ids array<string>, gold array<string>")
    got = runs.select(V.precision_at(F.col("ids"), F.col("gold"), 5), V.recall_at(F.col("ids"), F.col("gold"), 5)).collect()
    assert [tuple(r) for r in got] == [(0.2, 0.5), (0.0, 0.0)]
    assert [len(r["metrics"]) for r in V.question_metrics(runs).orderBy("query_id").collect()] == [8, 0]


def test_pushed_pagerank_is_near_the_fixed_point_for_all_queries(spark):
    r = random.Random(4)
    edges = [("hub", f"n{i}") for i in range(40)] + [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(60)] + [("far", "away")]
    restarts = [(1, "n1", 0.5), (1, "n2", 0.25), (1, "n2", 0.25), (2, "hub", 1.0), (3, "far", 0.6), (3, "no edge", 0.4)]
    frame = spark.createDataFrame(edges + edges[:5], "src string, dst string")
    limit = 1e-6
    got = {(x["query_id"], x["id"]): x["score"] for x in G.pushed_pagerank(frame, spark.createDataFrame(restarts, "query_id long, id string, weight double"), residual=limit).collect()}
    ways = {}
    for a, b in edges:
        if a != b:
            ways.setdefault(a, set()).add(b)
            ways.setdefault(b, set()).add(a)
    for q in (1, 2, 3):
        start = {n: sum(w for x, i, w in restarts if x == q and i == n) for n in ways}
        score = dict(start)
        for _ in range(300):
            score = {n: 0.15 * start[n] + 0.85 * sum(score[m] / len(ways[m]) for m in ways[n]) for n in ways}
        for n in ways:
            assert score[n] - limit * len(ways[n]) - 1e-12 <= got.get((q, n), 0.0) <= score[n] + 1e-12, (q, n)
    assert G.pushed_pagerank(frame, spark.createDataFrame([], "query_id long, id string, weight double")).count() == 0


def test_a_walk_reads_only_what_pushes_and_gives_the_nodes_asked_for_the_same_scores(spark):
    r = random.Random(6)
    edges = sorted({(f"c{i}", f"e{r.choice([0, 0, 1, r.randrange(2, 60)])}") for i in range(80) for _ in range(4)})
    frame = spark.createDataFrame(edges, "src string, dst string")
    restarts = spark.createDataFrame([(1, "e5", 0.5), (1, "e0", 0.5), (2, "c7", 1.0), (3, "e1", 1.0)], "query_id long, id string, weight double")
    whole = G.PushWays(frame, 0.02)
    asked = G.PushWays(frame, 0.02, F.col("id").startswith("c"))
    scores = [{(x["query_id"], x["id"]): x["score"] for x in G.pushed_pagerank(None, restarts, ways=w).collect() if x["id"][0] == "c"} for w in (whole, asked)]
    assert scores[0] and scores[0] == pytest.approx(scores[1])
    degree = {x["id"]: x["degree"] for x in whole.degrees.collect()}
    assert degree["e0"] > 50 and degree == {n: sum(n in e for e in edges) for n in degree}  # e0 cannot push
    read = {x["id"] for x in whole.known.collect()}
    assert "e0" not in read and len(read) == whole.known.count() < len(degree)
    assert {x["id"] for x in asked.near.collect()} == {x["id"] for x in whole.near.collect()} - {n for n, d in degree.items() if n[0] == "e" and d * 0.02 >= 1.001}


def test_tiles_are_those_of_ntile_without_one_task_for_all(spark):
    from pyspark.sql.window import Window

    from tessella.operators.windows import with_ntile

    for n in (0, 3, 50, 103):
        frame = spark.createDataFrame([(None if i % 9 == 4 else float(i * 37 % 11), i) for i in range(n)], "x double, i long")
        want = frame.withColumn("t", F.ntile(4).over(Window.orderBy("x", "i")))
        got = with_ntile(frame, 4, ["x", "i"], "t", part_rows=20)
        assert sorted(got.collect(), key=lambda r: r["i"]) == sorted(want.collect(), key=lambda r: r["i"])
        assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_inserts_of_absent_rows_join_nothing(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "n", 3)], "k long, name string, v int")
    new = spark.createDataFrame([(1, "a", 9), (2, "b", 5), (2, "b", 5), (None, "n", 7), (4, None, None)], "k long, name string, v int")
    got = G.insert_absent(old, new, ["k", "name"])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, [*old.collect(), (2, "b", 5), (None, "n", 7), (4, None, None)]))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_vector_scores_are_made_in_bounded_parts_with_the_same_rows(monkeypatch):
    from tessella.operators import retrieval

    r = np.random.default_rng(3)
    x, own, asked = r.normal(size=(30, 5)), np.arange(30), r.normal(size=(17, 5))

    def best():
        return sorted(tuple(c.as_py() for c in row) for b in retrieval._best_pairs(own, x, np.arange(17), asked, 4) for row in zip(*b.columns))

    whole, shapes, plain = best(), [], retrieval._cosines
    monkeypatch.setattr(retrieval, "SCORES", 100)
    monkeypatch.setattr(retrieval, "_cosines", lambda a, b: shapes.append(len(a) * len(b)) or plain(a, b))
    assert best() == whole and max(shapes) <= 100


def test_keyword_search_skips_blocks_and_loses_nothing(spark, monkeypatch):
    from tessella.operators import retrieval

    r = random.Random(8)
    docs = [(None if i == 3 else i % 900, " ".join(r.choices(["Rare"] * (i % 97 == 0) + ["common", "Word_1", "ça", "x"], k=r.randrange(0, 12)))) for i in range(1000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "id long, text string, n int").repartition(3)
    queries = spark.createDataFrame([(1, "rare COMMON"), (2, "x word_1 common"), (3, "nowhere")], "query_id long, text string")

    def best(segment):
        monkeypatch.setattr(retrieval, "SEGMENT", segment)
        return sorted((x["query_id"], x["rank"], x["id"] or -1, round(x["score"], 9)) for x in retrieval.bm25_top_k(frame, queries, 7).collect())

    assert best(16) == best(5000) and {q for q, *_ in best(64)} == {1, 2}
    dropped = retrieval.bm25_top_k(frame, queries, 7, drop_ratio=0.5).filter("query_id = 1")
    alone = retrieval.bm25_top_k(frame, spark.createDataFrame([(1, "rare")], "query_id long, text string"), 7)
    assert sorted(map(tuple, dropped.collect())) == sorted(map(tuple, alone.collect()))
    assert retrieval.bm25_top_k(frame.limit(0), queries, 5).count() == 0


def test_cron_next_is_the_first_minute_that_fits(spark):
    from datetime import timedelta, timezone
    from zoneinfo import ZoneInfo

    def minute_by_minute(expression, zone, after, most=100_000):
        minutes, hours, days, months, weekdays, either = E._cron(expression)
        at = after.replace(tzinfo=timezone.utc, second=0, microsecond=0)
        for _ in range(most):
            at += timedelta(minutes=1)
            x = at.astimezone(ZoneInfo(zone))
            a, b = x.day in days, x.isoweekday() % 7 in weekdays
            if x.minute in minutes and x.hour in hours and x.month in months and (a or b if either else a and b):
                return at.replace(tzinfo=None)
        return None

    r = random.Random(9)
    zones = ["UTC", "Asia/Shanghai", "Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata"]
    # days on which clocks change, and others
    starts = [datetime(2024, 3, 30, 20, 17, 5), datetime(2024, 3, 31, 0, 59), datetime(2024, 10, 26, 21, 30), datetime(2024, 10, 27, 0, 30), datetime(2024, 3, 10, 5, 0), datetime(2024, 11, 3, 5, 45), datetime(2024, 4, 6, 14, 0), datetime(2023, 12, 31, 23, 59)]
    exprs = ["*/7 * * * *", "30 2 * * *", "15,45 1-3 * * *", "0 0 * * 0", "30 1 * * 1-5", "5 */6 1,15 * *", "0 12 13 * 5", "59 23 31 * *", "* * * * *", "0 3 * * 7"]
    for _ in range(120):
        e, z, t = r.choice(exprs), r.choice(zones), r.choice(starts)
        assert E.cron_next(e, z, t) == minute_by_minute(e, z, t), (e, z, t)
    assert E.cron_next("0 0 29 2 *", "UTC", datetime(2024, 3, 1)) == datetime(2028, 2, 29) and E.cron_next("0 0 30 2 *", "UTC", datetime(2024, 1, 1)) is None
    for bad in ("* * * *", "61 * * * *", "*/0 * * * *", "5-2 * * * *"):
        with pytest.raises(ValueError):
            E.cron_next(bad, "UTC", datetime(2024, 1, 1))
    rows = spark.createDataFrame([("0 9 * * *", "UTC", datetime(2024, 1, 1, 9)), (None, "UTC", datetime(2024, 1, 1)), ("0 9 * * *", "UTC", None)], "c string, z string, t timestamp_ntz")
    assert [x["next_run"] for x in E.with_next_run(rows, "c", "z", "t").collect()] == [datetime(2024, 1, 2, 9), None, None]


def test_memoised_asks_only_for_new_texts(spark, tmp_path):
    from tessella.operators import models

    calls = tmp_path / "calls"
    calls.mkdir()

    def model(texts):
        for t in texts:
            with open(calls / hashlib.sha1(t.encode()).hexdigest(), "a") as f:
                f.write("x")
        if any("bad" in t for t in texts):
            raise TimeoutError("no answer")
        return [t.upper() for t in texts]

    def asked(text):
        path = calls / hashlib.sha1(text.encode()).hexdigest()
        return len(path.read_text()) if path.exists() else 0

    models.register("shout", model)
    store = str(tmp_path / "store")
    rows = [(1, "a"), (2, "b"), (2, "b"), (3, "bad"), (4, None), (None, "a")]
    run = lambda r: sorted((x["id"] or 0, x["out"], x["status"]) for x in models.memoised(spark.createDataFrame(r, "id long, text string, key string"), "shout", "text", "out", store, sleep=lambda s: None).collect())
    rows = [(i, t, "clash") for i, t in rows]
    first = run(rows)
    assert first == [(0, "A", "done"), (1, "A", "done"), (2, "B", "done"), (2, "B", "done"), (3, None, "failed"), (4, "", "done")]
    before = {t: asked(t) for t in ("a", "b", "bad", "")}
    assert before["bad"] >= 3
    assert run([*rows, (5, "new", "clash")])[-1] == (5, "NEW", "done")
    assert {t: asked(t) for t in ("a", "b", "")} == {t: before[t] for t in ("a", "b", "")} and asked("bad") > before["bad"] and asked("new") <= 2  # alone again after a batch that failed
    assert spark.read.parquet(f"{store}/failed").filter("error like 'TimeoutError%'").count() == 2
    assert run([]) == []


def test_embedding_index_is_bucketed_and_takes_changes_only(spark, tmp_path):
    from tessella.operators import models

    calls = tmp_path / "calls"

    def model(texts):
        with open(calls, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return [[float(len(t))] for t in texts]

    models.register("lengths", model)
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string")
    name = "embedding_index_test"
    first = [("a", "one"), ("b", "two two"), ("c", None), (None, "lost"), ("b", "two two")]
    assert K.index_embeddings(frame(first), name, "lengths", 4) == 3
    assert K.index_embeddings(frame(first), name, "lengths", 4) == 0
    assert K.index_embeddings(frame([("a", "one"), ("b", "changed"), ("d", "new")]), name, "lengths", 4) == 2
    assert {r["id"]: r["embedding"] for r in spark.table(name).collect()} == {"a": [3.0], "b": [7.0], "c": [0.0], "d": [3.0]}
    assert sorted(calls.read_text().splitlines()) == ["", "changed", "new", "one", "two two"]
    joined = spark.table(name).join(frame([("a", "x")]).hint("merge"), "id")
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 * ("Initial Plan" in plan) or plan.count("Exchange hashpartitioning") == 1  # the other side's alone


def test_contexts_grow_from_each_anchor(spark):
    mentions = [(1, "x"), (1, "y"), (2, "x"), (2, "z"), (3, "z"), (3, "w"), (4, "w"), (5, "alone"), (6, "y"), (6, "x")]
    frame = spark.createDataFrame(mentions, "chunk long, entity string")
    anchors = spark.createDataFrame([(1,), (4,), (5,), (9,)], "anchor long")
    got = {}
    for r in G.expanded_contexts(frame, anchors, 3, 1e-5).orderBy("anchor", "position").collect():
        got.setdefault(r["anchor"], []).append(r["chunk"])
    assert got == {1: [1, 6, 2], 4: [4, 3, 2]}  # 5 leads nowhere, 9 mentions nothing


def test_pagerank_sums_to_one(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    restart = spark.createDataFrame([("a", 1.0)], "id string, weight double")
    got = {r["id"]: r["score"] for r in G.personalised_pagerank(nodes, edges, restart, rounds=12).collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    assert got["d"] == 0 and got["b"] > got["c"]


def test_pagerank_runs_until_it_converges(spark):
    n = 9
    both = [(i, i + 1) for i in range(n - 2)]  # a path, and a node without neighbours
    walk = np.zeros((n, n))
    for i, j in both:
        walk[i, j] = walk[j, i] = 1
    restart = np.zeros(n)
    restart[0], restart[n - 1] = 0.75, 0.25
    walk /= np.maximum(walk.sum(axis=1, keepdims=True), 1)
    walk[n - 1] = restart
    want = np.linalg.solve(np.eye(n) - 0.85 * walk.T, 0.15 * restart)
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    weights = spark.createDataFrame([(0, 0.75), (n - 1, 0.25)], "id long, weight double")
    got = G.personalised_pagerank(nodes, spark.createDataFrame(both, "src long, dst long"), weights).orderBy("id").collect()
    assert [r["score"] for r in got] == pytest.approx(want.tolist(), abs=1e-5)


def test_deleting_a_file_twice_changes_nothing(spark):
    m = spark.createDataFrame([(1, "x"), (2, "y")], "chunk_id long, entity_id string")
    t = spark.createDataFrame([("t", "x", "z")], "triple_id string, source_id string, target_id string")
    tm = spark.createDataFrame([(2, "t")], "chunk_id long, triple_id string")
    e = spark.createDataFrame([("x",), ("y",), ("z",)], "entity_id string")
    gone = spark.createDataFrame([(1,)], "chunk_id long")
    once = G.delete_file(m, t, tm, e, gone)
    assert sorted(r[0] for r in once["entities"].collect()) == ["x", "y", "z"]  # x and z by their triple
    again = G.delete_file(once["mentions"], once["triples"], once["triple_mentions"], once["entities"], gone)
    assert again["entities"].count() == 3
    both = G.delete_file(m, t, tm, e, spark.createDataFrame([(1,), (2,)], "chunk_id long"))
    assert both["entities"].count() == 0


def chunks_of(spark, text, name, p):
    found = C.chunked(spark.createDataFrame([(1, text)], "doc_id long, text string"), name, p).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in found] == list(range(len(found)))
    return found


def test_chunkers_keep_all_tokens_and_limits(spark):
    text = "\n".join(f"Line {i} has several words in it." for i in range(200))
    p = C.ChunkParams(limit=40)
    for name in ("general", "separator", "book", "semantic", "unknown"):
        chunks = chunks_of(spark, text, name, p)
        assert sum(r["tokens"] for r in chunks) == C.count_tokens(text), name
        assert max(r["tokens"] for r in chunks) <= 60, name
    assert C.cut_at_tokens("", 5) == [] and C.count_tokens("  ") == 0
    assert C.spans("a b c", ["a", "c", "zz"]) == [(0, 1), (4, 5), (None, None)]


def test_separated_parts_are_stripped_at_their_ends_only_and_placed_forward(spark):
    """A line terminator at the end is no end of text: what stands before it stays, as in SQL."""
    text = "one \u0085. two. two. \u3000three\u00a0. zwei drei. two"
    found = chunks_of(spark, text, "separator", C.ChunkParams(limit=8, delimiter="`. `"))
    assert [r["content"] for r in found] == ["one \u0085", "two", "two", "three", "zwei drei", "two"]
    assert [(r["start"], r["end"]) for r in found] == C.spans(text, [r["content"] for r in found])


def test_native_chunks_are_the_fold_line_by_line(spark):
    """Random texts against the functions of lists; nulls, blanks, texts without tokens and very long ones."""
    from tessella.functions import chunks as N

    r = random.Random(6)
    part = lambda: r.choice(["one ", "two_2 ", "é, ", "字", "。", "...", "\n", "\n\n", " \u00a0", "\t", "three", "四 "])
    texts = ["".join(part() for _ in range(r.randrange(0, 60))) for _ in range(80)] + [None, "", " \n\u3000", "... !", "w " * 30_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")

    def of(column):
        return {x["i"]: x["c"] for x in frame.select("i", column.alias("c")).collect()}

    for limit, overlap in ((1, 0), (4, 0), (4, 30), (9, 90)):
        got = of(N.merged(N.sections(F.col("text"), "\n"), limit, overlap))
        assert got == {i: C.merge_sections((t or "").split("\n"), limit, overlap) for i, t in enumerate(texts)}, (limit, overlap)
    for limit, hard in ((1, 0), (3, 0), (3, 4), (5, 7), (0, 0)):
        got = of(N.cut_at_tokens(F.coalesce("text", F.lit("")), limit, hard))
        assert got == {i: C.cut_at_tokens(t or "", limit, hard) for i, t in enumerate(texts)}, (limit, hard)
    got = of(N.placed(F.col("text"), N.general(F.col("text"), 4, 0, "\n", 1.5)))
    for i, t in enumerate(texts):
        want = [x for c in C.merge_sections((t or "").split("\n"), 4) for x in (C.cut_at_tokens(c, 4, 6) if C.count_tokens(c) > 6 else [c])]
        assert [(x["content"], x["start"], x["end"]) for x in got[i]] == [(c, *at) for c, at in zip(want, C.spans(t or "", want), strict=True)]
    assert [x["content"] for x in chunks_of(spark, "a b c<br>d|e<br>f g h i", "separator", C.ChunkParams(limit=3, delimiter="`<br>``|`", overlap_percent=34))] == ["a b c", "d", "e", "f g h", "h i"]


def test_contents_go_up_to_their_first_heading():
    lines = ["Preface", "目 录", "", "第一章 总则 .... 1", "第二章 附则 .... 2", "第一章 总则", "text"]
    assert C.without_contents(lines) == ["Preface", "第一章 总则", "text"]
    assert C.without_contents(["# Table of Contents", "One two three", "Four", "One two again", "x"], english=True) == ["One two again", "x"]
    assert C.without_contents(["Contents", "", " "]) == [] and C.without_contents(["contents", "only entry", "other"]) == ["other"]
    far = ["Contents", "Alpha", *["filler"] * 128, "Alpha"]
    assert C.without_contents(far) == far[2:] and C.without_contents(far[:2] + far[3:]) == ["Alpha"]


def test_long_paragraphs_cluster_as_a_whole():
    topics = np.random.default_rng(1).normal(size=(9, 12))
    at = {f"Sentence {i} of many.": i for i in range(600)}
    # topics come back after more than 256 sentences
    vectors = topics[np.arange(600) // 20 % 9] + np.random.default_rng(2).normal(size=(600, 12)) / 2
    embed = lambda run: vectors[[at[x] for x in run]]
    pairs = lambda label: {(i, j) for i in range(0, 600, 7) for j in range(i) if label[i] == label[j]}

    def plain(count):
        """The two nearest clusters merge, by the mean of their members' distances, until so many are left."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        sums, sizes, label = unit.copy(), np.ones(600), np.arange(600)
        distance = 1 - sums @ sums.T
        np.fill_diagonal(distance, np.inf)
        for _ in range(600 - max(1, count)):
            i, j = sorted(np.unravel_index(int(np.argmin(distance)), distance.shape))
            sums[i], sizes[i] = sums[i] + sums[j], sizes[i] + sizes[j]
            label[label == j] = i
            row = 1 - sums @ sums[i] / (sizes * sizes[i])
            row[np.isinf(distance[i])] = np.inf
            distance[i], distance[:, i] = row, row
            distance[j], distance[:, j] = np.inf, np.inf
            distance[i, i] = np.inf
        return label

    for k in (1, 9, 60, 599, 700):
        assert pairs(C.chained_linkage(vectors, k)) == pairs(plain(k))
    assert len(C.semantic(" ".join(at), C.ChunkParams(limit=150), embed)) > 10
    # equal sentences: no end of ties
    assert len(set(C.chained_linkage(np.tile(topics[:3], (200, 1)), 3).tolist())) == 3


def test_terms_of_long_texts_are_counted_in_slices():
    """However many texts come in one batch, a task holds the terms of about a megabyte of them."""
    import pyarrow as pa

    from tessella.operators import retrieval as R

    texts = ["ab Cd 字 " * 40_000, None, "", *["x1 y2 " * 60_000] * 8, "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    out = list(R._counted(iter([batch])))
    assert len(out) >= 4 and [i for b in out for i in b.column("id").to_pylist()] == list(range(len(texts)))
    assert [n for b in out for n in b.column("dl").to_pylist()] == [120_000, 0, 0, *[120_000] * 8, 1]
    assert out[0].column("terms").to_pylist()[0] == ["ab", "cd", "字"] and out[0].column("tfs").to_pylist()[0] == [40_000] * 3


def test_linkage_of_repeated_sentences_and_of_those_without_tokens():
    """Groups of copies fold before any distance of theirs is taken: 12,000 sentences took 5.8 s of CPU one by one."""
    import time

    r = np.random.default_rng(4)
    kinds = np.abs(r.normal(size=(40, 16)))
    kinds[::8] = 0  # no tokens
    of = r.integers(0, 40, 12_000)
    vectors = kinds[of] * r.integers(1, 4, 12_000)[:, None]
    began = time.process_time()
    label = C.chained_linkage(vectors, 3_000)
    assert time.process_time() - began < 3
    assert len(set(label.tolist())) == 3_000

    def plain(count, vectors):
        """The two nearest clusters merge, by the mean of their members' distances, the first of equal ones."""
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        groups = [[i] for i in range(len(vectors))]
        each = 1 - unit @ unit.T
        while len(groups) > count:
            means = [(round(each[np.ix_(a, b)].mean(), 9), i, j) for j, b in enumerate(groups) for i, a in enumerate(groups[:j])]
            _, i, j = min(means)
            groups[i] += groups.pop(j)
        return {frozenset(g) for g in groups}

    few = np.array([kinds[k] for k in [1, 2, 3, 1, 4, 2, 1, 3, 5, 1, 2, 1, 3, 4, 8, 8, 8]])
    for count in (1, 5, 6, 7, 8):
        label = C.chained_linkage(few, count)
        assert len(set(label.tolist())) == count
        if 4 <= count - 3 <= 5:  # the three without tokens join last
            assert {frozenset(np.flatnonzero(label == x).tolist()) for x in set(label.tolist())} == plain(count, few)
    assert C.chained_linkage(np.ones((5, 3)), 2).tolist().count(0) == 4
    assert C.chained_linkage(np.zeros((0, 3)), 2).tolist() == [] and C.chained_linkage(np.zeros((3, 3)), 3).tolist() == [0, 1, 2]


def test_chunker_pays_no_heed_to_the_first_chunk_that_overshoots():
    assert C.merge_sections(["a b c", "d e", "f"], 2) == ["a b c", "d e\nf"]


def test_qa_headings_and_laws(spark):
    def vote(*texts):
        rows = spark.createDataFrame([(i, "\n".join(t) if t is not None else None) for i, t in enumerate(texts)], "i long, text string")
        return [r[1] for r in sorted(rows.select("i", C.heading_family(F.col("text"))).collect())]

    assert C.qa_pairs("Q: one\nmore\nA: two\nQ: three\nA: four") == [("one\nmore", "two"), ("three", "four")]
    assert C.qa_pairs("| q | a |\n| --- | --- |\n| x | y |") == [("q", "a"), ("x", "y")]
    assert C.qa_pairs("# A\n## B\ntext") == [("A B", "text")]
    assert C.qa_pairs("x\ty\nmore") == [("x", "y\nmore")]
    assert vote(["# a", "text"], ["plain"], None, []) == [C.MARKDOWN, None, None, None]
    # 一、 stands in one family, numbers in another; the first of equal ones wins; marks within a line and sentences count less
    assert vote(["一、总则", "二、附则"], ["1. one", "1.1 two", "2. three"]) == [2, C.DECIMAL]
    assert vote(["第一章 总则", "第一节 甲"], ["0 zero", "12 3", "1.. x"]) == [0, None]
    assert vote(["Section 1 见（一）与（二）", "（一）甲"], ["第1章 " + "字" * 100] * 3 + ["# one"]) == [0, C.MARKDOWN]
    assert vote(["###### deep", "Chapter I one", "Chapter II two", "Chapter V three"], ["## high", "Chapter I one", "Chapter II two", "Chapter V three"]) == [3, C.MARKDOWN]
    assert C.laws("第一章 总则\n第一条 甲乙\n第二条 丙丁", C.ChunkParams(limit=50), 0)[0].startswith("第一章 总则")
    assert C.sentences("Dr. Smith came. He left.") == ["Dr. Smith came.", "He left."]


def test_trees_and_paths(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent string")
    below = S.descendants(tree, spark.createDataFrame([("b",)], "id string"))
    assert sorted(r["id"] for r in below.collect()) == ["b", "c"]
    left = S.pruned(tree, spark.createDataFrame([("c",)], "id string"), "a")
    assert sorted(r["id"] for r in left.collect()) == ["a", "d"]
    paths = spark.createDataFrame([("a/./b//c",), ("../x",), ("/abs",), ("a\\b",)], "p string")
    assert [r[0] for r in paths.select(S.normal_path(F.col("p"))).collect()] == ["a/b/c", None, None, "a/b"]


def test_line_windows_do_not_repeat_covered_matches(spark):
    df = spark.createDataFrame([(["x", "m", "m", "x", "x", "m"],)], "l array<string>")
    got = df.select(S.line_windows(F.col("l"), lambda x: x == "m", 3, 9)).first()[0]
    assert [(w["start"], w["end"]) for w in got] == [(0, 3), (3, 6)]


def test_sql_tool_allows_queries_only(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    assert sqltool.run(spark, "SELECT sum(id) FROM numbers;").first()[0] == 3
    assert sqltool.run(spark, "WITH a AS (SELECT 1 AS x UNION SELECT 2) SELECT count(*) FROM a").first()[0] == 2
    assert sqltool.run(spark, "SELECT id, rank() OVER (ORDER BY id) AS r FROM numbers WHERE id IN (SELECT max(id) FROM numbers)").count() == 1
    assert sqltool.run(spark, "SELECT * FROM numbers PIVOT (count(*) FOR id IN (1, 2))").count() == 1
    assert sqltool.run(spark, "SELECT a.id, x FROM numbers a JOIN numbers b USING (id) LATERAL VIEW explode(array(1, 2)) t AS x ORDER BY 1 LIMIT 3 OFFSET 1").count() == 3
    assert sqltool.run(spark, "VALUES (1), (2) EXCEPT SELECT 1").count() == 1 and sqltool.run(spark, "SHOW TABLES").columns
    assert sqltool.run(spark, "SELECT * FROM range(3) WHERE EXISTS (SELECT 1 FROM numbers) GROUP BY ROLLUP(id)").count() == 4
    for bad in (
        "WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT * FROM a",
        "WITH a AS (SELECT 1 AS x) DELETE FROM t WHERE x IN (SELECT x FROM a)",
        "FROM numbers INSERT INTO t SELECT * INSERT INTO u SELECT *",
        "BEGIN DROP TABLE t; END",
        "SELECT java_method('java.lang.System', 'exit', 1)",
        "SELECT * FROM numbers WHERE id = (SELECT reflect('java.lang.Math', 'random'))",
        "WITH a AS (SELECT try_reflect('x', 'y')) SELECT * FROM a",
        "SELECT * FROM parquet.`/etc/x`",
        "SELECT * FROM `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/etc/hosts`",
        "SELECT * FROM `org.apache.spark.sql.execution.datasources.v2.text.TextDataSourceV2`.`/etc/hosts`",
        "SELECT * FROM numbers WHERE id IN (SELECT 1 FROM `text`.`/etc/hosts`)",
        "WITH a AS (SELECT * FROM TEXT.`/etc/hosts`) SELECT * FROM a",
        "EXPLAIN SELECT * FROM text.`/etc/hosts`",
        "EXPLAIN INSERT INTO t VALUES (1)",
        "SET a = 1", "CACHE TABLE numbers", "REFRESH TABLE numbers", "TRUNCATE TABLE t", "CALL f()", "USE x",
        "MERGE INTO t USING numbers ON t.id = numbers.id WHEN MATCHED THEN DELETE",
    ):
        with pytest.raises(ValueError):
            sqltool.validated(spark, bad)
    for bad in ("", "DROP TABLE numbers", "SELECT 1; SELECT 2", "INSERT INTO numbers VALUES (1)", "CREATE TABLE t (a INT)", "not sql"):
        with pytest.raises(ValueError):
            sqltool.run(spark, bad)
    assert "Range" in sqltool.run(spark, "EXPLAIN FORMATTED SELECT * FROM numbers WHERE id > 1").first()[0]
    assert sqltool.run(spark, "EXPLAIN SELECT 1").count() == 1
    spark.range(2).createOrReplaceGlobalTempView("shared_numbers")
    assert sqltool.run(spark, "SELECT count(*) FROM global_temp.shared_numbers").first()[0] == 2
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"
    assert len(sqltool.run_limited(spark, "SELECT id FROM numbers", 30)) == 3
    assert "| 1 |" in sqltool.formatted(["a"], [(1,), (2,)])
    with pytest.raises(ValueError):
        sqltool.describe(spark, "a; drop")


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hi")
    (tmp_path / "b.html").write_text("<h2>T</h2><script>x</script><p>p <a href='u'>l</a></p>")
    (tmp_path / "c.json").write_text('{"a": 1}')
    (tmp_path / "d.xyz").write_text("?")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in R.read_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.md"]["markdown"] == "# hi" and got["d.xyz"]["error"]
    assert got["b.html"]["markdown"] == "## T\n\np [l](u)"
    assert got["c.json"]["markdown"].startswith("```json\n{")
    (tmp_path / "t.csv").write_text("a,b\n1,\n")
    assert R.read_csv_tables(spark, f"file://{tmp_path}/t.csv").first()[0] == "| a | b |\n| --- | --- |\n| 1 |  |"
    with pytest.raises(ValueError):
        R.reader("nope")


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, s int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, s int")
    once = K.merged(old, new, "k", F.col("s"))
    want = [(1, "a"), (2, "d"), (3, "e")]
    assert sorted((r["k"], r["v"]) for r in once.collect()) == want
    assert sorted((r["k"], r["v"]) for r in K.merged(once, new, "k", F.col("s")).collect()) == want


def test_events_and_models(spark):
    ev = spark.createDataFrame([("9-1", 1), ("10-0", 2), ("10-2", 3)], "seq string, n int")
    assert [r["n"] for r in E.after_cursor(ev, "seq", "9-1", 5).collect()] == [2, 3]
    assert E.cron_next("30 9 * * 1", "Asia/Shanghai", datetime(2024, 1, 3)) == datetime(2024, 1, 8, 1, 30)
    assert [M.delay(i) for i in (1, 2, 9)] == [1, 2, 30] and M.delay(1, 5) == 5
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return texts

    assert M.with_retries(flaky, ["a"], sleep=lambda s: None) == ["a"]


def test_index_recall(spark):
    import os

    from tessella.operators.retrieval import coarse_index, indexed_top_k

    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(path).select(F.col("vec_id").alias("id"), "embedding")
    asked = rows.filter("id % 100 = 0")
    index = coarse_index(rows)
    assert index.rows.count() == rows.count()
    exact = {(r["query_id"], r["id"]) for r in vector_top_k(rows, asked, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in indexed_top_k(index, asked, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    everything = indexed_top_k(index, asked, 10, probes=len(index.centers)).collect()
    assert {(r["query_id"], r["id"]) for r in everything} == exact


def test_index_of_clustered_vectors_reads_little_of_them(spark):
    from tessella.operators import retrieval

    r = np.random.default_rng(2)
    centers = r.normal(size=(60, 24))
    # a third of all in one cluster
    of = np.where(r.random(6000) < 0.33, 0, r.integers(0, 60, 6000))
    data = [(i, x.tolist()) for i, x in enumerate(centers[of] + r.normal(size=(6000, 24)) * 0.35)]
    rows = spark.createDataFrame(data, "id long, embedding array<float>").repartition(6)
    asked = rows.filter("id % 100 = 0")
    index = retrieval.coarse_index(rows)
    assert index.rows.count() == 6000 and len(set(index.cell_of.tolist())) > 3
    exact = {(x["query_id"], x["id"]) for x in vector_top_k(rows, asked, 10).collect()}
    found = {(x["query_id"], x["id"]) for x in retrieval.indexed_top_k(index, asked, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    sizes = {x["list"]: x["count"] for x in index.rows.groupBy("list").count().collect()}
    vectors = np.array([x["embedding"] for x in asked.collect()])
    read = sum(sizes.get(c, 0) for near in retrieval._by_distance(index.centers, vectors)[:, : index.probes].tolist() for c in near) / (len(vectors) * 6000)
    assert read < 0.25
    plan = retrieval.indexed_top_k(index, asked.filter("id = 100"), 10, probes=1)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)


def test_index_of_blocks_and_of_odd_vectors(spark, monkeypatch):
    from tessella.operators import retrieval

    r = random.Random(5)
    data = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(300, [0.0] * 4), (301, None)]
    rows = spark.createDataFrame(data, "id long, embedding array<float>")
    asked = rows.filter("id % 20 = 0 or id = 301")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    index = retrieval.coarse_index(rows, k=3)
    lists = len(index.centers)
    assert 4 <= lists <= 12 and 1 <= index.probes <= lists and index.rows.count() == 301
    every = retrieval.indexed_top_k(index, asked, 3, probes=lists)
    pairs = lambda df: sorted((x["query_id"], x["rank"], x["id"]) for x in df.collect())
    assert pairs(every) == pairs(vector_top_k(rows, asked, 3))
    small = retrieval.coarse_index(rows.limit(10))
    assert len(small.centers) == 1 and pairs(retrieval.indexed_top_k(small, asked, 3)) == pairs(vector_top_k(rows.limit(10), asked, 3))
    none = retrieval.coarse_index(rows.filter("id < 0"))
    assert none.rows.count() == 0 and retrieval.indexed_top_k(none, asked, 3).count() == 0


def test_probes_are_the_fewest_that_reach_the_recall():
    import numpy as np

    from tessella.operators.retrieval import _by_distance, probes_for

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    centers = x[:12] / np.linalg.norm(x[:12], axis=1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = _by_distance(centers, x)

    def recall(probes: int) -> float:
        hit = 0
        for i in range(50):
            best = np.argsort(-(unit @ unit[i]), kind="stable")[:5]
            hit += sum(order[j, 0] in order[i, :probes] for j in best)
        return hit / 250

    for wanted in (0.5, 0.8, 0.95, 1.0):
        p = probes_for(centers, x, 5, wanted, tried=50)
        assert recall(p) >= wanted and (p == 1 or recall(p - 1) < wanted)


def test_judged_runs_are_the_metrics_of_whole_gold_lists(spark):
    from tessella.operators.evaluation import judged_runs, question_metrics

    labels = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(30, None)], "id long, label int")
    found = spark.createDataFrame([(q, (q * 7 + r * 5) % 32, r + 1) for q in (0, 1, 2, 30) for r in range(6)], "query_id long, id long, rank int")
    runs = judged_runs(found, labels)
    got = {r["query_id"]: r["metrics"] for r in question_metrics(runs).collect()}
    gold = spark.createDataFrame([(q, [i for i in range(30) if i % 3 == q % 3]) for q in (0, 1, 2)], "query_id long, gold array<long>")
    want = question_metrics(runs.select("query_id", "ids").join(gold, "query_id"))
    assert got == {r["query_id"]: r["metrics"] for r in want.collect()} and set(got) == {0, 1, 2}
    assert all(len(r["ids"]) == 6 and r["n_gold"] == 10 for r in runs.collect())


def test_bm25_is_the_formula_over_blocks_and_slices(spark, monkeypatch):
    import math

    from tessella.operators import retrieval

    r = random.Random(2)
    words = [f"w{i}" for i in range(12)] + ["中", "文"]
    docs = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 4, 30])))) for i in range(60)] + [(60, None), (61, "中文 W1")]
    queries = [(i, " ".join(r.choices([*words, "none"], k=3))) for i in range(7)] + [(7, None), (8, "")]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    got = retrieval.bm25_top_k(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, text string"), 4)
    terms = {i: [w.lower() for w in re.findall("[A-Za-z0-9_]+|[\u4e00-\u9fff]", t or "")] for i, t in docs}
    mean = sum(map(len, terms.values())) / len(docs)
    want = set()
    for q, text in queries:
        scores = {}
        for w in {w for w in re.findall("[A-Za-z0-9_]+|[\u4e00-\u9fff]", text or "")}:
            df = sum(w in ws for ws in terms.values())
            for i, ws in terms.items():
                if tf := ws.count(w):
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:4]
        want |= {(q, i, n + 1, round(scores[i], 6)) for n, i in enumerate(best)}
    assert {(x["query_id"], x["id"], x["rank"], round(x["score"], 6)) for x in got.collect()} == want


def test_rerank_batches_and_failures(spark):
    seen = []

    def model(pairs):
        if pairs[0][0] == 2:
            return [(0, 1.0)] * len(pairs)  # an index twice
        if pairs[0][0] == 3:
            raise TimeoutError
        assert len(pairs) <= 4 and len({q for q, _ in pairs}) == 1
        return [(i, float(t)) for i, (_, t) in enumerate(pairs)][::-1]

    M.register("numbers", model)
    rows = [(q, str(n)) for q in (1, 2, 3) for n in range(6)]
    got = M.reranked(spark.createDataFrame(rows, "q long, text string"), "numbers", "q", "text", size=4).collect()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    assert len(got) == 18 and not seen
    assert all(r["rerank_score"] == pytest.approx(sigmoid(float(r["text"]) if r["q"] == 1 else 0.5)) for r in got)
    for bad in ([(0, 1.0)], [(0, 1.0), (0, 2.0)], [(0, 1.0), (2, 1.0)], [(0, 1.0), (1, float("nan"))], [(0, 1.0), (True, 1.0)], [(0, 1.0), (1, True)]):
        with pytest.raises(ValueError):
            M.checked_scores(bad, 2)


def test_tables_titles_and_lines():
    html = "<p>x</p><table><tr><th>Name</th><th colspan=2>Size</th><th></th></tr><tr><td rowspan='2'>a <b>b</b></td><td>1</td><td>2</td><td>z</td></tr><tr><td>3</td></tr></table><table><tr><td>no</td></tr></table>"
    assert C.table_to_kv(html) == ["Name：ab；Size：1；Size：2；", "Name：ab；Size：3；"]
    assert C.table_to_kv("") == C.table_to_kv("<p>none</p>") == C.table_to_kv("<table></table>") == []
    text = "这里有一个超过三十二个字符的句子因此可以作为标题来看待并且它的确是这样的长。最后一句："
    assert C.colon_titles([(text, "text"), ("a: b", "x"), ("short:", "y")]) == [("最后一句：", "title"), (text, "text"), ("a: b", "x"), ("short:", "y")]
    p = C.ChunkParams(limit=6)
    got = C.paragraphs_then_lines("one two\n\na b c\nd e\nf g h i j k\n\nl m n o. P q r s. T u v", p, C.hashed_vectors)
    assert got[:3] == ["one two", "a b c\nd e", "f g h i j k"] and " ".join(got[3:]).split() == "l m n o. P q r s. T u v".split()


def test_deep_trees_and_cycles(spark):
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)] + [(100, 101), (101, 100)], "id long, parent long")
    assert S.descendants(tree, spark.createDataFrame([(0,), (100,)], "id long")).count() == 72


def test_workbooks_and_archives(spark):
    import io
    import zipfile

    book = R.workbook({"A": [["x", "1"], ["<&>"]], "B": []})
    assert R.workbook_sheets(book) == {"A": [["x", "1"], ["<&>", ""]], "B": []}

    def archive(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in files.items():
                z.writestr(name, text)
        return out.getvalue()

    assert R.zip_to_markdown(archive({"d/b.md": "no", "d/full.md": "![i](images/1.png)", "d/images/1.png": "x"})) == "![i](d/images/1.png)"
    for bad in ({"../a.md": "x"}, {"/a.md": "x"}, {"a.txt": "x"}):
        with pytest.raises(ValueError):
            R.zip_to_markdown(archive(bad))


def test_a_cluster_needs_a_shared_folder():
    from tessella.session import shared_dir

    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared_dir(Fake())
