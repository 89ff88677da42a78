"""One id, one window or one text on very many rows, against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tessella.llm import decontamination as D
from tessella.llm import fingerprints as P


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def hits(text, items, size):
    """Hit words and items of a text, one window at a time."""
    own, marked, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == w[j : j + n]:
                    marked |= set(range(i, i + n))
                    found.add(item)
    return len(marked), sorted(str(x) for x in found if x is not None)


def scan(spark, docs, items, size=3):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.scan_contamination(frame, spark.createDataFrame(items, "item_id long, text string"), size=size).collect()
    return sorted((r["doc_id"], sum(x["end"] - x["first"] for x in r["ranges"]), r["items"]) for r in got)


def test_items_that_share_a_window(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefgh")
    items = [(i if i % 7 else None, " ".join(word() for _ in range(r.randrange(1, 9))) + " the common window " + word()) for i in range(60)] + [(3, "a")] * 4
    docs = [(i, " ".join([*(word() for _ in range(12)), "The Common; window", word()] if i % 2 else [word() for _ in range(9)])) for i in range(30)]
    want = sorted((i, *hits(t, items, 3)) for i, t in docs)
    assert scan(spark, docs, items) == want and any(len(x[2]) > 50 for x in want)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "window_hashes", lambda h, k: (h[: max(len(h) - k + 1, 0)] * 0))
    items = [("1", "a b c d"), ("2", "b c d a"), ("3", "a b c"), ("2", "b c d")]
    texts = ["x a b c y", "b c d", "nothing here at all", "a b", "d a b c d"]
    for text, (_, _, _, found, of) in zip(texts, D.Windows(items, 3).scan([t.encode() for t in texts]), strict=True):
        want = hits(text, items, 3)
        assert len({j for i, n in found for j in range(i, i + n)}) == want[0] and of == want[1]


def test_many_items_with_one_window_cost_one_comparison():
    items = [(str(i), f"the very same passage of ten words in every item and tail{i}") for i in range(8000)]
    windows = D.Windows(items, 10)
    known, first, *_ = windows.of[10]
    assert int((first[1:] - first[:-1]).max()) == 1  # each hash has one text, however many items have it
    assert len(windows.names(frozenset({(10, int(first[list(known).index(known[0])]))}))) in (1, 8000)
    found = list(windows.scan([b"so the very same passage of ten words in every item"] * 50))
    assert all(len(of) == 8000 for *_, of in found) and found[0][4] is found[1][4]


def test_one_id_on_all_rows_is_dealt_to_several_ranges(spark):
    docs = spark.createDataFrame([(7, f"text {i} " * (1 + i % 5)) for i in range(400)] + [(None, "x")] * 30, "doc_id long, text string")
    parts = P.with_next(docs, "doc_id", "text").filter("own").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 250


def test_next_rows_with_ties_nulls_and_repeats(spark):
    rows = [(5, "five five"), (5, "other five"), (5, "five five"), (9, None), (None, "no id"), (None, "no id"), (1, ""), (1, "one " * 40_000)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, own string")
    got = P.fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))] == [1, 1, 5, 5, 5, 9, None, None]
    # each edited text is that of its row and some row of its own id or the next lower one
    nexts = {9: [5], 5: [5, 1], 1: [1, None], None: [None, 9]}
    for i, t in rows:
        half, possible = len(t or "") // 2, set()
        for j, u in rows:
            if j in nexts[i]:
                possible.add(hashlib.sha256(((t or "")[: len(t or "") - half] + (u or "")[:half]).encode()).hexdigest())
        mine = [r["edited_sha256"] for r in got if r["doc_id"] == i and r["n_chars"] == len(t or "")]
        assert mine and set(mine) <= possible
