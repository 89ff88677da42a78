"""Notices longer than a template, and both ways of joining spans."""

import re

from tessella.llm import license_scan as L


def scan(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["places"] for r in L.scan_licenses(frame).collect()}


def words(text):
    return re.findall("[0-9a-z]+", text.lower())


def test_long_notices_are_several_templates_that_share_a_word():
    known, long = L.templates(), max(L.NOTICES, key=lambda n: len(n[1]))
    assert all(2 <= len(w) <= L.MOST_WORDS for *_, w in known) and len({t for t, *_ in known}) == len(known)
    parts = [w for _, label, phrase, w in known if label == long[0] and not phrase]
    want = words(long[1])
    start = next(i for i, p in enumerate(parts) if p[0] == want[0] and p[1] == want[1])
    joined = parts[start][:]
    while len(joined) < len(want):
        start += 1
        assert parts[start][0] == joined[-1]
        joined += parts[start][1:]
    assert joined == want


def test_every_notice_is_found_by_its_label_and_where_it_stands(spark):
    texts = [f"before it all {text} and after" for _, text in L.NOTICES]
    got = scan(spark, texts)
    for i, (label, text) in enumerate(L.NOTICES):
        mine = [p for p in got[i] if p["label"] == label and not p["phrase"]]
        assert mine and min(p["first"] for p in mine) == 3 and max(p["end"] for p in mine) == 3 + len(words(text)), label
        assert all(p["score"] == 1.0 for p in mine if p["end"] - p["first"] <= L.MOST_WORDS), label
    assert {p["label"] for p in got[[n for n, _ in L.NOTICES].index("bsd-3-clause")]} == {"bsd-3-clause"}


def test_spans_joined_by_a_shuffle_give_the_same_rows(spark, monkeypatch):
    texts = [None, "", "x", "The MIT License, cc-by"] + [f"{i} {text} " * 2 for i, (_, text) in enumerate(L.NOTICES)] + ["mit license"] * 3
    want = scan(spark, texts)
    monkeypatch.setattr(L, "MAX_BROADCAST_BYTES", -1)
    assert scan(spark, texts) == want
