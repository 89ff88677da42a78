"""The conditional random field against enumeration of all taggings, and the classifier on texts of our own and the tables."""

import itertools
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from tessella.llm import toxicity as T


def enumerated(e, first, field):
    """log Z, marginals and expected pairs, one tagging at a time."""
    total, marginal, pairs = 0.0, np.zeros(len(e)), np.zeros(4)
    for tags in itertools.product((0, 1), repeat=len(e)):
        s = 0.0
        for t, y in enumerate(tags):
            s += e[t] * y + (field.first * y if first[t] else field.pairs[2 * tags[t - 1] + y])
        w = np.exp(s)
        total += w
        marginal += w * np.array(tags)
        for t in range(len(e)):
            if not first[t]:
                pairs[2 * tags[t - 1] + tags[t]] += w
    return np.log(total), marginal / total, pairs / total


@pytest.mark.parametrize("seed", range(4))
def test_marginals_and_gradient(seed):
    r = np.random.default_rng(seed)
    n = 9
    field = T.Field(np.zeros(1), r.normal(size=4), first=float(r.normal()))
    e, first, tags = r.normal(size=n) * 2, r.random(n) < 0.3, r.integers(0, 2, n)
    first[0] = True
    _, want, pairs = enumerated(e, first, field)
    _, f, b = field.messages(e, first)
    assert np.allclose(f * b / (1 + f * b), want)
    by_word, by_pair, by_first = T.gradient(field, e, first, tags)
    seen = np.bincount([2 * tags[t - 1] + tags[t] for t in range(n) if not first[t]], minlength=4)
    assert np.allclose(by_word, tags - want) and np.allclose(by_pair, seen - pairs) and by_first == pytest.approx((tags - want)[first].sum())


def test_blocks_give_the_plain_recurrence():
    r = np.random.default_rng(1)
    m = np.exp(r.normal(size=(4, 10_007)) * 6)
    x, want = 1.0, []
    for a, b, c, d in m.T:
        x = (b + d * x) / (a + c * x)
        want.append(x)
    assert np.allclose(T._chain(m, np.float64(1)), want, rtol=1e-9)


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(r.randrange(8, 60))], r.random() < 0.3
        if toxic:
            for _ in range(r.randrange(1, 5)):
                words.insert(r.randrange(len(words)), r.choice(["Vile", "rotten", "zorq" + word()]))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_learns_words_and_stems_and_finds_their_places(spark):
    data, new = corpus(900, 1), corpus(300, 2)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in data], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model, again = T.train(docs, labels), T.train(docs.repartition(5), labels.orderBy("toxic"))
    fresh = spark.createDataFrame([(i, "é" * 3 + " " + t) for i, t, _ in new], "doc_id long, text string")
    got = {r["doc_id"]: r for r in T.scored(fresh, model).collect()}
    assert {i: r["score"] for i, r in got.items()} == {r["doc_id"]: r["score"] for r in T.scored(fresh, again).collect()}
    assert sum((got[i]["score"] >= 0.7) == bool(y) for i, _, y in new) >= 0.97 * len(new)
    found = {("ééé " + t)[s["start"] : s["end"]] for i, t, _ in new for s in got[i]["spans"]}
    single = {w for span in found for w in span.lower().split()}
    assert {"vile", "rotten"} <= single and any(w.startswith("zorq") for w in single)
    assert sum(w in ("vile", "rotten") or w.startswith("zorq") for w in single) >= 0.9 * len(single)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "vile " * 60_000), (3, "x"), (3, "x"), (None, "... !")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = T.scored(docs, T.train(docs, none)).collect()
    assert len(out) == 6 and {r["score"] for r in out} == {0.5} and all(r["spans"] == [] for r in out)
    clean = T.train(docs, spark.createDataFrame([(1, 0), (3, 0)], "doc_id long, toxic int"))
    assert all(r["score"] < 0.5 for r in T.scored(docs, clean).collect())
    assert T.scored(docs.limit(0), clean).count() == 0


def test_calibration_never_falls_with_more():
    x = np.array([[0.0, -8, 0], [1, -4, 0.6], [2, -3, 0.9], [0.1, -7, 0.1]] * 10)
    y = np.array([0.0, 1, 1, 0] * 10)
    assert (T.calibrate(None, x, y).slope[:3] >= 0).all()
    assert set(T.calibrate(None, x[:0], y[:0]).scores(x)) == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in entry.queries()["op12_toxicity"](spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    seen = [(labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels]
    assert sum(y == p for y, p in seen) >= 0.98 * len(seen)
    assert sum(p for y, p in seen if y) >= 0.85 * sum(y for y, _ in seen)
    assert sum(p for y, p in seen if not y) <= 0.01 * len(seen)
