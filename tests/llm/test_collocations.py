"""Phrase collocations against a brute-force count in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import collocations as C


def brute(rows, most_words, least, inside, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = set()
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def found(spark, rows, **args):
    docs = spark.createDataFrame([(l, t, "x") for l, t in rows], "lang string, text string, key string")
    return {tuple(r) for r in C.collocations(docs, **args).collect()}


@pytest.mark.parametrize("most_words", [2, 3, 5])
def test_against_brute_force(spark, most_words):
    r = random.Random(most_words)
    words = ["a", "B", "b", "ça", "İ", "x\x00y", "d-e", "日本", "new", "york", "city"]
    breaks = [" ", " ", "  ", "\t", " ", ", ", ".", "\n", "\r\n", " ; ", " "]
    rows = [(r.choice(["en", "fr", None, "und", ""]), "".join(r.choice(words) + r.choice(breaks) for _ in range(r.randrange(0, 40)))) for _ in range(150)]
    rows += [("en", "New York City hall")] * 30 + [("en", None), ("en", ""), (None, None), ("en", "... ,, !")]
    args = dict(most_words=most_words, least=4, inside=50, top=40)
    want = brute(rows, **args)
    assert len(want) > 20 and found(spark, rows, **args) == want


def test_hot_prefix_long_text_and_nothing(spark):
    rows = [("en", "hot word " * 50_000 + "tail"), ("en", "x"), (None, "lone")]
    assert found(spark, rows, most_words=3, least=10, inside=50, top=10) == brute(rows, 3, 10, 50, 10)
    assert found(spark, [], least=1) == set()
    assert found(spark, [(None, None), ("en", "one")], least=1) == set()


def test_two_words_with_one_key_are_told_apart(spark, monkeypatch):
    plain, tried = C._count_words, []

    def clumsy(seed):
        tried.append(seed)
        if seed:
            return plain(seed)

        def run(batches):
            for batch in plain(seed)(batches):
                yield batch.set_column(0, "key", C._long(np.zeros(batch.num_rows, np.int64)))

        return run

    monkeypatch.setattr(C, "_count_words", clumsy)
    rows = [("en", "one two")] * 12
    assert found(spark, rows) == brute(rows, 3, 10, 50, 2000) and tried == [0, 1]


def test_growth_is_depth_first_and_exact():
    rows = np.array([[1, 2, 3, 4], [1, 2, 3, 0], [1, 2, 5, 4], [7, 2, 3, 4], [1, 2, 3, 4]])
    got = sorted(C.grow(rows, np.array([3, 2, 1, 4, 1]), 2, 4))
    assert got == [([1, 2, 3], 6), ([1, 2, 3, 4], 4), ([7, 2, 3], 4), ([7, 2, 3, 4], 4)]
    assert list(C.grow(np.zeros((0, 4), int), np.zeros(0, int), 2, 1)) == []
