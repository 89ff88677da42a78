import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import jaccard_join as J
from tessella.llm.components import components
from tessella.llm.sieve import held, passing, sieve
from tessella.llm.words import shingles


def sets_of(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(sets_of(t))
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(100 * len(x & y) >= 75 * len(x | y) > 0 for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((-1 if i is None else i), len(sets_of(t)), (-1 if i is None else find(i))) for i, t in rows)


def ours(df):
    got = J.near_duplicates(df).select(*(F.coalesce(c, F.lit(-1)) for c in ("doc_id", "n_shingles", "component_id"))).collect()
    return sorted(tuple(r) for r in got)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(30))
    bases = [[r.choice(words) for _ in range(r.choice([1, 3, 5, 6, 8, 11, 14, 16, 40, 90]))] for _ in range(n // 4)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "one two three four"), (6, "one two three four")]
    for i in range(7, n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.3:
            w += passage.split()
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + [(500, None), (None, "x y z x y z"), (8, corpus(seed)[9][1])]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, id string, component_id int")
    assert ours(df) == brute(rows)


def test_long_lists_and_crowded_blocks(spark, monkeypatch):
    for name, value in (("LONG_LIST", 4), ("BLOCK", 8), ("COMPARED", 2), ("COLUMNS", 16), ("EXACT_ABOVE", 6), ("PLACES", 2), ("SENT", 500), ("AGREE", 2.0)):
        monkeypatch.setattr(J, name, value)
    rows = corpus(3, 160)
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def sets_corpus(seed, n=60):
    """Word sets of one vocabulary: variants of a few bases, of which some share a passage."""
    r = random.Random(seed)
    words = [f"s{seed}w{i}" for i in range(150)]
    passage = r.sample(words, 6)
    bases = [r.sample(words, r.choice([6, 8, 10, 12, 20, 30])) for _ in range(n // 5)]
    out = []
    for _ in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(words)
        out.append({*w, *(passage if r.random() < 0.5 else ())})
    return out


@pytest.mark.parametrize(("agree", "max_light"), [(2.0, 0), (0.5, 14)])
def test_hundreds_of_corpora(spark, monkeypatch, agree, max_light):
    """Corpora of vocabularies of their own in one table, with moved shingles, crowded keys and many blocks."""
    small = {"LONG_LIST": 4, "BLOCK": 8, "COMPARED": 4, "COMPARED_SHINGLES": 64, "COLUMNS": 16, "EXACT_ABOVE": 6, "PLACES": 2, "SENT": 500}
    for name, value in {**small, "AGREE": agree, "MAX_LIGHT": max_light}.items():
        monkeypatch.setattr(J, name, value)
    rows, want = [], {}
    for seed in range(200):
        sets, first = sets_corpus(seed), 1000 * seed
        parent = list(range(len(sets)))
        for i, x in enumerate(sets):
            for j in range(i):
                if 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                    a, b = parent[i], parent[j]
                    parent = [min(a, b) if p in (a, b) else p for p in parent]
        rows += [(first + i, " ".join(sorted(x))) for i, x in enumerate(sets)]
        want |= {first + i: first + p for i, p in enumerate(parent)}
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_sieve_has_all_of_its_keys(spark):
    keys = [*range(-50, 5000, 7), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(k,) for k in [*keys, None]], "id long")
    table = sieve(df)
    assert held(table, np.array(keys, np.int64)).all() and held(table, np.arange(10**6, 10**6 + 10**5)).mean() < 0.001
    larger = sieve(df, expected=1 << 23)
    assert len(larger) == 2 * len(table) and held(larger, np.array(keys, np.int64)).all() and held(larger, np.arange(10**6, 10**6 + 10**5)).mean() < 0.001
    other = spark.createDataFrame([(7, 1), (None, 2), (6, 3)], "id long, other int")
    assert {r["other"] for r in passing(other, table, "id").collect()} <= {1, 3}
    assert {2} <= {r["other"] for r in passing(other, table, "id", inside=False).collect()}


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        J.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_moved_shingle_in_a_set_without_long_lists(spark, monkeypatch):
    """a has no long list, but in its prefix the shingles that those of b's long list move to the end."""
    for name, value in (("LONG_LIST", 4), ("AGREE", 2.0)):
        monkeypatch.setattr(J, name, value)
    of_word = {f"v{i}": int(next(shingles([f"v{i}".encode()], 1))[0]) for i in range(400)}
    w = [x for x in sorted(of_word, key=of_word.get) if of_word[x] < 1 << 63]  # in the global order
    long, a, b, common = w[0], w[1:3], w[3], w[29:47]
    others = [[long, *w[4 + 5 * i : 9 + 5 * i], *common[:4], *w[50 + 10 * i : 60 + 10 * i]] for i in range(5)]
    sets = [[*a, *common], [long, b, *common], *others]
    assert [len(s) for s in sets] == [20] * 7
    alike = {(i, j) for i in range(7) for j in range(i) if 100 * len({*sets[i]} & {*sets[j]}) >= 75 * len({*sets[i]} | {*sets[j]})}
    assert alike == {(1, 0)}
    got = J.near_duplicates(spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "doc_id long, text string"), k=1)
    assert sorted(tuple(r) for r in got.select("doc_id", "component_id").collect()) == [(0, 0), (1, 0), *((i, i) for i in range(2, 7))]


def test_empty_table_and_dedup(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(none).count() == 0
    t = " ".join(f"a{i}" for i in range(50))
    df = spark.createDataFrame([(3, t, "x"), (2, t + " b", "y"), (9, "other words", "z"), (None, t, "n")], "doc_id long, text string, source string")
    assert sorted(r["source"] for r in J.deduplicated(df).collect()) == ["n", "y", "z"]


def test_boundary_is_where_the_cost_is_least():
    assert J._boundary({5: 10}, 75, 100) >= 4 and J._boundary({}, 75, 100) == J.MAX_LIGHT
    assert J._boundary({14: 10**6, 13: 10**6}, 75, 100) < 14
    assert J.needed(7, 7, 75, 100) == 6 and J.smallest(4, 75, 100) == 3


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[301] == 300 and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_of_bytes():
    from tessella.llm.words import ALNUM, SPACED, Words

    found = Words(["A\x00b c".encode(), "é-É x".encode(), b""], SPACED)
    assert found.offsets.tolist() == [0, 2, 4, 4]
    assert Words([b"A b"], SPACED).hashes.tolist() == Words([b"a B"], SPACED).hashes.tolist()
    assert [Words(["x-y é9".encode()], ALNUM).text(i, 1).decode() for i in range(3)] == ["x", "y", "é9"]
    assert len(np.unique(Words([b"ab ba aab abb"], SPACED).hashes)) == 4
