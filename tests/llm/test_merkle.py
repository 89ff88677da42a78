"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random

import pytest

from tessella.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """All levels of a tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out, places = [], []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out += run[: i % 8] + run[i % 8 + 1 :]
        places.append((i % 8, len(run)))
        i //= 8
    return out, places


def brute(rows):
    """rows: (lang, id, leaf) -> sorted list of (id, leaf, subroot, root, proof), and the places on the way."""
    names = sorted({r[0] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [(n, sorted(((r[1], r[2]) for r in rows if r[0] == n), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))) for n in names]
    built = [tree([x for _, x in leaves]) for _, leaves in trees]
    top = tree([b[-1][0] for b in built])
    out = []
    for t, (_, leaves) in enumerate(trees):
        for i, (doc, leaf) in enumerate(leaves):
            low, high = siblings(built[t], i), siblings(top, t)
            out.append((doc, leaf, built[t][-1][0], top[-1][0], low[0] + high[0], low[1] + high[1]))
    return out


def check(spark, rows, **args):
    leaves = spark.createDataFrame([(a, b, c, "clash") for a, b, c in rows], "lang string, doc_id long, leaf string, part string")
    manifest = M.build(leaves, **args)
    got = M.proofs(manifest, whole=True).collect()
    want = brute(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[4])
    assert sorted(((r["id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got), key=key) == sorted((r[:5] for r in want), key=key)
    assert all(r["folded_root"] == r["root"] == manifest.root for r in got)
    for _, leaf, _, root, proof, places in want:
        assert M.folded(leaf, proof, places) == root
    return manifest


@pytest.mark.parametrize("langs,n", [(1, 1), (1, 8), (1, 9), (2, 65), (11, 700), (70, 150)])
def test_trees_and_proofs(spark, langs, n):
    r = random.Random(n)
    check(spark, [(f"l{r.randrange(langs)}", i, h(str(i))) for i in range(n)])


def test_ties_nulls_repeats_and_a_hot_id(spark):
    rows = [(None, None, h("a")), (None, None, h("a")), ("", 3, h("b")), ("é", 3, h("c")), ("z", 3, h("d")), ("z", 3, h("c"))]
    rows += [("hot", 7, h("same"))] * 200 + [("hot", 7, h(str(i))) for i in range(100)] + [("hot", None, h("n"))]
    check(spark, rows)


def test_no_rows(spark):
    empty = M.build(spark.createDataFrame([], "lang string, doc_id long, leaf string"))
    assert empty.root is None and M.proofs(empty).count() == 0


def test_merging_is_associative():
    r = random.Random(5)
    sizes = {M.TOP: 3, 0: 70, 1: 1, 2: 513}
    leaves = [((t, 0, i), h(f"{t}/{i}")) for t, n in sizes.items() if t != M.TOP for i in range(n)]
    want = tree([tree([x for k, x in leaves if k[0] == t])[-1][0] for t in range(3)])[-1][0]

    def piece(part):
        out = M.Forest(dict(sizes))
        for k, v in part:
            out.add(k, v)
        return out

    for _ in range(4):
        r.shuffle(leaves)
        a, b, c = piece(leaves[:150]), piece(leaves[150:400]), piece(leaves[400:])
        left, right = a.merge(b).merge(c), a.merge(b.merge(c))
        assert left.nodes == right.nodes == c.merge(a).merge(b).nodes == {(M.TOP, 1, 0): want}
        assert a.merge(M.Forest({})).nodes == a.nodes
    # neighbours leave only what stands at their ends
    near = piece(sorted(x for x in leaves if x[0][0] == 2)[100:400])
    assert len(near.nodes) <= 2 * 7 * 3


def test_leaf_fields(spark):
    df = spark.createDataFrame([(1, "é", None), (-5, "", "x:1")], "a long, b string, c string")
    assert [r[0] for r in df.select(M.leaf("a", "b", "c")).collect()] == [h("1:1", "2:é", "-"), h("2:-5", "0:", "3:x:1")]


def test_claimed_leaves_fold_to_another_root(spark):
    rows = [("a", i, h(str(i)), h("bad") if i == 9 else h(str(i)), "x" * 100_000 if i == 3 else None) for i in range(40)]
    leaves = spark.createDataFrame(rows, "lang string, doc_id long, leaf string, claimed string, text string")
    m = M.build(leaves, claimed_col="claimed")
    got = {r["id"]: r for r in M.proofs(m).collect()}
    assert {i for i, r in got.items() if r["folded_root"] != m.root} == {9}
    assert got[0]["proof"] == h(*[r for r in brute([r[:3] for r in rows]) if r[0] == 0][0][4])
