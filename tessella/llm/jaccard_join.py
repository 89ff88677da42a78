"""Near duplicates: an exact n-gram Jaccard join by the size-aware heavy-light method.

Small sets ("light") enumerate subsets: sets of a and b shingles are similar enough exactly if they
share c(a, b) of them, so both list their c-subsets, and a subset listed from both sides is a link.
Large sets ("heavy") meet in inverted lists. As the similarity is relative, a set's lists are those
of its first |s| - c(|s|, least partner) + 1 shingles in one global order (prefix filter): similar
sets share a list. The size between light and heavy is the one with the least estimated cost.

What keeps the heavy side in proportion:
* equal sets are one set (128-bit digest and size), so exact copies never meet in a list;
* lists are scanned twice: first only the heads of sets' prefixes (HEAD entries), where each set is compared with
  one set, the hub of most of its lists, so that whole groups of near copies become components in proportion to their
  size; then all lists, for the pairs that are left;
* only lists that more than one of those components enter give pairs, and pairs inside a component
  are not needed. Lists with the same least hash of a component are counted together, in pairs of blocks of
  bounded size, and only pairs whose shared entries can suffice leave the task;
* shingles that many sets have are last in the global order (any order is correct), so that passages
  which otherwise different documents share are hardly ever in a prefix: first those frequent within
  some block of documents, then, where lists are long, all that are frequent among the sets in them.
Pairs are verified on whole sets. Nothing is dropped: each pair of similar sets is either linked or
within one component already.

The plan is the same at every size: nothing that grows with the input is broadcast. What a join would drop anyway
(list entries of one component, texts without a pair) is sifted by a bit table of fixed size before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessella.llm.components import components
from tessella.llm.sieve import held, passing, sieve
from tessella.llm.words import encoded, lists, mix, shingles, sliced, trimmed
from tessella.session import bounded_batches, materialise, release

#: Sets above this size are never light: their subsets are too many whatever the sizes of others.
MAX_LIGHT = 14
#: Entries of a prefix whose lists are scanned first, and the share of them that must lead to one hub.
HEAD, AGREE = 12, 0.5
#: Shingles counted together when frequent ones are looked for: bounds the memory of a task.
COUNT_BLOCK = 1 << 20
#: A shingle is frequent if it is in this share of a block's documents (and in 8 of them).
FREQUENT = 1 / 1024
#: At most so many frequent shingles are broadcast (8 MB); others keep their place in the order.
MAX_FREQUENT = 1_000_000
#: Lists with more entries than this are looked into: their sets' frequent shingles go last, too.
LONG_LIST = 1024
#: Sets of two blocks of this size are counted against each other in one unit of work.
BLOCK = 512
#: Keys of more sets than this have all lists of their sets at hand, so their counts are those of the whole pair.
EXACT_ABOVE = 64
#: Lists that are counted at a time in a unit.
COLUMNS = 2048
#: Whole sets of two blocks are compared in one place; a block has about so many sets, and so many shingles.
COMPARED, COMPARED_SHINGLES = 128, 1 << 19
#: Places of a set that travel in one row with its text, and bytes of sets in one batch.
PLACES, SENT = 32, 4 << 20


def needed(a: int, b: int, num: int, den: int) -> int:
    """The least intersection with which sets of these sizes reach a Jaccard similarity of num/den."""
    return -(-num * (a + b) // (num + den))


def smallest(a: int, num: int, den: int) -> int:
    return -(-num * a // den)


def _survey(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(8, FREQUENT * len(held))
            return _survey_rows([None], [0], [0], [0], [values[keep]], [np.zeros(0, np.int64)], [counts[keep] / len(held)], True)

        for batch in sliced(batches, 1):
            ids, ns, d1, d2, least, small = [], [], [], [], [], []
            for i, s in zip(batch.column(0).to_pylist(), shingles(encoded(batch.column(1)), k), strict=True):
                ids.append(i)
                ns.append(len(s))
                mixed = mix(s)
                d1.append(int(s.sum().view(np.int64)))
                d2.append(int(mixed.sum().view(np.int64)))
                least.append(s[: min(HEAD, len(s) - smallest(len(s), num, den) + 1)])
                small.append(s if len(s) <= MAX_LIGHT else s[:0])
                held.append(s)
                size += len(s)
                if size > COUNT_BLOCK:
                    yield frequent()
                    held, size = [], 0
            yield _survey_rows(ids, ns, d1, d2, least, small, [np.zeros(0)] * len(ids))
        if held:
            yield frequent()

    return run


def _survey_rows(ids, ns, d1, d2, least, small, share, frequent=False) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(ns, pa.int64()),
            pa.array(d1, pa.int64()),
            pa.array(d2, pa.int64()),
            lists([x.view(np.int64) for x in least], pa.int64()),
            lists([x.view(np.int64) for x in small], pa.int64()),
            lists(share, pa.float64()),
            pa.array([frequent] * len(ids), pa.bool_()),
        ],
        names=["id", "n", "d1", "d2", "least", "small", "share", "frequent"],
    )


_SURVEY = "id long, n long, d1 long, d2 long, least array<long>, small array<long>, share array<double>, frequent boolean"


def _within(batch: pa.RecordBatch, table: np.ndarray | None) -> pa.RecordBatch:
    """The rows whose id (the first column) the table may have; all without a table."""
    if table is None:
        return batch
    ids = batch.column(0)
    return batch.filter(pa.array(held(table, ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)))


def _prefixes(k: int, num: int, den: int, above: int, late: np.ndarray, linked: np.ndarray, only: np.ndarray | None):
    """Each set's prefix in the global order: frequent shingles last, else by hash; and whether it may have a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced((_within(b, only) for b in batches), 1):
            ids, ns, firsts = [], [], []
            for i, s in zip(batch.column(0).to_pylist(), shingles(encoded(batch.column(1)), k), strict=True):
                n = len(s)
                # a light set meets heavy ones only if their sizes allow it
                if i is None or not n or n < smallest(above + 1, num, den):
                    continue
                if len(late):
                    at = np.searchsorted(late, s)
                    is_late = late[np.minimum(at, len(late) - 1)] == s
                    s = np.concatenate([s[~is_late], s[is_late]])
                length = n - smallest(n, num, den) + 1
                ids.append(i)
                ns.append(n)
                firsts.append(s[:length].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), lists(firsts, pa.int64()), pa.array(held(linked, np.array(ids, np.int64)), pa.bool_())],
                names=["id", "n", "prefix", "linked"],
            )

    return run


def _low_half(k: int, only: np.ndarray):
    """The lower half of each set's hashes, from which prefixes are taken (beyond it, if at all, by few sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced((_within(b, only) for b in batches), "text"):
            halves = [s[: np.searchsorted(s, np.uint64(1 << 63))].view(np.int64) for s in shingles(encoded(batch.column("text")), k)]
            yield pa.RecordBatch.from_arrays([lists(halves, pa.int64())], names=["low"])

    return run


def _whole_sets(k: int):
    """The set of each text, once for each place where it is compared."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["g", "i", "j", "a", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in sliced(batches, "text"):
            made = shingles(encoded(batch.column("text")), k)
            for i, places, s in zip(batch.column("id").to_pylist(), batch.column("places").to_pylist(), made, strict=True):
                blob = s.tobytes()
                for place in places:
                    rows.append((place["g"], place["i"], place["j"], i, blob))
                    size += len(blob)
                    if size > SENT:
                        yield batch_of(rows)
                        rows, size = [], 0
        yield batch_of(rows)

    return run


def _similar(num: int, den: int):
    """The pairs whose sets are similar. In each place sets come first, then the pairs."""

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return den * both >= num * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, {}
        for batch in sliced(batches, "s"):
            found: tuple[list, list] = ([], [])
            for g, i, j, a, b, blob in zip(*(batch.column(c).to_pylist() for c in ("g", "i", "j", "a", "b", "s")), strict=True):
                if (g, i, j) != key:
                    key, sets = (g, i, j), {}
                if b is None:
                    sets.setdefault(a, {}).setdefault(blob, np.frombuffer(blob, np.uint64))  # equal rows of an id are one
                elif any(alike(x, y) for x in sets[a].values() for y in sets[b].values()):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["a", "b"])

    return run


def _ids_with(table: np.ndarray):
    """The ids of the sets that have an entry which the table may have."""

    def pick(batch: pa.RecordBatch) -> np.ndarray:
        prefix = batch.column("prefix")
        at = np.repeat(np.arange(batch.num_rows), prefix.value_lengths().to_numpy())
        return batch.column("id").to_numpy()[np.unique(at[held(table, prefix.flatten().to_numpy())])]

    return pick


def _entered(table: np.ndarray, without: np.ndarray | None):
    """The list entries that the table may have, a row each; without the sets whose id that table may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            flat = prefix.flatten().to_numpy()
            at = np.repeat(np.arange(batch.num_rows), prefix.value_lengths().to_numpy())
            found = held(table, flat)
            if without is not None:
                found &= ~held(without, batch.column("id").to_numpy())[at]
            at = pa.array(at[found])
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(at) for c in ("id", "n", "component")} | {"h": pa.array(flat[found], pa.int64())})

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each set and each key of lists that it is in: these lists and how many others it has; where the key
    is crowded, all of its lists."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for i, n, component, entered in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "component", "entered")), strict=True):
            by: dict[tuple[int, bool], list[int]] = {}
            for e in entered:
                by.setdefault((e["p"], e["crowded"]), []).append(e["h"])
            for (p, crowded), hs in by.items():
                whole = [e["h"] for e in entered] if crowded else hs
                for column, value in zip(columns, (p, i, n, component, len(entered) - len(whole), crowded, whole), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["p", "id", "n", "component", "out", "exact", "hs"])


def _unit(rows: list[tuple], num: int, den: int) -> tuple[np.ndarray, ...]:
    """Pairs of different components in one unit that can be similar, their sizes, and the lists that they share here,
    which are counted for all pairs of two blocks at once. Pairs share at most these entries, those that both have
    elsewhere (none if the unit is exact), and what lies beyond the prefix of one of them; so a similar pair passes in
    each of its units."""
    i, j, own, ids, ns, components_, out, exact, hs = zip(*rows, strict=True)
    own, ids, ns, comps, out = (np.array(x, np.int64) for x in (own, ids, ns, components_, out))
    entries = np.concatenate([np.array(h, np.int64) for h in hs])
    _, codes, counts = np.unique(entries, return_inverse=True, return_counts=True)
    # lists with one of these sets only say nothing; the others are counted some columns at a time
    kept = counts[codes] > 1
    rows_at = np.repeat(np.arange(len(ids)), [len(h) for h in hs])[kept]
    columns = (np.cumsum(counts > 1) - 1)[codes[kept]]
    x, y = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
    shared = np.zeros((len(x), len(y)), np.int64)
    for low in range(0, int((counts > 1).sum()), COLUMNS):
        here = (columns >= low) & (columns < low + COLUMNS)
        has = np.zeros((len(ids), COLUMNS), np.float32)
        has[rows_at[here], columns[here] - low] = 1
        shared += (has[x] @ has[y].T).astype(np.int64)
    beyond = -(-num * ns // den) - 1
    most = shared + np.minimum(out[x][:, None], out[y][None, :]) + np.maximum(beyond[x][:, None], beyond[y][None, :])
    # within one block each pair is met both ways round
    apart = comps[x][:, None] < comps[y][None, :] if i[0] == j[0] else comps[x][:, None] != comps[y][None, :]
    ok = (shared > 0) & apart & (most * (num + den) >= (ns[x][:, None] + ns[y][None, :]) * num)
    ok &= (ns[x][:, None] * den >= ns[y][None, :] * num) & (ns[y][None, :] * den >= ns[x][:, None] * num)
    a, b = np.nonzero(ok)
    counted = shared[a, b]
    a, b = x[a], y[b]
    a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    return ids[a], ids[b], ns[a], ns[b], counted, np.full(len(a), int(exact[0]))


def _candidates(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        found: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(6)]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n_a", "n_b", "shared", "exact"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("p", "i", "j", "own", "id", "n", "component", "out", "exact", "hs")), strict=True):
                if row[:3] != key:
                    if len(rows) > 1:
                        found.append(_unit(rows, num, den))
                    key, rows = row[:3], []
                rows.append(row[1:])
            yield flush()
        if len(rows) > 1:
            found.append(_unit(rows, num, den))
            yield flush()

    return run


def _verified(texts: DataFrame, pairs: DataFrame, sizes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough. Sets are made again from the texts of the
    documents in pairs rather than kept for all documents. Documents that pairs connect are dealt into blocks, and
    all pairs of two blocks are compared in one place, so a set is sent once for each block it has pairs with.
    ``sizes`` has the number of shingles ``n`` of each document ``id``."""
    pairs = materialise(pairs, "pairs")
    nodes = materialise(components(pairs), "groups")
    sized = nodes.join(sizes.groupBy("id").agg(F.max("n").alias("n")), F.col("node") == F.col("id"), "left")
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / COMPARED), F.ceil(F.sum("n") / COMPARED_SHINGLES), F.lit(1)).alias("blocks"))
    nodes = materialise(nodes.join(blocks, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "nodes")
    met = pairs.join(nodes.select(F.col("node").alias("a"), F.col("component").alias("g"), F.col("block").alias("x")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("block").alias("y")), "b"
    )
    met = materialise(met.select("g", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", "b"), "met")
    places = met.select(F.explode(F.array("a", "b")).alias("id"), F.struct("g", "i", "j").alias("place")).distinct()
    wanted = places.groupBy("id").agg(F.collect_list("place").alias("places"))
    # a set with many places, as the hub of a large group has, gets several rows
    part = F.explode(F.sequence(F.lit(0), F.ceil(F.size("places") / PLACES).cast("int") - 1))
    wanted = wanted.select("*", part.alias("part")).select("id", F.expr(f"slice(places, part * {PLACES} + 1, {PLACES})").alias("places"))
    wanted = materialise(wanted, "wanted")
    sifted = passing(texts, sieve(wanted.select("id"), expected=wanted.count()), "id")
    # always a shuffle: within one stage the two functions would run in two Python workers at once
    sets = sifted.join(wanted.hint("merge"), "id").select("id", "text", "places").mapInArrow(trimmed(_whole_sets(k)), "g long, i int, j int, a long, s binary")
    both = sets.select("g", "i", "j", "a", F.lit(None).cast("long").alias("b"), "s").unionByName(met.withColumn("s", F.lit(None).cast("binary")))
    dealt = both.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", F.asc_nulls_first("b"))
    links = materialise(dealt.mapInArrow(trimmed(_similar(num, den)), "a long, b long").distinct(), "links")
    release(pairs, nodes, met, wanted)
    return links


def _boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The size up to which sets are light: the least sum of listed subsets and of list entries.
    A list entry is scanned once by each set that it leads to, taken as one here."""
    from math import comb

    def subsets(a: int, top: int) -> int:
        return sum(comb(a, needed(a, b, num, den)) for b in range(smallest(a, num, den), min(top, den * a // num) + 1))

    best, least = 0, None
    for top in range(MAX_LIGHT + 1):
        light = sum(n * subsets(a, top) for a, n in sizes.items() if a <= top)
        heavy = sum(n * (a - smallest(a, num, den) + 1) for a, n in sizes.items() if a >= smallest(top + 1, num, den))
        if least is None or light + heavy <= least:
            best, least = top, light + heavy
    return best


def _subsets(top: int, num: int, den: int):
    """The subsets that light sets list: key, the set's size, and the two sizes it is for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, own, lesser, larger = [], [], [], [], []
            for i, small in zip(batch.column("id").to_pylist(), batch.column("small").to_pylist(), strict=True):
                a = len(small)
                marks = mix(np.array(small, np.int64).view(np.uint64) + np.uint64(1))
                for b in range(smallest(a, num, den), min(top, den * a // num) + 1):
                    picked = np.array(list(combinations(range(a), needed(a, b, num, den))), np.int64)
                    key = marks[picked].sum(axis=1, dtype=np.uint64)
                    keys.append(mix(key).view(np.int64))
                    ids += [i] * len(key)
                    own += [a] * len(key)
                    lesser += [min(a, b)] * len(key)
                    larger += [max(a, b)] * len(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64()), *(pa.array(x, pa.int64()) for x in (ids, own, lesser, larger))],
                names=["key", "id", "own", "lesser", "larger"],
            )

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` and ``component_id``, the smallest id that
    links reach (a link: Jaccard similarity of the k-word shingle sets of at least num/den).

    Words are what white space (0x20, 0x09-0x0D) divides, A-Z lowered; a text of fewer than k words
    has its whole sequence as its shingle. A null, empty or blank text has no shingles and no links;
    its component is itself. Ids are integers, else it is a TypeError. Rows that share an id are one
    document whose links are those of all its rows. A row with a null id is counted, but its component
    is null. Other columns of ``docs`` are not looked at, whatever their names.
    """
    docs = bounded_batches(docs)
    if not 0 < num <= den:
        raise ValueError("a similarity between 0 and 1 is needed")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"ids in {id_col} must be integers")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    survey = materialise(texts.mapInArrow(trimmed(_survey(k, num, den)), _SURVEY), "survey")
    rows = survey.filter("not frequent").select("id", "n", "d1", "d2")

    linkable = survey.filter("not frequent and n > 0 and id is not null")
    rep = linkable.groupBy("n", "d1", "d2").agg(
        F.min("id").alias("rep"), F.min_by("least", "id").alias("least"), F.min_by("small", "id").alias("small")
    )
    rep = materialise(rep, "sets")
    sizes = rep.select(F.col("rep").alias("id"), "n")
    same = rows.join(rep.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"]).filter("id is not null and id <> rep").select(
        F.col("id").alias("a"), F.col("rep").alias("b")
    )

    # one row for each size, up to MAX_LIGHT sizes
    counts = {r["n"]: r["count"] for r in rep.filter(F.col("n") <= den * (MAX_LIGHT + 1) // num).groupBy("n").count().collect()}
    above = _boundary(counts, num, den)
    linked = _first_links(texts, rep, above, sizes, k, num, den)
    early = materialise(components(linked.unionByName(_light_links(rep, above, num, den)).unionByName(same)), "early")
    more = _verified(texts, _list_pairs(texts, survey, rep, early, above, k, num, den), sizes, k, num, den)

    ends = early.select("node", "component")
    joined = (
        more.join(ends.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(ends.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    late_links = materialise(components(joined).select(F.col("node").alias("component"), F.col("component").alias("top")), "tops")
    final = early.join(late_links, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = late_links.join(early, late_links["component"] == early["node"], "left_anti").select(
        F.col("component").alias("node"), F.col("top").alias("component")
    )
    return (
        rows.join(final.unionByName(alone), F.col("id") == F.col("node"), "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )


def _light_links(rep: DataFrame, above: int, num: int, den: int) -> DataFrame:
    """A link from each light set to the least set that lists the same subset."""
    listed = (
        rep.filter(F.col("n") <= above)
        .select(F.col("rep").alias("id"), "small")
        .mapInArrow(_subsets(above, num, den), "key long, id long, own long, lesser long, larger long")
    )
    bucket = ["key", "lesser", "larger"]
    shared = listed.groupBy(*bucket).agg(F.min("id").alias("hub"), F.min("own").alias("p"), F.max("own").alias("q")).filter(
        "p = lesser and q = larger"
    )
    return listed.join(shared, bucket).filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()


def _first_links(texts: DataFrame, rep: DataFrame, above: int, sizes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links of heavy sets to hubs of the inverted lists of their first prefix entries: the hub that at least half of a set's
    lists lead to, if they are similar."""
    entries = rep.filter(F.col("n") > above).select(F.col("rep").alias("id"), "n", F.size("least").alias("own"), F.explode("least").alias("h"))
    # the set whose lists most others are in, too, is the likeliest original of a group of copies
    sizes_of = entries.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
    central = entries.join(sizes_of, "h").groupBy("id").agg(F.sum("m").alias("weight"))
    hubs = entries.join(central, "id").groupBy("h").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"), F.count("*").alias("m")).filter("m > 1").drop("m")
    first = (
        entries.join(hubs, "h")
        .filter("id <> hub")
        .groupBy("id", "hub", "own")
        .count()
        .filter(F.col("count") >= AGREE * F.col("own"))
        .groupBy("id")
        .agg(F.min_by("hub", F.struct(-F.col("count"), "hub")).alias("hub"))
        .select(F.col("id").alias("a"), F.col("hub").alias("b"))
    )
    return _verified(texts, first, sizes, k, num, den)


def _hashes(df: DataFrame) -> np.ndarray:
    """The one column of hashes, of at most MAX_FREQUENT rows, on the driver."""
    return np.sort(df.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _list_pairs(texts: DataFrame, survey: DataFrame, rep: DataFrame, early: DataFrame, above: int, k: int, num: int, den: int) -> DataFrame:
    """Pairs of sets of different components of ``early`` that meet in the inverted lists and can be similar."""
    late = (
        survey.filter("frequent")
        .select(F.explode(F.arrays_zip("least", "share")).alias("f"))
        .groupBy(F.col("f.least").alias("h"))
        .agg(F.max("f.share").alias("share"))
        .orderBy(F.desc("share"), "h")
        .limit(MAX_FREQUENT)
        .select("h")
    )
    late_hashes = _hashes(late)
    # sets without a link are components of their own; only others have to be looked up
    linked = early.join(rep.select(F.col("rep").alias("node"), F.lit(True).alias("is_rep")).distinct(), "node", "left")
    in_early = sieve(early.select("node"), expected=early.count())

    def prefixes(only: np.ndarray | None) -> DataFrame:
        """(id, n, prefix, component) of the sets, or of those whose ids the table may have."""
        made = materialise(texts.mapInArrow(trimmed(_prefixes(k, num, den, above, late_hashes, in_early, only)), "id long, n long, prefix array<long>, linked boolean"), "prefixes")
        looked_up = made.filter("linked").join(linked, F.col("id") == F.col("node"), "left").filter("node is null or is_rep")
        looked_up = materialise(looked_up.select("id", "n", "prefix", F.coalesce("component", "id").alias("component")), "looked_up")
        return made.filter("not linked").select("id", "n", "prefix", F.col("id").alias("component")).unionByName(looked_up)

    def mixed_lists(of: DataFrame) -> DataFrame:
        """Lists of several components. Those with the same components get the same key p, whatever else is in their sets."""
        entered = of.select(F.xxhash64("component").alias("c"), F.explode("prefix").alias("h")).groupBy("h")
        found = entered.agg(F.min("c").alias("p"), F.max("c").alias("q"), F.count("*").alias("entries"))
        return materialise(found.filter("p < q").select("h", "p", "entries"), "lists")

    entries = prefixes(None)
    mixed = mixed_lists(entries)
    too_long = mixed.filter(F.col("entries") > LONG_LIST).select("h")
    again = stale = None
    if too_long.count():
        # passages that some sets share: count the shingles of those sets, move the frequent ones to the end of
        # the order, and make the prefixes that hold a moved shingle again, whoever's they are: any other prefix is
        # the same in both orders, so that all sets follow one
        touched = sieve(entries, _ids_with(sieve(too_long)))
        counts = texts.mapInArrow(trimmed(_low_half(k, touched)), "low array<long>").select(F.explode("low").alias("h")).groupBy("h").count()
        moved = materialise(counts.filter(F.col("count") > LONG_LIST).orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).select("h"), "moved")
        late_hashes = np.union1d(late_hashes, _hashes(moved))
        stale = sieve(entries, _ids_with(sieve(moved)))
        again = prefixes(stale)
        release(mixed, moved)
        mixed = mixed_lists(passing(entries, stale, "id", inside=False).unionByName(again))
    of_several = sieve(mixed.select("h"), expected=mixed.count())
    schema = "id long, n long, component long, h long"
    entered = entries.mapInArrow(trimmed(_entered(of_several, stale)), schema)
    if again is not None:
        entered = entered.unionByName(again.mapInArrow(trimmed(_entered(of_several, None)), schema))
    keyed = materialise(entered.join(mixed.select("h", "p"), "h"), "keyed")
    full = keyed.select("p", "id").distinct().groupBy("p").count().filter(F.col("count") > EXACT_ABOVE).select("p", F.lit(True).alias("full"))
    flagged = keyed.join(full, "p", "left").withColumn("crowded", F.coalesce("full", F.lit(False)))
    by_set = flagged.groupBy("id", "n", "component").agg(F.collect_list(F.struct("p", "h", "crowded")).alias("entered"))
    members = materialise(by_set.mapInArrow(trimmed(_members), "p long, id long, n long, component long, out long, exact boolean, hs array<long>"), "members")
    crowded = members.groupBy("p").count().filter(F.col("count") > BLOCK).select("p", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(crowded, "p", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (
        placed.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("p", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "component", "out", "exact", "hs")
    )
    units = dealt.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")
    counted = units.mapInArrow(trimmed(_candidates(num, den)), "a long, b long, n_a long, n_b long, shared long, exact long")
    beyond = F.greatest(*(F.ceil(F.col(c) * num / den) - 1 for c in ("n_a", "n_b")))
    return (
        counted.groupBy("a", "b", "n_a", "n_b")
        .agg(F.sum("shared").alias("shared"), F.max("exact").alias("exact"))
        .filter((F.col("exact") == 1) | ((F.col("shared") + beyond) * (num + den) >= (F.col("n_a") + F.col("n_b")) * num))
        .select("a", "b")
        .distinct()
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document (the smallest id) of each component; a row with a null id stays.
    Of rows that share the id of a kept document, all stay."""
    docs = bounded_batches(docs)
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = materialise(found.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).cast("long").alias("_gone")).distinct(), "gone")
    table = sieve(gone, expected=gone.count())
    # only texts that the table of the ids that go may have are shuffled
    maybe = passing(docs, table, id_col)
    return passing(docs, table, id_col, inside=False).unionByName(maybe.join(gone, maybe[id_col] == gone["_gone"], "left_anti"))
