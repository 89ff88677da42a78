"""A Merkle manifest of a dataset: one hash tree for each part of the data (a language, a source), and one over their roots.

A tree's leaves are in the order of ids; while several nodes remain, each run of eight consecutive ones (the last has fewer)
becomes its hash. Trees are built as an associative monoid of sparse forests: a fragment holds nodes by (tree, level, index),
and merging two puts their nodes together and replaces a run by its parent as soon as all of its siblings are there, which the
tree's size tells. Each partition of the sorted leaves makes its own fragment; neighbours are merged by FAN, again and again,
until one is left. A fragment of neighbouring partitions has only the runs at its two ends, so none grows with the data.

No tree passes through the driver or one task: leaves stay in their partition, and the nodes that a partition's proofs need
from others (the runs at its ends, and those above) reach it by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import materialise, release

ARITY = 8
#: Leaves of a partition at most, by their number before it is dealt; and fragments that are merged in one task.
PART_ROWS, FAN = 1 << 17, 16
#: The tree over the roots of all others.
TOP = -1

Key = tuple[int, int, int]
_NODE = "part long, tree long, size long, level int, idx long, hash string, made boolean, open boolean"


def digest(*parts: str) -> str:
    """SHA-256 of the parts one after the other, in lower-case hexadecimal digits."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column | str) -> Column:
    """The hash of a row's fields in this order: ``-`` for null, else the bytes' number, ``:`` and the value as text."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


class Forest:
    """Nodes whose run is not complete. ``sizes`` has the leaves of each tree that it knows, of which TOP's are the trees."""

    def __init__(self, sizes: dict[int, int]):
        self.sizes, self.nodes = sizes, {}
        #: All nodes that were made by completing a run here.
        self.made: dict[Key, str] = {}

    def width(self, tree: int, level: int) -> int:
        """The nodes of a tree at a level."""
        n = self.sizes[tree]
        for _ in range(level):
            n = -(-n // ARITY)
        return n

    def run(self, key: Key) -> list[Key]:
        """The run that a node is in: it and its siblings."""
        tree, level, i = key
        first = i // ARITY * ARITY
        return [(tree, level, j) for j in range(first, min(first + ARITY, self.width(tree, level)))]

    def add(self, key: Key, value: str, made: bool = False) -> None:
        """Put a node in, and complete what it completes. A tree's root becomes a leaf of TOP."""
        while True:
            if made:
                self.made[key] = value
            tree, level, i = key
            if self.width(tree, level) == 1:
                if tree == TOP:
                    self.nodes[key] = value
                    return
                key, made = (TOP, 0, tree), True
                continue
            self.nodes[key] = value
            run = self.run(key)
            if not all(k in self.nodes for k in run):
                return
            value, made = digest(*(self.nodes.pop(k) for k in run)), True
            key = (tree, level + 1, i // ARITY)

    def merge(self, other: Forest) -> Forest:
        """Both together; associative, and with an empty forest as its neutral element."""
        out = Forest({**self.sizes, **other.sizes})
        for part in (self, other):
            for key, value in part.nodes.items():
                out.add(key, value)
        return out


@dataclass
class Manifest:
    """Leaves in order (part, tree_name, id, leaf, claimed), where each tree stands in each part (``sections``), the nodes that
    are not of one part alone, and the root (None if there is no leaf)."""

    ordered: DataFrame
    sections: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def _rows(forest: Forest, part: int, made_only: bool) -> pa.Table:
    """Nodes that were made here, and open ones."""
    keys = dict.fromkeys([*(forest.made if made_only else ()), *forest.nodes])
    return pa.table(
        {
            "part": pa.array([part] * len(keys), pa.int64()),
            "tree": pa.array([k[0] for k in keys], pa.int64()),
            "size": pa.array([forest.sizes[k[0]] for k in keys], pa.int64()),
            "level": pa.array([k[1] for k in keys], pa.int32()),
            "idx": pa.array([k[2] for k in keys], pa.int64()),
            "hash": pa.array([forest.nodes.get(k) or forest.made[k] for k in keys], pa.string()),
            "made": pa.array([k in forest.made or not made_only for k in keys], pa.bool_()),
            "open": pa.array([k in forest.nodes for k in keys], pa.bool_()),
        }
    )


def _placed(rows: pa.Table, sections: pa.Table) -> Iterator[tuple[dict, int, int]]:
    """Each row of a part with its tree and its place there. Ties of ids go by the leaf."""
    at = {s["tree_name"]: [s["tree"], s["start"]] for s in sections.to_pylist()}
    order = pc.sort_indices(rows, sort_keys=[("tree_name", "ascending"), ("id", "ascending"), ("leaf", "ascending")], null_placement="at_start")
    for row in rows.take(order).to_pylist():
        place = at[row["tree_name"]]
        yield row, place[0], place[1]
        place[1] += 1


def _forest(sections: pa.Table, trees: int) -> Forest:
    return Forest({TOP: trees, **{s["tree"]: s["size"] for s in sections.to_pylist()}})


def _fragment(trees: int):
    def run(rows: pa.Table, sections: pa.Table) -> pa.Table:
        forest, part = _forest(sections, trees), -1
        for row, tree, place in _placed(rows, sections):
            part = row["part"]
            forest.add((tree, 0, place), row["leaf"])
        return _rows(forest, part, False)

    return run


def _merged(trees: int):
    def run(table: pa.Table) -> pa.Table:
        forest, rows = Forest({TOP: trees}), table.to_pylist()
        for r in rows:
            one = Forest({TOP: trees, r["tree"]: r["size"]})
            forest.sizes |= one.sizes
            forest.add((r["tree"], r["level"], r["idx"]), r["hash"])
        return _rows(forest, rows[0]["part"], True)

    return run


def build(leaves: DataFrame, tree_col: str = "lang", id_col: str = "doc_id", leaf_col: str = "leaf", claimed_col: str | None = None) -> Manifest:
    """The manifest of a table of leaves. Trees ascend by name (null first, by bytes), leaves by id (null first), and those of
    equal ids by their hash, so that the result does not depend on how rows are stored. Repeated rows are leaves of their own.
    ``claimed_col`` has other leaves to be checked by ``proofs``. Other columns are not looked at.

    The driver gets one number for each partition.
    """
    spark = leaves.sparkSession
    held = materialise(
        leaves.select(F.col(tree_col).alias("tree_name"), F.col(id_col).cast("long").alias("id"), F.col(leaf_col).alias("leaf"), F.col(claimed_col or leaf_col).alias("claimed")),
        "leaves",
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // PART_ROWS))
    # equal rows are interchangeable: a number of the row lets many of them be dealt to several ranges
    dealt = held.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, "tree_name", "id", "leaf", "salt")
    ordered = materialise(dealt.select("tree_name", "id", "leaf", "claimed", F.spark_partition_id().cast("long").alias("part")), "ordered-leaves")
    release(held)

    counts = materialise(ordered.groupBy("part", "tree_name").agg(F.count("*").alias("n")), "counts")
    tree = Window.partitionBy("tree_name")
    spread = counts.withColumn("size", F.sum("n").over(tree)).withColumn(
        "start", F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    first = spread.filter("start = 0").select("tree_name", F.col("part").alias("first_part"), F.row_number().over(Window.partitionBy("part").orderBy("tree_name")).alias("nth"))
    trees, before = 0, []
    for r in sorted(first.groupBy("first_part").count().collect()):
        before.append((r["first_part"], trees))
        trees += r["count"]
    ranks = first.join(spark.createDataFrame(before, "first_part long, before long"), "first_part").select(F.col("tree_name").alias("name"), (F.col("before") + F.col("nth") - 1).alias("tree"))
    sections = spread.join(ranks, F.col("tree_name").eqNullSafe(F.col("name"))).select("part", "tree_name", "tree", "start", "n", "size")
    sections = materialise(sections, "sections")
    release(counts)

    level = materialise(ordered.groupBy("part").cogroup(sections.groupBy("part")).applyInArrow(_fragment(trees), _NODE), "fragments")
    nodes = level
    while parts > 1:
        parts = -(-parts // FAN)
        near = level.filter("open").withColumn("part", F.floor(F.col("part") / FAN))
        level = materialise(near.groupBy("part").applyInArrow(_merged(trees), _NODE), "fragments")
        nodes = nodes.unionByName(level)
    top = level.filter("open").select("hash").limit(2).collect()
    if len(top) > 1:
        raise RuntimeError("the trees are not complete")
    return Manifest(ordered, sections, nodes.filter("made").select("tree", "level", "idx", "hash"), trees, top[0]["hash"] if top else None)


def _wanted(trees: int):
    """The nodes of others that the ends of a span may need: at each level their runs, and the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for s in batch.to_pylist():
                forest, level = Forest({s["tree"]: s["size"]}), 0
                for level in range(64):
                    for place in (s["start"], s["start"] + s["n"] - 1):
                        out.update((s["part"], *k) for k in forest.run((s["tree"], level, place // ARITY**level)))
                    if forest.width(s["tree"], level) == 1:
                        break
            rows = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64())], names=["part", "tree", "level", "idx"]
            )

    return run


_PROOF = "id long, leaf string, subroot string, root string, proof {kind}, folded_root string"


def _proofs(trees: int, whole: bool):
    def run(rows: pa.Table, context: pa.Table) -> pa.Table:
        is_section = pc.is_valid(context.column("start"))
        sections = context.filter(is_section)
        forest, known, placed = _forest(sections, trees), {}, []
        for row, tree, place in _placed(rows, sections):
            placed.append((row, tree, place))
            known[tree, 0, place] = row["leaf"]
            forest.add((tree, 0, place), row["leaf"])
        known |= forest.made | {(r["tree"], r["level"], r["idx"]): r["hash"] for r in context.filter(pc.invert(is_section)).to_pylist()}
        runs: dict[Key, list[str]] = {}

        def children(tree: int, level: int, nth: int) -> list[str]:
            found = runs.get((tree, level, nth))
            if found is None:
                found = runs[tree, level, nth] = [known[k] for k in forest.run((tree, level, nth * ARITY))]
            return found

        depth = {t: next(x for x in range(64) if forest.width(t, x) == 1) for t in forest.sizes} if placed else {}
        out: list[list] = [[], [], []]
        for row, tree, place in placed:
            mine, siblings = row["claimed"], []
            for t, i in ((tree, place), (TOP, tree)):
                for level in range(depth[t]):
                    i, k = divmod(i, ARITY)
                    run_ = children(t, level, i)
                    left, right = run_[:k], run_[k + 1 :]
                    siblings += left
                    siblings += right
                    mine = digest(*left, mine, *right)
            out[0].append(known[TOP, 0, tree])
            out[1].append(siblings if whole else digest(*siblings))
            out[2].append(mine)
        root = known[TOP, depth[TOP], 0] if placed else None
        return pa.table(
            {
                "id": pa.array([r["id"] for r, _, _ in placed], pa.int64()),
                "leaf": pa.array([r["leaf"] for r, _, _ in placed], pa.string()),
                "subroot": pa.array(out[0], pa.string()),
                "root": pa.array([root] * len(placed), pa.string()),
                "proof": pa.array(out[1], pa.list_(pa.string()) if whole else pa.string()),
                "folded_root": pa.array(out[2], pa.string()),
            }
        )

    return run


def proofs(manifest: Manifest, whole: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root) of each leaf: the siblings on its way to the root, in order (with
    ``whole``, else their hash), and the root that its claimed leaf gives with them. No leaf gives no row."""
    s = manifest.sections
    spans = s.filter("n < size").select("part", "tree", "start", "n", "size")
    top = s.groupBy("part").agg(F.min("tree").alias("start"), (F.max("tree") - F.min("tree") + 1).alias("n"))
    spans = spans.unionByName(top.select("part", F.lit(TOP).cast("long").alias("tree"), "start", "n", F.lit(manifest.trees).cast("long").alias("size")))
    wanted = spans.mapInArrow(_wanted(manifest.trees), "part long, tree long, level int, idx long")
    context = wanted.join(manifest.nodes, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "hash").unionByName(
        s.select("part", "tree", "tree_name", "start", "size"), allowMissingColumns=True
    )
    rows = manifest.ordered.groupBy("part").cogroup(context.groupBy("part"))
    return rows.applyInArrow(_proofs(manifest.trees, whole), _PROOF.format(kind="array<string>" if whole else "string"))


def folded(leaf_hash: str, proof: list[str], places: list[tuple[int, int]]) -> str:
    """The root that a leaf gives with its proof: ``places`` has for each level of the way the place in the run and the run's size."""
    at = 0
    for k, n in places:
        run = proof[at : at + n - 1]
        leaf_hash, at = digest(*run[:k], leaf_hash, *run[k:]), at + n - 1
    return leaf_hash
