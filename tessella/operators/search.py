"""Text and file search, set differences, trees and access rules."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import snippet
from tessella.session import materialise


def message_search(messages: DataFrame, conv: str, turn: str, text: str, term: str, shown: int = 2) -> DataFrame:
    """(conv, matches, latest, place, snippet): conversations that contain the term, and their newest places."""
    found = messages.filter(F.lower(text).contains(term.lower()))
    w = Window.partitionBy(conv)
    ranked = found.withColumns({"matches": F.count("*").over(w), "latest": F.max(turn).over(w), "place": F.row_number().over(w.orderBy(F.desc(turn)))})
    return ranked.filter(F.col("place") <= shown).select(conv, "matches", "latest", "place", snippet(F.col(text), term).alias("snippet"))


def not_in_or_null(column: Column, values: list[str]) -> Column:
    """NOT IN that keeps nulls."""
    return column.isNull() | ~column.isin(values)


def path_score(name: Column, path: Column, term: str) -> Column:
    """How well a file fits a term, in any case: 1000 for its name, 500 and more for a name with it (50 at the begin, 20 at
    the end, less its place up to 30 and half the name's length up to 50); 0 if only the path has it; else null."""
    n, t = F.lower(name), term.lower()
    partial = (
        F.lit(500.0) + F.when(n.startswith(t), 50).otherwise(0) + F.when(n.endswith(t), 20).otherwise(0)
        - F.least(F.instr(n, t) - 1, F.lit(30)) - F.least(F.length(n) * 0.5, F.lit(50.0))
    )
    return F.when(n == t, 1000.0).when(n.contains(t), partial).when(F.lower(path).contains(t), 0.0)


def numbered_window(text: Column, first: int, count: int) -> Column:
    """Lines from the ``first``-th (1 to 2000 of them), each with its number."""
    lines = F.slice(F.split(text, "\n"), first, min(2000, max(1, count)))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.format_string("%6d", i + first), F.lit("\t"), x)), "\n")


def line_windows(lines: Column, wanted, height: int, most: int) -> Column:
    """Windows (start, end) of ``height`` lines around the lines for which ``wanted`` holds, left to right; a match that the
    window before covers makes none. At the end of a text a window shifts up."""
    n = F.size(lines)
    at = F.filter(F.transform(lines, lambda x, i: F.when(wanted(x), i).otherwise(-1)), lambda i: i >= 0)
    empty = F.expr("named_struct('covered', 0, 'found', cast(array() as array<struct<start:int,end:int>>))")

    def step(state: Column, m: Column) -> Column:
        end = F.least(F.greatest(m - height // 2, F.lit(0)) + height, n)
        start = F.greatest(end - height, F.lit(0))
        more = F.concat(state["found"], F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))))
        return F.when(m < state["covered"], state).otherwise(F.struct(end.cast("int").alias("covered"), more.alias("found")))

    return F.slice(F.aggregate(at, empty, step, lambda s: s["found"]), 1, most)


def differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or unchanged."""
    both = old.select(key).distinct().withColumn("_o", F.lit(1)).join(new.select(key).distinct().withColumn("_n", F.lit(1)), key, "full_outer")
    return both.select(key, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("unchanged").alias("change"))


def directory(files: DataFrame, path: str, below: str = "") -> DataFrame:
    """(name, is_folder, files) of one level: files as they are, deeper ones as a folder for each first segment."""
    inner = files.filter(F.col(path).startswith(below)).select(F.substring(F.col(path), len(below) + 1, 2**31 - 1).alias("rest"))
    own = inner.filter(~F.col("rest").contains("/")).select(F.col("rest").alias("name"), F.lit(False).alias("is_folder"), F.lit(1).cast("long").alias("files"))
    folders = inner.filter(F.col("rest").contains("/")).groupBy(F.split_part("rest", F.lit("/"), F.lit(1)).alias("name")).agg(F.count("*").alias("files"))
    return own.unionByName(folders.select("name", F.lit(True).alias("is_folder"), "files")).orderBy(F.desc("is_folder"), F.lower("name"), "name")


def normal_path(path: Column) -> Column:
    """A relative path without empty and ``.`` segments; null if it is absolute or leads out of its folder."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    bad = path.rlike(r"^[/\\]|^[A-Za-z]:") | F.exists(parts, lambda x: x == "..")
    return F.when(~bad, F.array_join(parts, "/"))


def folders_of(files: DataFrame, path: str) -> DataFrame:
    """(parent, name) of every folder that the paths need, once each."""
    parts = F.split(path, "/")
    every = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.slice(parts, 1, i))).alias("p"), F.size(parts).alias("depth"))
    return every.filter(F.col("depth") > 1).select(F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/").alias("parent"), F.element_at("p", -1).alias("name")).distinct()


def descendants(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth): the roots and all below them in (id, parent), level by level until none is left (cycles end, too)."""
    level = found = materialise(roots.select("id").distinct().withColumn("depth", F.lit(0)), "level")
    for depth in count(1):
        below = tree.join(level.select(F.col("id").alias("parent")), "parent").select("id").distinct().withColumn("depth", F.lit(depth))
        level = materialise(below.join(found, "id", "left_anti"), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
        if depth % 16 == 0:  # a deep tree leaves no long plan
            found = materialise(found, "level")
    return found


def pruned(tree: DataFrame, gone: DataFrame, root) -> DataFrame:
    """The tree (id, parent) without the leaves in ``gone``, and without parents that this leaves empty, up to the root."""
    parents = tree.select(F.col("parent").alias("id")).distinct()
    left = materialise(tree.join(gone.join(parents, "id", "left_anti"), "id", "left_anti"), "tree")
    while True:
        was = parents
        parents = left.select(F.col("parent").alias("id")).distinct()
        empty = was.join(parents, "id", "left_anti").filter(F.col("id") != F.lit(root)).join(left, "id", "left_semi")
        if empty.isEmpty():
            break
        left = materialise(left.join(empty, "id", "left_anti"), "tree")
    return left


def access(owner: Column, readers: Column, managers: Column, user: str, role: str) -> Column:
    """2 manage, 1 read or 0, by owner, manage scope and read scope (arrays; a null read scope is none), under the ceiling of
    the role: superadmin and admin may manage, user and unknown roles read. A superadmin manages all."""
    ceiling = {"superadmin": 2, "admin": 2}.get(role, 1)
    has = lambda scope: F.coalesce(F.array_contains(scope, user), F.lit(False))
    level = F.when(F.lit(role == "superadmin") | (owner == user) | has(managers), 2).when(has(readers), 1).otherwise(0)
    return F.least(level, F.lit(ceiling))


def redacted(values: Column) -> Column:
    """A map without the entries whose key speaks of a secret."""
    return F.map_filter(values, lambda k, _: ~F.lower(k).rlike("token|secret|password|api_key"))
