"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise, release


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, limit: int = 100) -> DataFrame:
    """(node, component) for each node that ``links`` (a, b: long) names: the least node that it
    reaches. A link of a node to itself, or with a null, is ignored; links may repeat and go either way.

    Each round is a few group-bys with partial aggregation, so a node with very many links is no
    heavier than others; its result is written to the shared folder. Rounds grow with the logarithm
    of the links' number; only two numbers of each round reach the driver.
    """
    links = (
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    links = materialise(links, "stars")
    state = _state(links)
    for _ in range(limit):
        if not state[0]:
            break
        # large star: larger neighbours go to the least of the node and its neighbours
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = ways.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours, and the node itself, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
            .select("l.a", "l.b")
            .filter("a <> b")
            .distinct()
        )
        before, links = links, materialise(small, "stars")
        release(before)
        now = _state(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components are not found in {limit} rounds")
    tops = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
