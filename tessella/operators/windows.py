"""Ranking, top-k and paging over ordered rows. An order is always total: it ends with a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import materialise


def newest_per_group(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; the plan cuts groups before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def all_but_newest(df: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """What pruning removes: the rows of each group after the first ``keep``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") > keep).drop("_n")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, cursor: int, limit: int) -> DataFrame:
    """The rows after an exclusive cursor; the filter reaches the scan."""
    return df.filter(F.col(key) > cursor).orderBy(key).limit(limit)


def page_with_more(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """A page, and in ``has_more`` whether another row follows."""
    probe = df.orderBy(*order).limit(limit + 1)
    more = probe.agg((F.count("*") > limit).alias("has_more"))
    return probe.orderBy(*order).limit(limit).join(F.broadcast(more))


def around(df: DataFrame, key: str, anchor: int, n: int) -> DataFrame:
    """``n`` rows around an anchor: (n + 1) / 2 up to it, the rest after it."""
    before = (n + 1) // 2
    low = df.filter(F.col(key) <= anchor).orderBy(F.desc(key)).limit(before)
    return low.unionByName(df.filter(F.col(key) > anchor).orderBy(key).limit(n - before))


def tail(df: DataFrame, key: str, n: int) -> DataFrame:
    """The last ``n`` rows in ascending order, and in ``truncated`` whether there are others."""
    probe = df.orderBy(F.desc(key)).limit(n + 1)
    cut = probe.agg((F.count("*") > n).alias("truncated"))
    return probe.orderBy(F.desc(key)).limit(n).join(F.broadcast(cut)).orderBy(key)


def within_budget(df: DataFrame, by: list[str], order: list[Column], size: Column, most: int) -> DataFrame:
    """The rows of each group until their sizes exceed the budget: the first that does ends it, none after it is kept."""
    return df.withColumn("_sum", F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_sum") <= most).drop("_sum")


def with_ntile(df: DataFrame, tiles: int, order: list[str], out: str, part_rows: int = 250_000) -> DataFrame:
    """``df`` with the number from 1 of its tile of as equal tiles in ascending ``order`` (nulls first), as ``ntile`` over the whole
    table gives it, but in ranges of about ``part_rows`` rows: rows are numbered within a range, after those of the ranges before,
    whose sizes are all that the driver gets."""
    n = df.count()
    ranges = max(1, -(-n // part_rows))
    dealt = materialise(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dict(dealt.groupBy("_part").count().collect())
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _before long"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    small, larger = divmod(n, tiles)
    split = larger * (small + 1)  # rows of the tiles that have one more
    tile = F.when(F.col("_at") < split, F.floor(F.col("_at") / (small + 1))).otherwise(larger + F.floor((F.col("_at") - split) / max(1, small)))
    numbered = dealt.join(starts, "_part").withColumn("_at", at)
    return numbered.withColumn(out, (tile + 1).cast("int")).drop("_part", "_before", "_at")
