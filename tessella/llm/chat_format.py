"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A logged conversation is often followed by snapshots of itself with more turns. Rolling hashes of the turn
prefixes find the conversations that begin longer ones; anti-joins drop these, and equal ones but the
least; the maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import materialise


def _turn_hash(part: int) -> Column:
    """64 bits of a hash of a turn with its place: 15 hexadecimal digits stay within a long."""
    turn = F.concat_ws("\x1f", F.col("pos").cast("string"), F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00")))
    return F.conv(F.substring(F.sha2(turn, 256), 1 + 15 * part, 15), 16, 10).cast("long")


def maximal_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, pos, role, text): the turns of those conversations that no other one continues.

    Turns are in the order of ``turn_col`` (ties: role, text), and their place in it counts, not their
    number. Conversation A is dropped if another has more turns and begins with all of A's (roles and texts
    equal, nulls too), or has the same turns and a smaller id. Turns with a null conversation id belong to
    no conversation and are left out. Rows that repeat are turns of their own. Other columns are dropped.
    """
    rows = turns.select(F.col(conv_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).filter("id is not null")
    order = Window.partitionBy("id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the hash of a prefix: its turns' hashes, which hold their places, xor-ed
    placed = rows.withColumn("pos", F.row_number().over(order)).withColumns({"h0": _turn_hash(0), "h1": _turn_hash(1)})
    rolled = placed.select("id", "pos", F.bit_xor("h0").over(upto).alias("p0"), F.bit_xor("h1").over(upto).alias("p1"), F.count("*").over(Window.partitionBy("id")).alias("n"))
    rolled = materialise(rolled, "prefixes")
    whole = rolled.filter("pos = n").select("id", "pos", "p0", "p1")
    begun = rolled.filter("pos < n").select("pos", "p0", "p1").distinct()
    first = whole.groupBy("pos", "p0", "p1").agg(F.min("id").alias("id"))
    keep = first.join(begun, ["pos", "p0", "p1"], "left_anti").select("id")
    return placed.select("id", "pos", "role", "text").join(keep, "id", "left_semi")


def rendered(turns: DataFrame, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """One row per maximal conversation: id, ``n_turns``, ``n_chars`` and ``rendered``, each turn as
    ``<|im_start|>role``, its text and ``<|im_end|>``, a null role as ``user`` and a null text as empty."""
    kept = maximal_conversations(turns, conv_col, **columns)
    turn = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    lines = kept.select("id", "pos", turn.alias("line")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return lines.select(F.col("id").alias(conv_col), F.size("lines").cast("long").alias("n_turns"), F.length(text).cast("long").alias("n_chars"), text.alias("rendered"))
