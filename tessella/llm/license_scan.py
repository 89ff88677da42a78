"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word pair of every document is hashed and joined to the word pairs of a fixed set of license
templates (a few hundred rows, broadcast). A hit votes for a diagonal: the document's place less the
template's. Each template place votes once on a diagonal, as a bit of a mask that merges before the shuffle;
neighbouring diagonals of a notice merge, so that words added or left out do not part it; spans with enough
places are verified on the words themselves, in their order, along the diagonals that voted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import materialise

# Short phrases whose places are counted exactly (label, phrase).
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
#: Words of a template at most, as a pair of words is a bit of a long; longer notices are several templates, which share a word.
MOST_WORDS = 64
# Notices of public licenses (label, text).
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Places that must vote on a diagonal of a notice before it merges, and the most that neighbours lie apart.
LEAST_VOTES, NEIGHBOURS = 2, 3
#: Share of a notice's pairs that must vote, and of its words that must stand at their place on the voted diagonals,
#: give or take NEIGHBOURS. Of a notice of fewer than WHOLE words all must: one tells it from another license.
VOTED, WORDS_FOUND, WHOLE = 0.6, 0.7, 12
#: Candidate spans are broadcast for verification up to so many bytes, else joined by a shuffle.
MAX_BROADCAST_BYTES = 64 << 20


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(id, label, is a phrase, words)."""
    found = []
    for label, text in PHRASES + NOTICES:
        words = re.findall("[0-9a-z]+", text.lower())
        parts = -(-(len(words) - 1) // (MOST_WORDS - 1))
        cuts = [i * (len(words) - 1) // parts for i in range(parts + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            found.append((len(found), label, len(found) < len(PHRASES), words[a : b + 1]))
    return found


def words_of(text: Column) -> Column:
    """Runs of ASCII letters (A-Z lowered), digits and non-ASCII characters; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``places`` (array of template id, label, first word,
    end, whether it is a phrase, score; only verified spans).

    Null and empty texts have no words and no places. Rows that repeat, or share an id, each have their row;
    a null id is kept. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    known = templates()
    pairs = spark.createDataFrame(
        [(t, i, 1 << i, phrase, len(words), a, b) for t, _, phrase, words in known for i, (a, b) in enumerate(zip(words, words[1:], strict=False))],
        "template int, at int, bit long, phrase boolean, size int, w string, x string",
    ).select("template", "at", "bit", "phrase", "size", F.xxhash64("w", "x").alias("h"))
    # one row for each document: the pair that its last word begins, which no word can be in
    end = F.xxhash64(F.lit(" "), F.lit(" "))
    ends = spark.range(1).select(F.lit(-1).alias("template"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("bit"), F.lit(True).alias("phrase"), F.lit(0).alias("size"), end.alias("h"))
    pairs = F.broadcast(pairs.unionByName(ends))

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = texts.select("id", F.xxhash64("id", "text").alias("key"), "text")
    grams = (
        keyed.select("id", "key", words_of(F.col("text")).alias("words"))
        .select(
            "id",
            "key",
            F.size("words").alias("n_words"),
            F.when(F.size("words") > 0, F.transform("words", lambda w, i: F.when(i + 1 < F.size("words"), F.xxhash64(w, F.get("words", i + 1))).otherwise(end)))
            .otherwise(F.array(end))
            .alias("grams"),
        )
        # outer: else a filter on the size of "grams" is inferred, which computes the words anew for each place
        .select("id", "key", "n_words", F.posexplode_outer("grams").alias("pos", "h"))
    )
    votes = (
        grams.join(pairs, "h")
        .groupBy("id", "key", "n_words", "template", "phrase", "size", F.when(F.col("template") >= 0, F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.count("*").alias("votes"), F.bit_or("bit").alias("mask"), F.min("at").alias("low"), F.max("at").alias("high"))
    )
    votes = materialise(votes, "votes")
    # equal rows are counted together; the end of text tells how many there are
    rows = votes.filter("template < 0").select("id", "key", "n_words", F.col("votes").alias("copies"))
    cast = votes.filter("template >= 0").withColumn("places", F.bit_count("mask"))

    exact = cast.filter("phrase and places = size - 1").selectExpr("id", "key", "template", "phrase", "diagonal AS first", "diagonal + size AS end", "diagonal AS from", "diagonal AS to")
    by_diagonal = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    runs = (
        cast.filter(f"not phrase and places >= {LEAST_VOTES}")
        .withColumn("apart", (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEIGHBOURS).cast("int"))
        .withColumn("run", F.sum(F.coalesce("apart", F.lit(0))).over(by_diagonal))
        .groupBy("id", "key", "template", "phrase", "size", "run")
        .agg(
            F.bit_or("mask").alias("mask"),
            F.min(F.col("diagonal") + F.col("low")).alias("first"),
            F.max(F.col("diagonal") + F.col("high") + 2).alias("end"),
            (F.min("diagonal") - NEIGHBOURS).alias("from"),
            (F.max("diagonal") + NEIGHBOURS).alias("to"),
        )
        .filter(F.bit_count("mask") >= VOTED * (F.col("size") - 1))
        .select("id", "key", "template", "phrase", "first", "end", "from", "to")
    )
    told = spark.createDataFrame(
        [(t, label, words) for t, label, _, words in known], "template int, label string, wanted array<string>"
    )
    spans = exact.unionByName(runs).groupBy("id", "key").agg(F.collect_list(F.struct("template", "phrase", "first", "end", "from", "to")).alias("spans"))
    spans = materialise(spans.select(F.col("id").alias("i"), F.col("key").alias("k"), "spans"), "spans")
    # a row holds its keys and some 50 bytes for each span
    if (spans.agg(F.sum(64 + 50 * F.size("spans"))).first()[0] or 0) <= MAX_BROADCAST_BYTES:
        spans = F.broadcast(spans)
    # verification on the words of the documents that have a span: those that stand where a voted diagonal has them
    stands = """array_contains(slice(words, greatest(i + s.from, 0) + 1, greatest(i + s.to + 1 - greatest(i + s.from, 0), 0)), wanted[i])"""
    found = (
        keyed.join(spans, F.col("key").eqNullSafe(F.col("k")) & F.col("id").eqNullSafe(F.col("i")))
        .dropDuplicates(["id", "key"])
        .select("id", "key", words_of(F.col("text")).alias("words"), F.explode("spans").alias("s"))
        .join(F.broadcast(told), F.col("s.template") == F.col("template"))
        .select("id", "key", "s.*", "label", F.size("wanted").alias("size"), F.expr(f"size(filter(sequence(0, size(wanted) - 1), i -> {stands})) / size(wanted)").alias("score"))
        .filter(F.col("score") >= F.when(F.col("size") < WHOLE, 1.0).otherwise(WORDS_FOUND))
        .select("id", "key", F.struct("template", "label", "first", "end", "phrase", "score").alias("place"))
    )
    both = rows.select("id", "key", "n_words", "copies", F.lit(None).cast(found.schema["place"].dataType).alias("place")).unionByName(
        found.select("id", "key", F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("long").alias("copies"), "place")
    )
    return (
        both.groupBy("id", "key")
        .agg(F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.array_sort(F.collect_list("place")).alias("places"))
        .select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "places", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
        .drop("_copy")
    )
