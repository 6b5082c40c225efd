"""License scans by diagonal voting, in DataFrame operations alone.

All rolling word k-grams of a text are joined by hash to the k-gram positions of the templates; each match votes for a
diagonal, the offset between its place in the text and its place in the template. Votes are summed per diagonal,
neighbouring diagonals of a template (an inserted word moves the rest up by one, a missing word down) are merged where
their spans follow each other in the text and the template, and a span is verified by the share of the template's k-grams that it holds. Matches compare
the words themselves beside their hashes, so a span that holds all k-grams of one diagonal is the phrase word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.shared import ascii_lower, spread

WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DRIFT = 2  # how far neighbouring diagonals may be apart
COVERAGE = 0.8
BROADCAST = 200_000  # word pairs of templates that go to every task; of more both sides are dealt by hash

# Exact phrases with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Whole paragraphs of common license notices, as their words.
PARAGRAPHS = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied",
        "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
        "warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "gpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
        "this permission notice appear in all copies",
        "isc",
    ),
]
# Opening sentences of common license notices, found with small changes too.
NOTICES = [
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("all rights reserved", "all-rights-reserved"),
    *PARAGRAPHS,
]


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, runs of ASCII letters, digits and characters beyond ASCII."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAKS)
    return F.filter(parts, lambda w: w != "")


def template_grams(spark: SparkSession, phrases=None, notices=None) -> DataFrame:
    """(h, w1, w2, template, exact, label, n_grams, at): the word pairs of all templates; bounded by the lists given."""
    rows = []
    listed = [(t, x, True) for t, x in (PHRASES if phrases is None else phrases)] + [(t, x, False) for t, x in (NOTICES if notices is None else notices)]
    for no, (text, label, exact) in enumerate(listed):
        words = text.split(" ")
        rows += [(words[i], words[i + 1], no, exact, label, len(words) - 1, i) for i in range(len(words) - 1)]
    small = F.broadcast if len(rows) <= BROADCAST else lambda d: d
    grams = spark.createDataFrame(rows, "w1 string, w2 string, template int, exact boolean, label string, n_grams int, at int")
    return small(grams.select(F.xxhash64("w1", "w2").alias("h"), F.col("w1").alias("t1"), F.col("w2").alias("t2"), "template", "exact", "label", "n_grams", "at"))


def votes(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """(row, n_words, template.., diagonal, n, first, last, places) for rows (row, words); a row without a match keeps one
    line with a null template. places has n entries, no more than the template has word pairs."""
    pairs = F.arrays_zip(F.sequence(F.lit(0), F.greatest(F.size("words") - 2, F.lit(0))), F.col("words"), F.expr("slice(words, 2, greatest(size(words) - 1, 0))"))
    each = rows.select("*", F.size("words").alias("n_words"), F.inline_outer(pairs).alias("place", "w1", "w2")).drop("words")
    each = each.where("place is not null and (w2 is not null or place = 0)")
    hit = each.join(grams, F.xxhash64("w1", "w2") == F.col("h"), "left")
    same = F.coalesce((F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")), F.lit(False))
    hit = hit.where(same | (F.col("place") == 0))
    for c in ("template", "exact", "label", "n_grams", "at"):
        hit = hit.withColumn(c, F.when(same, F.col(c)))
    keys = ["row", "n_words", "template", "exact", "label", "n_grams", (F.col("place") - F.col("at")).alias("diagonal")]
    return hit.groupBy(*keys).agg(F.count("at").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.collect_list("place").alias("places"))


def islands(voted: DataFrame, drift: int = DRIFT) -> DataFrame:
    """voted in parts (row, .., n, first, last) with `island`, the parts that are merged. Notices come twice, as two orders
    find islands: whole diagonals, upward, and single matches by place in the text, among diagonals that are near each
    other, where they may move both ways. An island of either counts, so what parts one of them doesn't part the other."""
    exact = F.coalesce("exact", F.lit(True))
    near = Window.partitionBy("row", "template").orderBy("diagonal", "first")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > drift, F.lit(True))
    apart = far | F.coalesce(F.col("first") <= F.lag("last").over(near), F.lit(False))
    rows = voted.withColumn("upward", F.sum((exact | apart).cast("int")).over(near)).withColumn("band", F.sum(far.cast("int")).over(near))
    part = lambda single, n, first, last: F.struct(F.lit(single).alias("single"), n.cast("long").alias("n"), first.alias("first"), last.alias("last"))
    whole = F.array(part(False, F.col("n"), F.col("first"), F.col("last")))
    parts = F.when(exact, whole).otherwise(F.concat(whole, F.transform("places", lambda p: part(True, F.lit(1), p, p))))
    rows = rows.withColumn("votes", F.col("n")).withColumn("part", F.explode(parts)).drop("n", "first", "last", "places").select("*", "part.*").drop("part")
    keys = ["row", "template", "single", "band"]
    order = ["first", F.desc("votes"), "diagonal"]
    along = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("again", F.coalesce(F.col("first") == F.lag("first").over(along), F.lit(False)))  # a place counts once
    along = Window.partitionBy(*keys, "again").orderBy(*order)
    moved = F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > drift
    back = F.col("first") - F.col("diagonal") <= F.lag(F.col("first") - F.col("diagonal")).over(along)
    rows = rows.withColumn("onward", F.sum(F.coalesce(moved | back, F.lit(True)).cast("int")).over(along))
    single = F.col("single")
    island = F.struct(single, F.when(single, F.col("onward")).otherwise(F.col("upward")).alias("no"), F.when(single, F.col("band")).alias("band"), F.when(single, F.col("again")).alias("again"))
    return rows.withColumn("island", island).drop("votes", "upward", "band", "single", "again", "onward")


def spans(voted: DataFrame, drift: int = DRIFT, coverage: float = COVERAGE) -> DataFrame:
    """Spans (row, n_words, template, exact, label, start, end, score, good) of votes(): end is the last word's place,
    good whether the span is verified. A row without a match keeps one line with good false."""
    keys = ["row", "n_words", "template", "exact", "label", "n_grams", "island"]
    merged = islands(voted, drift).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first").alias("start"), (F.max("last") + 1).alias("end"))
    score = F.least(F.col("n") / F.col("n_grams"), F.lit(1.0))
    enough = F.when(F.col("exact"), F.col("n") >= F.col("n_grams")).otherwise(score >= coverage)
    return merged.select("row", "n_words", "template", "exact", "label", "start", "end", score.alias("score"), (F.col("template").isNotNull() & F.coalesce(enough, F.lit(False))).alias("good"))


def scan(docs: DataFrame, phrases=None, notices=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    n_base counts the places of the exact phrases; first_word and last_word are the smallest and largest of their
    starts. labels adds those of notices found whole or with small changes. score is the best verified share, 1 for an
    exact phrase, 0 where nothing is found. Labels are distinct, sorted and comma-joined, empty where there is none.
    Null and empty texts have no words. Repeated and null doc_ids are rows of their own; further columns are not read;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    rows = rows.select(F.struct(F.monotonically_increasing_id().alias("no"), "doc_id").alias("row"), words_of(F.col("text")).alias("words"))
    found = spans(votes(rows, template_grams(spark, phrases, notices)))
    base = F.col("good") & F.col("exact")
    label = F.when(F.col("good"), F.col("label"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    per_row = found.groupBy("row").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(label).alias("labels"), F.coalesce(F.max(F.when(F.col("good"), F.col("score"))), F.lit(0.0)).alias("score"),
    )
    return per_row.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
