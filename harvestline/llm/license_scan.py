"""Operator 9: license scans by diagonal voting, in DataFrame operations only.

Templates are sequences of words.  Every k-gram of words of every text is hashed
and joined to the k-grams of the templates; a match at word p of the text and
word t of the template votes for the diagonal p - t.  Votes are summed by text,
template and diagonal; diagonals of one template that lie ``NEAR`` words apart at
most and follow one another in the text are merged, since words put in or left
out move the rest of a passage to a neighbouring diagonal.  A merged span counts
if the template k-grams it holds, compared word by word, are enough of them.

The base phrases are templates too, with k = 2 and all k-grams demanded on one
diagonal, so each of their places is one such span.  Longer notices use k = 5,
which keeps pairs of frequent words from meeting everything.

Notices are a table (``phrase``, ``label``) of any size; those of this module are the
default.  Their k-grams are broadcast up to ``BROADCAST_GRAMS``; beyond that places
go to them by shuffle, each with its own few words.  A notice of 2 to 4 words is
found as base phrases are, whole; one of a single word, or null, never.  A notice
with a null label is found but adds none.  A repeated notice counts once.

Null or empty text has no words and no labels (``labels`` is ''), score 0.  Rows
with equal ``doc_id`` and text give equal rows.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestline.llm.common import Scratch, lower_ascii

# Base phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Notices of well-known licences, as words, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of": "gpl",
    "this work is licensed under a creative commons attribution": "cc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_K, NOTICE_K = 2, 5
NEAR = 3  # words between diagonals that merge
COVER = 0.5  # of a notice's k-grams that a span must hold
BROADCAST_GRAMS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def templates(spark: SparkSession, notices: DataFrame | None = None) -> DataFrame:
    """``t_words, label, base, k, template, t_grams``: the base phrases and the notices."""
    if notices is None:
        notices = spark.createDataFrame(list(NOTICES.items()), "phrase string, label string")
    base = spark.createDataFrame(list(BASE.items()), "phrase string, label string")
    known = (
        base.select(words_of(F.col("phrase")).alias("t_words"), "label", F.lit(True).alias("base"))
        .unionByName(notices.select(words_of(F.col("phrase")).alias("t_words"), "label", F.lit(False).alias("base")).distinct())
        .withColumn("k", F.when(F.col("base") | (F.size("t_words") < NOTICE_K), BASE_K).otherwise(NOTICE_K))
    )
    named = known.withColumn("template", F.xxhash64("t_words", "label", F.isnull("label"), "base"))
    return named.withColumn("t_grams", F.size("t_words") - F.col("k") + 1).filter("t_grams > 0")


def _gram(words: str, at: str, k: int) -> Column:
    parts = [F.get(words, F.col(at) + i) for i in range(k)]
    return F.xxhash64(F.lit(k), *parts)


def _template_grams(known: DataFrame) -> DataFrame:
    """A row a k-gram: its hash, its words, its template and its place there."""
    spread = known.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("t_grams") - 1)))
    gram = F.when(F.col("k") == BASE_K, _gram("t_words", "t", BASE_K)).otherwise(_gram("t_words", "t", NOTICE_K))
    own = F.slice("t_words", F.col("t") + 1, F.col("k"))
    return spread.select(gram.alias("gram"), "template", "label", "base", "k", "t", own.alias("t_gram"), "t_grams")


def text_key(text: Column) -> Column:
    """Rows with equal ``doc_id`` and key hold the same text, and the same spans."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(9))


def license_spans(docs: DataFrame, notices: DataFrame | None = None, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``doc_id, key, label, base, first_word, end_word, cover``: the verified spans of all texts."""
    spark = docs.sparkSession
    grams = Scratch(spark, "license-scan").keep(_template_grams(templates(spark, notices)), "grams")
    parsed = docs.select("doc_id", text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("words"))
    # Places of pairs; a longer gram that would pass the end has null words and meets nothing.
    placed = parsed.filter(F.size("words") >= BASE_K).select(
        "doc_id", "key", "words", F.explode(F.sequence(F.lit(0), F.size("words") - BASE_K)).alias("p")
    )
    hashed = placed.select(
        "doc_id",
        "key",
        "words",
        "p",
        F.explode(F.array(_gram("words", "p", BASE_K), _gram("words", "p", NOTICE_K))).alias("gram"),
    )
    # The words at a place: cut out after a broadcast join, for what met; before a shuffle, so that no text moves.
    here = F.slice("words", F.col("p") + 1, NOTICE_K).alias("here")
    if grams.count() <= broadcast_grams:
        met = hashed.join(F.broadcast(grams), "gram").select("*", here)
    else:
        met = hashed.select("doc_id", "key", "p", "gram", here).join(grams, "gram")
    votes = (
        met.filter(F.slice("here", F.lit(1), F.col("k")) == F.col("t_gram"))
        .select("doc_id", "key", "template", "label", "base", "k", "t_grams", "t", "p", (F.col("p") - F.col("t")).alias("diagonal"))
    )
    by = ["doc_id", "key", "template", "label", "base", "k", "t_grams"]
    diagonals = votes.groupBy(*by, "diagonal").agg(
        F.min("p").alias("low"), F.max("p").alias("high"), F.collect_set("t").alias("seen")
    )
    # What is found whole stands on one diagonal; a longer notice's neighbours are joined to it.
    whole = F.col("k") == BASE_K
    along = Window.partitionBy("doc_id", "key", "template").orderBy("low", "diagonal")
    apart = (
        whole
        | F.lag("diagonal").over(along).isNull()
        | (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > NEAR)
        | (F.col("low") > F.lag("high").over(along) + F.col("k") + NEAR)
    )
    spans = (
        diagonals.withColumn("apart", apart.cast("int"))
        .withColumn("span", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "span")
        .agg(
            F.min("low").alias("first_word"),
            (F.max("high") + F.first("k")).alias("end_word"),
            F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("held"),
        )
        .withColumn("cover", F.col("held") / F.col("t_grams"))
    )
    return spans.filter(F.when(whole, F.col("held") == F.col("t_grams")).otherwise(F.col("cover") >= COVER)).select(
        "doc_id", "key", "label", "base", "first_word", "end_word", "cover"
    )


def scan_licenses(docs: DataFrame, notices: DataFrame | None = None, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row."""
    spans = license_spans(docs, notices, broadcast_grams)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    found = spans.groupBy(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key")).agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first_word"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("cover").alias("score"),
    )
    found = Scratch(docs.sparkSession, "license-scan").keep(found, "found")
    counted = docs.select(
        "doc_id", text_key(F.col("text")).alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words")
    )
    return counted.join(
        found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("key") == F.col("of_key")), "left"
    ).select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
