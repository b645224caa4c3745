"""License scans by diagonal voting, with DataFrame functions only.

Base: the places where the words of a fixed phrase stand consecutively.

Method. Every k-gram of words of a document is joined, by hash and then word by
word, to the k-grams of the license templates. A match at document word p and
template word t votes for the diagonal p - t. Votes are counted by (document,
template, diagonal); diagonals at most ``GAP`` apart (inserted or left-out words)
are merged into one span; a span is verified by the share of the template's
words that its exact k-gram matches cover and by their density in the document.
Neighbouring diagonals may also be occurrences of a short template side by side,
so each run of consecutive diagonals of a span is verified, and the best share
counts. Verified spans add the template's label.

The documents' words are exploded and joined in the scan stage: the templates are
fixed text (a few hundred k-grams), so that side is broadcast. Only votes and
one line per document are shuffled, by document.

Defined cases: null or empty texts have no words, no labels and score 0; a null id
is carried as null; repeated rows are each returned. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from disputelens.llm.common import prepare

#: Phrases and labels of the contract.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Public license notices, and the label that a verified span adds.
TEMPLATES = (
    ("apache-notice",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-short", "Licensed under the Apache License, Version 2.0"),
    ("gpl-notice",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("mit-notice",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software"),
    ("mit-short", "Released under the MIT License"),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-short", "This work is licensed under the GNU General Public License"),
    ("cc-short", "Licensed under CC BY"),
    ("all-rights-reserved", "All rights reserved"),
)

K = 3
#: Diagonals that far apart at most are one span.
GAP = 4
#: Least share of a template's words, and of the span's words, that matches cover.
MIN_COVER, MIN_DENSITY = 0.75, 0.6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one character beyond ASCII whose lower case is an ASCII letter (the Kelvin sign), and a stand-in.
KELVIN, OTHER = "\u212a", "\ufffd"


def words_of(text: Column) -> Column:
    """The words of a text lower-cased in A-Z.

    ``lower`` changes letters beyond ASCII too, but never into or out of ASCII
    once the Kelvin sign is set aside, so places and ASCII words are the same.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def _grams(words: str) -> Column:
    """struct(w0, .. w{K-1}) for each word: it and its followers, null beyond the end."""
    array = F.col(words)
    parts = [array if i == 0 else F.slice(array, i + 1, F.size(array)) for i in range(K)]
    return F.arrays_zip(*[p.alias(f"w{i}") for i, p in enumerate(parts)])


def _hash() -> Column:
    return F.xxhash64(*[f"g.w{i}" for i in range(K)])


def _phrase_at(text: Column, words: str) -> Column:
    """struct(at, phrase) for each place of a phrase. Texts that lack a word of every phrase are not walked."""
    def one(w: Column, i: Column) -> Column:
        cases = None
        for number, (phrase, _) in enumerate(PHRASES):
            first, *rest = phrase.split(" ")
            hit = reduce(lambda a, b: a & b, [F.get(words, i + j) == v for j, v in enumerate(rest, 1)], w == first)
            cases = F.when(hit, number) if cases is None else cases.when(hit, number)
        return F.struct(i.alias("at"), cases.alias("phrase"))

    low = F.lower(text)
    may = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in p.split(" ")])
                                      for p, _ in PHRASES])
    found = F.filter(F.transform(words, one), lambda s: s["phrase"].isNotNull())
    return F.when(may, found).otherwise(F.slice(found, 1, 0))


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, label, length, off, hash, t0 .. t{K-1}; and one row that answers each document's own line."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"))
                     for i, (label, text) in enumerate(templates)])
    words = spark.range(1).select(F.inline(rows)).withColumn("words", words_of(F.col("text")))
    grams = words.select("template", "label", F.size("words").alias("length"),
                         F.posexplode(_grams("words")).alias("off", "g")).filter(F.col("off") <= F.col("length") - K)
    own = spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(0).alias("length"),
                                F.lit(0).alias("off"), _own_line().alias("g"))
    return grams.union(own).select("template", "label", "length", "off", _hash().alias("hash"),
                                   *[F.col(f"g.w{i}").alias(f"t{i}") for i in range(K)])


def _own_line() -> Column:
    """A k-gram that no text has: empty words."""
    return F.struct(*[F.lit("").alias(f"w{i}") for i in range(K)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of ``docs``."""
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"),
                        words_of(text).alias("words"))
    based = split.select("row", "id", "words", _phrase_at(F.col("text"), "words").alias("base"))
    seen = F.transform(F.lit([i for i in range(len(PHRASES))]), lambda p: F.exists("base", lambda s: s["phrase"] == p))
    # each document's own line travels as one more k-gram
    line = ("id", "n_words", "n_base", "first_word", "last_word", "seen")
    lines = based.select(
        "row", "id", F.size("words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.at")).cast("long").alias("first_word"),
        F.array_max(F.col("base.at")).cast("long").alias("last_word"),
        F.aggregate(seen, F.lit(0), lambda a, x: a * 2 + x.cast("int")).alias("seen"),
        F.concat(_grams("words"), F.array(_own_line())).alias("grams"))
    # only the line's few numbers go along with each k-gram
    rows = lines.select("row", *line, F.posexplode("grams").alias("pos", "g"))
    same = [F.col(f"g.w{i}") == F.col(f"t{i}") for i in range(K)]
    votes = rows.withColumn("hash", _hash()).join(F.broadcast(template_grams(spark, templates)), "hash").filter(
        reduce(lambda a, b: a & b, same)).select(
        "row", "template", "label", "length", "off", "pos",
        # the line's own diagonal is 0, and only its row carries the columns
        F.when(F.col("template") < 0, 0).otherwise(F.col("pos") - F.col("off")).alias("diagonal"),
        *[F.when(F.col("template") < 0, F.col(c)).alias(c) for c in line])
    diagonals = votes.groupBy("row", "template", "label", "length", "diagonal").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("off").alias("offs"),
        *[F.max(c).alias(c) for c in line])
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(False)).cast("int")
    merged = (diagonals.withColumn("apart", apart)
              .withColumn("span", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("row", "template", "label", "length", "span")
              .agg(F.sort_array(F.collect_list(F.struct("diagonal", "lo", "hi", "offs"))).alias("parts"),
                   *[F.max(c).alias(c) for c in line]))

    def verified(run: Column) -> Column:
        """The share of a run of diagonals that is verified, else null."""
        covered = F.size(F.array_distinct(F.flatten(F.transform(
            F.flatten(run["offs"]), lambda o: F.sequence(o, o + (K - 1))))))
        share = covered / F.col("length")
        density = covered / (F.array_max(run["hi"]) - F.array_min(run["lo"]) + K)
        return F.when((F.col("template") >= 0) & (share >= MIN_COVER) & (density >= MIN_DENSITY), share)

    # the density bounds a run's words and so its diagonals
    most = F.greatest(F.ceil(F.col("length") / MIN_DENSITY).cast("int"), F.lit(1))
    best = F.transform("parts", lambda _, i: F.array_max(F.transform(
        F.sequence(F.lit(1), F.least(F.size("parts") - i, most)), lambda k: verified(F.slice("parts", i + 1, k)))))
    spans = merged.withColumn("share", F.array_max(best))
    out = spans.groupBy("row").agg(
        *[F.max(c).alias(c) for c in line], F.max("share").alias("share"),
        F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("added"))
    bits = len(PHRASES)
    base = F.filter(F.array(*[F.when(F.col("seen").bitwiseAND(1 << (bits - 1 - i)) > 0, label)
                              for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, "added"))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0))).alias("score"))
