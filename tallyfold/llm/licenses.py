"""License scans by diagonal voting.

Every rolling k-gram of a document's words that a template also holds becomes a hit.  Hits join the
template positions; a hit at document word p of template word q votes for the diagonal p - q.
Neighbouring diagonals (a word more or less in between) are merged into spans, and a span counts if its
votes cover enough of the template without stretching.  Short base phrases must be complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import lower_ascii, staged

#: Words of an n-gram; base phrases have two words at least.
K = 2
#: Diagonals this near are one span; share of a template's k-grams to be seen; longest span in template lengths.
NEAR, SHARE, STRETCH = 3, 0.6, 1.5
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Customary notices of public licences and their labels.
NOTICES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: Column) -> Column:
    """Lower-cased words of the whole text (null: none)."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def template_grams(spark: SparkSession, base: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    """template, label, base, grams (how many), q, a, b: every k-gram of every template with its position."""
    rows = [(n, label, is_base, text) for n, (label, text, is_base) in enumerate([(v, k, True) for k, v in base.items()] + [(v, k, False) for v, k in notices])]
    told = spark.createDataFrame(rows, "template int, label string, base boolean, text string").withColumn("words", words_of(F.col("text")))
    grams = told.select("template", "label", "base", (F.size("words") - 1).alias("grams"), "words", F.posexplode(F.slice("words", 1, F.size("words") - 1)).alias("q", "a"))
    return grams.select("template", "label", "base", "grams", "q", "a", F.expr("words[q + 1]").alias("b"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two tables: a row for every row of `docs`, and a row for every verified span.

    Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest
    share of a template that a span covers, 0 if none).  Spans: id, label, base, first_word, last_word,
    share.  Null texts have no words; rows that repeat id and text give equal rows; rows with null ids
    are scanned like any other; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    templates = template_grams(spark, base or BASE, NOTICES if notices is None else notices)
    # a fixed list in this module or the caller's argument: small enough for the plan
    grams = sorted({r[0] for r in templates.select(F.xxhash64("a", "b")).collect()})

    def hit(word: Column, at: Column) -> Column:
        after = F.get("words", at + 1)
        return F.when(F.xxhash64(word, after).isin(grams), F.struct(at.alias("p"), word.alias("a"), after.alias("b")))

    text = F.col(text_col)
    worded = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), words_of(text).alias("words"))
    hits = worded.select("id", "key", F.size("words").cast("long").alias("n_words"), F.filter(F.transform("words", hit), lambda x: x.isNotNull()).alias("hits"))
    scanned = staged(hits, "license-hits")

    votes = (
        scanned.select("id", "key", F.explode("hits").alias("h"))
        .select("id", "key", "h.*")
        .join(F.broadcast(templates), ["a", "b"])
        .groupBy("id", "key", "template", "label", "base", "grams", (F.col("p") - F.col("q")).alias("diagonal"))
        .agg(F.collect_set("q").alias("seen"))
    )
    order = W.Window.partitionBy("id", "key", "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR)
    chained = votes.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    spans = (
        chained.groupBy("id", "key", "template", "label", "base", "grams", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n_seen"),
            F.min(F.col("diagonal") + F.array_min("seen")).cast("long").alias("first_word"),
            F.max(F.col("diagonal") + F.array_max("seen") + 1).cast("long").alias("last_word"),
        )
        .withColumn("share", F.col("n_seen") / F.col("grams"))
        .withColumn("length", F.col("last_word") - F.col("first_word") + 1)
        .where((F.col("n_seen") == F.col("grams")) | (~F.col("base") & (F.col("share") >= SHARE) & (F.col("length") <= STRETCH * (F.col("grams") + 1))))
    )
    found = staged(spans.select("id", "key", "label", "base", "first_word", "last_word", "share"), "license-spans")
    is_base = F.col("base")
    of = found.groupBy("id", "key").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(is_base, F.col("first_word"))).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(is_base, F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"),
        F.max("share").alias("score"),
    )
    left, right = scanned.select("id", "key", "n_words").alias("d"), of.withColumnsRenamed({"id": "of_id", "key": "of_key"})
    joined = left.join(right, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left")
    per_doc = joined.select(
        "id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return per_doc, found.drop("key")
