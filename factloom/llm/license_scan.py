"""License scans by diagonal voting, in DataFrame functions only.

Every word k-gram of every text is hashed and joined to the positions of the same k-gram in the license templates
(a fixed list of phrases, so that side is broadcast). A hit's diagonal is its place in the text less its place in the
template; hits are counted on each diagonal. A diagonal that holds all k-grams of a template is a whole occurrence.
For the longer templates neighbouring diagonals are merged where one begins after the end of the one before, both in the text and in the
template, so that a few inserted or missing words do not matter but words in another order do, and the covered share of the template's k-grams is the span's score. Such a span counts only if it holds, in place and without a gap, all
words of the template that name the license and its version (or, in a text that has no name, its distinctive words); the
boilerplate that licenses share is not enough.

Each hit is verified word by word in the join condition, so a hash collision counts for nothing. Besides the hits, one
marker row for each text passes the join, so that texts without a hit keep their row. One shuffle by row follows; it
carries the hits and markers, no text.

Null and empty texts have no words: n_words and n_base 0, first_word and last_word null, labels empty, score 0. Repeated
rows are counted separately (rows are told apart by their place in the input, not by doc_id, which may be null). An
empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

K = 3
#: (label, phrase); the labels that the contract fixes.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: (label, phrase, the words of it, K at least, that name the license) that the method adds.
MORE = [
    ("mit", "released under the terms of the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "attribution sharealike 4 0"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced", "all rights reserved no part of this publication"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _templates(spark, base, more) -> DataFrame:
    """template, label, is_base, grams, tpos, bit (of tpos), naming (how many k-grams the name has, if this is one of them, else 0) and the k words of each k-gram.

    Template -1 is the marker.
    """
    rows = [(-1, "", False, 1, -1, 1, 0, "", "", "")]
    for i, (label, phrase, name) in enumerate([*((label, phrase, phrase) for label, phrase in base), *more]):
        words, named = phrase.split(" "), name.split(" ")
        n, m = len(words) - K + 1, len(named) - K + 1
        if n > 62:
            raise ValueError("a template has at most 64 words: its k-grams are the bits of a long")
        at = next(p for p in range(n) if m > 0 and words[p : p + len(named)] == named)
        rows += [(i, label, i < len(base), n, p, 1 << p, m if at <= p < at + m else 0, *words[p : p + K]) for p in range(n)]
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, grams int, tpos int, bit long, naming int, t0 string, t1 string, t2 string").withColumn(
        "gram", F.when(F.col("template") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("t0", "t1", "t2"))
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base=BASE, more=MORE, least: float = 0.6, near: int = 3) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    labels, score and spans tell of verified spans only.
    least: share of a longer template's k-grams that a span must hold; near: how far apart merged diagonals may be.
    spans: the (label, first word, last word, share) found, at most a few for each template's occurrence.
    """
    spark = docs.sparkSession
    words, at = F.col("words"), F.col("at")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    last = F.greatest(F.size(words) - K, F.lit(-1))
    grams = rows.select("row", "doc_id", "words", F.explode(F.sequence(F.lit(-1), last)).alias("at")).select(
        "row", "doc_id", F.size(words).alias("size"), "at",
        *[F.get(words, at + i).alias(f"w{i}") for i in range(K)],
    )
    grams = grams.withColumn("gram", F.when(at < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("w0", "w1", "w2")))
    same = ((at < 0) & (F.col("template") < 0)) | ((at >= 0) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")))
    hits = grams.join(F.broadcast(_templates(spark, base, more)), "gram").where(same)  # the templates are a fixed list
    hits = hits.select("row", "doc_id", "size", "template", "label", "is_base", "grams", "naming", "bit", "at", (at - F.col("tpos")).alias("diagonal")).repartition("row")
    diagonals = hits.groupBy("row", "template", "diagonal").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("label").alias("label"), F.first("is_base").alias("is_base"),
        F.first("grams").alias("grams"), F.bit_or("bit").alias("held"), F.min("at").alias("low"), F.max("at").alias("high"),
        (F.count(F.when(F.col("naming") > 0, 1)) == F.max("naming")).alias("named"), (F.max("naming") > 0).alias("names"),
    )
    order = W.partitionBy("row", "template").orderBy("low", "diagonal")
    before = lambda c: F.lag(c).over(order)
    diagonal, low, high = F.col("diagonal"), F.col("low"), F.col("high")
    # a run goes on only while places rise in the text and in the template too, so it holds no more diagonals than the template has k-grams
    goes_on = (F.abs(diagonal - before(diagonal)) <= near) & (low > before(high)) & (low - diagonal > before(high - diagonal))
    merged = diagonals.withColumn("run", F.sum(F.when(F.col("is_base") | ~F.coalesce(goes_on, F.lit(False)), 1).otherwise(0)).over(order))
    found = merged.groupBy("row", "template", "run").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("label").alias("label"), F.first("is_base").alias("is_base"),
        F.min("diagonal").alias("start"), F.min("low").alias("low"), (F.max("high") + K - 1).alias("high"),
        (F.bit_count(F.bit_or("held")) / F.first("grams")).alias("share"),  # different k-grams of the template, however often they come
        F.bool_or(F.col("named") & F.col("names")).alias("named"),
    )
    whole = F.col("is_base") & (F.col("share") == 1)
    good = whole | (~F.col("is_base") & (F.col("share") >= least) & F.col("named"))
    real = F.col("template") >= 0
    label = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when & real, F.col("label")))), ",")
    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("size").cast("long").alias("n_words"),
        F.count(F.when(whole & real, 1)).alias("n_base"),
        F.min(F.when(whole & real, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(whole & real, F.col("start"))).cast("long").alias("last_word"),
        label(whole).alias("base_labels"),
        label(good).alias("labels"),
        F.coalesce(F.max(F.when(real & good, F.col("share"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(good & real, F.struct("low", "high", "label", "share")))).alias("spans"),
    ).drop("row")
