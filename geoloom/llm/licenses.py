"""License and copyright notices by diagonal voting.

Every rolling word 2-gram of a text is joined by its XXH64 to the positions of
the templates' 2-grams (the words are compared too, so a match is exact). A
match votes for the diagonal text position minus template position. Votes are
gathered for each text, template and diagonal; neighbouring diagonals, which an
inserted or a missing word makes, are merged in bands of a bounded width; a
band is verified by the share of the template's 2-grams that it holds, each
counted once. As a band is narrow, what it holds stands in as many words as the
template has, and slack more. A base phrase needs all its 2-grams on one
diagonal, so its places are counted exactly.

Only DataFrame functions are used. The templates are a parameter of a few
dozen positions, which is the bound of what is broadcast; of the 2-grams only
those that match reach a shuffle, added up for each task before.

Defined cases: null texts count as empty; every row of the table has a row in
the result, repeated rows equal ones, and two texts under one doc_id, or under
none, each its own (a row is told by two hashes of doc_id and text); an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Phrases whose every place counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices found approximately, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution license": "cc-by-notice",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_grams(spark, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    rows = []
    for number, (phrase, label, exact) in enumerate([(p, x, True) for p, x in base.items()] + [(p, x, False) for p, x in notices.items()]):
        words = phrase.split()
        rows += [(number, label, exact, len(words), i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    grams = spark.createDataFrame(rows, "template int, label string, exact boolean, size int, at int, t1 string, t2 string")
    return F.broadcast(grams.withColumn("hash", F.xxhash64("t1", "t2")))


def scanned(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, share: float = 0.8, slack: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A notice counts if share of its distinct 2-grams are found on diagonals of a
    band, which has slack at most between its first and its last. score is the
    highest share of any template.
    """
    text = F.coalesce("text", F.lit(""))
    # Of all letters beyond A-Z, lower() turns the Kelvin sign alone into one of them.
    words = F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138"))), SEPARATORS), "")
    # xxhash64() passes over nulls, so an id that may be null goes with a flag.
    known = [F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id")]
    row = [F.xxhash64(*known, text).alias("h1"), F.xxhash64(text, *known).alias("h2")]
    texts = docs.select(*row, words.alias("words"))
    grams = texts.select("h1", "h2", "words", F.posexplode(F.expr("slice(words, 1, greatest(size(words) - 1, 0))")).alias("pos", "w1"))
    grams = grams.select("h1", "h2", "pos", "w1", F.get("words", F.col("pos") + 1).alias("w2"))
    grams = grams.withColumn("hash", F.xxhash64("w1", "w2"))
    found = grams.join(template_grams(docs.sparkSession, base, notices), "hash").filter("w1 = t1 and w2 = t2")
    votes = found.withColumn("diagonal", (F.col("pos") - F.col("at")).cast("long")).groupBy("h1", "h2", "template", "diagonal", "label", "exact", "size").agg(F.collect_set("at").alias("ats"))
    votes = written(votes, "license-votes")

    nothing = F.lit(None)
    places = votes.filter("exact and size(ats) = size - 1").select("h1", "h2", F.col("diagonal").alias("place"), "label", nothing.cast("string").alias("notice"), nothing.cast("double").alias("covered"))
    band = Window.partitionBy("h1", "h2", "template").orderBy("diagonal").rangeBetween(0, slack)
    held = F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(band))))
    spans = votes.filter("not exact").withColumn("covered", held / (F.col("size") - 1))
    spans = spans.select("h1", "h2", nothing.cast("long").alias("place"), nothing.cast("string").alias("label"), F.when(F.col("covered") >= share, F.col("label")).alias("notice"), "covered")
    hits = places.unionByName(spans).groupBy("h1", "h2")
    hits = hits.agg(
        F.count("place").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"), F.collect_set("label").alias("base_set"), F.collect_set("notice").alias("notice_set"), F.max("covered").alias("covered")
    )

    rows = docs.select("doc_id", *row, F.size(words).cast("long").alias("n_words"))
    out = rows.join(hits, ["h1", "h2"], "left")
    none = F.array().cast("array<string>")
    base_set, notice_set = F.coalesce("base_set", none), F.coalesce("notice_set", none)
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        joined(base_set).alias("base_labels"),
        joined(F.array_union(base_set, notice_set)).alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("covered", F.lit(0.0))).alias("score"),
    )
