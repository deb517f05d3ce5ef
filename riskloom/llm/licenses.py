"""Licence scan by diagonal voting: runs of k words join template positions, and places that agree on an offset vote together.

Null and empty texts have no words and no labels; very long ones are read whole, run by run. Repeated rows give the same result each: votes are sets
of template positions, so that a row read twice counts once. Only named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases whose every place counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The wording of common notices, in words as this module reads them, with their labels.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "spdx license identifier apache 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "spdx license identifier mit": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUN = 2  # words of a run
DRIFT = 2  # words by which neighbouring diagonals may lie apart
SHORT = 10  # notices of fewer words need every word
SHARE = 0.8  # of the words of longer ones


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def template_runs(spark, base: dict[str, str], notices: dict[str, str], k: int) -> DataFrame:
    """One row per run of ``k`` words of a template (of all its words if it has fewer): the templates are a parameter, some hundred rows."""
    rows = []
    for exact, texts in ((True, base), (False, notices)):
        for text, label in texts.items():
            parts = text.split()
            n = min(k, len(parts))
            for place in range(len(parts) - n + 1):
                rows.append((text, label, exact, len(parts), place, parts[place : place + n]))
    schema = "template string, label string, exact boolean, size int, place int, run array<string>"
    return spark.createDataFrame(rows, schema).withColumn("hash", F.xxhash64("run"))


def spans(
    docs: DataFrame, text: str = "text", key: str = "doc_id", base=None, notices=None, share: float = SHARE, k: int = RUN
) -> DataFrame:
    """(doc_id, digest, template, label, exact, first, last, score): verified places of templates, words from 0, ``last`` exclusive.

    A run joins by hash and is verified by its words. Runs on one diagonal (word place minus
    template place) add the template's words they cover; a notice also takes those of diagonals up to two
    words later, for words put in or left out. A span holds if the words covered are all of a base phrase, on one
    diagonal, all of a notice of fewer than SHORT words, or ``share`` of a longer one, and if the span is no longer
    than the template and the drift.
    """
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    lengths = sorted({min(k, len(t.split())) for t in [*base, *notices]}) or [k]
    runs = template_runs(docs.sparkSession, base, notices, k)
    source = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"), words(F.col(text)).alias("w"))

    def of_length(n: int) -> DataFrame:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1)))
        grams = F.transform(starts, lambda i: F.slice("w", i, n))
        return source.select("doc_id", "digest", F.posexplode(grams).alias("at", "words"))

    rows = of_length(lengths[0])
    for n in lengths[1:]:
        rows = rows.unionByName(of_length(n))
    votes = rows.withColumn("hash", F.xxhash64("words")).join(F.broadcast(runs), "hash").where("words = run")
    covered = F.sequence("place", F.col("place") + F.size("run") - 1)
    votes = votes.select(
        "doc_id", "digest", "template", "label", "exact", "size", (F.col("at") - F.col("place")).alias("diagonal"), "at", covered.alias("covered"), F.size("run").alias("n")
    )
    same = ["doc_id", "digest", "template", "label", "exact", "size"]
    # A notice's vote counts on its own diagonal and on the neighbours that may merge with it.
    near = F.when(F.col("exact"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(-DRIFT), F.lit(0)))
    merged = (
        votes.withColumn("step", F.explode(near))
        .withColumn("diagonal", F.col("diagonal") + F.col("step"))
        .groupBy(*same, "diagonal")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("kept"),
            F.min("at").alias("first"),
            F.max(F.col("at") + F.col("n")).alias("last"),
            F.max(F.col("step") == 0).alias("own"),
        )
    )
    score = F.col("kept") / F.col("size")
    needed = F.when(F.col("exact") | (F.col("size") < SHORT), F.col("size")).otherwise(F.ceil(F.col("size") * share))
    found = merged.where("own").withColumn("score", score)
    found = found.where((F.col("kept") >= needed) & (F.col("last") - F.col("first") <= F.col("size") + DRIFT))
    return found.select(*same[:5], "first", "last", "score")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", base=None, notices=None, share: float = SHARE, k: int = RUN) -> DataFrame:
    """One row per document: word count, places of base phrases, labels and the best score."""
    found = spans(docs, text, key, base, notices, share, k)
    per = found.groupBy(F.col("doc_id").alias("k"), F.col("digest").alias("d")).agg(
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
        F.size(words(F.col(text))).cast("long").alias("n_words"),
    )
    joined = rows.join(per, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
