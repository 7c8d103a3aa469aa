"""License scan by diagonal voting, in DataFrame functions only.

All rolling word k-grams of every text are joined with the places of the same k-grams in license
templates. Matches of one template on one offset diagonal (place in text minus place in template) vote
together, diagonals that lie next to each other (a word put in or left out) are merged, and a merged
span counts if its k-grams, compared word by word, cover enough of the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: ASCII but 0-9 and a-z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, with their labels.
PHRASES = ((("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved"))

#: Label and wording of the notices that are looked for.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
GRAM = 3
#: Diagonals at most so far apart are merged.
SLACK = 3
#: Share of a template's words that a span's k-grams have to cover.
LEAST_COVER = 0.7


def license_words(text: Column) -> Column:
    """Runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS)
    return F.array_remove(parts, "")


def grams(words: Column, k: int = GRAM) -> Column:
    """The hashes of all runs of k words."""
    n = F.size(words) - (k - 1)
    hashed = F.transform(F.slice(words, 1, F.greatest(n, F.lit(1))), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.when(n >= 1, hashed).otherwise(F.array().cast("array<bigint>"))


def template_places(spark: SparkSession, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """One row per place of a k-gram in a template; their number is that of the templates' words."""
    t = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, template_text string")
    t = t.select("template", "label", license_words(F.col("template_text")).alias("t_words"))
    t = t.select("template", "label", "t_words", F.size("t_words").alias("t_len"), F.posexplode_outer(grams(F.col("t_words"), k)).alias("t_pos", "gram")).where("gram is not null")
    return t.select("gram", "template", "label", "t_len", "t_pos", *[F.get("t_words", F.col("t_pos") + j).alias(f"t_w{j}") for j in range(k)])


def base_places(words: Column) -> dict[str, Column]:
    """Places (word numbers) of each base phrase."""

    def at(phrase):
        rest = lambda w, i: (w == phrase[0]) & _all([F.get(words, i + j) == p for j, p in enumerate(phrase) if j])
        hits = F.filter(F.transform(words, lambda w, i: F.when(F.coalesce(rest(w, i), F.lit(False)), i)), lambda x: x.isNotNull())
        return F.when(F.array_contains(words, phrase[0]) & F.array_contains(words, phrase[-1]), hits).otherwise(F.array().cast("array<int>"))

    return {label: at(phrase) for phrase, label in PHRASES}


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def spans(docs: DataFrame, templates=TEMPLATES, k: int = GRAM, slack: int = SLACK, least_cover: float = LEAST_COVER) -> DataFrame:
    """Verified spans: doc_id, text_hash, label, template, first_word, last_word, score (share of the template's words covered).

    Rows of the same doc_id and text give the same spans once.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), license_words(F.col("text")).alias("words"))
    d = d.select("doc_id", "text_hash", "words", F.posexplode_outer(grams(F.col("words"), k)).alias("pos", "d_gram"))
    places = F.broadcast(template_places(spark, templates, k))  # as many rows as the templates have words
    hit = d.join(places, F.col("d_gram") == F.col("gram")).where(_all([F.get("words", F.col("pos") + j) == F.col(f"t_w{j}") for j in range(k)]))
    # votes on each diagonal; a template has a bounded number of places, so the sets stay small
    key = ["doc_id", "text_hash", "template", "label", "t_len"]
    by_diagonal = hit.groupBy(*key, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("places"))
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int"), F.lit(1))
    merged = by_diagonal.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order)).groupBy(*key, "span").agg(
        F.array_distinct(F.flatten(F.collect_list(F.transform("places", lambda p: p)))).alias("places"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("places") + (k - 1)).alias("last_word"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1))))))
    return merged.withColumn("score", covered / F.col("t_len")).where(F.col("score") >= least_cover).select("doc_id", "text_hash", "label", "template", "first_word", "last_word", "score")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 where a base phrase stands, else the best span's. No label: an empty string, score 0. Null
    text: no words. Null doc_id: joined as a value of its own. Repeated rows: one result each.
    """
    d = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), license_words(F.col("text")).alias("words"))
    at = base_places(F.col("words"))
    d = d.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), *[c.alias(f"at_{i}") for i, c in enumerate(at.values())])
    every = F.concat(*[F.col(f"at_{i}") for i in range(len(at))])
    found = F.array_compact(F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, label in enumerate(at)]))
    d = d.select("doc_id", "text_hash", "n_words", every.alias("every"), found.alias("found"))
    d = d.select("doc_id", "text_hash", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"), "found")
    best = spans(docs, templates).groupBy(F.col("doc_id").alias("doc_id_"), F.col("text_hash").alias("text_hash_")).agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    d = d.join(best, (F.col("text_hash") == F.col("text_hash_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")), "left")
    every_label = F.sort_array(F.array_union("found", F.coalesce("more", F.array().cast("array<string>"))))
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("found"), ",").alias("base_labels"),
        F.array_join(every_label, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
