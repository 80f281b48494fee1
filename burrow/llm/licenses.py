"""License scan by diagonal voting: rolling word k-gram hashes joined to template positions.

Every k-gram of a text that a template holds too gives a vote for the diagonal ``position - template position``.
Votes are aggregated by diagonal, diagonals that lie at most ``reach`` words apart are merged, and a merged span is
verified by the share of the template's words that its matches cover. Words are compared by the 64-bit hashes of
their k-grams alone, so that the join's rows stay narrow whatever a text's length. Templates are a parameter of bounded size and are broadcast only while their k-grams stay few.

Cases: null and empty texts have no words, no places and score 0; texts shorter than k words can hold base phrases
only; repeated rows are kept with equal results; texts are scanned whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose every place is reported, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Licence notices, label and text.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
)
#: Template k-grams up to which the template side is broadcast.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def grams(words: Column, k: int) -> Column:
    """The hash of each k-gram, in order."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]))


def places(words: Column, phrase: str) -> Column:
    """Starts of a phrase, from 0."""
    parts = phrase.split()
    ends = F.size(words) - len(parts)
    at = F.when(ends >= 0, F.sequence(F.lit(0), ends)).otherwise(F.array().cast("array<int>"))

    def stands(i: Column) -> Column:
        hit = F.element_at(words, i + len(parts)) == parts[-1]
        for j, part in enumerate(parts[:-1]):
            hit = hit & (F.element_at(words, i + j + 1) == part)
        return hit

    return F.filter(at, stands)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = 5, reach: int = 2, cover: float = 0.6) -> DataFrame:
    """``doc_id, n_words, base (array of (start, label)), found (array of (label, score, first, last))`` for each row."""
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(7), "text")
    tokens = docs.select("doc_id", key.alias("key"), words_of(F.col("text")).alias("words"))
    none = F.array().cast("array<struct<start:int,label:string>>")
    low = lower(F.coalesce("text", F.lit("")))
    hints = [F.contains(low, F.lit(p.split()[-1])) for p, _ in phrases]
    rows = docs.select("doc_id", key.alias("key"), words_of(F.col("text")).alias("words"), *[h.alias(f"hint{i}") for i, h in enumerate(hints)])
    spots = []
    for i, (phrase, label) in enumerate(phrases):
        named = F.lit(label).alias("label")
        hit = F.transform(places(F.col("words"), phrase), lambda s: F.struct(s.alias("start"), named))  # noqa: B023
        spots.append(F.when(F.col(f"hint{i}"), hit).otherwise(none))
    rows = rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.sort_array(F.concat(*spots)).alias("base"))

    given = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    given = given.select("template", "label", words_of(F.col("text")).alias("t_words"))
    sides = given.select("template", "label", "t_words", F.posexplode(grams(F.col("t_words"), k)).alias("t_pos", "gram"))
    sides = sides.select("template", "label", "t_pos", "gram", F.size("t_words").alias("t_size"))
    few = sum(len(text.split()) for _, text in templates) <= BROADCAST_ROWS
    rolled = tokens.select("doc_id", "key", F.posexplode(grams(F.col("words"), k)).alias("pos", "gram"))
    votes = rolled.join(F.broadcast(sides) if few else sides, "gram")
    votes = votes.select("doc_id", "key", "template", "label", "t_size", (F.col("pos") - F.col("t_pos")).alias("diagonal"), "pos", "t_pos")
    lines = votes.groupBy("doc_id", "key", "template", "label", "t_size", "diagonal").agg(
        F.collect_set("t_pos").alias("held"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    near = W.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    lines = lines.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(near) <= reach, 0).otherwise(1))
    lines = lines.withColumn("island", F.sum("new").over(near))
    spans = lines.groupBy("doc_id", "key", "template", "label", "t_size", "island").agg(
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("held", lambda p: F.sequence(p, p + (k - 1))))))
    spans = spans.withColumn("score", covered / F.col("t_size")).where(F.col("score") >= cover)
    span = F.struct("label", F.col("score"), F.col("first").alias("first"), (F.col("last") + (k - 1)).alias("last"))
    found = spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(span)).alias("found"))
    joined = rows.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.key") == F.col("f.key")), "left")
    return joined.select("r.doc_id", "n_words", "base", F.coalesce("found", F.array().cast("array<struct<label:string,score:double,first:int,last:int>>")).alias("found"))
