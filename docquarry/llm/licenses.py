"""License scans by a positional rare-token index (DataFrame functions only).

The index holds, for every licence template, its words of highest inverse document frequency over
the whole corpus, with their positions.  A file's occurrences of such words are joined to it; hits
that agree on where the template would begin are added up, and a template that is covered well
enough there must have its mandatory key phrases in that window.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, with_words

# --- fixed values: the base phrases and their labels
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# --- fixed values: licence notices (label, notice, mandatory key phrases)
TEMPLATES = (
    ("mit", "released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ("permission is hereby granted", "without restriction")),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2")),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("general public license", "version 3")),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", ("general public license", "version 2")),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3", ("lesser general public license", "version 3")),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3", ("affero general public license", "version 3")),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", ("mozilla public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "hereby granted")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution", "international license")),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License", ("attribution sharealike",)),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License", ("attribution noncommercial",)),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0", "universal")),
)
#: Words of a template that the index holds at most, and how rare (as a share of its rarest word's
#: inverse document frequency) they must be, which keeps everyday words out of it; share of their weight that must agree on a place; words
#: by which a place may be off (what an edited notice inserts or lacks).
RARE_WORDS, RARITY, COVERAGE, DRIFT = 6, 0.5, 0.7, 4


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and in how many of them each licence word is: one row per licence word comes back."""
    some = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    seen = docs.select(F.explode(F.array_union(some, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    df = {r["word"]: r["count"] for r in seen}
    return df.pop("", 0), df


def starts(words: Column, norm: Column, phrase: str) -> Column:
    """Positions at which the phrase's words stand one after the other."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        at = F.get(words, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            at = at & (F.get(words, i + k) == w)
        return at

    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return F.when((F.size(words) >= len(parts)) & norm.contains(phrase), places).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``labels`` are the base labels and those of the templates found, sorted, joined by commas; an
    empty string where there are none.  ``score`` is 1 where a base phrase stands, else the best
    share of a found template's index weight that agreed on a place (0 without one).  A null or
    empty text has no words.  Rows that repeat an id get the labels of all of them; rows without an
    id get base labels only.
    """
    texts = with_words(docs.select("doc_id", "text")).select("doc_id", "words", "norm")
    templates = [(label, tokens(notice), phrases) for label, notice, phrases in TEMPLATES]
    total, df = document_frequencies(texts, sorted({w for _, t, _ in templates for w in t}))
    import math

    idf = lambda w: math.log((1 + total) / (1 + df.get(w, 0))) + 1e-3
    postings = []
    for k, (_, t, _) in enumerate(templates):
        rare = sorted(set(t), key=lambda w: (-idf(w), t.index(w)))[:RARE_WORDS]
        rare = [w for w in rare if idf(w) >= RARITY * idf(rare[0])]
        weight = sum(idf(w) for w in rare)
        postings += [(w, k, at, idf(w) / weight) for w in rare for at, x in enumerate(t) if x == w]
    spark = docs.sparkSession
    index = spark.createDataFrame(postings, "word string, template int, at int, weight double")  # RARE_WORDS a template, and repeats
    notices = spark.createDataFrame([(k, label, len(t), list(p)) for k, (label, t, p) in enumerate(templates)], "template int, label string, size int, phrases array<string>")
    index = F.broadcast(index.join(notices.select("template", "size"), "template"))

    base = {phrase: starts(F.col("words"), F.col("norm"), phrase) for phrase in BASE_PHRASES}
    found = F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(BASE_PHRASES.values())))
    rows = texts.select("doc_id", F.size("words").cast("long").alias("n_words"), *(p.alias(f"p{k}") for k, p in enumerate(base.values())))
    places = F.concat(*(F.col(f"p{k}") for k in range(len(base))))
    rows = rows.select("doc_id", "n_words", places.alias("places"), F.array_sort(F.array_distinct(F.array_compact(found))).alias("base"))

    rare = sorted({w for w, *_ in postings})
    marked = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(rare))
    spots = texts.where("doc_id IS NOT NULL").select("doc_id", "words", F.when(F.size("words") > 0, marked).alias("spots")).select("doc_id", "words", F.explode_outer("spots").alias("pos"))
    spots = spots.select("doc_id", "words", "pos", F.get("words", F.col("pos")).alias("word"))
    begins = F.floor((F.col("pos") - F.col("at")) / DRIFT).cast("int")
    # a place belongs to its own stretch and the one before, so that places DRIFT apart share one
    hits = spots.join(index, "word").select(
        "doc_id", "template", "word", "weight", F.explode(F.array(begins - 1, begins)).alias("stretch"), "words", "size"
    )
    window = F.array_join(F.slice("words", F.greatest(F.col("stretch") * DRIFT + 1, F.lit(1)), F.col("size") + 2 * DRIFT), " ")
    agreed = hits.select("doc_id", "template", "word", "weight", "stretch", window.alias("window")).groupBy("doc_id", "template", "stretch", "word").agg(F.max("weight").alias("weight"), F.min("window").alias("window"))
    agreed = agreed.groupBy("doc_id", "template", "stretch").agg(F.least(F.sum("weight"), F.lit(1.0)).alias("share"), F.min("window").alias("window")).where(F.col("share") >= COVERAGE)
    whole = F.forall("phrases", lambda p: F.concat(F.lit(" "), "window", F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" "))))
    named = cut(agreed.join(F.broadcast(notices), "template").where(whole).groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("label").alias("more"), F.max("share").alias("share")))
    none = F.array().cast("array<string>")
    return rows.join(named, rows["doc_id"] == named["id"], "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.round("share", 9), F.lit(0.0))).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
