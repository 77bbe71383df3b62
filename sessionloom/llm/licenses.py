"""License scans by diagonal voting, in DataFrame expressions alone.

All rolling word k-grams of all texts are hashed and joined to the places where the templates have the same k-gram. A
hit at word p of a text and place t of a template votes for the diagonal p - t: a template that stands in the text
whole puts all its votes on one diagonal, one with words added or left out on neighbouring ones. Votes are counted by
diagonal, neighbouring diagonals are merged, and a span stays if enough of the template's distinct places voted.
The join compares the k-grams themselves beside their hashes, so a vote is never a collision.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import written

#: Words of a k-gram: as many as the shortest phrase has.
K = 2
#: Diagonals this far apart are neighbours: words added or left out within a template.
SLACK = 3
#: Part of a template's k-grams that must vote.
COVER = 0.6
#: A word: letters and digits of ASCII, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands for a document among its k-grams; no word has its first character.
DOCUMENT = "\x01document"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
# Notices of public licenses, with labels of their own.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution License"),
    ("gpl-work", "This work is licensed under the GNU General Public License"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-release", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False  # a phrase: one diagonal with every vote


TEMPLATES = tuple(Template(label, text, True) for label, text in PHRASES) + tuple(Template(*n) for n in NOTICES)


def template_words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def template_grams(templates: tuple[Template, ...], k: int = K) -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, exact, grams, place, gram) of each k-gram; every template must have k words or more."""
    out = []
    for n, t in enumerate(templates):
        w = template_words(t.text)
        if len(w) < k:
            raise ValueError(f"a template of fewer than {k} words: {t.text!r}")
        out += [(n, t.label, t.exact, len(w) - k + 1, i, " ".join(w[i : i + k])) for i in range(len(w) - k + 1)]
    return out


def word_array(text: Column) -> Column:
    """The words of a text in their own case; words are the same with A-Z lower-cased."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def text_key(text: Column) -> Column:
    """With the id, tells the rows of repeated ids apart; rows equal in both have equal results."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def voted(docs: DataFrame, templates: tuple[Template, ...], k: int) -> DataFrame:
    """Votes by document and diagonal, written: doc_id, text_key, n_words, template, label, exact, grams, diagonal, votes (places), copies.

    Each document also has a row of its own (template -1), so its words are parted once: copies says how many rows of the
    table it stands for.
    """
    rows = [*template_grams(templates, k), (-1, "", False, 0, -1, DOCUMENT)]
    places = docs.sparkSession.createDataFrame(rows, "template int, label string, exact boolean, grams int, place int, gram_of string")
    places = F.broadcast(places.withColumn("h", F.xxhash64(F.lower("gram_of"))))  # as many rows as the templates have words
    w = F.col("w")
    many = F.greatest(F.size(w) - (k - 1), F.lit(0))
    gram = F.slice(w, 1, many)
    for j in range(1, k):
        gram = F.zip_with(gram, F.slice(w, j + 1, many), lambda x, y: F.concat_ws(" ", x, y))
    worded = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), word_array(F.col("text")).alias("w"))
    # nothing that is read from the words may stand beside the explode: each of its rows would carry all words of the text
    listed = worded.select("doc_id", "text_key", F.size("w").alias("n_words"), F.concat(F.array(F.lit(DOCUMENT)), gram).alias("grams"))
    # outer, though no list is empty: else Spark tests the list's size below, and parts the words of each text again for that
    grams = listed.select("doc_id", "text_key", "n_words", F.posexplode_outer("grams").alias("pos", "gram"))
    # between, not equality: that would become a key of the join, taken of every k-gram and not only of those whose hash meets one
    same = F.translate("gram", UPPER, LOWER).between(F.col("gram_of"), F.col("gram_of"))
    hits = grams.join(places, (F.xxhash64(F.lower("gram")) == F.col("h")) & same)
    by = hits.groupBy("doc_id", "text_key", "n_words", "template", "label", "exact", "grams", (F.col("pos") - 1 - F.col("place")).alias("diagonal"))
    return written(by.agg(F.collect_set("place").alias("votes"), F.count("*").alias("copies")))  # votes: no more than the template has places


def merged_spans(diagonals: DataFrame, k: int = K, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    whole = diagonals.where("exact and size(votes) = grams").select("doc_id", "text_key", "label", "exact", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("grams") + (k - 1)).alias("end"), F.lit(1.0).alias("coverage"))
    near = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    merged = diagonals.where("not exact and template >= 0").withColumn("coverage", F.size(F.array_distinct(F.flatten(F.collect_list("votes").over(near)))) / F.col("grams"))
    merged = merged.withColumn("start", F.min(F.col("diagonal") + F.array_min("votes")).over(near)).withColumn("end", F.max(F.col("diagonal") + F.array_max("votes") + k).over(near))
    own = F.struct(F.size("votes").alias("n"), (-F.col("diagonal")).alias("d"))
    peaks = merged.withColumn("own", own).withColumn("best", F.max("own").over(near)).where((F.col("coverage") >= cover) & (F.col("own") == F.col("best")))
    spans = peaks.select("doc_id", "text_key", "label", "exact", "start", "end", "coverage")
    return whole.unionByName(spans)


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = K, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """Per span: doc_id, text_key, label, exact, start and end (words from 0, end exclusive), coverage (0 to 1).

    A phrase (exact) gives a span wherever its words stand one after another. A notice gives one for each diagonal that,
    merged with its neighbours, has votes from at least `cover` of the notice's places and more than any neighbour (the
    first of equal ones). Null and empty texts give none; repeated rows give their spans once.
    """
    return merged_spans(voted(docs, templates, k), k, slack, cover)


def licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best coverage, 0
    without a span). Repeated rows give a row each, with the same values; a null id is an id like any other; null and
    empty texts have no words and no labels; other columns are ignored; an empty table gives an empty result."""
    diagonals = voted(docs, templates, K)
    spans = merged_spans(diagonals)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy(F.col("doc_id").alias("of"), F.col("text_key").alias("key")).agg(
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start"))).alias("last_word"),
        joined(F.when(F.col("exact"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    own = diagonals.where("template = -1")
    all_ = own.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
    return all_.join(found, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def licenses_sql(templates: tuple[Template, ...] = TEMPLATES, k: int = K, slack: int = SLACK, cover: float = COVER) -> str:
    """DuckDB SQL for licenses() over the table documents, whose ids must not repeat."""
    values = ",\n  ".join(f"({n}, '{label}', {str(exact).lower()}, {grams}, {place}, '{gram}')" for n, label, exact, grams, place, gram in template_grams(templates, k))
    tail = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH places(template, label, exact, grams, place, gram) AS (VALUES
  {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, {tail} AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d)),
diagonals AS (
  SELECT doc_id, template, label, exact, grams, pos - place AS diagonal, list(DISTINCT place) AS votes
  FROM g JOIN places USING (gram) GROUP BY ALL),
merged AS (
  SELECT *, len(list_distinct(flatten(list(votes) OVER near))) / grams AS coverage,
    max(len(votes) * 10000000 - diagonal) OVER near AS best
  FROM diagonals WHERE NOT exact
  WINDOW near AS (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN {slack} PRECEDING AND {slack} FOLLOWING)),
spans AS (
  SELECT doc_id, label, true AS exact, diagonal AS start, 1.0::DOUBLE AS coverage FROM diagonals WHERE exact AND len(votes) = grams
  UNION ALL
  SELECT doc_id, label, false, 0, coverage FROM merged WHERE coverage >= {cover} AND len(votes) * 10000000 - diagonal = best),
found AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(coverage) AS score
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id)"""
