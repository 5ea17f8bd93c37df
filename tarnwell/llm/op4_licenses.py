"""Licence scan by a positional rare-token index, with DataFrame functions only.

The templates' words get inverse document frequencies from all documents. Each template is looked up by its `RARE`
words of highest frequency weight, words that no document has left out: their places in a file, less their places in
the template, give possible starts; a start's score is the weight of the rare words found there, `SLACK` words aside,
over the weight of all. A template labels a file if its best start reaches `REACH` and the file holds the template's
key phrases. Fixed phrases label a file wherever they stand. Only files with one of the `KEYS` are looked at closely; as every key phrase and fixed phrase
has one of them inside a word, the others, whose words are just counted, cannot get a label.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows give equal rows; null doc_ids
are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm._common import let, table

NAME = "op4_licenses"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
RARE = 6
REACH = 0.6
SLACK = 2
KEYS = ["licen", "reserved", "cc", "warrant", "redistribut", "permission", "creative", "bsd"]
#: label, words of the notice, key phrases
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ["permission is hereby granted"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "released under the terms of the mit license", ["mit license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["in compliance with the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "licensed under the bsd 3 clause license", ["bsd 3 clause"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["general public license"]),
    ("lgpl", "this library is free software under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "to the extent possible under law the author has waived all copyright under cc0 1 0", ["cc0 1 0"]),
    ("as-is", "the software is provided as is without warranty of any kind express or implied", ["without warranty of any kind"]),
    ("reserved", "copyright c all rights reserved no part may be reproduced without permission", ["all rights reserved"]),
]
_FOUND = "array<struct<label:string,score:double>>"
VOCABULARY = sorted({w for _, words, _ in TEMPLATES for w in words.split()})


def words(low: Column) -> Column:
    return F.filter(F.split(low, BETWEEN), lambda x: x != "")


def lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gated(low: Column) -> Column:
    out = F.lit(False)
    for k in KEYS:
        out = out | low.contains(k)
    return out


def frequencies(docs: DataFrame) -> dict[str, float]:
    """Weight ln((n + 1) / (documents with the word + 1)) of each template word that some document has, over all
    documents; at most len(VOCABULARY) + 1 rows reach the driver."""
    low = docs.select(lower(F.col("text")).alias("low"))
    held = F.array_intersect(F.split(F.col("low"), BETWEEN), F.array(*map(F.lit, VOCABULARY)))
    found = low.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w"))  # the empty word counts the documents
    counts = {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = counts.pop("", 0)
    return {w: math.log((n + 1) / (c + 1)) + 0.01 for w, c in counts.items()}


def _places(w: Column, phrase: str) -> Column:
    """Where the phrase's words start, from 0."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(w, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out & (F.get(w, i + k) == p)
        return out

    return F.when(F.size(w) >= len(parts), F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - len(parts), F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def template_score(hits: Column, rare: list[tuple[str, int, float]]) -> Column:
    """Best share of the rare words' weight at one start; hits: array of (i, x), rare: (word, place, weight)."""
    total = sum(x for *_, x in rare)

    def start(h: Column) -> Column:
        out = F.lit(None).cast("int")
        for word, at, _ in rare:
            out = F.when(h["x"] == word, h["i"] - at).otherwise(out)
        return out

    def found(s: Column, word: str, at: int) -> Column:
        return F.exists(hits, lambda h: (h["x"] == word) & (F.abs(h["i"] - s - at) <= SLACK))

    def score(s: Column) -> Column:
        out = F.lit(0.0)
        for word, at, weight in rare:
            out = out + F.when(found(s, word, at), weight).otherwise(0.0)
        return out / total

    starts = F.array_distinct(F.filter(F.transform(hits, start), lambda s: s.isNotNull()))
    return F.coalesce(F.array_max(F.transform(starts, score)), F.lit(0.0))


def scan(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row for each row of docs."""
    rare = []
    for label, notice, phrases in TEMPLATES:
        tokens = notice.split()
        first = {w: tokens.index(w) for w in dict.fromkeys(tokens)}
        best = sorted(first.keys() & weights.keys(), key=lambda w: (-weights[w], w))[:RARE]
        if best:  # a template whose words no document has needs no look-up
            rare.append((label, [(w, first[w], weights[w]) for w in best], phrases))
    looked = sorted({w for _, r, _ in rare for w, *_ in r})

    def close(w: Column) -> Column:
        placed = F.filter(F.transform(w, lambda x, i: F.when(x.isin(looked), F.struct(i.alias("i"), x.alias("x")))), lambda h: h.isNotNull())
        body = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))

        def judge(hits: Column, text: Column) -> Column:
            out = []
            for label, r, phrases in rare:
                keyed = F.lit(True)
                for p in phrases:
                    keyed = keyed & text.contains(f" {p} ")
                out.append(F.struct(F.lit(label).alias("label"), F.when(keyed, template_score(hits, r)).otherwise(0.0).alias("score")))
            return F.array(*out).cast(_FOUND)

        found = let(placed, lambda hits: let(body, lambda text: judge(hits, text)))
        base = let(body, lambda text: F.array(*[F.when(text.contains(f" {p} "), _places(w, p)).otherwise(F.array().cast("array<int>")) for p, _ in PHRASES]))
        return F.struct(F.size(w).alias("n"), base.alias("base"), found.alias("found"))

    far = F.struct(F.lit(0).alias("n"), F.array(*[F.array().cast("array<int>")] * len(PHRASES)).alias("base"), F.array().cast(_FOUND).alias("found"))
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower(F.col("text")).alias("low"))
    seen = low.select("doc_id", let(F.col("low"), lambda t: F.when(gated(t), let(words(t), close)).otherwise(far.withField("n", F.size(words(t))))).alias("s"))
    places = F.flatten("s.base")
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(F.element_at("s.base", k + 1)) > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))))
    more = F.transform(F.filter("s.found", lambda f: f["score"] >= REACH), lambda f: f["label"])
    out = seen.select("doc_id", "s", places.alias("places"), base_labels.alias("b"), more.alias("m"))
    return out.select(
        "doc_id",
        F.col("s.n").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("b", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("b", "m")), ",").alias("labels"),
        F.when(F.size("b") > 0, F.lit(1.0)).otherwise(F.round(F.coalesce(F.array_max(F.transform("s.found", lambda f: f["score"])), F.lit(0.0)), 6)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, frequencies(docs))
