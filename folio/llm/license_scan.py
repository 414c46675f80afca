"""Operator 7: licence scan over a positional index of rare tokens, in DataFrame expressions only.

Templates are the wordings of licence notices. Each is indexed by its RARE words of highest inverse document frequency
among the templates, with their positions. Every occurrence in a file of a word of the index is looked up there, as long
as the file holds all mandatory phrases of a template that the word belongs to, as others can't become finds; a posting
says where in the file that template would start. Where enough distinct rare words of a template agree on a start, up to
SLACK words, is a find; finds of one template within SLACK words are one.

Short names of licences ("mit license") are found wherever their words stand next to each other.

Everything happens inside a row: hits of a file are sorted by template and start, and a binary search finds the end of
the SLACK words behind each start, which hold a bounded number of hits. Nothing is shuffled, so neither a source nor
copies of a file make a hot key, and time grows with the text. Null and empty texts have no words and score 0. Repeated
rows are scanned each. Only the id and the text are read, whatever the names of other columns. Equal labels are one.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.arrays import let, rank
from folio.llm.common import column, positional

#: Words are runs of these, after A-Z have become a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Short names and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Rare words by which a template is indexed, least share of a template's rare words in one find.
RARE, LEAST = 8, 0.75
#: Words by which a file's notice may be longer or shorter than the template between two of its rare words.
SLACK = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: label, wording, mandatory phrases.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", ("without restriction", "free of charge")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("required by applicable law",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ("free software foundation", "general public license")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", ("affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at", ("eclipse public license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit", ("creative commons attribution",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ("public domain",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("unencumbered software", "public domain")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("held liable for any damages",)),
)


def _idf() -> dict[str, float]:
    seen = Counter(w for _, text, _ in TEMPLATES for w in set(text.split()))
    return {w: math.log((1 + len(TEMPLATES)) / n) for w, n in seen.items()}


def postings() -> list[tuple[str, int, int]]:
    """(word, template, position) of each template's RARE words of highest IDF; ties by word; first position of a word."""
    idf, out = _idf(), []
    for k, (_, text, _) in enumerate(TEMPLATES):
        words = text.split()
        for w in sorted(set(words), key=lambda w: (-idf[w], w))[:RARE]:
            out.append((w, k, words.index(w)))
    return out


def _needed() -> dict[int, int]:
    """Distinct rare words that a placing of each template needs."""
    have = Counter(k for _, k, _ in postings())
    return {k: max(2, math.ceil(LEAST * n)) for k, n in have.items()}


def _strings(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def _finds(hits: Column) -> Column:
    """(template, at, n) of the finds among hits (template, start, w), which are sorted."""
    needed = F.array(*[F.lit(n) for _, n in sorted(_needed().items())])
    wide = lambda x: x["template"].cast("long") * (1 << 33) + x["start"]

    def counted(keys: Column) -> Column:
        near = lambda x, i: F.slice(hits, i + 1, rank(keys, wide(x) + SLACK, True) - i)
        every = F.transform(hits, lambda x, i: F.struct(x["template"].alias("template"), x["start"].alias("at"), F.size(F.array_distinct(F.transform(near(x, i), lambda y: y["w"]))).alias("n")))
        return F.filter(every, lambda x: x["n"] >= F.get(needed, x["template"]))

    def first_of_each(good: Column) -> Column:
        before = lambda i: F.get(good, i - 1)
        again = lambda x, i: F.coalesce((before(i)["template"] == x["template"]) & (x["at"] - before(i)["at"] <= SLACK), F.lit(False))
        return F.filter(good, lambda x, i: ~again(x, i))

    return let(let(F.transform(hits, wide), counted), lambda good: F.struct(first_of_each(good).alias("finds"), good.alias("every")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels arrays, score, and finds: (label, at) array."""
    index = postings()
    mandatory = sorted({p for _, _, phrases in TEMPLATES for p in phrases})
    #: A find needs all of its template's mandatory phrases, so a file without the longest word of any holds no template.
    gates = sorted({max((w for p in phrases for w in p.split()), key=lambda w: (len(w), w)) for _, _, phrases in TEMPLATES})
    text = F.coalesce(F.col(column(docs, text_col)).cast("string"), F.lit(""))
    at = positional(docs).select(F.col(column(docs, id_col)).alias("doc_id"), F.translate(text, UPPER, LOWER).alias("low"))
    at = at.withColumn("words", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))
    some = lambda values: reduce(lambda a, b: a | b, [F.contains(F.col("low"), F.lit(x)) for x in values])
    empty = lambda kind: F.array().cast(f"array<{kind}>")

    def places(phrase: str) -> Column:
        parts = phrase.split()
        match = lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(F.col("words"), i + j) == p, F.lit(False)) for j, p in enumerate(parts)])
        return F.when(some([parts[0]]) & some([parts[-1]]) & (F.size("words") > 0), F.filter(F.sequence(F.lit(0), F.size("words") - 1), match)).otherwise(empty("int"))

    at = at.withColumns({f"p{k}": places(p) for k, p in enumerate(PHRASES)})
    every = F.array_sort(F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))]))
    base = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(F.size(f"p{k}") > 0, F.array(F.lit(v))).otherwise(empty("string")) for k, v in enumerate(PHRASES.values())]))))
    spaced = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    held = F.when(F.arrays_overlap("words", _strings(gates)), F.filter(_strings(mandatory), lambda p: F.contains(spaced, F.concat(F.lit(" "), p, F.lit(" "))))).otherwise(empty("string"))
    at = at.withColumns({"every": every, "base": base, "held": held})

    # Postings of the templates whose mandatory phrases the file holds.
    templates = F.array(*[F.struct(_strings(TEMPLATES[k][2]).alias("mandatory"), F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("template"), F.lit(p).alias("tpos")) for w, j, p in index if j == k]).alias("postings")) for k in range(len(TEMPLATES))])
    possible = F.filter(templates, lambda t: F.size(F.array_except(t["mandatory"], F.col("held"))) == 0)
    at = at.withColumn("mine", F.when(F.size("held") > 0, F.flatten(F.transform(possible, lambda t: t["postings"]))).otherwise(empty("struct<w:string,template:int,tpos:int>")))
    known = F.transform("mine", lambda p: p["w"])
    met = lambda names: F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("pos"))), lambda h: F.array_contains(names, h["w"]))
    started = lambda h: F.transform(F.filter("mine", lambda p: p["w"] == h["w"]), lambda p: F.struct(p["template"].alias("template"), (h["pos"] - p["tpos"]).alias("start"), p["w"].alias("w")))
    hits = F.array_sort(F.flatten(F.transform(let(known, met), started)))
    at = at.withColumn("hits", F.when(F.size("mine") > 0, hits).otherwise(empty("struct<template:int,start:int,w:string>")))
    at = at.withColumn("found", F.when(F.size("hits") > 0, _finds(F.col("hits"))).otherwise(F.lit(None)))
    labels_of, totals = _strings(t[0] for t in TEMPLATES), F.array(*[F.lit(sum(j == k for _, j, _ in index)) for k in range(len(TEMPLATES))])
    finds = F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col("found")["finds"], empty("struct<template:int,at:int,n:int>")), lambda x: F.struct(F.get(labels_of, x["template"]).alias("label"), F.greatest(x["at"], F.lit(0)).alias("at")))))
    share = F.array_max(F.transform(F.col("found")["every"], lambda x: x["n"] / F.get(totals, x["template"])))
    at = at.withColumns({"finds": finds, "share": share})
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("finds", lambda x: x["label"]))))
    return at.select("doc_id", F.size("words").cast("long").alias("n_words"), F.size("every").cast("long").alias("n_base"), F.get("every", F.lit(0)).cast("long").alias("first_word"), F.when(F.size("every") > 0, F.element_at("every", -1)).cast("long").alias("last_word"), F.col("base").alias("base_labels"), labels.alias("labels"), F.when(F.size("every") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), "finds")


def digests(found: DataFrame) -> DataFrame:
    """What scan returns, with the labels comma-joined and the finds counted."""
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.size("finds").cast("long").alias("n_finds"))
