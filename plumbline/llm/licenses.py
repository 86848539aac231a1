"""License scans: an exact set-similarity join of text blocks with notice templates, in DataFrame expressions only.

A block is a sentence: it ends at `.!?` before white space, or at an empty line. A template holds where a block has at least
`threshold` of the template's distinct words. Words are ordered by the number of documents that have them, rarest first. A
block of s template words can hold c words of a template of t only if it meets the template within the first t - c + 1 words
of the one and the first s - c + 1 of the other (prefix filter), has s >= c (length filter), and if enough words follow the
match on both sides (positional filter). Candidates so found are verified on their whole sets.

Words that no template has add nothing to an overlap; they are left out of the sets before anything is shuffled. Sentences
are cut only in documents that as a whole have enough words of one template, so nearly all leave before that. Of a text only these small sets and the counts of the base are written, so texts are read once
and never shuffled. Templates are a parameter of at most MAX_WORDS distinct words; what is broadcast is bounded by that.

Of the templates that hold in a block the one with the most common words gives the label (then the larger share, then the
smaller label), since the notice of one license can be part of another's.

Defined cases: a null text counts as empty; a text without words has zero counts and empty labels; a null id is kept;
repeated rows come out each; work is linear in a text's length, and sentences are cut only in texts that have enough of some
template's words; ties are settled as above; an empty table gives an empty result; other columns, whatever their names, are
left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

#: Characters that no word has.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SENTENCE_END = r"(?<=[.!?])[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest number of distinct words that templates may have together, a bound of what is sent to tasks.
MAX_WORDS = 20_000

# Phrases whose places are counted, and the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences of license notices, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the license"),
    ("gpl", "Licensed under the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This source code form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("reserved", "All rights reserved"),
]


def lowered(text: Column) -> Column:
    """A-Z in lower case, as far as words of a-z are concerned: of all other letters only the Kelvin sign would become one."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")))


def words_of(text: Column) -> Column:
    """Words of a lower-cased text; the first and the last can be empty."""
    return F.split(text, BETWEEN)


def spaced(text: Column) -> Column:
    """Words of a lower-cased text, each between two spaces."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(text, BETWEEN, " "), F.lit(" ")), F.lit(" "))


def _needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def _template_words(spark, templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    rows = spark.createDataFrame(templates, "label string, text string").select("label", F.array_remove(F.array_distinct(words_of(lowered(F.col("text")))), "").alias("w"))
    out = [(r["label"], sorted(r["w"])) for r in rows.collect() if r["w"]]
    if len({w for _, ws in out for w in ws}) > MAX_WORDS:
        raise ValueError(f"templates have more than {MAX_WORDS} distinct words")
    return out


def containment_join(blocks: DataFrame, templates: list[tuple[str, list[str]]], counts: dict[str, int], threshold: float) -> DataFrame:
    """Every block (row, block, words: distinct words of templates) and template with at least the threshold of the template's
    words: row, block, label, common, share. counts: of documents with each word, for the order."""
    spark = blocks.sparkSession
    order = {w: i for i, w in enumerate(sorted({w for _, ws in templates for w in ws}, key=lambda w: (counts.get(w, 0), w)))}
    sets = [(n, label, sorted(order[w] for w in ws), _needed(len(ws), threshold)) for n, (label, ws) in enumerate(templates)]
    index = [(w, n, label, at, ids, c) for n, label, ids, c in sets for at, w in enumerate(ids[: len(ids) - c + 1])]
    index = spark.createDataFrame(index, "w int, template int, label string, t_at int, t_words array<int>, needed int")
    ranks = spark.createDataFrame(list(order.items()), "word string, rank int")
    least = min(c for *_, c in sets)
    ranked = blocks.where(F.size("words") >= least).withColumn("word", F.explode("words")).join(F.broadcast(ranks), "word")
    ranked = ranked.groupBy("row", "block").agg(F.sort_array(F.collect_list("rank")).alias("b_words"))
    prefix = F.slice("b_words", 1, F.size("b_words") - least + 1)
    met = ranked.select("*", F.posexplode(prefix).alias("b_at", "w")).join(F.broadcast(index), "w")
    left = F.size("b_words") - F.col("b_at")
    near = met.where(
        (F.size("b_words") >= F.col("needed"))
        & (F.col("b_at") <= F.size("b_words") - F.col("needed"))
        & (F.least(left, F.size("t_words") - F.col("t_at")) + F.least("b_at", "t_at") >= F.col("needed"))
    )
    once = near.groupBy("row", "block", "template").agg(*[F.first(c).alias(c) for c in ("label", "needed", "b_words", "t_words")])
    common = F.size(F.array_intersect("b_words", "t_words"))
    found = once.withColumn("common", common).where(F.col("common") >= F.col("needed"))
    return found.select("row", "block", "label", "common", (F.col("common") / F.size("t_words")).alias("share"))


def _places(text: Column, phrase: str) -> Column:
    """How often the phrase's words stand in a spaced text; spaces are shared by neighbours, so the last one is looked ahead."""
    return F.regexp_count(text, F.lit(f" {phrase}(?= )")).cast("bigint")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every document: n_words, n_base, first_word, last_word, base_labels, labels and score, the largest share of a template
    that holds (0: none does)."""
    spark = docs.sparkSession
    known = _template_words(spark, templates)
    sets = F.array(*[F.struct(F.array(*map(F.lit, ws)).alias("w"), F.lit(_needed(len(ws), threshold)).alias("c")) for _, ws in known])
    least = min(_needed(len(ws), threshold) for _, ws in known)
    vocabulary = F.array(*map(F.lit, sorted({w for _, ws in known for w in ws})))
    reached = lambda words: F.exists(sets, lambda t: F.size(F.array_intersect(t["w"], words)) >= t["c"])
    low, line, words = F.col("__low"), F.col("__line"), F.col("__words")
    any_phrase = " (?:" + "|".join(PHRASES) + ") "
    before = lambda part: F.regexp_count(part, F.lit(" ")).cast("bigint")
    empty = lambda i: (F.element_at(words, i) == "").cast("int")
    counts = F.array(*[F.when(line.isNotNull(), _places(line, p)).otherwise(0) for p in PHRASES])
    sentences = F.transform(F.split(low, SENTENCE_END), lambda s: F.array_intersect(vocabulary, words_of(s)))
    last = [p.rpartition(" ")[2] for p in PHRASES]
    phrased = F.greatest(*[F.contains(low, F.lit(w)) for w in sorted(set(last))], F.lit(False))
    rows = (
        docs.select(F.col(key).alias("__key"), lowered(text_of(text)).alias("__low"))
        .withColumn("__words", words_of(low))
        .withColumn("__line", F.when(phrased, spaced(low)))
        .select(
            "__key",
            "__low",
            "__line",
            F.greatest(F.size(words) - empty(1) - empty(-1), F.lit(0)).cast("bigint").alias("n_words"),
            F.array_intersect(vocabulary, words).alias("words"),
            counts.alias("counts"),
        )
        .withColumn("n_base", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x))
        .select(
            "__key",
            F.monotonically_increasing_id().alias("row"),
            "n_words",
            "n_base",
            F.when(F.col("n_base") > 0, before(F.substring(line, F.lit(1), F.regexp_instr(line, F.lit(any_phrase)))) - 1).alias("first_word"),
            F.when(F.col("n_base") > 0, before(F.regexp_extract(line, f"(?s)^(.*){any_phrase}", 1))).alias("last_word"),
            F.array_compact(F.array(*[F.when(F.get("counts", i) > 0, label) for i, label in enumerate(PHRASES.values())])).alias("base"),
            "words",
            F.when(reached(F.col("words")), F.filter(sentences, lambda s: F.size(s) >= least)).alias("blocks"),
        )
    )
    scratch = Scratch(spark, "licenses")
    rows = scratch.write(rows, "rows")
    n = {r["word"]: r["count"] for r in rows.select(F.explode("words").alias("word")).groupBy("word").count().collect()}
    blocks = rows.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "words"))
    joined = containment_join(blocks, known, n, threshold)
    best = joined.groupBy("row", "block").agg(F.min(F.struct(-F.col("common"), -F.col("share"), "label")).alias("best"), F.max("share").alias("share"))
    found = best.groupBy("row").agg(F.collect_set("best.label").alias("more"), F.max("share").alias("score"))
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    return rows.join(found, "row", "left").select(
        F.col("__key").alias(key),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
