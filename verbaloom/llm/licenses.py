"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame expressions only.

Blocks are the lines of a text, and runs of two to MAX_LINES short lines with MAX_BLOCK_WORDS words together at most, so a
notice that is wrapped is found as one on a line is. Tokens are ordered by how many blocks of the corpus hold them, rarest first. A block meets a template when it holds at
least the threshold's share of the template's words; then it must hold one of the template's first
|T| - ceil(t |T|) + 1 words in that order (prefix filter), have enough words (length filter), and enough must be left
after the first shared word on either side (positional filter). What passes is verified by intersection.

The templates are a parameter, and all that is collected is one count per template word.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, need

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Phrase and label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label and notice.
TEMPLATES = (
    ("agpl", "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software and may be used under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "Copyright the authors. All rights reserved."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable"),
)
#: Up to so many words of all templates, the join's small side is broadcast.
BROADCAST_WORDS = 20_000
MAX_LINES = 4
MAX_BLOCK_WORDS = 60


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def phrase_pattern(phrase: str) -> str:
    """Case-insensitive for ASCII only, as Java's flag is: the phrase's words next to each other."""
    return f"(?i)(?<!{WORD})" + f"{GAP}+".join(phrase.split()) + f"(?!{WORD})"


def _words(text):
    """The words of a text in lower case, by splitting at what no word holds; far cheaper than extracting them."""
    return F.array_remove(F.split(text, f"{GAP}+"), "")


def lowered(text):
    """Lower case by the built-in function; the two letters outside ASCII that it would turn into ASCII ones give way first."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0101")), F.lit("\u0130"), F.lit("\u0101")))


def tokenized(documents: DataFrame, phrases, vocabulary: list[str]) -> DataFrame:
    """One pass over the texts: n_words, the places of phrases, and the blocks that hold any word of a template.

    A phrase is searched for only where all its words are somewhere in the text.
    """
    count = lambda c: F.size(_words(c)).cast("long")
    low = documents.withColumn("__low", lowered(F.col("__text")))
    lines = low.withColumn("__lines", F.transform(F.split("__low", "\n"), _words))
    counted = lines.withColumn("n_words", F.aggregate("__lines", F.lit(0).cast("long"), lambda a, x: a + F.size(x)))

    def place(phrase: str, label: str):
        n = len(phrase.split())
        of = lambda p: F.struct((F.size(p) - 1).cast("long").alias("n"), count(F.get(p, F.lit(0))).alias("first"), (F.col("n_words") - count(F.get(p, F.size(p) - 1)) - n).alias("last"), F.lit(label).alias("label"))
        near = F.lit(True)
        for word in phrase.split():
            near = near & F.contains("__low", F.lit(word))
        return F.when(near, F.get(F.transform(F.array(F.split("__low", phrase_pattern(phrase))), of), F.lit(0)))

    found = counted.withColumn("__places", F.filter(F.array(*[place(*p) for p in phrases]), lambda x: x.n > 0))
    listed = F.array(*[F.lit(w) for w in vocabulary])
    block = lambda words, i: F.struct(i.alias("block"), F.size(F.array_distinct(words)).alias("n_tokens"), F.array_intersect(words, listed).alias("tokens"))
    joined = found.withColumn("__joined", F.expr(joined_lines("__lines")))
    return joined.select(
        "__key",
        "__id",
        "n_words",
        F.coalesce(F.aggregate("__places", F.lit(0).cast("long"), lambda a, x: a + x.n), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.transform("__places", lambda x: x.first)).alias("first_word"),
        F.array_max(F.transform("__places", lambda x: x.last)).alias("last_word"),
        F.coalesce(F.transform("__places", lambda x: x.label), F.expr("CAST(array() AS array<string>)")).alias("__base"),
        F.filter(F.concat(F.transform("__lines", block), F.transform("__joined", lambda words, i: block(words, i + F.size("__lines")))), lambda b: F.size(b.tokens) > 0).alias("__blocks"),
    )


def joined_lines(lines: str) -> str:
    """SQL: the words of each run of 2 to MAX_LINES lines that has MAX_BLOCK_WORDS words at most and begins with some."""
    few = f"aggregate(slice({lines}, i + 1, w), 0, (a, x) -> a + size(x)) <= {MAX_BLOCK_WORDS}"
    runs = f"transform(filter(sequence(2, {MAX_LINES}), w -> i + w <= size({lines}) AND {few}), w -> flatten(slice({lines}, i + 1, w)))"
    begins = f"filter(sequence(0, size({lines}) - 2), i -> size({lines}[i]) > 0 AND size({lines}[i]) + size({lines}[i + 1]) <= {MAX_BLOCK_WORDS})"
    return f"IF(size({lines}) < 2, CAST(array() AS array<array<string>>), flatten(transform({begins}, i -> {runs})))"


def template_sets(templates) -> list[tuple[str, list[str]]]:
    sets = [(label, sorted(set(words_of(text)))) for label, text in templates]
    return [(label, tokens) for label, tokens in sets if tokens]


def matches(blocks: DataFrame, sets: list[tuple[str, list[str]]], threshold: float) -> DataFrame:
    """(row key, block, template label, containment) of every block and template that meet the threshold."""
    vocabulary = sorted({w for _, t in sets for w in t})
    counts = dict(blocks.select(F.explode("tokens").alias("w")).groupBy("w").count().collect())  # a row per template word at most
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, tokens in sets:
        tokens = sorted(tokens, key=rank.get)
        least = math.ceil(threshold * len(tokens) - 1e-9)
        rows += [(w, i, label, tokens, len(tokens), least) for i, w in enumerate(tokens[: len(tokens) - least + 1])]
    spark = blocks.sparkSession
    prefixes = spark.createDataFrame(rows, "w string, i int, label string, template array<string>, size int, least int")
    if sum(len(t) for _, t in sets) <= BROADCAST_WORDS:
        prefixes = F.broadcast(prefixes)
    ordered = blocks.withColumn("tokens", F.array_sort(F.transform("tokens", lambda w: F.struct(F.array_position(F.array(*[F.lit(x) for x in order]), w).alias("r"), w.alias("w")))))
    probes = ordered.select("__key", "block", "n_tokens", "tokens", F.posexplode("tokens").alias("j", "t")).select("*", F.col("t.w").alias("w")).join(prefixes, "w")
    passed = probes.where((F.col("n_tokens") >= F.col("least")) & (F.size("tokens") >= F.col("least")))  # length
    # The first shared word of a pair is the one for which the positional bound holds; later ones find the same pair.
    bound = 1 + F.least(F.col("size") - F.col("i") - 1, F.size("tokens") - F.col("j") - 1)
    head = F.size(F.array_intersect(F.slice("template", 1, F.col("i")), F.transform(F.slice("tokens", 1, F.col("j")), lambda t: t.w))) == 0
    shared = F.size(F.array_intersect("template", F.transform("tokens", lambda t: t.w)))
    pairs = passed.where(head & (bound >= F.col("least"))).withColumn("shared", shared).where("shared >= least")
    return pairs.select("__key", "block", "label", (F.col("shared") / F.col("size")).alias("containment"))


def scan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document row.

    score: 1 where a phrase stands, else the largest containment of a template that meets the threshold, else 0. Null and
    empty texts have no words, no labels and score 0. Every row is judged by its own text, also where ids repeat or are
    null. Other columns are ignored; an empty table gives an empty result.
    """
    need(documents, id_col, text_col)
    docs = documents.select(F.monotonically_increasing_id().alias("__key"), F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    sets = template_sets(templates)
    counted = cut(tokenized(docs, phrases, sorted({w for _, t in sets for w in t})), "license-blocks")
    blocks = counted.select("__key", F.explode("__blocks").alias("b")).select("__key", "b.*")
    found = matches(blocks, sets, threshold).groupBy("__key").agg(F.collect_set("label").alias("__labels"), F.max("containment").alias("__score"))
    counted = counted.drop("__blocks")
    none = F.expr("CAST(array() AS array<string>)")
    joined = counted.join(found, "__key", "left")
    return joined.select(
        F.col("__id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array(F.array_distinct("__base")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("__base", F.coalesce("__labels", none)))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("__score", F.lit(0.0))).alias("score"),
    )
