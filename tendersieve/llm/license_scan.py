"""License scans with DataFrame functions only: phrases, and an exact set-similarity join with templates.

One pass over the texts finds the places of fixed phrases and, for every block (``WINDOW``
consecutive lines, one block from each line on, so that a template wrapped at 72 columns or more
stands whole in one), the distinct words that any template has. A block that meets some template needs as many of them as
the smallest required overlap, so all other blocks are left behind there (length filter). What
stays is written and joined with the templates:

* Words are ordered by how many of these blocks hold them, rarest first.
* To share ``need`` = ceil(threshold * size) words with a template, a block has one of the
  template's first size - need + 1 words among its own first words but need - 1 (prefix filter).
* The places of the shared word in both orders bound what may still follow; pairs whose bound is
  below ``need`` leave (positional filter).
* The other pairs are counted exactly. No pair that meets the threshold is lost.

Templates and phrases are parameters of a checked size (``MOST_TEMPLATES``), so their side of the
join is broadcast; the blocks are never shuffled by word, and a line that a third of all documents
have stays where its documents are.

Defined cases: null and empty texts have no words; all words of a block count once; ties give every
label; repeated rows are scanned alike; an empty table gives an empty result; extra columns are
passed through, those named like a result replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, materialize

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_TEMPLATES = 1000
WINDOW = 4

#: (phrase, label); fixed values
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: (label, text) of passages that licenses ask to be kept; fixed values
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def normal(text: Column) -> Column:
    """Words of lower-cased A-Z with one space between."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(lower, SEPARATORS, " "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_columns(padded: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(places, first word, last word) of a phrase; every word of ``padded`` has a space of its own on both sides."""
    pattern = "".join(f" {w} " for w in phrase.split())
    there = F.contains(padded, F.lit(pattern))
    before = F.locate(pattern, padded) - 1
    behind = F.length(padded) - (F.locate(pattern[::-1], F.reverse(padded)) - 1) - len(pattern)
    count = F.regexp_count(padded, F.lit(f"(?={pattern})"))
    word = lambda n: (spaces(F.substring(padded, F.lit(1), n)) / 2).cast("long")
    return F.when(there, count).otherwise(0), F.when(there, word(before)), F.when(there, word(behind))


def license_scan(
    docs: DataFrame, text: str = "text", *, phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8,
) -> DataFrame:
    """``docs`` without ``text`` and with the columns of ``RESULT``.

    n_base, first_word and last_word are of the phrases' places; labels has the phrases' labels and those of
    the templates of which some block (``WINDOW`` consecutive lines) holds ``threshold`` of the distinct words; score is the greatest such
    share, 1 where a phrase stands, 0 for neither.
    """
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MOST_TEMPLATES} are broadcast")
    words = [sorted(set(t.split())) for _, t in templates]
    need = [math.ceil(round(threshold * len(w), 9)) for w in words]
    vocab = F.array(*[F.lit(w) for w in sorted(set().union(*words))]) if words else F.array().cast("array<string>")
    rest = [c for c in docs.columns if c.lower() not in RESULT and c != text]
    uid, raw, low, padded, lines, found_in = (free_name(rest, n) for n in ("s_uid", "s_text", "s_line", "s_padded", "s_lines", "s_blocks"))

    line = F.col(low)
    scanned = docs.select(F.monotonically_increasing_id().alias(uid), *[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias(raw))
    scanned = scanned.withColumn(low, normal(F.col(raw)))
    scanned = scanned.withColumn(padded, F.concat(F.lit(" "), F.replace(line, F.lit(" "), F.lit("  ")), F.lit(" ")))
    found = [phrase_columns(F.col(padded), p) for p, _ in phrases]
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for (n, _, _), (_, label) in zip(found, phrases, strict=True)]))))
    least, most = (lambda cs: F.least(*cs) if len(cs) > 1 else cs[0]), (lambda cs: F.greatest(*cs) if len(cs) > 1 else cs[0])
    scanned = scanned.withColumn(lines, F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: F.array_intersect(F.split(normal(x), " "), vocab)))
    blocks = F.transform(F.col(lines), lambda x, i: F.array_distinct(F.flatten(F.slice(F.col(lines), i + 1, WINDOW))))
    base = scanned.select(
        uid, *[F.col(f"`{c}`") for c in rest], F.when(line == "", 0).otherwise(spaces(line) + 1).cast("long").alias("n_words"),
        reduce(lambda a, b: a + b, [n for n, _, _ in found]).cast("long").alias("n_base"), least([a for _, a, _ in found]).alias("first_word"),
        most([z for _, _, z in found]).alias("last_word"), labels.alias("base_labels"),
        F.filter(blocks, lambda b: F.size(b) >= min(need, default=1)).alias(found_in),
    )
    base = materialize(base, "scanned")

    block = materialize(base.where(F.size(found_in) > 0).select(uid, F.posexplode(found_in).alias("b", "words")), "blocks")
    # one row a template word, however many blocks there are
    counts = {r["w"]: r["n"] for r in block.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(set().union(*words), key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    rows = []
    for k, (own, least_words) in enumerate(zip(words, need, strict=True)):
        own = sorted(own, key=place.get)
        rows += [(w, k, templates[k][0], i, least_words, own) for i, w in enumerate(own[: len(own) - least_words + 1])]
    prefix = block.sparkSession.createDataFrame(rows, "w string, template int, label string, i int, need int, own array<string>")
    ranked = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("words"))
    first = block.select(uid, "b", ranked.alias("words")).select(uid, "b", "words", F.posexplode(F.slice("words", F.lit(1), F.size("words") - min(need, default=1) + 1)).alias("j", "w"))
    pairs = first.join(F.broadcast(prefix), "w")
    pairs = pairs.where((F.col("j") <= F.size("words") - F.col("need")) & (1 + F.least(F.size("own") - F.col("i") - 1, F.size("words") - F.col("j") - 1) + F.least("i", "j") >= F.col("need")))
    exact = pairs.withColumn("common", F.size(F.array_intersect("words", "own"))).where(F.col("common") >= F.col("need"))
    more = exact.groupBy(uid).agg(F.collect_set("label").alias("more"), F.max(F.col("common") / F.size("own")).alias("share"))
    more = more.withColumnRenamed(uid, "s_other")
    joined = base.join(more, F.col(uid) == F.col("s_other"), "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return joined.select(
        *[F.col(f"`{c}`") for c in rest], "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", every).alias("labels"), score.alias("score"),
    )
