"""License scan: phrases at word positions, and an exact set-similarity join of
text blocks with license templates.

Words are runs of ASCII letters, digits and non-ASCII characters after
lower-casing A-Z. A block is a window of twice n words that starts every n words,
n being ``BLOCK_WORDS`` or the words of the longest template where that is more, so
any passage as long as a template lies whole in one. A block gets a template's label if it holds at least ``threshold`` of
the template's distinct words. The join is exact: tokens are ordered by how few
documents hold them (counted over all documents); a pair that reaches the
overlap ``need`` shares a token inside both prefixes (all but ``need`` - 1
tokens), both sides have ``need`` tokens, and after the first shared token both
still have enough left. What passes is verified on the whole sets.

Defined results: a null or empty text has no words, labels or places and scores
0; equal texts score alike; an empty table gives an empty result; columns other
than doc_id and text are not read. Templates may have any length and number, whole
license texts included; one without words matches nothing. They are given by the
program, so their size is known: up to ``BROADCAST_CHARS`` characters they are
broadcast, beyond that the joins are planned without a hint.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharf.llm.common import ascii_lower, text_of
from wharf.session import materialize

#: (phrase, label): a place is where the words stand consecutively.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"),
           ("cc by", "cc-by"), ("mit license", "mit"))

#: (label, text) of notices; the words are public license wording.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain "
                   "a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or "
                "neighboring rights to this work"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the "
                   "terms of the gnu general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("mit-notice", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
BLOCK_WORDS = 64
BROADCAST_CHARS = 8_000_000

_NO_TEMPLATE = "(0, '', '', 0)"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """Words of a template, as the documents' words are taken."""
    return [w for w in re.split(_NOT_WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if w]


def _template_table(spark, labels: Sequence[str], tokens: Sequence[Sequence[str]], needs: Sequence[int]) -> DataFrame:
    """(template, label, tokens, least): a row per template; tokens hold no quote, space or comma."""
    rows = ", ".join("({}, '{}', '{}', {})".format(k, label.replace("\\", "\\\\").replace("'", "\\'"), " ".join(t), need)
                     for k, (label, t, need) in enumerate(zip(labels, tokens, needs)))
    made = spark.sql(f"SELECT * FROM VALUES {rows or _NO_TEMPLATE} AS t(template, label, tokens, least)")
    return made.withColumn("tokens", F.split("tokens", " ")).where("least > 0")


def _spaced(text: Column) -> Column:
    """' w0 w1 ... ' : the words with one space before and after each."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(text), F.lit(" ")), _NOT_WORD, " ")


def _n_spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _words(spaced: Column) -> Column:
    return F.when(spaced == " ", F.array().cast("array<string>")).otherwise(F.split(F.trim(spaced), " "))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _global_order(docs: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """Template tokens from rarest to most common by document count (one row each)."""
    held = docs.select(F.explode(F.array_intersect(_strings(vocabulary), _words(_spaced(text_of()))))
                       .alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
                  phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = 0.9) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (1 with a phrase, else the best containment of a
    labelled block, else 0), template_labels."""
    spark = docs.sparkSession
    worded = [(label, words_of(text)) for label, text in templates]
    sets = [(label, sorted(set(w))) for label, w in worded if w]
    step = max([BLOCK_WORDS] + [len(w) for _, w in worded])
    order = _global_order(docs, sorted({t for _, s in sets for t in s}))
    rank = {t: i for i, t in enumerate(order)}
    needs = [math.ceil(threshold * len(s) - 1e-9) for _, s in sets]
    ordered = [sorted(s, key=rank.get) for _, s in sets]
    rare = sorted({t for s, need in zip(ordered, needs) for t in s[:len(s) - need + 1]})

    # Phrases: one scan; only the pieces before the first and after the last place are counted.
    places = "(?<= )(?:{})(?= )".format("|".join(p for p, _ in phrases))
    spaced = docs.select("doc_id", _spaced(text_of()).alias("_s"))
    found = spaced.select("doc_id", "_s", _words(F.col("_s")).alias("_w"),
                          F.regexp_extract_all("_s", F.lit(places), 0).alias("_m"))
    some = F.size("_m") > 0
    pieces = F.split("_s", places)
    last = F.element_at("_m", -1)
    found = found.select(
        "doc_id", "_w", F.size("_w").cast("long").alias("n_words"), F.size("_m").cast("long").alias("n_base"),
        F.when(some, _n_spaces(F.element_at(pieces, 1)) - 1).cast("long").alias("first_word"),
        F.when(some, F.size("_w") - (_n_spaces(F.element_at(pieces, -1)) - 1) - (_n_spaces(last) + 1))
         .cast("long").alias("last_word"),
        F.transform(F.array_distinct("_m"), lambda m: F.element_at(
            F.create_map(*[F.lit(x) for pair in phrases for x in pair]), m)).alias("_base"))
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(step).cast("long")),
        lambda i: F.array_intersect(_strings(order), F.slice("_w", i.cast("int") + 1, 2 * step)))
    least = min(needs, default=1)
    blocks = F.when(F.arrays_overlap("_w", _strings(rare)), F.filter(windows, lambda b: F.size(b) >= least))
    rows = materialize(found.select("doc_id", F.monotonically_increasing_id().alias("_row"), "n_words", "n_base",
                                    "first_word", "last_word", "_base", blocks.alias("_blocks")), "license-rows")

    # Block tokens come in global order, so a token's place in the block is its position.
    wholes = _template_table(spark, [label for label, _ in sets], ordered, needs)
    prefixes = wholes.select("template", F.size("tokens").alias("size"), F.col("least").alias("need"),
                             F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("least") + 1)).alias("i", "token"))
    if sum(len(t) for s in ordered for t in s) <= BROADCAST_CHARS:
        wholes, prefixes = F.broadcast(wholes), F.broadcast(prefixes)
    block = rows.select("_row", F.explode("_blocks").alias("_b")).withColumn("_n", F.size("_b"))
    probe = block.select("_row", "_b", "_n", F.posexplode("_b").alias("_j", "_token"))
    left_over = F.least(F.col("size") - F.col("i"), F.col("_n") - F.col("_j"))
    candidates = (probe.join(prefixes, (F.col("_token") == F.col("token"))
                             & (F.col("_n") >= F.col("need"))                    # length
                             & (F.col("_j") <= F.col("_n") - F.col("need"))      # prefix of the block
                             & (left_over >= F.col("need")))                     # position
                  .select("_row", "template", "_b").distinct())
    share = F.size(F.array_intersect("_b", "tokens"))
    matched = (candidates.join(wholes, "template").where(share >= F.col("least"))
               .groupBy(F.col("_row").alias("_r"))
               .agg(F.collect_set("label").alias("_labels"), F.max(share / F.size("tokens")).alias("_best")))

    none = F.array().cast("array<string>")
    out = rows.drop("_blocks").join(matched, F.col("_row") == F.col("_r"), "left")
    added = F.coalesce("_labels", none)
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", added))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
        F.array_join(F.array_sort(added), ",").alias("template_labels"))
