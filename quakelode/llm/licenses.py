"""License scans by an exact set-similarity join of text blocks with license templates; DataFrame functions only."""

from __future__ import annotations

import math
import re
import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelode.llm.shared import fresh, materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a block: so many, or fewer for templates of few words; blocks begin half as many words after each other, so
#: what spans up to half a block, and one word more, lies in one block whole.
BLOCK, SHORT_BLOCK, SHORT = 128, 24, 15
#: Share of a template's words that a block must hold.
CONTAINMENT = 0.8

#: Phrases whose words must stand one after the other (fixed values), and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}



class Template(NamedTuple):
    text: str
    label: str
    phrase: str = ""  # words that a match must hold one after the other, and not as the beginning of another's: they tell licenses apart


#: Sentences of public licenses (fixed values).
TEMPLATES = [
    Template("Released under the MIT License", "mit", "mit license"),
    Template("Licensed under the MIT License", "mit", "mit license"),
    Template("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction", "mit", "free of charge"),
    Template("Released under the Apache License", "apache", "apache license"),
    Template("Licensed under the Apache License, Version 2.0", "apache", "apache license"),
    Template("You may obtain a copy of the License at apache org licenses; distributed under the License is distributed on an as is basis, without warranties or conditions of any kind", "apache", "apache org"),
    Template("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd", "source and binary forms"),
    Template("This work is licensed under the GNU General Public License", "gpl", "gnu general public license"),
    Template("This work is licensed under the GNU Lesser General Public License", "lgpl", "gnu lesser general public license"),
    Template("This work is licensed under the GNU Affero General Public License", "agpl", "gnu affero general public license"),
    Template("under the terms of the GNU General Public License", "gpl", "gnu general public license"),
    Template("under the terms of the GNU Lesser General Public License", "lgpl", "gnu lesser general public license"),
    Template("under the terms of the GNU Affero General Public License", "agpl", "gnu affero general public license"),
    Template("This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl", "gnu general public license"),
    Template("This library is free software: you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl", "gnu lesser general public license"),
    Template("This program is free software: you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl", "gnu affero general public license"),
    Template("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl", "mozilla public license"),
    Template("Licensed under CC BY 4.0", "cc-by", "cc by"),
    Template("Licensed under CC BY-NC 4.0", "cc-by-nc", "cc by nc"),
    Template("Licensed under CC BY-SA 4.0", "cc-by-sa", "cc by sa"),
    Template("Licensed under CC BY-ND 4.0", "cc-by-nd", "cc by nd"),
    Template("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa", "cc by nc sa"),
    Template("Licensed under CC BY-NC-ND 4.0", "cc-by-nc-nd", "cc by nc nd"),
    Template("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by", "creative commons attribution"),
    Template("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "cc-by-nc", "creative commons attribution noncommercial"),
    Template("This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "cc-by-sa", "creative commons attribution sharealike"),
    Template("This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License", "cc-by-nd", "creative commons attribution noderivatives"),
    Template("The person who associated a work with this deed has dedicated the work to the public domain", "cc0", "public domain"),
    Template("Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", "isc", "with or without fee"),
]


def words(text: Column) -> Column:
    """A-Z lower-cased and cut at ASCII characters that are neither letters nor digits; '' may stand at either end."""
    return F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), SEPARATORS)


def template_words(text: str) -> list[str]:
    return sorted({w for w in re.split(SEPARATORS, text.lower()) if w})


def _starts(w: Column, phrase: str, shift: Column) -> Column:
    """Where the words of phrase stand one after the other; only arrays that hold them all are searched."""
    parts = phrase.split()
    here = lambda i: _all([F.get(w, i + k) == p for k, p in enumerate(parts)])
    found = F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)
    return F.when(_all([F.array_contains(w, p) for p in parts]), F.transform(found, lambda i: (i - shift).cast("long"))).otherwise(F.array().cast("array<long>"))


def longer_phrases(phrase: str, phrases: Sequence[str]) -> list[str]:
    """Those of phrases that begin with the words of phrase and go on."""
    return sorted({p for p in phrases if p.startswith(phrase + " ")})


def _stands(block: Column, wide: Column, held: Column, phrase: str, phrases: Sequence[str]) -> Column:
    """Whether the words of phrase stand one after the other in the first ``wide`` words of block, where no longer phrase begins.

    held: the template words in it. block goes on for some words, so that a longer phrase isn't cut off at its end.
    """
    parts = phrase.split()
    at = lambda i, words_: _all([F.get(block, i + k) == p for k, p in enumerate(words_)])
    more = [p.split() for p in longer_phrases(phrase, phrases)]
    alone = lambda i: _all([at(i, parts), i + len(parts) <= wide, *(~F.coalesce(at(i, m), F.lit(False)) for m in more)])
    return _all([F.array_contains(held, p) for p in parts]) & F.exists(F.sequence(F.lit(0), F.size(block) - 1), alone)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of literals, made by the optimizer and not by Python workers."""
    structs = [F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, r, strict=True))) for r in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))


def block_words(n: int) -> int:
    """Words of the blocks in which a template of n distinct words is looked for."""
    return SHORT_BLOCK if n < SHORT else BLOCK


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) for each row of documents.

    n_base counts the places of PHRASES, first_word and last_word are the smallest and largest of them (null without),
    base_labels their labels. A block of words matches a template if it holds the share ``containment`` of its distinct
    words and its phrase, and there that phrase isn't the beginning of a longer one ("cc by" in "cc by nc"); blocks have
    SHORT_BLOCK words for templates of fewer than SHORT words, else BLOCK. blocks lists all matches as (template, first
    word of the block, share), and every match adds its label to labels, whatever else stands beside it; score is the greatest share, 1 where one of PHRASES stands, else 0. Null and empty texts have no words; null ids, repeated rows and other columns change nothing.

    Template words are ordered by how many documents hold them, rarest first. Of a template with n words, of which m
    must be met, one of the n - m + 1 rarest is in every match; so only texts with such a word are cut into blocks,
    joined on these words, and tested by length and position before sets are compared. The template side has a fixed
    size and is broadcast. A word that every text holds is never joined on as long as its template has a rarer one.
    """
    spark = documents.sparkSession
    sets = [template_words(t.text) for t in templates]
    need = [math.ceil(containment * len(s) - 1e-9) for s in sets]
    wide = [block_words(len(s)) for s in sets]
    vocabulary = F.array(*(F.lit(w) for w in sorted({w for s in sets for w in s})))
    split = documents.select(words(F.col(text_col)).alias("w"))
    held = {r.word: r["count"] for r in split.select(F.explode(F.array_intersect(vocabulary, "w")).alias("word")).groupBy("word").count().collect()}
    order = sorted({w for s in sets for w in s}, key=lambda w: (held.get(w, 0), w))
    sets = [sorted(s, key=order.index) for s in sets]
    index = [(k, j, w, len(s), need[k], wide[k]) for k, s in enumerate(sets) for j, w in enumerate(s[: len(s) - need[k] + 1])]
    rare = F.array(*(F.lit(w) for w in sorted({w for _, _, w, *_ in index})))
    ordered = F.array(*(F.lit(w) for w in order))

    one = documents.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    shift = F.when(F.col("w")[0] == "", 1).otherwise(0)
    tail = F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    places = [_starts(F.col("w"), p, shift).alias(f"p{k}") for k, p in enumerate(PHRASES)]
    one = one.select("id", (F.size("w") - shift - tail).cast("long").alias("n_words"), shift.alias("shift"), *places, F.when(F.arrays_overlap("w", rare), F.col("w")).alias("w"))
    one = materialize(one.withColumn("row", F.monotonically_increasing_id()), "licenses-rows")

    least, told = min(need), sorted({t.phrase.strip() for t in templates} - {""})
    further = max((len(p.split()) for p in told), default=0)
    sizes = F.array(*(F.lit(n) for n in sorted(set(wide))))
    cut = one.where("w is not null").select("row", "w", "shift", F.explode(sizes).alias("wide"))
    step = (F.col("wide") / 2).cast("int")
    cut = cut.select("row", "w", "shift", "wide", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1 - step), step)).alias("at"))
    cut = cut.select("row", "wide", (F.col("at") - F.when(F.col("at") > 0, F.col("shift")).otherwise(0)).cast("long").alias("first"), F.slice("w", F.col("at") + 1, F.col("wide") + further).alias("s"))
    cut = cut.withColumn("b", F.array_intersect(ordered, F.slice("s", 1, F.col("wide"))))
    there = F.filter(F.array(*(F.when(_stands(F.col("s"), F.col("wide"), F.col("b"), p, told), F.lit(p)) for p in told)).cast("array<string>"), lambda p: p.isNotNull())
    ends = cut.where(F.size("b") >= least).select("row", "wide", "first", "b", there.alias("there")).select("row", "wide", "first", "b", "there", F.posexplode(F.slice("b", 1, F.size("b") - least + 1)).alias("i", "word"))
    table = _table(spark, index, ["template", "j", "word", "n", "need", "wide"])
    met = ends.join(F.broadcast(table), ["word", "wide"])
    met = met.where((F.size("b") >= F.col("need")) & (1 + F.least(F.size("b") - F.col("i") - 1, F.col("n") - F.col("j") - 1) >= F.col("need")))
    list_of = lambda s: F.array(*(F.lit(w) for w in s)).cast("array<string>")
    whole = _table(spark, [(k, list_of(s), t.phrase.strip(), t.label) for k, (s, t) in enumerate(zip(sets, templates, strict=True))], ["template", "words", "phrase", "label"])
    pairs = met.groupBy("row", "first", "template", "need").agg(F.first("b").alias("b"), F.first("there").alias("there")).join(F.broadcast(whole), "template")
    common = F.size(F.array_intersect("b", "words"))
    hits = pairs.where((common >= F.col("need")) & ((F.col("phrase") == "") | F.array_contains(F.col("there"), F.col("phrase"))))
    hits = hits.select("row", "first", "label", (common / F.size("words")).alias("share"), "template")
    found = hits.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), F.sort_array(F.collect_list(F.struct("template", "first", "share"))).alias("blocks"))

    every = F.flatten(F.array(*(f"p{k}" for k in range(len(PHRASES)))))
    base = F.filter(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))), lambda x: x.isNotNull())
    out = one.drop("w", "shift").join(found, "row", "left")
    labels = F.sort_array(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    (blocks,) = fresh([id_col], "blocks")
    return out.select(F.col("id").alias(id_col), "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"), F.array_join(F.sort_array(base), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.coalesce("blocks", F.array().cast("array<struct<template:int,first:bigint,share:double>>")).alias(blocks))
