"""License scans: an exact containment join of templates' word sets with every block of every text.

Texts are read once: a tokeniser finds the base phrases and writes, for each block, which
template words it holds.  The rest is DataFrame operations: words are put in one global
order, rarest in the corpus first; a template's prefix in that order is joined with the
blocks; length and positional filters drop candidates; the overlap of the rest is counted
in full.  No pair that reaches the threshold is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, sliced, written

#: Phrases whose words stand consecutively, and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices as their licenses word them, and their labels (fixed values).
TEMPLATES = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, "
    "distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}

#: Templates are sent to every task: at most so many distinct words in all.
TEMPLATE_WORDS = 20_000
#: Bytes that end a word become spaces, capital ASCII letters small; all else is part of a word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PARAGRAPHS = re.compile(rb"\n[ \t\r\f\v]*\n")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def places(words: list[bytes], phrase: bytes) -> list[int]:
    """Where the phrase's words stand consecutively, as words before it; overlapping places count each."""
    line, key = b" " + b" ".join(words) + b" ", b" " + phrase + b" "
    found, at = [], line.find(key)
    while at >= 0:
        found.append(at)
        at = line.find(key, at + 1)
    out, n, last = [], 0, 0
    for at in found:
        n += line.count(b" ", last, at)
        last = at
        out.append(n)
    return out


def _read(docs: DataFrame, numbers: dict[bytes, int], phrases: Mapping[str, str], stretch: int, least: int, key: str, text: str) -> DataFrame:
    """Each row's words and base places, and of each block the numbers of the template words in it.

    A block is a paragraph; a longer one than two stretches is read in blocks of two
    stretches that begin a stretch apart, so that any stretch of words lies within one.
    """
    sought = [(" ".join(p.lower().split()).encode(), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(numbers)
        for b in sliced(batches, "text"):
            data, offsets = binary_column(b.column("text"))
            whole, ends = data.tobytes(), offsets.tolist()
            out: list[list] = [[], [], [], [], [], []]
            for i in range(b.num_rows):
                t = whole[ends[i] : ends[i + 1]]
                parts = [words_of(p) for p in _PARAGRAPHS.split(t)]
                words = parts[0] if len(parts) == 1 else [w for p in parts for w in p]
                line = b" " + b" ".join(words) + b" "
                at = [(n, label) for p, label in sought if b" " + p + b" " in line for n in places(words, p)]
                starts = [n for n, _ in at]
                blocks = []
                if len(known.intersection(words)) >= least:
                    for p in parts:
                        for lo in range(0, max(1, len(p) - stretch), stretch):
                            held = known.intersection(p[lo : lo + 2 * stretch])
                            if len(held) >= least:
                                blocks.append(sorted(numbers[w] for w in held))
                row = (len(words), len(at), min(starts, default=None), max(starts, default=None), sorted({x for _, x in at}), blocks)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<array<int>>")


def needed(size: int, percent: int) -> int:
    """Words of a template of `size` distinct words that a block must hold."""
    return max(1, -(-size * percent // 100))


def containment_join(blocks: DataFrame, templates: Mapping[str, frozenset[int]], percent: int) -> DataFrame:
    """(id, block, template, share) where a block holds `percent` of a template's words or more.

    `blocks(id, block, words)` has sets as arrays of numbers, without words that no
    template has.  Words are put in one order, those that fewest blocks hold first.  A
    block that reaches the threshold shares one of the template's first size - needed + 1
    words; a pair is met once, at the first word it shares, and what follows there in
    the template and in the block must suffice.  The overlap is then counted in full.
    Templates are few (`TEMPLATE_WORDS`), so their index goes to where the blocks are
    and no block moves.
    """
    spark = blocks.sparkSession
    vocabulary = sorted(set().union(*templates.values()))
    if len(vocabulary) > TEMPLATE_WORDS:
        raise ValueError(f"templates have {len(vocabulary)} words; {TEMPLATE_WORDS} may be sent to every task")
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("word").between(0, max(vocabulary, default=0)))
    often = {r["word"]: r["count"] for r in counts.collect()}  # a row for each template word at most
    at = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    index = []
    for name, words in templates.items():
        sought, need = sorted(at[w] for w in words), needed(len(words), percent)
        prefix = sought[: len(sought) - need + 1]
        index += [(x, name, need, i, prefix, sought) for i, x in enumerate(prefix)]
    index = F.broadcast(spark.createDataFrame(index, "at int, template string, need int, i int, prefix array<int>, sought array<int>"))
    numbers = ",".join(str(at.get(w, -1)) for w in range(max(vocabulary, default=-1) + 1))
    order = F.split(F.lit(numbers), ",").cast("array<int>")
    held = blocks.select("id", "block", F.sort_array(F.transform("words", lambda w: F.element_at(order, w + 1))).alias("held"))
    met = held.select("id", "block", "held", F.explode("held").alias("at")).join(index, "at")
    met = met.where("size(held) >= need AND at = array_min(array_intersect(held, prefix))")
    met = met.where("least(size(sought) - i, size(held) - array_position(held, at) + 1) >= need")
    met = met.withColumn("overlap", F.size(F.array_intersect("held", "sought")))
    return met.where("overlap >= need").select("id", "block", "template", (F.col("overlap") / F.size("sought")).alias("share"))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    `base_labels` are those of phrases that stand in the text, `labels` also those of
    templates that a block of it (see `_read`) holds to `percent`.  `score` is 1 with a
    base label, else the largest share of a template, else 0.  Null and empty texts have
    no words and no labels; long texts are read whole, in blocks; templates that tie are
    all named; rows are judged one by one, so repeated rows are judged alike and an
    empty table gives no rows; null keys stay; other columns are not read.
    """
    numbers: dict[bytes, int] = {}
    sets, longest = {}, 1
    for name, notice in templates.items():
        words = words_of(notice.encode())
        if not words:
            raise ValueError(f"template {name!r} has no word")
        longest = max(longest, len(words))
        sets[name] = frozenset(numbers.setdefault(w, len(numbers)) for w in words)
    least = min((needed(len(x), percent) for x in sets.values()), default=1)
    read = _read(docs, numbers, phrases, longest, least, key, text)
    read = written(read.withColumn("id", F.monotonically_increasing_id()), "license-blocks")
    found = containment_join(read.select("id", F.posexplode("blocks").alias("block", "words")), sets, percent)
    found = found.groupBy("id").agg(F.collect_set("template").alias("found"), F.max("share").alias("share"))
    joined = read.drop("blocks").join(found, "id", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
