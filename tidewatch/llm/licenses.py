"""License scan: an exact set-similarity join between license templates and blocks of text.

Texts are cut into blocks of ``2 c`` words, one starting at every ``c``-th word, for each size class
``c`` (a power of two) of the templates: a passage as long as its template lies whole in one of them.
A block and a template are sets of words.  A template is found in a block that holds at least
``threshold`` of its words.  The join tests few pairs and loses none:

* words are ordered by how often all documents use them, the rarest first;
* of a template that must share ``a`` words only the first ``size - a + 1`` are joined, and of a block
  as well (prefix filter);
* a block has ``a`` words of any template at least (length filter);
* a shared word at place ``i`` of one and ``j`` of the other leaves room for
  ``min(i, j) + 1 + min(words after i, words after j)`` shared words (positional filter);
* what is left is decided by the whole sets.

Words that no template holds cannot be shared, so blocks keep template words only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.storage import staged

#: Phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Notices and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Words of a text in UTF-8 once A-Z are lower-cased.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
THRESHOLD = 0.9


def words_of(text: str) -> list[str]:
    return [w.decode() for w in WORDS.findall(text.encode().lower())]


def size_class(words: list[str]) -> int:
    return 1 << max(3, (len(words) - 1).bit_length())


def needed(words: list[str], threshold: float) -> int:
    """Words of a template that a block must hold."""
    return max(1, math.ceil(threshold * len(set(words)) - 1e-9))


def located(docs: DataFrame, phrases: Sequence[tuple[str, str]], vocabulary: list[str]) -> DataFrame:
    """One row a document: its places of phrases, and where words of the vocabulary stand.

    ``row`` numbers the rows, ``gaps`` and ``codes`` are the distances and numbers of vocabulary words.
    """
    known = {w.encode(): i + 1 for i, w in enumerate(vocabulary)}
    sought = [(np.array([known[w.encode()] for w in words_of(p)]), label) for p, label in phrases]
    columns = (
        "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
        "gaps array<int>, codes array<int>"
    )

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base", "gaps", "codes")}
            for text in batch.column("text"):
                words = WORDS.findall(text.as_py().encode().lower()) if text.is_valid else []
                codes = np.fromiter((known.get(w, 0) for w in words), np.int32, len(words))
                places, base = [], set()
                for phrase, label in sought:
                    if len(codes) >= len(phrase):
                        at = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(codes, len(phrase)) == phrase).all(1))
                        places.append(at)
                        base |= {label} if len(at) else set()
                places = np.concatenate(places) if places else np.zeros(0, np.int64)
                at = np.flatnonzero(codes)
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(int(places.min()) if len(places) else None)
                out["last_word"].append(int(places.max()) if len(places) else None)
                out["base"].append(sorted(base))
                out["gaps"].append(np.diff(at, prepend=0).astype(np.int32))
                out["codes"].append(codes[at])
            longs = [pa.array(out[c], pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
            lists = [pa.array(out["base"], pa.list_(pa.string())), *(pa.array(out[c], pa.list_(pa.int32())) for c in ("gaps", "codes"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *longs, *lists], names=[c.split()[0] for c in columns.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(locate, columns)


def blocks(found: DataFrame, rank: np.ndarray, classes: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """``row, size_class, block, words``: blocks that may hold a template, their words by rank.

    ``rank`` is the place of each code in the order of words; ``classes`` gives for each size class the
    fewest words a block needs, and a mask of the ranks that some prefix of a template holds.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = len(rank)
        for batch in batches:
            out: dict[str, list] = {"row": [], "size_class": [], "block": [], "words": []}
            for row, gaps, codes in zip(batch.column("row"), batch.column("gaps"), batch.column("codes")):
                ranks = rank[codes.values.to_numpy(zero_copy_only=False) if len(codes) else np.zeros(0, np.int64)]
                if not any(mask[ranks].any() for _, mask in classes.values()):
                    continue
                at = np.cumsum(gaps.values.to_numpy(zero_copy_only=False))
                for c, (least, mask) in classes.items():
                    both = np.concatenate([at // c, at[at >= c] // c - 1]), np.concatenate([ranks, ranks[at >= c]])
                    pairs = np.unique(both[0].astype(np.int64) * kinds + both[1])
                    number, words = np.divmod(pairs, kinds)
                    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
                    ends = np.append(starts[1:], len(number))
                    fits = np.flatnonzero((ends - starts >= least) & np.logical_or.reduceat(mask[words], starts)) if len(starts) else []
                    for b in fits:
                        out["row"].append(row.as_py())
                        out["size_class"].append(c)
                        out["block"].append(int(number[starts[b]]))
                        out["words"].append(words[starts[b]:ends[b]].astype(np.int32))
            kinds_of = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds_of)], names=list(out))

    return found.select("row", "gaps", "codes").mapInArrow(cut, "row long, size_class int, block long, words array<int>")


def join_templates(spark: SparkSession, cut: DataFrame, templates: list[tuple[int, int, int, list[int]]], least: dict[int, int]) -> DataFrame:
    """``row, template, containment`` of every block and template that share enough words.

    ``templates`` are (number, size class, words needed, ranks in order).
    """
    prefixes = [
        (c, words[i], number, i, len(words), need, words)
        for number, c, need, words in templates for i in range(len(words) - need + 1)
    ]
    sides = spark.createDataFrame(prefixes, "size_class int, word int, template int, i int, template_size int, need int, template_words array<int>")
    fewest = F.element_at(F.create_map(*[F.lit(v) for pair in least.items() for v in pair]), F.col("size_class"))
    size = F.size("words")
    first = cut.select("*", size.alias("block_size"), F.posexplode(F.slice("words", F.lit(1), size - fewest + 1)).alias("j", "word"))
    after = F.least(F.col("template_size") - F.col("i") - 1, F.col("block_size") - F.col("j") - 1)
    room = F.least("i", "j") + 1 + after >= F.col("need")
    prefix = (F.col("block_size") >= F.col("need")) & (F.col("j") <= F.col("block_size") - F.col("need"))
    # the templates are a parameter, a few hundred rows
    met = first.join(F.broadcast(sides), ["size_class", "word"]).filter(prefix & room)
    shared = F.size(F.array_intersect("words", "template_words"))
    return met.filter(shared >= F.col("need")).select("row", "template", (shared / F.col("template_size")).alias("containment"))


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    Words are the maximal runs of digits, letters and characters from U+0080 on in whole texts, A-Z
    lower-cased; a null text has none.  ``n_base`` counts the places where a phrase's words stand
    consecutively, ``first_word`` and ``last_word`` are the smallest and largest start (null without a
    place).  ``labels`` adds those of the templates found, ``score`` is the highest containment found, 1
    where a phrase stands, else 0.  Lists of labels without an entry are empty strings.  Every row of the
    input has one row, repeated and null doc_ids too.
    """
    sets = [list(dict.fromkeys(words_of(text))) for _, text in templates]
    vocabulary = sorted({w for s in sets for w in s} | {w for p, _ in phrases for w in words_of(p)})
    found = staged(located(docs, phrases, vocabulary), "located")
    counts = found.select(F.explode("codes").alias("code")).groupBy("code").count().collect()  # at most one row a template word
    used = dict(map(tuple, counts))
    order = sorted(range(len(vocabulary)), key=lambda i: (used.get(i + 1, 0), vocabulary[i]))
    rank = np.zeros(len(vocabulary) + 1, np.int64)
    rank[[i + 1 for i in order]] = np.arange(len(order))
    known = {w: int(rank[i + 1]) for i, w in enumerate(vocabulary)}

    sides = [
        (number, size_class(words_of(text)), needed(words, threshold), sorted(known[w] for w in words))
        for number, ((_, text), words) in enumerate(zip(templates, sets)) if words
    ]
    least = {c: min(need for _, k, need, _ in sides if k == c) for c in sorted({c for _, c, _, _ in sides})}
    masks = {c: np.zeros(len(rank), bool) for c in least}
    for _, c, need, words in sides:
        masks[c][words[:len(words) - need + 1]] = True
    cut = blocks(found, rank, {c: (n, masks[c]) for c, n in least.items()})
    matches = join_templates(docs.sparkSession, cut, sides, least)
    label = F.element_at(F.array(*[F.lit(name) for name, _ in templates]), F.col("template") + 1)
    best = matches.groupBy("row").agg(F.collect_set(label).alias("added"), F.max("containment").alias("containment"))
    none = F.array().cast("array<string>")
    return found.join(best, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("added", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
