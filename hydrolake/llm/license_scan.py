"""License scan with a positional index of rare words.

Templates are word sequences of notices. The index holds, for each template, its INDEX_WORDS words of highest inverse
document frequency over the corpus, with their positions. A file looks up all its words among these; postings that
agree on the relative position of file and template make a candidate, which holds if at least MATCHED of the template's
words stand at their places and one of its mandatory key phrases stands within the place. A place with fewer postings
than a match must have is no candidate; a match of a template of up to 47 words always has one.
Base phrases are plain places of a phrase's consecutive words and always give their label.

Words are longest runs of [0-9a-z] and characters from U+0080 on, after A-Z are lower-cased; they are compared by
64-bit hashes. Document frequencies are counted over all documents.

Defined cases: null text is empty; no word, no place: counts 0, first and last null, labels empty, score 0; places may
overlap; repeated rows are scanned each; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.common import NON_ALNUM, blocks_of, flat, word_hashes

INDEX_WORDS = 12
MATCHED = 0.75
#: Words by which a key phrase may lie outside the matched place.
SLACK = 3

BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# Wording of public notices, and the phrases without which a notice does not count.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge",),
    ),
    "mit-short": ("Released under the MIT License", ("mit license",)),
    "cc-by-nc-short": ("Licensed under CC BY-NC 4.0", ("cc by nc",)),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        ("apache license version 2 0",),
    ),
    "apache-2.0-short": ("Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation",
        ("gnu general public license",),
    ),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation",
        ("lesser general public license",),
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at",
        ("mozilla public license",),
    ),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    "cc-by-sa-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        ("creative commons attribution sharealike",),
    ),
    "cc-by-short": ("Licensed under CC BY 4.0", ("cc by 4 0", "cc by")),
    "unlicense": ("This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    "all-rights-reserved": ("Copyright. All rights reserved", ("all rights reserved",)),
}


def hashes_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]), NON_ALNUM)[0]


@dataclass
class Index:
    labels: list[str]
    words: list[np.ndarray]  # per template
    keys: list[list[np.ndarray]]
    base: list[tuple[str, np.ndarray]]
    rare: np.ndarray  # sorted hashes of the indexed words
    begin: np.ndarray  # of each indexed word's postings, one more than words
    template: np.ndarray  # of each posting
    position: np.ndarray
    need: np.ndarray  # per template: postings that a match has at least


def build_index(frequency: dict[int, int], templates: dict = TEMPLATES, base: dict = BASE) -> Index:
    """frequency: documents that hold a word, by its hash; words unseen in the corpus are the rarest."""
    labels = sorted(templates)
    words = [hashes_of(templates[x][0]) for x in labels]
    places: dict[int, list[tuple[int, int]]] = {}
    for t, w in enumerate(words):
        distinct = sorted(set(w.tolist()), key=lambda h: (frequency.get(h, 0), h))[:INDEX_WORDS]
        for p, h in enumerate(w.tolist()):
            if h in distinct:
                places.setdefault(h, []).append((t, p))
    rare = np.array(sorted(places), np.uint64)
    postings = [x for h in rare.tolist() for x in places[h]]
    template, position = np.array(postings, np.int64).reshape(-1, 2).T
    indexed = np.bincount(template, minlength=len(words))
    missing = [len(w) - int(np.ceil(MATCHED * len(w))) for w in words]
    return Index(labels, words, [[hashes_of(k) for k in templates[x][1]] for x in labels], sorted((n, hashes_of(p)) for n, p in base.items()),
                 rare, np.cumsum([0, *(len(places[h]) for h in rare.tolist())]), template, position, np.maximum(1, indexed - missing))


def runs(hashes: np.ndarray, phrase: np.ndarray, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Words at which the phrase begins, not reaching beyond its text; owner: text of a word."""
    n = len(hashes) - len(phrase) + 1
    at = np.flatnonzero(hashes[: max(n, 0)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[hashes[at + k] == phrase[k]]
    return at[at + len(phrase) <= first[1:][owner[at]]]


def scan_block(index: Index, data: np.ndarray, offs: np.ndarray) -> list[tuple]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of each text."""
    hashes, first, _, _ = word_hashes(data, offs, NON_ALNUM)
    m, n_words = len(offs) - 1, np.diff(first)
    owner = np.repeat(np.arange(m), n_words)
    n_base, low, high = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max), np.full(m, -1)
    based: list[set] = [set() for _ in range(m)]
    for label, phrase in index.base:
        at = runs(hashes, phrase, first, owner)
        docs, place = owner[at], at - first[:-1][owner[at]]
        np.add.at(n_base, docs, 1)
        np.minimum.at(low, docs, place)
        np.maximum.at(high, docs, place)
        for d in set(docs.tolist()):
            based[d].add(label)
    score = (n_base > 0).astype(float)
    labels = [set(x) for x in based]
    if len(index.rare):
        found = np.minimum(np.searchsorted(index.rare, hashes), len(index.rare) - 1)
        at = np.flatnonzero(index.rare[found] == hashes)
        docs, template, shift = candidates(index, owner[at], at - first[:-1][owner[at]], found[at])
        by_doc = np.searchsorted(docs, np.arange(m + 1))
        for d in np.unique(docs).tolist():
            here = slice(by_doc[d], by_doc[d + 1])
            best = _match(index, hashes[first[d] : first[d + 1]], template[here], shift[here])
            for label, share in best.items():
                labels[d].add(label)
                score[d] = max(score[d], share)
    return [
        (int(n_words[d]), int(n_base[d]), int(low[d]) if n_base[d] else None, int(high[d]) if n_base[d] else None,
         ",".join(sorted(based[d])), ",".join(sorted(labels[d])), float(score[d]))
        for d in range(m)
    ]


def candidates(index: Index, docs: np.ndarray, places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, template and relative position, in order of texts, with the postings that a match needs; ids: indexed word at each place."""
    reps = index.begin[ids + 1] - index.begin[ids]
    nth = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
    posting = np.repeat(index.begin[ids], reps) + nth
    low = int(index.position.max())
    span = int(places.max(initial=0)) + low + 1
    shift = np.repeat(places, reps) - index.position[posting] + low
    votes, n = np.unique((np.repeat(docs, reps) * len(index.words) + index.template[posting]) * span + shift, return_counts=True)
    votes = votes[n >= index.need[votes // span % len(index.words)]]
    return votes // span // len(index.words), votes // span % len(index.words), votes % span - low


def _match(index: Index, file: np.ndarray, templates: np.ndarray, shifts: np.ndarray) -> dict[str, float]:
    """Best share of matched words for each template whose key phrase stands within the place."""
    best: dict[str, float] = {}
    for t, shift in zip(templates.tolist(), shifts.tolist()):
        words, label = index.words[t], index.labels[t]
        a, b = max(0, shift), min(len(file), shift + len(words))
        share = float((file[a:b] == words[a - shift : b - shift]).sum()) / len(words)
        if share > best.get(label, 0.0) and share >= MATCHED:
            region = file[max(0, a - SLACK) : b + SLACK]
            one = np.array([0, len(region)])
            if any(len(runs(region, k, one, np.zeros(len(region), np.int64))) for k in index.keys[t]):
                best[label] = share
    return best


def frequencies(docs: DataFrame, text_col: str = "text", templates: dict = TEMPLATES) -> dict[int, int]:
    """Documents that hold each template word; as many numbers as the templates have words."""
    known = np.array(sorted({h for text, _ in templates.values() for h in hashes_of(text).tolist()}), np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            data, offs = flat(batch.column(0))
            for a, b in blocks_of(offs):
                part = offs[a : b + 1]
                hashes, first, _, _ = word_hashes(data[part[0] : part[-1]], part - part[0], NON_ALNUM)
                found = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[found] == hashes
                owner = np.repeat(np.arange(b - a), np.diff(first))
                pairs = np.unique(owner[hit] * len(known) + found[hit])
                total += np.bincount(pairs % len(known), minlength=len(known))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["word", "n"])

    counted = docs.select(F.col(text_col)).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {int(known[r["word"]]): r["n"] for r in counted.collect()}


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with the counts, labels and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in RESULT.split(", ")]

    @F.arrow_udf(RESULT)
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offs = flat(texts)
            rows: list[tuple] = []
            for a, b in blocks_of(offs):
                part = offs[a : b + 1]
                rows += scan_block(shared.value, data[part[0] : part[-1]], part - part[0])
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

    found = docs.select(F.col(id_col).alias("doc_id"), look(F.col(text_col)).alias("_found"))
    return found.select("doc_id", *[f"_found.{n}" for n in names])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scan(docs, build_index(frequencies(docs, text_col)), id_col, text_col)
