"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or a run of lines between blank ones (a text without any: the whole). It matches a template
if it has at least the threshold's share of the template's different words. All words that templates have are ordered by
how many texts have them, rare ones first. Then a block that shares alpha = ceil(threshold * m) words with a template of m
words must have one of the first m - alpha + 1 words of the template (prefix filter), must have alpha words (length
filter), and where it has its first of them at place i of the template and place j of its own words in this order, alpha
must not exceed 1 and the fewer of those that follow (positional filter). What passes is counted exactly.

With windows, a block may also be several consecutive runs with the blank lines between them, as licenses of several
paragraphs are: no longer than WINDOW_LENGTH times the template, repeated words counted, and only where nothing smaller
inside it, a line or a run or a window, matches the template too.

The index of the templates' prefixes is broadcast; where templates are many, a bounded number of them at a time. Texts
aren't shuffled. Word counts cover all texts. They decide how much work is done, never what is found.

Defined cases: null text, null id or one that is no integer: takes no part. Empty text: no blocks. Very long texts: whole. A template without words: never found. A block
that ties on several templates matches all of them. A line of a block that is one line is reported once, as a line; a
block of several lines only for templates that none of its lines matches. Repeated rows: reported once. Empty tables: no
matches. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import map_arrow, quoted, slices, texts_of, whole_id
from stepweave.llm.textnp import distinct, words

THRESHOLD = 0.85
#: A window of several paragraphs has at most so many times a template's words.
WINDOW_LENGTH = 2
#: Words of the templates that are searched for at once.
TEMPLATE_WORDS = 2_000_000

TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "Copyright. All rights reserved. No part of this work may be reproduced without written permission.",
}


@dataclass
class Index:
    """Words in order (hashes and their ranks), and the templates as sorted ranks."""

    sorted_hashes: np.ndarray
    ranks: np.ndarray
    names: list[str]
    sets: list[np.ndarray]
    need: np.ndarray
    by_word: dict[int, list[tuple[int, int]]]  # rank of a prefix word: (template, its place)
    in_prefix: np.ndarray
    lengths: list[int]  # words, repeated ones included


def build(templates: dict[str, np.ndarray], counts: dict[int, int], threshold: float, lengths: dict[str, int] | None = None) -> Index:
    """templates: each one's distinct word hashes; counts: in how many texts each is; lengths: templates' numbers of words."""
    vocabulary = distinct(np.concatenate([*templates.values(), np.zeros(0, np.uint64)]))
    order = sorted(range(len(vocabulary)), key=lambda i: (counts.get(int(vocabulary[i]), 0), int(vocabulary[i])))
    ranks = np.empty(len(vocabulary), np.int64)
    ranks[order] = np.arange(len(vocabulary))
    names, sets, need, by_word = [], [], [], {}
    in_prefix = np.zeros(len(vocabulary) + 1, bool)
    for name, hashes in sorted(templates.items()):
        if not len(hashes):
            continue
        own = np.sort(ranks[np.searchsorted(vocabulary, hashes)])
        alpha = max(1, math.ceil(threshold * len(own) - 1e-9))
        for place, r in enumerate(own[: len(own) - alpha + 1].tolist()):
            by_word.setdefault(r, []).append((len(names), place))
            in_prefix[r] = True
        names.append(name)
        sets.append(own)
        need.append(alpha)
    return Index(vocabulary, ranks, names, sets, np.array(need, np.int64), by_word, in_prefix, [(lengths or {}).get(n, len(x)) for n, x in zip(names, sets, strict=True)])


def _blocks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of each line, and the number of the run of lines that each is in (blank lines end a run)."""
    lines = text.split("\n")
    starts = np.zeros(len(lines), np.int64)
    np.cumsum([len(x) + 1 for x in lines[:-1]], out=starts[1:])
    blank = np.array([not x or x.isspace() for x in lines])
    return starts, np.cumsum(blank)


def block_matches(ranks: np.ndarray, index: Index) -> list[tuple[int, int]]:
    """(template, shared words) of a block's distinct known words in order; distinct words that no template has don't matter."""
    out, done = [], set()
    for j in np.flatnonzero(index.in_prefix[ranks]).tolist():
        for t, i in index.by_word[int(ranks[j])]:
            if t in done:
                continue
            done.add(t)  # this is the first word that they share: the others follow in both
            own, need = index.sets[t], int(index.need[t])
            if len(ranks) < need or 1 + min(len(own) - i - 1, len(ranks) - j - 1) < need:
                continue
            both = 1 + len(np.intersect1d(own[i + 1 :], ranks[j + 1 :], assume_unique=True))
            if both >= need:
                out.append((t, both))
    return out


def smallest_windows(words_in: np.ndarray, run: np.ndarray, ranks: np.ndarray, template: int, index: Index) -> list[tuple[int, int, int]]:
    """(first run, last run, shared words) of the smallest windows of runs that match a template.

    words_in: words up to the end of each run; run, ranks: of the text's known words.
    """
    own = np.isin(ranks, index.sets[template])
    where, start = np.unique(run[own], return_index=True)
    parts = [set(x.tolist()) for x in np.split(ranks[own], start[1:])]
    where, need, most = where.tolist(), int(index.need[template]), WINDOW_LENGTH * index.lengths[template]
    out: list[tuple[int, int, int]] = []
    for i in range(len(where)):
        before = int(words_in[where[i] - 1]) if where[i] else 0
        seen: set[int] = set()
        for j in range(i, len(where)):
            if j > i and words_in[where[j]] - before > most:
                break
            seen |= parts[j]
            if len(seen) >= need:
                if out and out[-1][1] >= where[j]:
                    out.pop()  # this one is inside it
                out.append((where[i], where[j], len(seen)))
                break
    return [x for x in out if x[0] < x[1]]


def matches_of(texts: list[str | None], index: Index, windows: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(text, first line, number of lines, template, shared words); lines from 1."""
    if not len(index.sorted_hashes):
        return []
    w = words(texts)
    at = np.minimum(np.searchsorted(index.sorted_hashes, w.hash), len(index.sorted_hashes) - 1)
    known = np.flatnonzero(index.sorted_hashes[at] == w.hash)
    rank, doc, start = index.ranks[at[known]], w.doc[known], w.start[known]
    out: list[tuple[int, int, int, int, int]] = []
    # texts that have a prefix word at all
    for d in np.unique(doc[index.in_prefix[rank]]).tolist():
        a, b = np.searchsorted(doc, [d, d + 1])
        starts, runs = _blocks(texts[d])
        line = np.searchsorted(starts, start[a:b], side="right") - 1
        mine, prefix = rank[a:b], index.in_prefix[rank[a:b]]
        found: dict[int, set[int]] = {}
        for k in np.unique(line[prefix]).tolist():
            i, j = np.searchsorted(line, [k, k + 1])
            for t, both in block_matches(np.unique(mine[i:j]), index):
                out.append((d, k + 1, 1, t, both))
                found.setdefault(int(runs[k]), set()).add(t)
        run = runs[line]
        for k in np.unique(run[prefix]).tolist():
            i, j = np.searchsorted(run, [k, k + 1])
            if line[i] == line[j - 1]:
                continue
            for t, both in block_matches(np.unique(mine[i:j]), index):
                if t not in found.get(k, ()):
                    own = np.flatnonzero(runs == k)
                    own = own[1:] if k and len(own) > 1 else own  # the blank line that begins it
                    out.append((d, int(own[0]) + 1, len(own), t, both))
        if windows and run[0] != run[-1]:
            every = w.start[slice(*np.searchsorted(w.doc, [d, d + 1]))]
            words_in = np.cumsum(np.bincount(runs[np.searchsorted(starts, every, side="right") - 1], minlength=runs[-1] + 1))
            lines = np.flatnonzero(np.diff(runs, prepend=0) == 0)  # those that aren't blank
            for t, _ in block_matches(np.unique(mine), index):
                for i, j, both in smallest_windows(words_in, run, mine, t, index):
                    first, last = int(lines[np.searchsorted(runs[lines], i)]), int(lines[np.searchsorted(runs[lines], j, side="right") - 1])
                    out.append((d, first + 1, last - first + 1, t, both))
    return out


def _counts(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = vocabulary.value, np.zeros(len(vocabulary.value), np.int64)
        for b in slices(batches):
            w = words(texts_of(b))
            at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
            hit = known[at] == w.hash
            keys = distinct(w.doc[hit] * len(known) + at[hit])
            total += np.bincount(keys % len(known), minlength=len(known))
        there = np.flatnonzero(total)
        yield pa.record_batch({"word": pa.array(known[there].view(np.int64)), "n": pa.array(total[there])})

    return run


def _matches(index, windows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Index = index.value
        for b in slices(batches):
            ids = b.column("id").to_pylist()
            rows = [(ids[d], line, n, x.names[t], both, len(x.sets[t])) for d, line, n, t, both in matches_of(texts_of(b), x, windows)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "line", "n_lines", "template", "shared", "template_words"])

    return run


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", template_words: int = TEMPLATE_WORDS, windows: bool = False) -> DataFrame:
    """doc_id, line (the block's first, from 1), n_lines, template, shared, template_words (numbers of different words).

    windows: blocks may be several paragraphs, too."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = docs.sparkSession
    rows = docs.select(whole_id(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    names, texts = zip(*sorted((TEMPLATES if templates is None else templates).items()), strict=True) if (TEMPLATES if templates is None else templates) else ((), ())
    w = words(list(texts))
    bounds = np.searchsorted(w.doc, np.arange(len(names) + 1))
    lengths = dict(zip(names, np.diff(bounds).tolist(), strict=True))
    sets = {n: distinct(np.sort(w.hash[a:b])) for n, a, b in zip(names, bounds[:-1], bounds[1:], strict=True)}
    out = spark.createDataFrame([], "doc_id long, line int, n_lines int, template string, shared int, template_words int")
    part: dict[str, np.ndarray] = {}
    parts = []
    for n, x in sets.items():
        if part and sum(map(len, part.values())) + len(x) > template_words:
            parts.append(part)
            part = {}
        part[n] = x
    for part in [*parts, part]:
        vocabulary = distinct(np.sort(np.concatenate([*part.values(), np.zeros(0, np.uint64)])))
        if not len(vocabulary):
            continue
        found = map_arrow(rows.select("text"), _counts(spark.sparkContext.broadcast(vocabulary)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        counts = dict(zip(found.word.to_numpy(np.int64).view(np.uint64).tolist(), found.n.tolist(), strict=True))
        index = spark.sparkContext.broadcast(build(part, counts, threshold, lengths))
        out = out.union(map_arrow(rows, _matches(index, windows), out.schema))
    return out.distinct()
