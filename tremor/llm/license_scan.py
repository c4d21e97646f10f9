"""Licence scan: a generalised suffix automaton over licence templates, streamed for matching statistics.

The automaton holds every substring of every template (and of the base phrases) as word numbers. Streaming a file gives
at each word the longest suffix that is such a substring; where a match stops growing and is long enough it becomes a
segment. Segments are chained in file and template order into covered spans of a template, and a template whose cover
is large enough adds its label. Base phrases are read off the automaton too: a phrase ends wherever the matched string
has it as a suffix, which is so in the states below the phrase's own state on the suffix links.

Words outside the templates, and pairs of words that stand together in no template, cut every match of two words or
more, so only runs between them are streamed.

Defined results: null and empty text has 0 words, no labels, score 0 and null first_word and last_word; repeated and
null doc_ids are carried as they are; texts of any length are read whole; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.session import ship, table

PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
#: Words of a segment at least, words between chained segments at most, and what adds a label: words and share of the template.
SEGMENT, JUMP, COVER_WORDS, COVER_SHARE = 4, 60, 10, 0.4
#: Score of a file with a base phrase and no covered template, at least.
PHRASE_SCORE = 0.5
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
SPANS = "array<struct<label:string,first_word:long,last_word:long,covered:int,share:double>>"
#: Lower-cases A-Z and turns what is no word byte into a space; bytes of other letters stay.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
SLICE = 4 << 20


def split(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over sequences of word numbers (from 1)."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split(text.encode())]
        self.labels = [label for label, _ in templates]
        sequences = [number(text) for _, text in templates]
        self.sizes = [len(s) for s in sequences]
        ends = [number(text) for _, text in phrases]
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (template, position) where a state's strings end
        for t, s in enumerate(sequences + ends):
            last = 0
            for k, c in enumerate(s):
                last = self._extend(last, c)
                if t < len(sequences):
                    self.ends[last].append((t, k))
        for v in sorted(range(1, len(self.go)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]].extend(self.ends[v])
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.go]
        for p, s in enumerate(ends):
            home = 0
            for c in s:
                home = self.go[home][c]
            for v in range(1, len(self.go)):
                u = v
                while u > 0 and u != home:
                    u = self.link[u]
                if u == home:
                    self.phrases[v].append((p, len(s)))
        size = len(self.vocabulary) + 1
        self.pairs = np.zeros((size, size), bool)
        for s in sequences + ends:
            for a, b in zip(s, s[1:], strict=False):
                self.pairs[a, b] = True

    def _state(self, length: int, link: int, go: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.go.append(go)
        self.ends.append([])
        return len(self.go) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.go[last]:
            q = self.go[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.go[p]:
            self.go[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.go[q]))
        self.link[q] = clone
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = clone
            p = self.link[p]
        return clone

    def numbers(self, text: bytes | None) -> np.ndarray:
        """Number of each word of a whole text, 0 for words of no template."""
        out, text, k = [], text or b"", 0
        while k < len(text):
            piece = text[k : k + SLICE].translate(_TABLE)
            if k + SLICE < len(text) and (cut := piece.rfind(b" ")) > 0:
                piece = piece[:cut]
            elif k + SLICE < len(text):
                piece = text[k:].translate(_TABLE)
                piece = piece[: e if (e := piece.find(b" ")) > 0 else len(piece)]
            words = piece.split()
            out.append(np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words)))
            k += len(piece)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def stream(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(phrase, first word) of every phrase, and (last word, words, state) of every segment."""
        phrases, segments = [], []
        pair = self.pairs[numbers[:-1], numbers[1:]] if len(numbers) > 1 else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], pair.view(np.int8), [0]))))
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            state = length = 0
            for i, c in enumerate(numbers[begin : end + 1].tolist(), begin):
                if length >= SEGMENT and c not in self.go[state]:
                    segments.append((i - 1, length, state))
                while state and c not in self.go[state]:
                    state = self.link[state]
                    length = self.length[state]
                if c in self.go[state]:
                    state, length = self.go[state][c], length + 1
                for p, n in self.phrases[state]:
                    if length >= n:
                        phrases.append((p, i - n + 1))
            if length >= SEGMENT:
                segments.append((end, length, state))
        return phrases, segments

    def spans(self, segments: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, last word, template words covered, share) of the best chain of each template."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, state in segments:
            for t, at in self.ends[state]:
                found.setdefault(t, []).append((end - n + 1, at - n + 1, n))
        out = []
        for t, segs in found.items():
            segs = sorted(set(segs))
            best: list[tuple[int, int]] = []  # words covered by a chain that ends with the segment, and where it began
            for k, (d, a, n) in enumerate(segs):
                top = (n, d)
                for j in range(k - 1, -1, -1):
                    e, b, m = segs[j]
                    if d - (e + m) > JUMP and e + 2 * self.sizes[t] + JUMP < d:
                        break
                    over = max(0, b + m - a, e + m - d)
                    if e < d and b < a and over < n and d - (e + m) <= JUMP and best[j][0] + n - over > top[0]:
                        top = (best[j][0] + n - over, best[j][1])
                best.append(top)
            k = max(range(len(segs)), key=lambda k: (best[k][0], -best[k][1]))
            out.append((self.labels[t], best[k][1], segs[k][0] + segs[k][2] - 1, best[k][0], best[k][0] / self.sizes[t]))
        return sorted(out)


@lru_cache(maxsize=4)
def automaton(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(templates, phrases)


def scan_text(text: bytes | None, a: Automaton, phrases: tuple[tuple[str, str], ...]) -> dict:
    numbers = a.numbers(text)
    places, segments = a.stream(numbers)
    spans = a.spans(segments)
    base = {phrases[p][0] for p, _ in places}
    added = {s[0] for s in spans if s[3] >= COVER_WORDS and s[4] >= COVER_SHARE}
    starts = [i for _, i in places]
    score = max([PHRASE_SCORE if base else 0.0, *(min(1.0, s[4]) for s in spans if s[0] in added | base)])
    return {
        "n_words": len(numbers), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | added)), "score": score,
        "spans": [dict(zip(("label", "first_word", "last_word", "covered", "share"), s, strict=True)) for s in spans],
    }


def scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans of templates in the text."""
    ship(docs.sparkSession)
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int32()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(templates, phrases)
        for batch in batches:
            rows = [scan_text(t.as_py(), a, phrases) for t in batch.column(1)]
            columns = [pa.array([r[n] for r in rows], type=k) for n, k in [*kinds, ("spans", span)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(n for n, _ in kinds), "spans"])

    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
