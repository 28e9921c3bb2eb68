"""Licence scans: matching statistics of texts against licence templates, and chains of long matches.

The words of all templates and phrases stand in one generalised suffix automaton. A text is
streamed through it word by word: the state is at any time the longest string ending here
that stands in some template. From it follow the places of phrases and, for every template,
all matches of SEED words or more that can be extended to neither side. Matches of a
template in the same order as in it, at most GAP words apart, form chains; the chain that
covers most of the template ends a span, and a share of LEAST or more gives the template's
label.

The automaton depends on the templates only, a parameter of a few thousand words at most
(MOST_WORDS), and goes to the tasks with the code. Texts are read in blocks, of any length;
what a task holds is a text and its matches. A chain looks back over the matches of the last
GAP words and a template's length, so texts that repeat a licence many times take time in
proportion to their length.

Words are the runs of code points other than ASCII signs, blanks and controls, with A-Z in
lower case. Null text is empty: no words, no labels, score 0. Rows are independent, so
repeated rows give equal results; other columns pass through, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm._common import row_of, slices

SEED, GAP, LEAST = 4, 12, 0.8
MOST_WORDS = 20_000
#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_SIGN = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")

#: Phrases whose every place counts (fixed values).
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Notices as their publishers word them (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License."""),
    ("gpl", "licensed under the GNU General Public License, version 2"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl", "licensed under the GNU Affero General Public License, version 3"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]

SPAN = "struct<label:string,template:int,first:long,last:long,covered:int,share:double>"
FOUND = f"n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<{SPAN}>"


def word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, block by block."""
    at = 0
    while at < len(data):
        sign = _SIGN.search(data, at + BLOCK)
        end = sign.start() if sign else len(data)
        yield _WORD.findall(data[at:end].lower())
        at = end


def words(text: str) -> list[bytes]:
    return [w for block in word_lists(text.encode()) for w in block]


@dataclass
class Automaton:
    """Generalised suffix automaton of word strings.

    ``ends[s]`` are the phrases that end in state s, as (length, label); ``places[s]`` the
    (template, place of its last word, length) where a string of state s ends, each with the
    longest length in common.
    """

    ids: dict[bytes, int]
    templates: list[tuple[str, list[int]]]
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    ends: list[list[tuple[int, str]]] = field(default_factory=list)
    places: list[list[tuple[int, int, int]]] = field(default_factory=list)

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the strings that p and c lead to, apart from the longer ones of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = own
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = own
            p = self.link[p]
        return own

    def extend(self, last: int, c: int) -> int:
        """The state of the string of ``last`` and one more word."""
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][c], c)
        return new

    def step(self, s: int, n: int, c: int | None) -> tuple[int, int]:
        """State and length of the longest string that ends with one more word."""
        if c is None:
            return 0, 0
        while s and c not in self.next[s]:
            s = self.link[s]
            n = self.length[s]
        return (self.next[s][c], n + 1) if c in self.next[s] else (0, 0)


def compiled(phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> Automaton:
    """The automaton of phrases and templates, with what ends in each state."""
    lists = [(label, words(text)) for label, text in [*phrases, *templates]]
    if sum(len(ws) for _, ws in lists) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words of templates")
    if short := [ws for _, ws in lists[len(phrases) :] if len(ws) < SEED]:
        raise ValueError(f"templates have at least {SEED} words: {short}")
    ids: dict[bytes, int] = {}
    known = [(label, [ids.setdefault(w, len(ids)) for w in ws]) for label, ws in lists]
    made = Automaton(ids, known[len(phrases) :])
    for _, ws in known:
        s = 0
        for c in ws:
            s = made.extend(s, c)
    # states are only complete now: where each prefix of each string ends
    size, order = len(made.next), sorted(range(1, len(made.next)), key=made.length.__getitem__)
    ends, places = [{} for _ in range(size)], [{} for _ in range(size)]
    for k, (label, ws) in enumerate(known):
        s = n = 0
        for at, c in enumerate(ws):
            s, n = made.step(s, n, c)
            if k >= len(phrases):
                places[s][k - len(phrases), at] = made.length[s]
        if k < len(phrases) and ws:
            ends[s][len(ws), label] = True
    for s in reversed(order):  # a place of a string is one of its suffixes too
        if made.link[s]:
            for p in places[s]:
                places[made.link[s]][p] = made.length[made.link[s]]
    for s in order:  # and what ends in a suffix ends here
        up = made.link[s]
        ends[s] = {**ends[up], **ends[s]}
        places[s] = {**places[up], **places[s]}
    made.ends = [list(e) for e in ends]
    made.places = [[(t, at, n) for (t, at), n in p.items() if n >= SEED] for p in places]
    return made


Match = tuple[int, int, int]


def chains(matches: list[Match], size: int) -> list[tuple[int, int, int]]:
    """(first word, last word, covered words of the template) of chains that don't overlap, the best first; below LEAST only the best.

    Matches of a template of ``size`` words are (word of the text, word of the template, length), in order of their ends.
    """
    best: list[tuple[int, int]] = []
    begun = 0
    for k, (d, t, n) in enumerate(matches):
        top = (n, d)
        while matches[begun][0] + matches[begun][2] + GAP + size < d:
            begun += 1
        for j in range(begun, k):
            x, y, m = matches[j]
            over = max(0, x + m - d, y + m - t)
            if x < d and y < t and d - (x + m) <= GAP and over < n and best[j][0] + n - over > top[0]:
                top = (best[j][0] + n - over, best[j][1])
        best.append(top)
    taken: list[tuple[int, int, int]] = []
    for less, first, last in sorted((-covered, first, d + n - 1) for (covered, first), (d, _, n) in zip(best, matches, strict=True)):
        if taken and -less < LEAST * size:
            break
        at = bisect.bisect(taken, (first, last, 0))
        if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
            taken.insert(at, (first, last, -less))
        if -less < LEAST * size:
            break
    return taken


def scan(data: bytes, a: Automaton) -> tuple:
    """What is found in one text, in the order of FOUND."""
    n_words = n_base = s = n = 0
    first = last = None
    base: set[str] = set()
    matches: dict[int, list[Match]] = {}
    arcs, link, length, ends, places, get = a.next, a.link, a.length, a.ends, a.places, a.ids.get

    def broken(at: int, following: int | None) -> None:
        """Matches that end before word ``at`` because ``following`` doesn't follow in their template."""
        for t, e, most in places[s]:
            ws = a.templates[t][1]
            if e + 1 == len(ws) or ws[e + 1] != following:
                m = min(n, most)
                matches.setdefault(t, []).append((at - m, e - m + 1, m))

    for block in word_lists(data):
        for at, c in enumerate(map(get, block), n_words):
            if n >= SEED:
                broken(at, c)
            if c is None:
                s = n = 0
                continue
            while s and c not in arcs[s]:
                s = link[s]
                n = length[s]
            if c not in arcs[s]:
                s = n = 0
                continue
            s = arcs[s][c]
            n += 1
            for size, label in ends[s]:
                if n >= size:
                    n_base += 1
                    base.add(label)
                    first = at - size + 1 if first is None else min(first, at - size + 1)
                    last = at - size + 1 if last is None else max(last, at - size + 1)
        n_words += len(block)
    if n >= SEED:
        broken(n_words, None)
    spans, score = [], 1.0 if n_base else 0.0
    for t, found in sorted(matches.items()):
        label, ws = a.templates[t]
        for begin, end, covered in chains(found, len(ws)):
            share = covered / len(ws)
            score = max(score, share)
            if share >= LEAST:
                spans.append({"label": label, "template": t, "first": begin, "last": end, "covered": covered, "share": share})
    labels = sorted(base | {x["label"] for x in spans})
    return n_words, n_base, first, last, sorted(base), labels, score, sorted(spans, key=lambda x: (x["first"], x["template"]))


def scanned(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, keep: Iterable[str] | None = None) -> DataFrame:
    """(row, *FOUND): what each text holds; ``row`` has the columns ``keep``, all of them by default."""
    a = compiled(phrases, templates)
    row = row_of(docs if keep is None else docs.select(*keep))
    given = docs.select(row.alias("row"), F.col("text").alias("text"))
    schema = f"row {given.schema['row'].dataType.simpleString()}, {FOUND}"
    out = given.sparkSession.createDataFrame([], schema).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [scan((x.as_py() or "").encode(), a) for x in batch.column("text")]
            columns = zip(*found, strict=True) if found else [[]] * 8
            arrays = [pa.array(list(c), type=kind) for c, kind in zip(columns, KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=out.names)

    return given.mapInArrow(read, out)


_SPAN = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int32()), ("share", pa.float64())])
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(_SPAN)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scanned(docs, keep=["doc_id"])
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")
