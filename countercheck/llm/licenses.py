"""License wording found by templates that are compiled into token automata.

A template is plain text with two kinds of marked regions: ``{...}`` may be
absent, and ``<name:2-8>`` stands for any 2 to 8 words. All other words are
mandatory and have to follow each other exactly. All templates and base phrases
become one nondeterministic automaton over words, whose sets of states are
turned into deterministic ones when a text first reaches them. Regions are
bounded, so a place is decided within the length of the longest template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countercheck.llm.support import put, small_batches

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Fixed values: (label, template) of notices and of license texts.
TEMPLATES = (
    ("mit", "{released} {licensed} under the {terms of the} MIT License"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice {(including the next
        paragraph)} shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <holder:1-12> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE""",
    ),
    ("apache-2.0", "Licensed under the Apache License, {(the License),} Version 2.0"),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License""",
    ),
    ("gpl-3.0", "licensed under the {terms of the} GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the {terms of the} GNU General Public License, version 2"),
    (
        "gpl-3.0-or-later",
        """is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version""",
    ),
    (
        "gpl-2.0-or-later",
        """is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version""",
    ),
    ("lgpl-3.0", "licensed under the {terms of the} GNU Lesser General Public License, version 3"),
    ("cc-by-4.0", "licensed under {a} {the} {Creative Commons} {Attribution} CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under {a} {the} {Creative Commons} CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under {a} {the} {Creative Commons} CC BY-NC 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: {1.} Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. {2.} Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. {{3.} Neither the name of
        <organisation:1-12> nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission.} THIS SOFTWARE IS PROVIDED BY
        <holder:1-12> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at {http} {https}://mozilla.org/MPL/2.0/""",
    ),
    ("all-rights-reserved", "All rights reserved"),
)

#: Which bytes are in words: digits, a-z, and all of characters beyond ASCII. A-Z turn to a-z, the rest to blanks.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
PIECE = 1 << 20  # bytes whose words are held at a time

Region = tuple  # ("word", word), ("any", least, most) or ("maybe", regions)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


def parse(template: str) -> list[Region]:
    """The regions of a template, in order. Raises ValueError for one that is not well formed."""
    open_regions: list[list[Region]] = [[]]
    for sign in re.findall(r"[{}]|<[^<>]*>|[^{}<>]+", template):
        if sign == "{":
            open_regions.append([])
        elif sign == "}":
            if len(open_regions) == 1:
                raise ValueError(f"a region ends that was not begun: {template[:60]!r}")
            inner = open_regions.pop()
            open_regions[-1].append(("maybe", inner))
        elif sign[0] == "<":
            bounds = re.fullmatch(r"<[^:]*:([0-9]+)-([0-9]+)>", sign)
            if not bounds or int(bounds[1]) > int(bounds[2]):
                raise ValueError(f"no bounds in {sign!r}")
            open_regions[-1].append(("any", int(bounds[1]), int(bounds[2])))
        else:
            open_regions[-1] += [("word", w) for w in words_of(sign)]
    if len(open_regions) > 1:
        raise ValueError(f"a region does not end: {template[:60]!r}")
    return open_regions[0]


class Automaton:
    """All templates as one automaton over words.

    A state is a number; ``step`` has for each one what a word leads to, with
    None for any word; ``skip`` leads on without a word; ``accepts`` names the
    template that ends there. Sets of states that texts reach are numbered in
    ``sets``, with their moves filled in as they are needed: a word that is in no
    template moves like any other such word, so there are finitely many.
    """

    def __init__(self, templates: Sequence[str]):
        self.step: list[dict[bytes | None, int]] = []
        self.skip: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        self.vocabulary: set[bytes] = set()
        starts, self.longest = [], 0
        for number, template in enumerate(templates):
            regions = parse(template)
            start = self._state()
            self.accepts[self._build(start, regions)] = number
            starts.append(start)
            self.longest = max(self.longest, _most(regions))
        self.sets: list[frozenset[int]] = []
        self.moves: list[dict[bytes | None, int]] = []
        self.ends: list[tuple[int, ...]] = []
        self.number: dict[frozenset[int], int] = {}
        self.dead = self._set(frozenset())
        self.start = self._set(self._closed(starts))
        if self.ends[self.start] or any(None in self.step[s] for s in self.sets[self.start]):
            raise ValueError("a template has to begin with a mandatory word")
        #: What the first word of a place leads to; no other word begins one.
        self.first = {w: self._move(self.start, w) for s in self.sets[self.start] for w in self.step[s]}

    def _state(self) -> int:
        self.step.append({})
        self.skip.append([])
        return len(self.step) - 1

    def _build(self, at: int, regions: list[Region]) -> int:
        """Adds the regions after state ``at``; returns the state they end in."""
        for kind, *more in regions:
            if kind == "word":
                new = self._state()
                self.step[at][more[0]] = new
                self.vocabulary.add(more[0])
                at = new
            elif kind == "any":
                least, most = more
                exits = [at] if not least else []
                for k in range(1, most + 1):
                    new = self._state()
                    self.step[at][None] = new
                    at = new
                    if k >= least:
                        exits.append(at)
                at = self._join(exits)
            else:
                at = self._join([self._build(self._join([at]), more[0]), at])
        return at

    def _join(self, states: list[int]) -> int:
        new = self._state()
        for s in states:
            self.skip[s].append(new)
        return new

    def _closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _set(self, states: frozenset[int]) -> int:
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.ends.append(tuple(sorted(self.accepts[s] for s in states if s in self.accepts)))
        return self.number[states]

    def _move(self, at: int, word: bytes) -> int:
        known = word if word in self.vocabulary else None
        if known not in self.moves[at]:
            to = [self.step[s][k] for s in self.sets[at] for k in {known, None} if k in self.step[s]]
            self.moves[at][known] = self._set(self._closed(to))
        return self.moves[at][known]

    def places(self, words: list[bytes], low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """(template, start, stop) of the longest place of each template at each start in low..high-1."""
        first, size = self.first, len(words)
        for i in [i for i in range(low, high) if words[i] in first]:
            state, j, found = first[words[i]], i + 1, {}
            while state != self.dead:
                for template in self.ends[state]:
                    found[template] = j
                if j == size:
                    break
                state = self._move(state, words[j])
                j += 1
            for template in sorted(found):
                yield template, i, found[template]


def _most(regions: list[Region]) -> int:
    """Words of the longest text that the regions match."""
    return sum(1 if kind == "word" else more[1] if kind == "any" else _most(more[0]) for kind, *more in regions)


def _blocks(text: str) -> Iterator[list[bytes]]:
    """The words of a text, those of about PIECE bytes at a time."""
    data, start = text.encode().translate(WORDS), 0
    while start < len(data):
        stop = data.find(b" ", start + PIECE)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


class Scanner:
    """Finds places of phrases and templates in whole texts."""

    def __init__(self, phrases: Mapping[str, str], templates: Sequence[tuple[str, str]]):
        self.automaton = Automaton([*phrases, *(t for _, t in templates)])
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.phrases = len(phrases)

    def scan(self, text: str) -> tuple[int, list[tuple[str, bool, int, int]]]:
        """Number of words, and (label, whether a template, first word, word after the last) of all places.

        Places of phrases are all reported. Of a template, a place that lies
        within the one before it, as left by skipping an optional region, is not.
        """
        found, words, gone, reach = [], [], 0, {}
        ahead = self.automaton.longest
        blocks = _blocks(text)
        more = True
        while more:
            block = next(blocks, None)
            more = block is not None
            words += block or []
            high = max(0, len(words) - ahead) if more else len(words)
            for number, a, b in self.automaton.places(words, 0, high):
                if number >= self.phrases:
                    if gone + b <= reach.get(number, 0):
                        continue
                    reach[number] = gone + b
                found.append((self.labels[number], number >= self.phrases, gone + a, gone + b))
            del words[:high]
            gone += high
        return gone, found


_PLACES = pa.list_(
    pa.struct([("label", pa.string()), ("template", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64())])
)
_FOUND = pa.struct([("words", pa.int64()), ("places", _PLACES)])


@cache
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(phrases), templates)


def find(
    df: DataFrame,
    text: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """Add ``license words``, the number of words, and ``license places`` to each row.

    A place has ``label``, ``template`` (false for a base phrase), ``start`` and
    ``stop``, counted in words. Words are runs of digits, letters and characters
    beyond ASCII, with A-Z lower-cased. Whole texts of any length are read, a
    block at a time; null and empty ones have no words and no places. Rows and
    other columns stay, repeated rows are alike; columns called like the new
    ones are replaced.
    """
    small_batches(df.sparkSession)
    known = tuple(phrases.items()), tuple(templates)
    Scanner(phrases, templates)  # raises here if a template is wrong

    @F.arrow_udf("struct<words: long, places: array<struct<label: string, template: boolean, start: long, stop: long>>>")
    def scan(texts: pa.Array) -> pa.Array:
        scanner = _scanner(*known)
        counts, places = [], []
        for value in texts:
            n, found = scanner.scan(value.as_py() or "")
            counts.append(n)
            places.append([dict(zip(("label", "template", "start", "stop"), x, strict=True)) for x in found])
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(places, _PLACES)], fields=list(_FOUND))

    found = put(df, {"license found": scan(F.col(f"`{text}`"))})
    both = {"license words": F.col("license found.words"), "license places": F.col("license found.places")}
    return put(found, both).drop("license found")


def label_text(places: Column) -> Column:
    """Distinct labels of places, sorted, with commas between them."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def pattern(template: str) -> str:
    """A regular expression that finds the same wording among words that each have one blank after them."""

    def built(regions: list[Region]) -> str:
        out = ""
        for kind, *more in regions:
            if kind == "word":
                out += re.escape(more[0].decode()) + " "
            elif kind == "any":
                out += "(?:[^ ]+ ){" + f"{more[0]},{more[1]}" + "}"
            else:
                out += f"(?:{built(more[0])})?"
        return out

    return built(parse(template))
