"""License scans: templates with optional and replaceable regions, compiled into one automaton over words.

A template is the license's wording with the public template markup: what stands between ``<<beginOptional>>`` and
``<<endOptional>>`` may be missing (regions nest), and ``<<var;name=...;words=0-20>>`` stands for so many words of any kind. All else is
mandatory: a text has the template's label if somewhere in it stand exactly these words in this order. Templates
and plain phrases become one nondeterministic automaton whose state sets are made deterministic as texts ask for
them, so a text of any length is read once, a table look-up for each word. At most ``MAX_STATES`` sets are kept; then they are forgotten and made again, which changes no result.

The score is how telling the longest wording found is: ``m / (m + 4)`` for its ``m`` mandatory words, 0 without any; a base phrase
of four words gives 0.5, a full license text about 0.98.

Null texts count as empty: no words, no labels, score 0. Rows are judged one by one, so repeated rows and null ids are
nothing special. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import bounded_batches

# Phrases of the contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The wording of public licenses and of the usual notices, with template markup.
TEMPLATES = [
    ("mit", """<<beginOptional>><<beginOptional>>The<<endOptional>> MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>> <<beginOptional>>Copyright (c) <<var;name=holder;words=0-20>> <<beginOptional>>All rights reserved.<<endOptional>><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=software;words=1-6>> and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=party;words=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", """<<var;name=verb;words=1-1>> under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>permissive<<endOptional>> MIT license"""),
    ("isc", """<<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright (c) <<var;name=holder;words=0-20>><<endOptional>>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=party;words=1-8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("bsd-2", """Redistribution and use <<beginOptional>>of this software<<endOptional>> in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY <<var;name=party;words=1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES"""),
    ("bsd-3", """Redistribution and use <<beginOptional>>of this software<<endOptional>> in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=organisation;words=1-12>> nor the names of <<var;name=whose;words=0-2>> contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<beginOptional>>http<<beginOptional>>s<<endOptional>>://www.apache.org/licenses/LICENSE-2.0<<endOptional>>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("apache-2", """<<var;name=verb;words=1-1>> under the <<beginOptional>>terms of the<<endOptional>> Apache License <<beginOptional>>Version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>"""),
    ("gpl-3", """This <<var;name=program;words=1-4>> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl-3", """<<var;name=verb;words=1-1>> under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>v3<<endOptional>> <<beginOptional>>(GPL)<<endOptional>> version 3"""),
    ("gpl-2", """This <<var;name=program;words=1-4>> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http<<beginOptional>>s<<endOptional>>://mozilla.org/MPL/2.0/"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
    ("cc-by", """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution <<var;name=version;words=0-2>> International License"""),
    ("cc-by-sa", """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution-ShareAlike <<var;name=version;words=0-2>> <<beginOptional>>International<<endOptional>> License"""),
    ("cc-by-nc", """<<var;name=verb;words=1-1>> under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons Attribution-<<endOptional>> <<beginOptional>>Attribution-<<endOptional>> <<beginOptional>>CC BY<<endOptional>> NonCommercial <<var;name=version;words=0-2>> <<beginOptional>>International<<endOptional>> License"""),
    ("cc-by-nc", """licensed under <<beginOptional>>the<<endOptional>> CC BY-NC 4.0"""),
]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_MARK = re.compile(r"<<(.*?)>>", re.DOTALL)
MAX_STATES = 20_000


def words_in(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def parse(template: str) -> list:
    """A word as a string, a replaceable region as (least, most), an optional one as a list."""
    stack: list[list] = [[]]
    for k, piece in enumerate(_MARK.split(template)):
        if k % 2 == 0:
            stack[-1] += words_in(piece)
        elif piece == "beginOptional":
            stack.append([])
        elif piece == "endOptional":
            if len(stack) == 1:
                raise ValueError(f"endOptional without beginning: {template[:40]}")
            done = stack.pop()
            stack[-1].append(done)
        else:
            least, most = re.fullmatch(r"var;.*words=(\d+)-(\d+)", piece).groups()
            stack[-1].append((int(least), int(most)))
    if len(stack) > 1:
        raise ValueError(f"beginOptional without end: {template[:40]}")
    return stack[0]


def mandatory(parts: list) -> int:
    """Words that every text of a template has in its wording; of replaceable regions none count."""
    return sum(isinstance(p, str) for p in parts)


class Machine:
    """Numbered wordings as one automaton. ``step`` gives the state set after a word; 0 is the one before any."""

    def __init__(self, wordings: list[list]) -> None:
        self.vocabulary: dict[str, int] = {}  # from 1; 0 is any other word
        self.moves: list[tuple[int, int] | None] = []  # of a state: the word it takes (-1: any) and the next state
        self.skips: list[list[int]] = []
        self.ends: dict[int, int] = {}
        starts = set()
        for k, parts in enumerate(wordings):
            first = self._state()
            starts.add(first)
            self.ends[self._add(parts, first)] = k
        self.start = self._closed(starts)
        if any(s in self.ends for s in self.start):
            raise ValueError("a template must have mandatory words")
        self.forget()

    def _state(self) -> int:
        self.moves.append(None)
        self.skips.append([])
        return len(self.moves) - 1

    def _add(self, parts: list, at: int) -> int:
        for p in parts:
            if isinstance(p, str):
                to = self._state()
                self.moves[at] = self.vocabulary.setdefault(p, len(self.vocabulary) + 1), to
            elif isinstance(p, tuple):
                chain = [at]
                for _ in range(p[1]):
                    to = self._state()
                    self.moves[chain[-1]] = -1, to
                    chain.append(to)
                to = self._state()
                for s in chain[p[0] :]:
                    self.skips[s].append(to)
            else:
                inside = self._state()
                to = self._state()
                self.skips[at] += [inside, to]
                self.skips[self._add(p, inside)].append(to)
            at = to
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def forget(self) -> None:
        self.numbers, self.sets, self.table, self.found = {self.start: 0}, [self.start], [{}], [()]

    def step(self, state: int, word: int) -> int:
        """The next state set's number, made if it isn't there. Numbers hold until sets are forgotten, which happens here only."""
        taken = {self.moves[s][1] for s in self.sets[state] if self.moves[s] and self.moves[s][0] in (-1, word)}
        after = self._closed(taken) | self.start
        if after not in self.numbers and len(self.sets) >= MAX_STATES:
            self.forget()
            state = -1
        n = self.numbers.setdefault(after, len(self.sets))
        if n == len(self.sets):
            self.sets.append(after)
            self.table.append({})
            self.found.append(tuple(sorted(self.ends[s] for s in after if s in self.ends)))
        if state >= 0:
            self.table[state][word] = n
        return n

    def scan(self, words: list[str]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(place of the last word, wordings that end there)."""
        number, state = self.vocabulary.get, 0
        for at, word in enumerate(words):
            w = number(word, 0)
            to = self.table[state].get(w)
            state = self.step(state, w) if to is None else to
            if self.found[state]:
                yield at, self.found[state]


@lru_cache(maxsize=4)
def _compiled(phrases: tuple, templates: tuple) -> tuple[Machine, list[int], list[str], list[int]]:
    """The automaton, the phrases' lengths, all labels and all numbers of mandatory words."""
    wordings = [words_in(p) for p, _ in phrases] + [parse(t) for _, t in templates]
    return Machine(wordings), [len(w) for w in wordings[: len(phrases)]], [x for _, x in phrases] + [x for x, _ in templates], [mandatory(w) for w in wordings]


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_text(text: str | None, phrases: tuple, templates: tuple) -> tuple:
    machine, lengths, labels, sizes = _compiled(phrases, templates)
    words = words_in(text)
    n, first, last, hits = 0, None, None, set()
    for at, found in machine.scan(words):
        hits.update(found)
        for k in found:
            if k < len(lengths):
                start = at - lengths[k] + 1
                n += 1
                first = start if first is None else min(first, start)
                last = start if last is None else max(last, start)
    base = sorted({labels[k] for k in hits if k < len(lengths)})
    most = max((sizes[k] for k in hits), default=0)
    return len(words), n, first, last, ",".join(base), ",".join(sorted({labels[k] for k in hits})), most / (most + 4.0) if most else 0.0


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id`` and what was found in each row's whole text."""
    bounded_batches(docs.sparkSession)
    own = tuple(phrases.items()), tuple(templates)
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([scan_text(t, *own) for t in b["text"]], columns=names).astype({"first_word": "Int64", "last_word": "Int64"})
            yield out.assign(doc_id=b["doc_id"].to_numpy())

    # The id passes through Python as text, so that null and every 64-bit number stay what they are.
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInPandas(run, f"doc_id string, {FIELDS}")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def as_regex(parts: list) -> str:
    """A wording as a regular expression over words that are each followed by a space; for the SQL twin."""
    out = ""
    for p in parts:
        out += f"{p} " if isinstance(p, str) else f"(?:[^ ]+ ){{{p[0]},{p[1]}}}" if isinstance(p, tuple) else f"(?:{as_regex(p)})?"
    return out
