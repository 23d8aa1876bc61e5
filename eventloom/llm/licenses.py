"""Licence scans by template-markup matching.

A template is mandatory wording with markup: [[ ... ]] is optional, (a|b) is one of several wordings, {n} is up to n words of
any kind (a name, a year, a holder). Templates compile to one automaton over words; a text is accepted where the mandatory
wording stands exactly, in order, with nothing between but what the markup allows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import ALNUM, byte_column, chunks, span_hashes, spans

#: Phrases and the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of public licences and their notices, by label.
TEMPLATES = {
    "mit": [
        "(released|licensed|distributed|available|published) under the [[terms of the]] mit license",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
        software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to
        permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
        express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        (the authors or copyright holders|{8}) be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
        connection with the software or the use or other dealings in the software""",
    ],
    "apache": [
        "licensed under the apache license [[version 2 0]] [[the license]]",
        "(released|distributed|available|published) under the [[terms of the]] apache license",
        """licensed under the apache license version 2 0 the license you may not use (this file|this work|{4}) except in compliance with the license you may obtain a copy of the
        license at (http|https) www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions
        and limitations under the license""",
    ],
    "gpl": [
        "this (work|program|software|library|file|package) is [[free software]] licensed under the [[terms of the]] gnu [[lesser|affero]] general public license [[version (1|2|3)]]",
        "(released|licensed|distributed|published) under the [[terms of the]] gnu general public license",
        """(this program|this file|this library|{4}) is free software you can redistribute it and or modify it under the terms of the gnu general public license [[as published by the free
        software foundation]] either version (1|2|3) of the license or [[at your option]] any later version [[this program|{4}]] is distributed in the hope that it will be useful but without any
        warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details""",
    ],
    "lgpl": [
        "under the [[terms of the]] gnu (lesser|library) general public license",
        """(this library|this program|{4}) is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license as published by the
        free software foundation either version (2|2 1|3) of the license or [[at your option]] any later version""",
    ],
    "agpl": ["under the [[terms of the]] gnu affero general public license [[as published by the free software foundation either version 3 of the license]]"],
    "bsd": [
        "(released|licensed|distributed) under the [[new|simplified|modified]] [[(2|3|4) clause]] bsd license",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source
        code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice
        this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[ [[3]] [[neither]] the (name|names) of {12}
        (may|nor the names of its contributors may) [[not]] be used to endorse or promote products derived from this software without specific prior written permission]] this software is
        provided by (the copyright holders and contributors|{10}) as is and any express or implied warranties including but not limited to the implied warranties of merchantability
        and fitness for a particular purpose are disclaimed""",
    ],
    "isc": [
        "(released|licensed|distributed) under the isc license",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
        permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness""",
    ],
    "zlib": [
        """this software is provided as is without any express or implied warranty in no event will (the authors|{6}) be held liable for any damages arising from the use of this
        software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the
        following restrictions""",
    ],
    "mpl": [
        "[[this source code form is]] subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at (http|https) mozilla org mpl 2 0]]",
        "(released|licensed|distributed) under the mozilla public license",
    ],
    "cc-by": ["licensed under [[a|the]] cc by (1|2|3|4) (0|5)", "licensed under [[a|the]] creative commons attribution [[(1|2|3|4) (0|5)]] [[international|unported|generic]] license"],
    "cc-by-sa": ["licensed under [[a|the]] cc by sa", "licensed under [[a|the]] creative commons attribution sharealike"],
    "cc-by-nc": ["licensed under [[a|the]] cc by nc", "licensed under [[a|the]] creative commons attribution noncommercial"],
    "cc-by-nd": ["licensed under [[a|the]] cc by nd", "licensed under [[a|the]] creative commons attribution noderivatives"],
    "cc0": ["(released|licensed|dedicated|published) under [[the]] cc0", "dedicated to the public domain under cc0"],
    "unlicense": [
        """this is free and unencumbered software released into the public domain [[anyone is free to copy modify publish use compile sell or distribute this software either in source code form
        or as a compiled binary for any purpose commercial or non commercial and by any means]]""",
    ],
    "all-rights-reserved": ["copyright [[c]] {6} all rights reserved"],
}

_MARKUP = re.compile(r"\[\[|\]\]|\{\d+\}|[()|]|[^\s\[\]{}()|]+")


class Automaton:
    """All templates as one automaton over words. States are numbers; `steps[s]` has a word's next states, `free[s]` those
    after any word, both closed over what needs no word; `labels[s]` says whose template ends in a state."""

    def __init__(self, templates: dict[str, list[str]]):
        self.steps: list[dict[str, set[int]]] = []
        self.free: list[set[int]] = []
        self.skips: list[set[int]] = []
        self.labels: dict[int, str] = {}
        starts = []
        for label, each in templates.items():
            for template in each:
                at = self._new()
                starts.append(at)
                self.labels[self._choice(_MARKUP.findall(template)[::-1], at)] = label
        closed = [self._closed({s}) for s in range(len(self.steps))]
        join = lambda states: frozenset(x for s in states for x in closed[s])
        self.steps = [{w: join(to) for w, to in each.items()} for each in self.steps]
        self.free = [join(to) for to in self.free]
        self.starts = join(starts)
        #: Which states a word leads to from any start.
        self.begin: dict[str, frozenset[int]] = {}
        for s in self.starts:
            for w, to in self.steps[s].items():
                self.begin[w] = self.begin.get(w, frozenset()) | to

    def _new(self) -> int:
        for x in (self.steps, self.free, self.skips):
            x.append({} if x is self.steps else set())
        return len(self.steps) - 1

    def _choice(self, tokens: list[str], at: int) -> int:
        """Reads alternatives up to a closing bracket; the state in which they end."""
        end, now = self._new(), at
        while tokens and (t := tokens.pop()) not in (")", "]]"):
            if t == "|":
                self.skips[now].add(end)
                now = at
            elif t in ("(", "[["):
                to = self._choice(tokens, inner := self._after(now))
                if t == "[[":
                    self.skips[inner].add(to)
                now = to
            elif t[0] == "{":
                to = self._new()
                self.skips[now].add(to)
                for _ in range(int(t[1:-1])):
                    step = self._new()
                    self.free[now].add(step)
                    self.skips[step].add(to)
                    now = step
                now = to
            else:
                to = self._new()
                self.steps[now].setdefault(t, set()).add(to)
                now = to
        self.skips[now].add(end)
        return end

    def _after(self, at: int) -> int:
        to = self._new()
        self.skips[at].add(to)
        return to

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def accepted(self, words: list[str]) -> set[str]:
        """Labels of the templates that match anywhere: one pass, in which every match under way is a state, so the work of
        a word is bounded by the number of states."""
        found: set[str] = set()
        now: frozenset[int] = frozenset()
        for w in words:
            begun = self.begin.get(w)
            if now:
                to = set(begun or ())
                for s in now:
                    if x := self.steps[s].get(w):
                        to |= x
                    to |= self.free[s]
                now = frozenset(to)
            elif begun:
                now = begun
            if now:
                found.update(self.labels[s] for s in now if s in self.labels)
        return found


def mandatory(template: str) -> list[str]:
    """A template's words outside all markup."""
    words, depth = [], 0
    for t in _MARKUP.findall(template):
        depth += (t in ("(", "[[")) - (t in (")", "]]"))
        if not depth and t[0] not in "{()|]":
            words.append(t)
    return words


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.machine = Automaton(templates)
        # any one mandatory word tells which texts can match; the longest is the rarest
        anchors = {p[-1] for p, _ in self.phrases} | {max(mandatory(t), key=len) for each in templates.values() for t in each}
        blob = b" ".join(sorted(a.encode() for a in anchors))
        data = np.frombuffer(blob, np.uint8)
        starts, ends, _ = spans(data, np.array([0, len(data)]), ALNUM)
        self.anchors = np.sort(span_hashes(data, starts, ends))

    def scan(self, words: list[str]) -> tuple[list[int], set[str], set[str]]:
        """The places of phrases, their labels, the templates' labels."""
        places, base = [], set()
        for p, label in self.phrases:
            for i, w in enumerate(words):
                if w == p[0] and words[i : i + len(p)] == p:
                    places.append(i)
                    base.add(label)
        return places, base, self.machine.accepted(words)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        text, at = byte_column(batch.column("text"))
        for lo, hi, data, own in chunks(text, at):
            starts, ends, row = spans(data, own, ALNUM)
            h = span_hashes(data, starts, ends)
            hit = scanner.anchors[np.minimum(np.searchsorted(scanner.anchors, h), len(scanner.anchors) - 1)] == h
            rows = np.unique(np.searchsorted(row, np.flatnonzero(hit), "right") - 1)
            n = hi - lo
            counts = [0] * n
            first, last, score = [None] * n, [None] * n, [0.0] * n
            base, labels = [""] * n, [""] * n
            for i in rows.tolist():
                words = _WORD.findall(data[own[i] : own[i + 1]].tobytes().decode("utf-8", "replace").translate(_LOWER))
                places, own_base, found = scanner.scan(words)
                counts[i] = len(places)
                if places:
                    first[i], last[i] = min(places), max(places)
                base[i], labels[i] = ",".join(sorted(own_base)), ",".join(sorted(own_base | found))
                score[i] = 1.0 if found else 0.5 if own_base else 0.0
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, n), pa.array(np.diff(row), long), pa.array(counts, long), pa.array(first, long), pa.array(last, long), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text).

    score is 1 where a template matches, 0.5 where only a phrase stands, else 0. Null and empty texts have no words, no
    labels and score 0. Rows stand for themselves, whatever their doc_id. An empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_scanned, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
