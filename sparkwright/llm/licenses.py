"""License scans by template-markup matching.

A template is mandatory wording with marked regions: [ ... ] may be missing, ( a | b ) is one of several wordings
and {n} stands for up to n words of any kind. All templates are compiled into one token automaton, which is made
deterministic state by state as texts need it, and a place of a text is accepted if the mandatory wording matches
word for word. Texts are lower-cased in A-Z and cut into words of digits, a-z and all beyond ASCII.

BASE holds plain phrases, which are templates too; their places are always reported. A whole license is accepted only
with all of its mandatory wording in its place; an opening that stands alone, or with other conditions after it, has a
label of its own. Versions are mandatory in notices.

Null and empty texts have no words and no matches. Every row is scanned on its own, so repeated rows have equal
matches; an empty table gives no rows. The result has columns of its own only, whatever the table's are called.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkwright.llm.common import documents, lower_text, map_arrow

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases of the contract and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software without restriction"
_MIT_RIGHTS = "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_MIT_NOTICE = "the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software"
_MIT_DISCLAIMER = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and (noninfringement | non infringement) "
    "in no event shall (the authors or copyright holders | {8}) be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "[1 | a | i] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "[2 | b | ii] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "[3 | c | iii] neither the (name | names) of (the copyright holder | {12}) nor the names of (its | the | their) contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_DISCLAIMER = (
    "this software is provided by (the copyright holders and contributors | {12}) as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall (the copyright holder or contributors | the copyright owner or contributors | {12}) be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_FREE = "this program is free software you can redistribute it and or modify it under the terms of the gnu"
_PUBLISHED = "[as published by the free software foundation] [either] (version | v)"

#: Templates of whole license texts and of notices that name a license and its version. The wording of
#: the licenses, and their usual short names as labels; "-grant" marks an opening that stands without the rest.
TEMPLATES = {
    f"{_GRANT} {_MIT_RIGHTS} {_MIT_NOTICE} {_MIT_DISCLAIMER}": "mit",
    f"{_GRANT} {_MIT_RIGHTS} {_MIT_DISCLAIMER}": "mit-0",
    _GRANT: "mit-grant",
    "(released | licensed | distributed | available) under the [terms of the] mit license": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and {6} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall {6} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc",
    f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_DISCLAIMER}": "bsd-2",
    f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_DISCLAIMER}": "bsd-3",
    _BSD_GRANT: "bsd-grant",
    "licensed under the apache license version 2 [0] [the license]": "apache-2",
    "licensed to {8} under one or more contributor license agreements see the notice file distributed with this work for additional information regarding copyright ownership "
    "{8} licenses this file to you under the apache license version 2 [0] [the license]": "apache-2",
    f"gnu general public license {_PUBLISHED} 2": "gpl-2",
    f"gnu general public license {_PUBLISHED} 3": "gpl-3",
    f"{_FREE} general public license {_PUBLISHED} 2 [of the license] or at your option any later version": "gpl-2-or-later",
    f"{_FREE} general public license {_PUBLISHED} 3 [of the license] or at your option any later version": "gpl-3-or-later",
    f"gnu (lesser | library) general public license {_PUBLISHED} 2 [0]": "lgpl-2",
    f"gnu lesser general public license {_PUBLISHED} 2 1": "lgpl-2-1",
    f"gnu lesser general public license {_PUBLISHED} 3": "lgpl-3",
    f"gnu affero general public license {_PUBLISHED} 3": "agpl-3",
    "mozilla public license [(version | v)] 2 0": "mpl-2",
    "creative commons attribution (2 0 | 2 5 | 3 0 | 4 0) [international | unported | generic] (license | licence)": "cc-by",
    "creative commons attribution (sharealike | share alike) (2 0 | 2 5 | 3 0 | 4 0) [international | unported | generic] (license | licence)": "cc-by-sa",
    "creative commons attribution (noncommercial | non commercial)": "cc-by-nc",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
}

_tokens = re.compile(LICENSE_WORD).findall
_markup = re.compile(r"\[|\]|\(|\)|\||\{\d+\}|[^\s\[\](){}|]+").findall

ANY = None  # the edge of a replaceable word


class Automaton:
    """A token automaton of many templates; the label of an accepting state is its template's number."""

    def __init__(self, templates: list[str]):
        self.edges: list[list[tuple[str | None, int]]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        start = self._state()
        for number, template in enumerate(templates):
            at = self._state()
            self.free[start].append(at)
            items = _markup(template)
            end, used = self._choice(items, 0, at)
            if used != len(items):
                raise ValueError(f"unbalanced markup: {template}")
            self.accepts[end] = number
        self.words = {w for edges in self.edges for w, _ in edges if w is not ANY}
        self.start = self._close({start})
        if any(s in self.accepts for s in self.start):
            raise ValueError("a template without mandatory wording")
        self.firsts = {w for s in self.start for w, _ in self.edges[s] if w is not ANY}
        self.steps: dict[tuple[frozenset[int], str | None], frozenset[int]] = {}

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _choice(self, items: list[str], i: int, at: int) -> tuple[int, int]:
        end = self._state()
        while True:
            last, i = self._sequence(items, i, at)
            self.free[last].append(end)
            if i < len(items) and items[i] == "|":
                i += 1
            else:
                return end, i

    def _sequence(self, items: list[str], i: int, at: int) -> tuple[int, int]:
        while i < len(items) and items[i] not in ("|", "]", ")"):
            item, before = items[i], at
            if item in ("[", "("):
                at, i = self._choice(items, i + 1, at)
                if i == len(items) or items[i] != {"[": "]", "(": ")"}[item]:
                    raise ValueError("unbalanced markup")
                if item == "[":
                    self.free[before].append(at)
            elif item[0] == "{":
                for _ in range(int(item[1:-1])):
                    after = self._state()
                    self.edges[at].append((ANY, after))
                    self.free[at].append(after)
                    at = after
            else:
                at = self._state()
                self.edges[before].append((item, at))
            i += 1
        return at, i

    def _close(self, states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def step(self, states: frozenset[int], word: str) -> frozenset[int]:
        key = (states, word if word in self.words else None)
        if key not in self.steps:
            self.steps[key] = self._close({t for s in states for w, t in self.edges[s] if w is ANY or w == key[1]})
        return self.steps[key]

    def find(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(template, first word, end) of the longest match of each template at each place."""
        out = []
        for i in [i for i, w in enumerate(words) if w in self.firsts]:
            states, best, j = self.start, {}, i
            while states and j < len(words):
                states = self.step(states, words[j])
                j += 1
                for s in states:
                    if s in self.accepts:
                        best[self.accepts[s]] = j
            out += [(template, i, end) for template, end in sorted(best.items())]
        return out


@lru_cache(4)
def compiled(templates: tuple[str, ...]) -> Automaton:
    return Automaton(list(templates))


def license_words(text: str) -> list[str]:
    return _tokens(lower_text(text))


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, matches and score of every whole text.

    matches: label, whether it is a base phrase, first word and end (words from 0), in the order of places. score
    is the share of words inside matches.
    """
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    wording = (*base, *templates)
    labels = [*base.values(), *templates.values()]
    n_base = len(base)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = compiled(wording)
        counts, matches, scores = [], [], []
        for text in batch.column(1):
            words = license_words(text.as_py())
            found = automaton.find(words)
            covered, end = 0, 0
            for _, a, b in found:
                covered += max(0, b - max(a, end))
                end = max(end, b)
            counts.append(len(words))
            matches.append([{"label": labels[t], "base": t < n_base, "first": a, "end": b} for t, a, b in found])
            scores.append(covered / max(1, len(words)))
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(matches, kind), pa.array(scores, pa.float64())], ["doc_id", "n_words", "matches", "score"])

    return map_arrow(documents(docs, id_col, text_col), run, "doc_id long, n_words long, matches array<struct<label:string,base:boolean,first:long,end:long>>, score double")
