"""License scans by template markup.

A template is wording with markup: `[...]` encloses words that may be missing, `{n}`
stands for up to n words of any kind (a name, a year, a list of holders). Templates are
compiled to one token automaton: a non-deterministic machine over words, determined step
by step as texts need it. A place matches where the mandatory wording stands word for word.

Scale: no shuffle; the automaton is built from fixed templates and grows by its own states
only. Texts are read whole, words are found once, and the machine runs from the words
that can begin a template.

Defined results: a null or empty text has no words, no places, no labels and score 0. Texts of any length are read whole, a list of
their words at a time; rows that repeat each get a row. Further columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import map_texts

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: The phrases whose places are counted, with their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Wording of public licenses, whole, and of the notices that name them.
TEMPLATES = (
    ("mit", "[released] [licensed] [distributed] under [the terms of] the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {20} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "licensed under [the terms of] [the] apache license [version] 2 [0] [the license]"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [http] [https] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3", "licensed under [the terms of] the gnu general public license [as published by the free software foundation] [either] version 3 [of the license] [or [at your option] any later version]"),
    ("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [either] version 3"),
    ("gpl-2", "licensed under [the terms of] the gnu general public license [as published by the free software foundation] [either] version 2 [of the license] [or [at your option] any later version]"),
    ("lgpl-3", "licensed under [the terms of] the gnu lesser general public license [either] version 3 [of the license]"),
    ("agpl-3", "licensed under [the terms of] the gnu affero general public license [either] version 3 [of the license]"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by {20} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {20} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [3] neither the name of {20} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by {20} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {20} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {8} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {20} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("cc-by-nc", "licensed under [a] [the] cc by nc [4 0] [international] [license]"),
    ("cc-by-nc", "licensed under [a] [the] creative commons attribution non commercial [4 0] [international]"),
    ("cc-by-nc", "licensed under [a] [the] creative commons attribution noncommercial [4 0] [international]"),
    ("cc-by-sa", "licensed under [a] [the] cc by sa [4 0] [international] [license]"),
    ("cc-by", "licensed under [a] [the] cc by 4 0 [international] [license]"),
    ("cc0", "licensed under [the] cc0 1 0 [universal]"),
    ("public-domain", "this work is [hereby] dedicated to the public domain"),
    ("all-rights-reserved", "copyright {40} all rights reserved"),
)


class Automaton:
    """Templates as one machine over words. States of the determined machine are sets of raw states."""

    OTHER = b""

    def __init__(self, templates):
        self.step: list[dict[bytes, int]] = []  # raw state -> word -> raw state
        self.free: list[list[int]] = []  # moves without a word
        self.skip: list[int] = []  # move on any word, or -1
        self.accepts: dict[int, int] = {}  # raw state -> template
        self.labels = [label for label, _ in templates]
        self.mandatory = []
        start = self._state()
        for number, (_, wording) in enumerate(templates):
            tokens = re.findall(r"[\[\]]|\{\d+\}|[^\s\[\]{}]+", wording)
            at = self._state()
            self.free[start].append(at)
            end, rest, must = self._sequence(tokens, 0, at, 0)
            if rest != len(tokens):
                raise ValueError(f"unbalanced markup: {wording}")
            self.accepts[end] = number
            self.mandatory.append(must)
        self.words = {w for moves in self.step for w in moves}
        self.sets: list[frozenset[int]] = []
        self.number: dict[frozenset[int], int] = {}
        self.moves: list[dict[bytes, int]] = []
        self.found: list[tuple[int, ...]] = []
        self.start = self._set({start})
        self.first = frozenset(w for raw in self.sets[self.start] for w in self.step[raw])

    def _state(self) -> int:
        self.step.append({})
        self.free.append([])
        self.skip.append(-1)
        return len(self.step) - 1

    def _sequence(self, tokens, i, at, depth):
        """Compile tokens from `i` up to the end or the bracket that closes this level."""
        must = 0
        while i < len(tokens) and tokens[i] != "]":
            token, i = tokens[i], i + 1
            if token == "[":
                end, i, _ = self._sequence(tokens, i, at, depth + 1)
                if i >= len(tokens):
                    raise ValueError("a bracket is not closed")
                i += 1
                joined = self._state()
                self.free[end].append(joined)
                self.free[at].append(joined)
                at = joined
            elif token[0] == "{":
                out = self._state()
                self.free[at].append(out)
                for _ in range(int(token[1:-1])):
                    step = self._state()
                    self.skip[at] = step
                    self.free[step].append(out)
                    at = step
                at = out
            else:
                new = self._state()
                self.step[at][token.encode()] = new
                at, must = new, must + 1
        return at, i, must

    def _set(self, raw) -> int:
        todo, closed = list(raw), set(raw)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in closed:
                    closed.add(x)
                    todo.append(x)
        key = frozenset(closed)
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.found.append(tuple(sorted(self.accepts[x] for x in key if x in self.accepts)))
        return self.number[key]

    def move(self, state: int, word: bytes) -> int:
        """The next state, or -1."""
        if word not in self.words:
            word = self.OTHER
        known = self.moves[state].get(word)
        if known is None:
            raw = {t for x in self.sets[state] for t in (self.step[x].get(word, -1), self.skip[x]) if t >= 0}
            known = self.moves[state][word] = self._set(raw) if raw else -1
        return known

    def places(self, words: list[bytes]):
        """(template, first word, words spanned at most) wherever a template matches."""
        first, move, found = self.first, self.move, self.found
        for i, word in enumerate(words):
            if word in first:
                state, j, ends = self.start, i, {}
                while j < len(words):
                    state = move(state, words[j])
                    if state < 0:
                        break
                    j += 1
                    for number in found[state]:
                        ends[number] = j - i
                for number, span in ends.items():
                    yield number, i, span

    def accepts_text(self, words: list[bytes]) -> set[str]:
        """Labels of templates that the words match from first to last."""
        state = self.start
        for word in words:
            state = self.move(state, word)
            if state < 0:
                return set()
        return {self.labels[x] for x in self.found[state]}


def scan_words(automaton: Automaton, n_base: int, words: list[bytes]) -> tuple:
    """n_base, first_word, last_word, base_labels, labels, score; the first `n_base` templates are base phrases."""
    count, starts, base, labels, most = 0, [], set(), set(), 0
    for number, at, _ in automaton.places(words):
        labels.add(automaton.labels[number])
        most = max(most, automaton.mandatory[number])
        if number < n_base:
            count += 1
            starts.append(at)
            base.add(automaton.labels[number])
    score = 1.0 - 0.5 ** (most / 2) if most else 0.0
    return count, min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 - 2^(-m/2), m being the mandatory words of the longest wording found.
    """
    everything = tuple(base) + tuple(templates)

    def make():
        automaton = Automaton(everything)

        def work(texts):
            rows = []
            for raw in texts:
                words = WORD.findall(raw.lower())
                rows.append((len(words), *scan_words(automaton, len(base), words)))
            return list(zip(*rows))

        return work

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_texts(docs, ["doc_id"], fields, make)


def _regex(wording: str) -> str:
    """Markup as a regular expression over words that each follow a space."""
    parts = {"[": "(?:", "]": ")?"}
    tokens = re.findall(r"[\[\]]|\{\d+\}|[^\s\[\]{}]+", wording)
    return "".join(parts.get(t) or (f"(?: [^ ]+){{0,{t[1:-1]}}}" if t[0] == "{" else f" {t}") for t in tokens) + " "


def oracle_sql(base=BASE, templates=TEMPLATES) -> str:
    """The same by regular expressions over the words, joined by spaces."""
    automaton = Automaton(tuple(base) + tuple(templates))
    everything = [(label, _regex(wording), must) for (label, wording), must in zip((*base, *templates), automaton.mandatory)]
    spots = " union all ".join(
        f"select r, '{label}' as label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()})) as place from words" for label, p in base
    )
    marks = " union all ".join(f"select r, '{label}' as label, {must} as must from words where regexp_matches(j, '{pattern}')" for label, pattern, must in everything)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with words as (
  select *, ' ' || array_to_string(w, ' ') || ' ' as j from (
    select row_number() over () as r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents)),
spots as ({spots}),
marks as ({marks}),
b as (select r, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from spots group by r),
m as (select r, string_agg(distinct label, ',' order by label) as labels, max(must) as must from marks group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, case when must is null then 0.0 else 1.0 - pow(0.5, must / 2.0) end::double as score
from words left join b using (r) left join m using (r)"""


ORACLE = oracle_sql()
