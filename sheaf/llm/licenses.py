"""License scan by template-markup matching.

A template is the wording of a notice with markup: <<optional>>...<<end>> may be left out, <<var;N>> stands for up to N words
of any kind, <<any;a|b|c d>> for one of some wordings. Each template is compiled into an automaton over words; a place in a
text is accepted if all mandatory wording stands there exactly, word for word. Plain phrases are looked for besides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, ids_and_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

# Plain phrases and their labels, and notices in this module's markup with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit-notice": "<<any;released|licensed|distributed|available|provided>> under <<optional>>the terms of<<end>> <<optional>>the<<end>> MIT license",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software.""",
    "apache-2.0-notice": "<<any;released|licensed|distributed>> under <<optional>>the terms of<<end>> the Apache license <<optional>>,<<end>> version 2.0 <<optional>>(the License)<<end>>",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;3>> except in compliance with the
        License. You may obtain a copy of the License at <<optional>><<any;http|https>> www.apache.org/licenses/LICENSE-2.0<<end>>
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl-notice": "<<any;released|licensed|distributed>> under <<optional>>the terms of<<end>> the <<optional>>GNU<<end>> general public license <<optional>>, <<any;version|v>> <<any;1|2|3|2.0|3.0>> <<optional>><<optional>>of the license<<end>> or <<optional>>(at your option)<<end>> any later version<<end>><<end>>",
    "bsd-grant": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<var;2>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next
        paragraph)<<end>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<any;authors|author>> OR COPYRIGHT <<any;holders|holder>> BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE <<any;author|authors>>
        <<any;disclaims|disclaim>> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE <<any;author|authors>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
        OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<var;2>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. <<var;2>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES""",
    "bsd-3-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<var;2>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. <<var;2>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. <<var;2>> Neither the <<any;name|names>>
        of <<var;8>> <<any;nor|or>> the names of <<any;its|any|other>> contributors may be used to endorse or promote products derived from this
        software without specific prior written permission.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
        by any means.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, <<any;v. 2.0|version 2.0>>. If a copy of the MPL was not
        distributed with this file, You can obtain one at <<any;http|https>> <<optional>>www.<<end>> mozilla.org/MPL/2.0/""",
    "lgpl-notice": "<<any;released|licensed|distributed>> under <<optional>>the terms of<<end>> the <<optional>>GNU<<end>> <<any;lesser|library>> general public license <<optional>>, <<any;version|v>> <<any;2|2.1|3|2.0|3.0>><<end>>",
    "cc0": "<<any;released|licensed|distributed|available|dedicated>> <<any;under|to>> <<optional>>the<<end>> <<optional>>creative commons<<end>> <<optional>>public domain under<<end>> CC0 <<optional>>1.0 <<optional>>universal<<end>><<end>>",
    "cc-by": "<<any;released|licensed|distributed|available>> under <<optional>>a<<end>> <<any;CC|creative commons>> <<any;BY|attribution>> <<any;4.0|3.0|2.5|2.0|4.0 international>>",
    "cc-by-sa": "<<any;released|licensed|distributed|available>> under <<optional>>a<<end>> <<any;CC|creative commons>> <<any;BY SA|attribution sharealike>> <<any;4.0|3.0|2.5|2.0>>",
    "cc-by-nc": "<<any;released|licensed|distributed|available>> under <<optional>>a<<end>> <<any;CC|creative commons>> <<any;BY NC|attribution noncommercial>> <<any;4.0|3.0|2.5|2.0>>",
}

SCHEMA = "doc_id {id}, n_words bigint, base array<struct<label:string,start:bigint>>, templates array<struct<label:string,start:bigint,end:bigint>>"


def lower_ascii(text: str) -> str:
    """A to Z in lower case, nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str) -> list[str]:
    return WORD.findall(lower_ascii(text))


class Automaton:
    """A template as a nondeterministic automaton over words. State `len(edges) - 1` accepts."""

    ANY = None  # an edge that any word takes

    def __init__(self, template: str):
        self.edges: list[list[tuple[str | None, int]]] = []  # by state: (word, next state)
        self.free: list[list[int]] = []  # by state: states reached without a word
        self.mandatory: list[str] = []
        at = self._state()
        stack = []
        for piece in re.findall(r"<<[^>]*>>|[^<]+", template):
            if piece == "<<optional>>":
                stack.append(at)
            elif piece == "<<end>>":
                if not stack:
                    raise ValueError("<<end>> without <<optional>>")
                self.free[stack.pop()].append(at)
            elif piece.startswith("<<var;"):
                stop = None
                begin = [at]
                for _ in range(int(piece[6:-2])):
                    at = self._step(at, self.ANY)
                    begin.append(at)
                stop = self._state()
                for b in begin:
                    self.free[b].append(stop)
                at = stop
            elif piece.startswith("<<any;"):
                ends = []
                for wording in piece[6:-2].split("|"):
                    branch = at
                    for w in words_of(wording):
                        branch = self._step(branch, w)
                    ends.append(branch)
                at = self._state()
                for e in ends:
                    self.free[e].append(at)
            elif piece.startswith("<<"):
                raise ValueError(f"unknown markup {piece}")
            else:
                for w in words_of(piece):
                    at = self._step(at, w)
                    if not stack:
                        self.mandatory.append(w)
        if stack:
            raise ValueError("<<optional>> without <<end>>")
        if not self.mandatory:
            raise ValueError("a template needs mandatory words")
        self.final = at
        self.closed = [self._closure({s}) for s in range(len(self.edges))]
        self.first = {w for s in self.closed[0] for w, _ in self.edges[s]}
        self.anchor = max(self.mandatory, key=len)

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _step(self, state: int, word: str | None) -> int:
        new = self._state()
        self.edges[state].append((word, new))
        return new

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def longest(self, words: list[str], start: int) -> int | None:
        """Where the longest accepted run of words from `start` ends (exclusive), or None."""
        states, end = self.closed[0], None
        for i in range(start, len(words)):
            if self.final in states:
                end = i
            nxt: set[int] = set()
            for s in states:
                for w, n in self.edges[s]:
                    if w is None or w == words[i]:
                        nxt |= self.closed[n]
            if not nxt:
                return end
            states = nxt
        return len(words) if self.final in states else end

    def find(self, words: list[str], places: dict[str, list[int]]) -> list[tuple[int, int]]:
        """Leftmost longest non-overlapping matches."""
        if self.anchor not in places:
            return []
        starts = sorted(i for w in self.first for i in places.get(w, ())) if None not in self.first else range(len(words))
        found, free_from = [], 0
        for i in starts:
            if i >= free_from and (end := self.longest(words, i)) is not None and end > i:
                found.append((i, end))
                free_from = end
        return found


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.automata = {label: Automaton(t) for label, t in templates.items()}
        # a text with none of these can't match anything
        self.signs = sorted({max(p, key=len) for p, _ in self.phrases} | {a.anchor for a in self.automata.values()})
        self.wanted = {w for a in self.automata.values() for w in a.first | {a.anchor} if w} | {p[0] for p, _ in self.phrases}
        self.anywhere = any(None in a.first for a in self.automata.values())

    def scan(self, text: str) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int]]]:
        """Number of words, (label, word) of phrases, (label, first word, end) of templates."""
        low = text.lower()
        if not any(s in low for s in self.signs):
            return len(WORD_ANY_CASE.findall(text)), [], []
        words = words_of(text)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.wanted:
                places.setdefault(w, []).append(i)
        base = sorted((i, label) for p, label in self.phrases for i in places.get(p[0], ()) if words[i : i + len(p)] == p)
        found = sorted((a, b, label) for label, automaton in self.automata.items() for a, b in automaton.find(words, places))
        return len(words), [(label, i) for i, label in base], [(label, a, b) for a, b, label in found]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, base (phrase places) and templates (accepted runs of words).

    Null and empty texts have no words and no places; repeated rows are scanned each; an empty table gives an empty result;
    other columns are ignored. Map-only; the templates travel with the task.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    Scanner(phrases, templates)  # faults in the markup show here, not in a task

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, templates)
        for b in batches:
            rows = [scanner.scan(t) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_words": [r[0] for r in rows],
                "base": [[{"label": v, "start": i} for v, i in r[1]] for r in rows],
                "templates": [[{"label": v, "start": i, "end": j} for v, i, j in r[2]] for r in rows],
            })

    return ids_and_texts(docs, id_col, text_col).mapInPandas(run, SCHEMA.format(id=id_type(docs, id_col)))


def license_report(docs: DataFrame, **options) -> DataFrame:
    """Labels per document. score: 1 if a template's whole wording stands there, 0.5 if only a phrase does, else 0."""
    found = scan_licenses(docs, **options)
    labels = lambda c: F.transform(c, lambda x: x["label"])
    starts = F.transform("base", lambda x: x["start"])
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        text(labels(F.col("base"))).alias("base_labels"), text(F.concat(labels(F.col("base")), labels(F.col("templates")))).alias("labels"),
        F.when(F.size("templates") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
        F.size("templates").cast("long").alias("n_templates"),
    )
