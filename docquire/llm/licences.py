"""Licence scans by template-markup matching.

A template is wording with marked regions: `[[ ... ]]` may be absent, `{{ a | b c }}` is one of several wordings, and
`<<n>>` stands for up to n words of anything (a name, a year, an address). Regions nest. Each template compiles into a
token automaton; a passage is accepted where its mandatory wording appears word for word and its marked regions are
filled or left out as marked. Base templates have no markup, so their acceptances are exactly the places where the
phrase's words stand consecutively.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docquire.llm.common import ascii_words, slices, spread

#: Phrase to label (fixed values of the scan's contract).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Licence bodies, notices and statements with markup, and the label each adds (wordings of public licences).
TEMPLATES: dict[str, list[str]] = {
    "statement": [
        "licensed under [[ {{ the | a | an }} ]] [[ terms of {{ the | a }} ]] <<6>> {{ license | licence | licenses | licences }}",
        "released under [[ {{ the | a | an }} ]] [[ terms of {{ the | a }} ]] <<6>> {{ license | licence | licenses | licences }}",
        "distributed under [[ {{ the | a | an }} ]] [[ terms of {{ the | a }} ]] <<6>> {{ license | licence | licenses | licences }}",
    ],
    "spdx": ["SPDX License Identifier <<6>>"],
    "mit-body": [
        """Permission is hereby granted[[, free of charge,]] to any person obtaining a copy of this software and associated
        documentation files [[(the "Software")]], to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        {{ NONINFRINGEMENT | NON INFRINGEMENT }}. IN NO EVENT SHALL <<12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
        OR OTHER DEALINGS IN THE SOFTWARE"""
    ],
    "bsd-body": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: [[ <<1>> ]] Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. [[ <<1>> ]] Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. [[ <<1>> Neither the name of <<15>> nor the names of {{ its | their | other }}
        contributors may be used to endorse or promote products derived from this software without specific prior written
        permission. ]] THIS SOFTWARE IS PROVIDED BY <<15>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
        SHALL <<15>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
        BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
        SUCH DAMAGE"""
    ],
    "isc-body": [
        """Permission to use, copy, modify, {{ and | and/or }} distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND <<8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""
    ],
    "zlib-body": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the {{ author | authors }}
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
        the following restrictions: [[ 1 ]] The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an {{ acknowledgment | acknowledgement }} in
        the product documentation would be appreciated but is not required. [[ 2 ]] Altered source versions must be plainly
        marked as such, and must not be misrepresented as being the original software. [[ 3 ]] This notice may not be removed
        or altered from any source distribution"""
    ],
    "unlicense-body": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means"""
    ],
    "apache-notice": [
        """Licensed under the Apache License, Version 2.0 [[(the "License")]]; you may not use this file except in compliance
        with the License. You may obtain a copy of the License at <<8>> Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License"""
    ],
    "gpl-notice": [
        """is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License [[ as
        published by the Free Software Foundation ]], {{ either version <<2>> of the License, or [[(at your option)]] any later
        version | version <<2>> [[ of the License ]] }}"""
    ],
    "lgpl-notice": [
        """is free software: you can redistribute it and/or modify it under the terms of the GNU {{ Lesser | Library }} General
        Public License [[ as published by the Free Software Foundation ]], {{ either version <<2>> of the License, or [[(at your
        option)]] any later version | version <<2>> [[ of the License ]] }}"""
    ],
    "agpl-notice": [
        """is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
        [[ as published by the Free Software Foundation ]], {{ either version <<2>> of the License, or [[(at your option)]] any
        later version | version <<2>> [[ of the License ]] }}"""
    ],
    "mpl-notice": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at"""
    ],
    "cc-notice": [
        """licensed under {{ a | the }} Creative Commons [[ {{ Attribution | CC BY | Zero | CC0 }} ]] [[ {{ NonCommercial | NC }} ]]
        [[ {{ ShareAlike | SA | NoDerivatives | NoDerivs | ND }} ]] <<2>> [[ {{ International | Unported | Generic | Universal }} ]]
        [[ Public ]] {{ License | Licence }}"""
    ],
}


@dataclass
class Automaton:
    """Words lead from a state to the next; `skips` are moves without a word; `wild` states move on any word."""

    label: str
    steps: list[dict[bytes, int]] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    wild: list[int | None] = field(default_factory=list)
    final: int = 0
    anchors: list[bytes] = field(default_factory=list)

    def state(self) -> int:
        self.steps.append({})
        self.skips.append([])
        self.wild.append(None)
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[bytes], start: int) -> int | None:
        """End of the longest acceptance that starts at a word, or None."""
        now, end = self.closure({0}), None
        for i in range(start, len(words) + 1):
            if self.final in now:
                end = i
            if i == len(words):
                break
            following = {self.steps[s][words[i]] for s in now if words[i] in self.steps[s]}
            following |= {self.wild[s] for s in now if self.wild[s] is not None}
            if not following:
                break
            now = self.closure(following)
        return end


def compile_template(label: str, markup: str) -> Automaton:
    """Automaton of a template. It must start with mandatory wording; that wording also tells where to try it."""
    a = Automaton(label)
    at, open_at, runs, run = a.state(), [], [], []
    for token in re.findall(r"\[\[|\]\]|\{\{|\}\}|\||<<\d+>>|(?:(?!\[\[|\]\]|\{\{|\}\}|<<)[^|])+", markup):
        words = ascii_words(token.encode()) if token[:2] != "<<" else []
        if token in ("[[", "{{"):
            open_at.append((token, at, []))
        elif token == "]]":
            kind, first, _ = open_at.pop()
            if kind != "[[":
                raise ValueError(f"{label}: regions must nest")
            a.skips[first].append(at)
        elif token == "|":
            open_at[-1][2].append(at)
            at = open_at[-1][1]
        elif token == "}}":
            kind, first, ends = open_at.pop()
            if kind != "{{":
                raise ValueError(f"{label}: regions must nest")
            after = a.state()
            for end in [*ends, at]:
                a.skips[end].append(after)
            at = after
        elif token.startswith("<<"):
            states = []
            if a.wild[at] is not None:  # so does one that begins with a region of any words
                a.skips[at].append(fresh := a.state())
                at = fresh
            for _ in range(int(token[2:-2])):
                after = a.state()
                a.wild[at] = after
                states.append(at)
                at = after
            for s in states:
                a.skips[s].append(at)
        for word in words:
            if word in a.steps[at]:  # an alternative that begins like another gets states of its own
                a.skips[at].append(fresh := a.state())
                at = fresh
            after = a.state()
            a.steps[at][word] = after
            at = after
        if words and not open_at:
            run += words
        elif run and not words:
            runs.append(run)
            run = []
    runs += [run] if run else []
    if not a.steps[0] or a.skips[0] or open_at:
        raise ValueError(f"{label}: a template starts with mandatory wording and closes its regions")
    a.final = at
    a.anchors = [b" " + b" ".join(r) + b" " for r in runs]
    return a


def scan_licences(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES, text: str = "text") -> DataFrame:
    """Add what the scan finds to every row; other columns pass through, those with new names are replaced. No shuffle.

    n_words, n_base (places of base phrases), first_word and last_word (smallest and largest start of a base place,
    null without one), base_labels, labels (all; both distinct, sorted, comma-joined, empty without any), spans (label,
    first word, word after the last, for base and template acceptances) and score (share of words inside a span).
    Null and empty texts have no words: zeros, nulls and empty strings. Repeated rows get the same answer; where several
    templates accept, all count; an empty table stays empty.
    """
    found = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_base", T.LongType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()),
            T.StructField("base_labels", T.StringType()),
            T.StructField("labels", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        ]
    )
    docs = spread(docs.drop(*found.fieldNames()))
    automata = [(compile_template(label, phrase), True) for phrase, label in base.items()]
    automata += [(compile_template(label, markup), False) for label, markups in templates.items() for markup in markups]
    column = docs.columns.index(text)

    def scan(value: str | None) -> tuple:
        words = ascii_words(value.encode() if value else None)
        joined = b" " + b" ".join(words) + b" "
        spans, places = [], []
        for a, is_base in automata:
            if not all(x in joined for x in a.anchors):
                continue
            # tried where its first mandatory run stands, so texts without the wording cost one search
            at, start, seen = joined.find(a.anchors[0]), 0, 0
            while at >= 0:
                start, seen = start + joined.count(b" ", seen, at), at
                end = a.match(words, start)
                if end is not None:
                    spans.append((a.label, start, end))
                    if is_base:
                        places.append((start, a.label))
                at = joined.find(a.anchors[0], at + 1)
        covered, reached = 0, 0
        for _, start, end in sorted(spans, key=lambda s: s[1:]):
            covered += max(0, end - max(start, reached))
            reached = max(reached, end)
        starts = [p for p, _ in places]
        return (
            len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})), ",".join(sorted({s[0] for s in spans})),
            covered / len(words) if words else 0.0,
            [dict(zip(("label", "start", "end"), s, strict=True)) for s in sorted(spans, key=lambda s: s[1:])],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
        for batch in batches:
            rows = [scan(x) for part in slices(batch.column(column)) for x in part.to_pylist()]
            added = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *found.fieldNames()])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *found.fields]))
