"""Licence scan: template markup compiled into token automata.

A template is wording with ``<<optional>> ... <<end>>`` regions, which a text may leave out, and ``<<any N>>``
regions, which stand for up to N words of the text's own (names, years). Each template becomes a nondeterministic
automaton over words; a text is accepted from a place on when every mandatory word follows exactly. The automata of
one scan are started only where their first words stand, so the cost is one pass over the words.

Words: A-Z lower-cased, then maximal runs of digits, letters and non-ASCII characters. It is a map over rows.

Edge cases: null and empty texts have no words, null positions, empty labels and a score of 0; extra columns are
ignored; repeated rows repeat; tables without rows give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
    TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
    <<optional>>OR COPYRIGHT HOLDERS<<end>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
    CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
    SOFTWARE."""

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND <<any 12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
    INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY SPECIAL,
    DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
    IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
    OF THIS SOFTWARE."""

_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met: <<optional>>1.<<end>> Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. <<optional>>2.<<end>> Redistributions in binary form must
    reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
    other materials provided with the distribution."""

_BSD_ADVERTISING = """<<optional>>3.<<end>> All advertising materials mentioning features or use of this software must display the
    following <<optional>>acknowledgement<<end>> <<optional>>acknowledgment<<end>>: This product includes software developed
    by <<any 20>>"""

_BSD_NAMES = """<<optional>>3.<<end>> <<optional>>4.<<end>> Neither the name of <<any 16>> nor the names of
    <<optional>>its<<end>> contributors may be used to endorse or promote products derived from this software without
    specific prior written permission."""

_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<any 16>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
    SHALL <<any 16>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
    BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
    HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
    OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Licence wordings (public texts) with the markup described above, by the label they add. A licence's own
#: label takes its whole mandatory wording; notices, dedications and mentions that point to a licence are references.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice <<optional>>(including the next
        paragraph)<<end>> shall be included in all copies or substantial portions of the Software. """
    + _MIT_WARRANTY,
    "isc": """Permission to use, copy, modify, <<optional>>and<<end>> <<optional>>/or<<end>> distribute this software
        for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. """
    + _ISC_WARRANTY,
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted. """
    + _ISC_WARRANTY,
    "bsd-2-clause": f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "bsd-4-clause": f"{_BSD_CONDITIONS} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the software to the public domain.
        We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
        We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
        this software under copyright law. """
    + _MIT_WARRANTY,
    "apache-2.0-reference": """Licensed under the Apache License, <<optional>>Version<<end>> 2.0 <<optional>>(the "License")<<end>>""",
    "gpl-3.0-reference": """<<optional>>This work is<<end>> licensed under the <<optional>>terms of the<<end>> GNU General Public
        License, version 3""",
    "gpl-2.0-or-later-reference": """under the terms of the GNU General Public License as published by the Free Software
        Foundation; either version 2 of the License, or (at your option) any later version""",
    "mpl-2.0-reference": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.""",
    "cc-by-nc-4.0-reference": """Licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-NC 4.0""",
    "cc-by-sa-4.0-reference": """Licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-SA 4.0""",
    "cc-by-4.0-reference": """Licensed under <<optional>>a<<end>> <<optional>>the<<end>> Creative Commons Attribution 4.0
        <<optional>>International<<end>> <<optional>>License<<end>>""",
    "cc0-1.0-reference": """dedicated to the public domain under CC0 <<optional>>1.0<<end>>""",
    "mit-reference": """released under the <<optional>>terms of the<<end>> MIT License""",
    "copyright-notice": """Copyright <<optional>>(c)<<end>> <<any 8>> All rights reserved""",
}

_MARK = re.compile(r"<<(optional|end|any \d+)>>")


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER))


@dataclass(frozen=True)
class Automaton:
    """States are 0..n; state n accepts. step: (state, word) -> state; free: state -> state on any word; empty: state -> states without a word."""

    label: str
    n: int
    step: dict[int, tuple[str, int]]
    free: dict[int, int]
    empty: dict[int, tuple[int, ...]]

    def closed(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for x in self.empty.get(todo.pop(), ()):
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return out

    def first_words(self) -> set[str]:
        start = self.closed({0})
        if start & self.free.keys() or self.n in start:
            raise ValueError(f"template {self.label} must begin with wording of its own")
        return {self.step[s][0] for s in start if s in self.step}

    def match(self, tokens: list[str], at: int) -> int | None:
        """The end of the longest accepted run of words from at, or None."""
        states, end = self.closed({0}), None
        while True:
            if self.n in states:
                end = at
            if at >= len(tokens):
                return end
            word = tokens[at]
            onward = {self.step[s][1] for s in states if s in self.step and self.step[s][0] == word}
            onward |= {self.free[s] for s in states if s in self.free}
            if not onward:
                return end
            states = self.closed(onward)
            at += 1


def compile_template(label: str, markup: str) -> Automaton:
    """Optional regions may nest. Raises ValueError on markup that doesn't close or templates that could match nothing."""
    step: dict[int, tuple[str, int]] = {}
    free: dict[int, int] = {}
    empty: dict[int, list[int]] = {}
    state, opened = 0, []
    for k, part in enumerate(_MARK.split(markup)):
        if k % 2 == 0:
            for w in words(part):
                step[state] = (w, state + 1)
                state += 1
        elif part == "optional":
            opened.append(state)
        elif part == "end":
            if not opened:
                raise ValueError(f"template {label}: <<end>> without <<optional>>")
            begin = opened.pop()
            if begin != state:
                # a state of its own after the region, so that leaving it out and a loop's end don't mix
                empty.setdefault(begin, []).append(state + 1)
                empty.setdefault(state, []).append(state + 1)
                state += 1
        else:
            first = state
            for _ in range(int(part.split()[1])):
                free[state] = state + 1
                state += 1
            for s in range(first, state):
                empty.setdefault(s, []).append(state)
            empty.setdefault(state, []).append(state + 1)
            state += 1
    if opened:
        raise ValueError(f"template {label}: <<optional>> without <<end>>")
    made = Automaton(label, state, step, free, {k: tuple(v) for k, v in empty.items()})
    made.first_words()
    return made


@dataclass(frozen=True)
class Scanner:
    base: tuple[Automaton, ...]
    more: tuple[Automaton, ...]

    @classmethod
    def of(cls, phrases: dict[str, str], templates: dict[str, str]) -> Scanner:
        return cls(tuple(compile_template(v, k) for k, v in phrases.items()), tuple(compile_template(k, v) for k, v in templates.items()))

    def triggers(self) -> dict[str, list[tuple[bool, Automaton]]]:
        out: dict[str, list[tuple[bool, Automaton]]] = {}
        for is_base, automata in ((True, self.base), (False, self.more)):
            for a in automata:
                for w in sorted(a.first_words()):
                    out.setdefault(w, []).append((is_base, a))
        return out


def scan_text(triggers: dict[str, list[tuple[bool, Automaton]]], text: str) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, int]]]:
    """(n_words, n_base, first, last, base labels, labels, score, matches as (label, first word, end word))."""
    tokens = words(text)
    present = triggers.keys() & set(tokens)
    matches, base, n_base, first, last = [], set(), 0, None, None
    if present:
        for at, w in enumerate(tokens):
            if w not in present:
                continue
            for is_base, a in triggers[w]:
                if (end := a.match(tokens, at)) is None:
                    continue
                matches.append((a.label, at, end))
                if is_base:
                    base.add(a.label)
                    n_base += 1
                    first = at if first is None else first
                    last = at
    covered, reach = 0, 0
    for _, a, b in sorted(matches, key=lambda m: m[1:]):
        covered += max(0, b - max(a, reach))
        reach = max(reach, b)
    labels = base | {m[0] for m in matches}
    return len(tokens), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), covered / len(tokens) if tokens else 0.0, matches


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document. score: the share of the words that matched wording covers."""
    scanner = Scanner.of(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    triggers = scanner.triggers()
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            cols = list(zip(*((i, *scan_text(triggers, t)[:7]) for i, t in zip(ids, texts, strict=True)), strict=True))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return id_text(docs, id_col, text_col).mapInArrow(run, _OUT)
