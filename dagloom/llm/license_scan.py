"""License scans: templates with optional and replaceable regions as token automata.

A template is a whole license text, notice or mention, as words with markup:
``{...}`` may be absent, ``<a-b>`` stands for a to b arbitrary words (a name, a
title), ``<year>`` for a year, ``<x|y>`` for one of the listed wordings.  It is
compiled to an automaton over words; a place matches when a run of words is
accepted, which requires every mandatory word, in order.  So a text that opens
like a license but goes on differently is not that license.  All automata run
together over a text, started only at words that can begin a template, and a
text without any of the templates' key words is skipped.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as C

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD_RE2 = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Fixed phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wording that several templates share (public license texts, as words).
_HOLDER = "copyright {c} {<year>} {<year>} {by} <1-12> {all rights reserved}"
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to use
copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software
is furnished to do so subject to the following conditions the above copyright notice and this permission notice
{including the next paragraph} shall be included in all copies or substantial portions of the software the software is provided
as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness
for a particular purpose and noninfringement in no event shall <the|0-8> <authors|author|holders> {or copyright <holders|holder>}
be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
connection with the software or the use or other dealings in the software"""
_BSD_HEAD = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met {1} redistributions of source code must retain the above copyright notice this list of conditions
and the following disclaimer {2} redistributions in binary form must reproduce the above copyright notice this list of
conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_NAMES = """{3} neither the name of <1-10> nor the names of {its} {the} {contributors} <0-3> may be used to endorse or promote
products derived from this software without specific prior written permission"""
_BSD_TAIL = """this software is provided by <1-10> as is and any express or implied warranties including but not limited to the
implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <1-10> be liable for
any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute
goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in
contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
advised of the possibility of such damage"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
<1-6> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no
event shall <1-6> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from
loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection
with the use or performance of this software"""
_ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for
any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
commercial applications and to alter it and redistribute it freely subject to the following restrictions {1} the origin of this
software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product
an acknowledgment in the product documentation would be appreciated but is not required {2} altered source versions must be
plainly marked as such and must not be misrepresented as being the original software {3} this notice may not be removed or altered
from any source distribution"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
license you may obtain a copy of the license at <1-8> unless required by applicable law or agreed to in writing software
distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or
implied see the license for the specific language governing permissions and limitations under the license"""
_GNU = """free software you can redistribute it and or modify it under the terms of the gnu {VARIANT} general
public license as published by the free software foundation either version <VERSION> of the license or at your option any later
version <this program|1-4> is distributed in the hope that it will be useful but without any warranty without even the implied
warranty of merchantability or fitness for a particular purpose see the gnu {VARIANT} general public license for more details"""
_UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or
non commercial and by any means"""


def _gnu(variant: str, version: str) -> str:
    return _GNU.replace("{VARIANT}", variant).replace("VERSION", version)


#: Templates: label, markup.  Each label is given when any of its templates matches.  Labels
#: that end in -text are whole texts, in -notice the standard notices; others are mentions.
TEMPLATES = [
    ("agpl-3-notice", _gnu("affero", "3")),
    ("apache", "{licensed} {under} {the} apache license {version} <2|2 0>"),
    ("apache-2-notice", _APACHE),
    ("bsd", "{released} {under} {the} bsd {2|3} {clause} license"),
    ("bsd-2-text", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3-text", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    ("cc-by", "{licensed} {under} {a} creative commons attribution {noncommercial} {share alike|sharealike} {noderivatives} <1|2|3|4> {0|5} {international}"),
    ("cc-by-nc", "cc by nc {nd|sa} {1|2|3|4} {0|5}"),
    ("cc-by-sa", "cc by sa {1|2|3|4} {0|5}"),
    ("copyright", "copyright {c} <year> {<year>} {by} <1-1>"),
    ("copyright", "copyright {c} <0-6> all rights reserved"),
    ("gpl-2", "{gnu} general public license {as published by the free software foundation} {either} version 2"),
    ("gpl-2-notice", _gnu("", "2")),
    ("gpl-3", "{gnu} general public license {as published by the free software foundation} {either} version 3"),
    ("gpl-3-notice", _gnu("", "3")),
    ("isc-text", _ISC),
    ("lgpl", "gnu lesser general public license {version <2|2 1|3>}"),
    ("lgpl-notice", _gnu("lesser", "2 1|3")),
    ("mit", "{released} under the mit license"),
    ("mit-text", _MIT),
    ("mit-text", f"{{the mit license}} {{mit}} {_HOLDER} {_MIT}"),
    ("mpl", "mozilla public license {version|v} <1|2> {0|1}"),
    ("public-domain", "{released} <into|to> the public domain"),
    ("unlicense-text", _UNLICENSE),
    ("zlib-text", _ZLIB),
]
_YEAR = re.compile(r"(?:19|20)[0-9]{2}")


def parse(markup: str) -> list:
    """A template as nested parts: word, ("any", a, b), ("year",), ("one", [parts]), ("maybe", parts)."""
    tokens = re.findall(r"[{}<>|]|[^\s{}<>|]+", markup)
    pos = 0

    def sequence(stop: str) -> list:
        nonlocal pos
        ways, now = [], []
        while pos < len(tokens) and tokens[pos] not in stop:
            t = tokens[pos]
            pos += 1
            if t == "|":
                ways.append(now)
                now = []
            elif t == "{":
                now.append(("maybe", sequence("}")))
                pos += 1
            elif t == "<":
                now.append(("one", [sequence(">")]))
                pos += 1
            elif m := re.fullmatch(r"(\d+)-(\d+)", t):
                now.append(("any", int(m[1]), int(m[2])))
            elif t == "year":
                now.append(("year",))
            else:
                now.append(t)
        return now if not ways else [("one", [*ways, now])]

    return sequence("")


class Automaton:
    """States of all templates; ``moves[s][word]``, ``years[s]`` (a year) and ``free[s]`` (any word) lead on.

    ``most`` bounds what is kept of steps taken, which are recomputed beyond it.
    """

    def __init__(self, templates: list[tuple[str, str]]):
        self.moves: list[dict[str, set[int]]] = []
        self.free: list[set[int]] = []
        self.years: list[set[int]] = []
        self.empty: list[set[int]] = []
        self.accept: dict[int, str] = {}
        self.mandatory: dict[str, int] = {}
        start = self._state()
        for label, markup in templates:
            first = self._state()
            self.empty[start].add(first)
            self.accept[self._build(parse(markup), first)] = label
        self.start = self._closed({start})
        self.first = {w for s in self.start for w in self.moves[s]}
        self.any_first = any(self.free[s] or self.years[s] for s in self.start)
        self.cache: dict[tuple[frozenset, str, bool], frozenset] = {}

    def _state(self) -> int:
        self.moves.append(defaultdict(set))
        self.free.append(set())
        self.years.append(set())
        self.empty.append(set())
        return len(self.moves) - 1

    def _build(self, parts: list, at: int) -> int:
        for p in parts:
            to = self._state()
            if isinstance(p, str):
                self.moves[at][p].add(to)
            elif p[0] == "year":
                self.years[at].add(to)
            elif p[0] == "any":
                for k in range(p[2]):
                    if k >= p[1]:
                        self.empty[at].add(to)
                    step = self._state()
                    self.free[at].add(step)
                    at = step
                self.empty[at].add(to)
            elif p[0] == "one":
                for way in p[1]:
                    self.empty[self._build(way, at)].add(to)
            else:
                self.empty[at].add(to)
                self.empty[self._build(p[1], at)].add(to)
            at = to
        return at

    def _closed(self, states: set[int]) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    def step(self, states: frozenset, word: str) -> frozenset:
        known = any(word in self.moves[s] for s in states)
        year = bool(_YEAR.fullmatch(word)) and any(self.years[s] for s in states)
        key = (states, word if known else "", year)
        if (got := self.cache.get(key)) is None:
            to = set()
            for s in states:
                to |= self.free[s] | (self.moves[s].get(word, set()) if known else set()) | (self.years[s] if year else set())
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[key] = self._closed(to)
        return got

    def matches(self, words: list[str]) -> list[tuple[str, int, int]]:
        """Label, first word and end of the longest accepted run from every place."""
        out = []
        for i, w in enumerate(words):
            if w not in self.first and not self.any_first:
                continue
            states, best = self.start, {}
            for j in range(i, len(words)):
                states = self.step(states, words[j])
                if not states:
                    break
                for s in states:
                    if (label := self.accept.get(s)) is not None:
                        best[label] = j + 1
            out += [(label, i, end) for label, end in sorted(best.items())]
        return out


def _key_words(templates: list[tuple[str, str]]) -> set[str] | None:
    """Words such that every template has one of them as a mandatory word: its longest.

    None if a template has no mandatory word outside its replaceable regions.
    """
    out = set()
    for _, markup in templates:
        words = [p for p in parse(markup) if isinstance(p, str)]
        if not words:
            return None
        out.add(max(words, key=len))
    return out


def scan_words(words: list[str], automaton: Automaton) -> tuple[list[tuple[str, int]], list[tuple[str, int, int]]]:
    """Base places (label, first word) and template matches of one text's words."""
    base = []
    for phrase, label in BASE.items():
        p = phrase.split()
        base += [(label, i) for i, w in enumerate(words) if w == p[0] and words[i : i + len(p)] == p]
    return base, automaton.matches(words)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """License wording of every document.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, places``; ``places`` lists label, first word and end of
    every template match.  ``score`` is 1 for a template match; with a fixed
    phrase alone it is 0.5, else 0.  ``docs`` needs ``doc_id`` and ``text``; other
    columns are ignored.  A null or empty text has no words; a null doc_id stays
    null; repeated rows are scanned each on its own; an empty table gives an empty
    result.
    """
    templates = TEMPLATES if templates is None else templates
    keys = _key_words([*templates, *((label, phrase) for phrase, label in BASE.items() if phrase != "cc by")])
    edge = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]"
    # short keys are common parts of words, so they must be whole ones
    each = [rf"(?:^|{edge}){re.escape(k)}(?:$|{edge})" if len(k) < 6 else re.escape(k) for k in sorted(keys or ())]
    quick = "" if keys is None else "(?i:" + "|".join([rf"cc{edge}+by", *each]) + ")"

    def body(it):
        automaton = Automaton(templates)
        low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
        for batch in it:
            for part in C.parts(batch):
                text = C.texts(part)
                n = pc.count_substring_regex(text, _WORD_RE2)
                hit = pc.match_substring_regex(text, quick).to_numpy(zero_copy_only=False)
                rows = []
                for k, h in enumerate(hit):
                    base, found = scan_words(WORD.findall(text[k].as_py().translate(low)), automaton) if h else ([], [])
                    places = [i for _, i in base]
                    labels = {x for x, _ in base}
                    rows.append((len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, _, _ in found})), 1.0 if found else 0.5 if base else 0.0, [{"label": x, "start": a, "end": b} for x, a, b in found]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
                yield pa.record_batch([part.column(0), n.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long,end:long>>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(body, schema)
