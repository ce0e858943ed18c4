"""Secret scans: fixed patterns, and literals assigned to sensitive names.

Source and configuration syntax is lexed into pairs of a name and a value:
``name = value``, ``name: value``, ``"name": value``, ``a.b["name"] = value``,
flags, and here-documents.  A value is a literal (quoted with escapes, triple
quoted, or bare), a name that stands for earlier literals, or several of these
joined by ``+``, ``.`` or nothing.  Constants are propagated in order of
assignment, through any number of names, so a literal counts for every name it
reaches.  A literal is scored by how sensitive its names are and how random it
looks.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as C

KINDS = ["assign", "access", "hex", "literal"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of names and of bare values.
_IN_NAME, _IN_VALUE = "A-Za-z0-9_.-", "A-Za-z0-9+/_.=-"
_OPERATOR = ":=|=>|[:=]"
#: One assignment's name and operator, or the name of a subscript.
_HEAD = re.compile(rf"""(?:(?<![{_IN_NAME}])|(?<=\s-)|(?<=\s--)|(?<=\A--))["']?(?P<name>[A-Za-z_][{_IN_NAME}]*+)["']?\]?[ \t]*+(?P<op>{_OPERATOR})[ \t]*+""")
#: One term of a value: a literal with escapes, of any length and quoting, or a bare word.
_TERM = re.compile(
    r"""[rbuf]{0,2}(?:\"{3}(?P<a>(?:[^"\\]|\\.|"(?!""))*+)\"{3}|\'{3}(?P<b>(?:[^'\\]|\\.|'(?!''))*+)\'{3}"""
    rf"""|"(?P<c>(?:[^"\\\n]|\\.)*+)"|'(?P<d>(?:[^'\\\n]|\\.)*+)')|(?P<bare>[{_IN_VALUE}]++)|<<[-~]?[ \t]*+["']?(?P<here>[A-Za-z_][A-Za-z0-9_]*+)["']?""",
    re.S,
)
#: What joins terms: an operator, or blanks and continued lines before a quoted one.
_JOIN = re.compile(r"[ \t]*+(?:(\+|\.\.?)[ \t]*+(?:\\?\n[ \t]*+)?|\\\n[ \t]*+)?")
_QUOTED = re.compile(r"""[rbuf]{0,2}["']""")
#: Parts of names, and how sensitive a value they make.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.6, "key": 0.5, "auth": 0.5, "bearer": 0.8, "signature": 0.4}
THRESHOLD = 0.6
#: What a text must have for any span to be found: fixed wording, or the middle of a pair.
_ANY = rf"""(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{{24}}|[{_IN_NAME}]["']?\]?[ \t]*(?:{_OPERATOR})[ \t]*["'<{_IN_VALUE}]"""


def sensitivity(name: str) -> float:
    """Of a name by its parts (camel case, snake case, dots and dashes)."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    joined = parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in joined), default=0.0)


def randomness(letters: Counter) -> float:
    """Of a value by how often it has each character.

    From 0 to 1: bits a character against 4, times variety of length up to 16.
    """
    n = letters.total()
    if not n:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in letters.values())
    classes = sum(any(re.match(p, x) for x in letters) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    digits = all(x.isdigit() for x in letters)
    return min(1.0, bits / 4) * min(1.0, n / 16) * (0.6 if classes == 1 and not digits else 1.0)


class Values:
    """What a text assigns: literals, and values made of them, each listed after its parts.

    ``literal[v]`` is (start, end) of a literal, else None; ``parts[v]`` the
    values that v is joined of; ``names`` lists every name with its value.  A
    name is known by itself and by its last part after a dot.
    """

    def __init__(self, text: str):
        self.text = text
        self.literal: list[tuple[int, int] | None] = []
        self.parts: list[list[int]] = []
        self.names: list[tuple[str, int]] = []
        self.known: dict[str, int] = {}
        self.lines: dict[str, list[int]] | None = None
        at = 0
        while m := _HEAD.search(text, at):
            value, end = self._value(m.end())
            at = max(end, m.end())
            if value is not None:
                self.known[m["name"]] = self.known[m["name"].rpartition(".")[2]] = value
                self.names.append((m["name"], value))

    def _add(self, literal: tuple[int, int] | None, parts: list[int]) -> int:
        self.literal.append(literal)
        self.parts.append(parts)
        return len(self.literal) - 1

    def _here(self, word: str, at: int) -> tuple[tuple[int, int], int] | None:
        """The lines after ``at`` up to one that holds ``word`` alone, and the end of that."""
        if self.lines is None:
            self.lines = {}
            for m in re.finditer(r"^[ \t]*+([A-Za-z_][A-Za-z0-9_]*+)[ \t]*+\r?$", self.text, re.M):
                self.lines.setdefault(m[1], []).append(m.start())
        begin, ends = self.text.find("\n", at) + 1, self.lines.get(word, [])
        k = bisect_left(ends, begin)
        if not begin or k == len(ends):
            return None
        end = self.text.find("\n", ends[k])
        return (begin, ends[k]), len(self.text) if end < 0 else end

    def _value(self, at: int) -> tuple[int | None, int]:
        """The value that begins at ``at``, and where it ends."""
        terms: list[int] = []
        first = end = at
        while m := _TERM.match(self.text, at):
            if m["here"]:
                if at == first and (got := self._here(m["here"], m.end())):
                    return self._add(got[0], []), got[1]
                break
            quoted = next((k for k in "abcd" if m[k] is not None), None)
            if quoted:
                terms.append(self._add(m.span(quoted), []))
            elif m["bare"] in self.known:
                terms.append(self.known[m["bare"]])
            elif at == first:  # a bare word is a literal of its own; joined, an unknown name has none
                terms.append(self._add(m.span("bare"), []))
                end = m.end()
                break
            end = m.end()
            j = _JOIN.match(self.text, end)
            if not j or not (j[1] or quoted and _QUOTED.match(self.text, j.end())):
                break
            at = j.end()
        if not terms:
            return None, end
        return (terms[0] if len(terms) == 1 else self._add(None, terms)), end


def pairs(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Names with the literals that reach them (value, start, end), constants propagated."""
    v = Values(text)
    out = []
    for name, value in v.names:
        todo, seen, got = [value], {value}, []
        while todo:
            k = todo.pop()
            if v.literal[k]:
                a, b = v.literal[k]
                got.append((text[a:b], a, b))
            new = [p for p in dict.fromkeys(v.parts[k]) if p not in seen]
            seen.update(new)
            todo += new
        out.append((name, sorted(got, key=lambda x: x[1])))
    return out


def literals(text: str) -> list[tuple[int, int, float]]:
    """Start, end and score of literals worth reporting.

    A value's score is the sensitivity of its most sensitive name, weighed by
    the randomness of all it is joined of; literals take the best score of the
    values that they are part of, so the work is one pass over the values.
    """
    v = Values(text)
    worst = [0.0] * len(v.literal)
    for name, value in v.names:
        worst[value] = max(worst[value], sensitivity(name))
    if not any(worst):
        return []
    need = [s > 0 for s in worst]
    for k in reversed(range(len(need))):
        if need[k]:
            for p in v.parts[k]:
                need[p] = True
    best, letters = [0.0] * len(need), [None] * len(need)
    for k, wanted in enumerate(need):
        if wanted:
            if v.literal[k]:
                a, b = v.literal[k]
                letters[k] = Counter(text[a:b])
            else:
                both = sum((letters[p] for p in v.parts[k]), Counter())
                letters[k] = Counter({x: min(n, 1 << 40) for x, n in both.items()})  # joined with itself, it doubles
            if worst[k] and letters[k].total() >= 6:
                score = worst[k] * (0.4 + 0.6 * randomness(letters[k]))
                best[k] = score if score >= THRESHOLD else 0.0
    found: dict[tuple[int, int], float] = {}
    for k in reversed(range(len(best))):
        if best[k]:
            for p in v.parts[k]:
                best[p] = max(best[p], best[k])
            if v.literal[k] and v.literal[k][1] > v.literal[k][0]:
                found[v.literal[k]] = max(best[k], found.get(v.literal[k], 0.0))
    return [(a, b, s) for (a, b), s in sorted(found.items())]


def find_in(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added ones as start, kind, end; an added one overlaps no base one."""
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    merged: list[list[int]] = []
    for a, _, b in base:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts, ends = np.array([x[0] for x in merged], np.int64), [x[1] for x in merged]
    added = []
    for a, b, _ in literals(text):
        k = int(np.searchsorted(starts, b)) - 1
        if k < 0 or ends[k] <= a:
            added.append((a, 3, b))
    return base, added


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, spans`` of every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Spans
    are ``kind:start:end`` in code points, end excluded, comma-joined, by start,
    then kind.  A null or empty text has none; a null doc_id stays null; repeated
    rows are scanned each on its own; an empty table gives an empty result.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = C.texts(batch)
        rows = []
        for k, hit in enumerate(pc.match_substring_regex(text, _ANY).to_numpy(zero_copy_only=False)):
            base, added = find_in(text[k].as_py()) if hit else ([], [])
            n = Counter(x[1] for x in base)
            rows.append((n[0], n[1], n[2], told(base), told(base + added)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(C.batches(one), "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")
