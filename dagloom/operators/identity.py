"""Order-dependent canonical forms of expression graphs, one theorem at a time.

A theorem's table is a list of nodes ``(id, kind, name, idx, names, refs)``
with operands before their users.  These kernels need the whole (bounded)
table of a theorem, so they run as ``applyInPandas`` groups by theorem.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

#: Kinds whose nodes are variables, renamed by first use below a root.
VARIABLES = frozenset(["Fvar", "ExprMvar"])


_text = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def digest(value) -> bytes:
    """SHA-256 of a value's canonical text."""
    return hashlib.sha256(_text(value).encode()).digest()


def region(refs: dict[int, list[int]], root: int, radius: int | None = None) -> tuple[list[int], list]:
    """Operand-ordered breadth-first numbering from ``root``.

    Returns the nodes in that order and for each its operands' positions;
    ``None`` stands for a node at the radius whose operands are cut off, which
    is not the same as a leaf's empty list.
    """
    place, order, depth, out = {root: 0}, [root], {root: 0}, []
    todo = deque([root])
    while todo:
        n = todo.popleft()
        if radius is not None and depth[n] == radius and refs[n]:
            out.append(None)
            continue
        at = []
        for c in refs[n]:
            if c not in place:
                place[c], depth[c] = len(order), depth[n] + 1
                order.append(c)
                todo.append(c)
            at.append(place[c])
        out.append(at)
    return order, out


def fragments(refs: dict[int, list[int]], anchors: Iterable[int], depths: Iterable[int]) -> list[tuple[int, int, bytes, list, list[int]]]:
    """``anchor, depth, identity, edges, nodes`` of every anchor's bounded fragments."""
    out = []
    for a in anchors:
        for d in depths:
            nodes, edges = region(refs, a, d)
            out.append((a, d, digest(edges), edges, nodes))
    return out


def topology(refs: dict[int, list[int]], root: int) -> bytes:
    return digest(region(refs, root)[1])


def labelled_topology(refs: dict[int, list[int]], kinds: dict[int, str], root: int) -> bytes:
    nodes, edges = region(refs, root)
    return digest([[kinds[n], e] for n, e in zip(nodes, edges, strict=True)])


def levels(value):
    """A payload with the level metavariables within it as variables ``("level", id)``."""
    if isinstance(value, dict):
        return Variable("level", value["mvar"]) if value.keys() == {"mvar"} else [[k, levels(v)] for k, v in value.items()]
    return [levels(v) for v in value] if isinstance(value, list | tuple) else value


class Variable(tuple):
    """A kind of variable and its name."""

    def __new__(cls, kind: str, name):
        return super().__new__(cls, (kind, name))


def _variables(value) -> list[Variable]:
    if isinstance(value, Variable):
        return [value]
    return [x for v in value for x in _variables(v)] if isinstance(value, list | tuple) else []


def _numbered(value, number: dict[Variable, int]):
    if isinstance(value, Variable):
        return [value[0], number[value]]
    return [_numbered(v, number) for v in value] if isinstance(value, list | tuple) else value


def alpha_identities(nodes: dict[int, tuple], leaves: dict | None = None) -> dict[int, bytes]:
    """Identity of every node up to renaming of variables, operands before their users.

    ``nodes[id]`` is (kind, payload, refs); the payload is all that tells nodes of
    a kind apart (a plain value or nested lists).  A node's variables are numbered
    by first use below it, and its digest is made of its payload and, for every
    operand, that one's digest and which of the node's numbers its variables have.
    So each node is digested once, ``f x x`` and ``f x y`` differ, and ``f x y`` and
    ``f y x`` are the same.  ``leaves`` keeps identities of nodes without operands
    from call to call.
    """
    out: dict[int, bytes] = {}
    own: dict[int, list[Variable]] = {}
    for n in sorted(nodes):
        kind, payload, refs = nodes[n]
        if leaves is not None and not refs:
            own[n] = [Variable(kind, payload)] if kind in VARIABLES else list(dict.fromkeys(_variables(payload)))
            key = (kind, None if kind in VARIABLES else _text(_numbered(payload, {v: k for k, v in enumerate(own[n])})), len(own[n]))
            if (known := leaves.get(key)) is None:
                known = leaves[key] = alpha_identities({n: nodes[n]})[n]
            out[n] = known
            continue
        data = Variable(kind, payload) if kind in VARIABLES else payload
        used = dict.fromkeys(_variables([data]))
        for c in refs:
            used.update(dict.fromkeys(own[c]))
        number = {v: k for k, v in enumerate(used)}
        own[n] = list(used)
        out[n] = digest([kind, _numbered(data, number), [[out[c].hex(), [number[v] for v in own[c]]] for c in refs]])
    return out


def alpha_identity(nodes: dict[int, tuple], root: int) -> bytes:
    return alpha_identities(nodes)[root]


def expanded_sizes(refs: dict[int, list[int]]) -> dict[int, int]:
    """Exact expanded tree size of every node, in order of id."""
    out: dict[int, int] = {}
    for n in sorted(refs):
        out[n] = 1 + sum(out[c] for c in refs[n])
    return out


def depths(refs: dict[int, list[int]]) -> dict[int, int]:
    out: dict[int, int] = {}
    for n in sorted(refs):
        out[n] = 1 + max((out[c] for c in refs[n]), default=0)
    return out


def frequencies(refs: dict[int, list[int]], roots: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """Per node its (top, root_dag, expanded_tree) counts over a multiset of roots, exactly."""
    tree = dict.fromkeys(refs, 0)
    dag = dict.fromkeys(refs, 0)
    for r, n in roots.items():
        tree[r] += n
        for c in region(refs, r)[0]:
            dag[c] += n
    for n in sorted(refs, reverse=True):
        for c in refs[n]:
            tree[c] += tree[n]
    return {n: (roots.get(n, 0), dag[n], tree[n]) for n in refs if dag[n]}


def _table(df: pd.DataFrame) -> dict[int, list[int]]:
    return {int(i): [int(x) for x in r] for i, r in zip(df["id"], df["refs"], strict=True)}


def mine_fragments(exprs: DataFrame, depths_: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``thm, anchor, depth, ident, edges, nodes`` of every node; ``exprs`` has ``thm, id, refs``."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        refs = _table(df)
        rows = fragments(refs, sorted(refs), depths_)
        return pd.DataFrame({"thm": df["thm"].iloc[0], "anchor": [r[0] for r in rows], "depth": [r[1] for r in rows], "ident": [r[2].hex() for r in rows], "edges": [json.dumps(r[3]) for r in rows], "nodes": [r[4] for r in rows]})

    kind = exprs.schema["thm"].dataType.simpleString()
    return exprs.groupBy("thm").applyInPandas(one, f"thm {kind}, anchor long, depth int, ident string, edges string, nodes array<long>")


#: Columns that tell nodes of one kind apart, where a table has them; levels are JSON.
PAYLOAD = ("name", "idx", "val", "names", "binder_info", "nondep", "meta", "level")


def _payloads(df: pd.DataFrame) -> list[list]:
    columns = []
    for c in PAYLOAD:
        if c in df:
            plain = [None if x is None or x is pd.NA or isinstance(x, float) and x != x else x for x in df[c]]
            if c == "level":
                plain = [None if x is None else levels(json.loads(x)) for x in plain]
            elif c == "names":
                plain = [None if x is None else list(x) for x in plain]
            elif c == "idx":
                plain = [None if x is None else int(x) for x in plain]
            elif c == "nondep":
                plain = [None if x is None else bool(x) for x in plain]
            columns.append(plain)
    return [list(x) for x in zip(*columns, strict=True)] if columns else [[] for _ in range(len(df))]


def node(kind: str, payload: list, refs: list[int]) -> tuple:
    """A node as :func:`alpha_identities` takes it; a variable is told by its payload."""
    return kind, json.dumps(payload) if kind in VARIABLES else payload, refs


def identities(exprs: DataFrame) -> DataFrame:
    """``thm, id, alpha, topology, labelled`` of every node.

    ``exprs`` has ``thm, id, kind, refs`` and any of :data:`PAYLOAD`.  A variable
    is told by its payload (``Fvar`` and ``ExprMvar``), a level's by its number.
    """

    def one(df: pd.DataFrame) -> pd.DataFrame:
        refs = _table(df)
        kinds = dict(zip(df["id"].astype(int), df["kind"], strict=True))
        payload = dict(zip(df["id"].astype(int), _payloads(df), strict=True))
        nodes = {n: node(kinds[n], payload[n], refs[n]) for n in refs}
        at, alpha = sorted(refs), alpha_identities(nodes)
        return pd.DataFrame({"thm": df["thm"].iloc[0], "id": at, "alpha": [alpha[n].hex() for n in at], "topology": [topology(refs, n).hex() for n in at], "labelled": [labelled_topology(refs, kinds, n).hex() for n in at]})

    kind = exprs.schema["thm"].dataType.simpleString()
    return exprs.groupBy("thm").applyInPandas(one, f"thm {kind}, id long, alpha string, topology string, labelled string")


def patterns(refs: dict[int, list[int]], kinds: dict[int, str], anchors: Iterable[int], radii: Iterable[int]) -> list[tuple[int, int, int, str]]:
    """``id, radius, flavour, digest`` of every anchor's bounded signatures."""
    rows = []
    for n in anchors:
        for r in radii:
            nodes, edges = region(refs, n, r)
            rows.append((n, r, 0, digest(["*" if e is None else e for e in edges]).hex()))
            rows.append((n, r, 1, digest([[kinds[m], "*" if e is None else e] for m, e in zip(nodes, edges, strict=True)]).hex()))
    return rows


def local_patterns(exprs: DataFrame, radii: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``thm, id, radius, flavour, digest``: bounded signatures, plain (0) and with kinds (1)."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        refs = _table(df)
        kinds = dict(zip(df["id"].astype(int), df["kind"], strict=True))
        rows = patterns(refs, kinds, sorted(refs), radii)
        out = pd.DataFrame(rows, columns=["id", "radius", "flavour", "digest"])
        out.insert(0, "thm", df["thm"].iloc[0])
        return out

    kind = exprs.schema["thm"].dataType.simpleString()
    return exprs.groupBy("thm").applyInPandas(one, f"thm {kind}, id long, radius int, flavour int, digest string")
