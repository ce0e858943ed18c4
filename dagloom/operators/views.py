"""Rewritten views of a theorem's graph: instances hidden, conversions compacted or erased."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

# Heads of the rewrite rules, their kinds and slots ("I" marks an instance slot).
_FIXED = [
    ("operator", "HAdd.hAdd HMul.hMul HSub.hSub HDiv.hDiv HPow.hPow HSMul.hSMul", "lhs_type rhs_type result_type I lhs rhs"),
    ("operator", "Neg.neg Inv.inv", "type I value"),
    ("operator", "LE.le LT.lt", "type I lhs rhs"),
    ("operator", "Membership.mem", "element_type container_type I container element"),
    ("numeral", "OfNat.ofNat", "type numeral I"),
    ("numeral", "Zero.zero One.one", "type I"),
    ("function-coercion", "DFunLike.coe", "object_type domain codomain I object"),
    ("function-coercion", "CoeFun.coe", "type codomain I object"),
    ("value-coercion", "Coe.coe CoeTC.coe CoeHTCT.coe", "source_type target_type I value"),
    ("value-coercion", "Nat.cast NatCast.natCast Int.cast IntCast.intCast", "target_type I value"),
    ("value-coercion", "Int.ofNat", "value"),
    ("type-coercion", "CoeSort.coe", "source_type target_type I value"),
    ("set-coercion", "SetLike.coe", "object_type element_type I object"),
    ("projection", "Subtype.val", "type predicate object"),
]
#: Kinds that change only how a value is seen.
CONVERSIONS = frozenset(["function-coercion", "value-coercion", "type-coercion", "set-coercion", "projection"])
VIEWS = ("original", "instances", "compact", "erased")


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    slots: tuple[str, ...]


RULES = {h: Rule(kind, h, tuple(slots.split())) for kind, heads, slots in _FIXED for h in heads.split()}

Node = tuple[str, str | None, list[int]]


def spine(nodes: dict[int, Node], n: int) -> tuple[int, list[int]]:
    """Head and arguments of an application, nested ones joined, metadata looked through."""
    args: list[int] = []
    while True:
        kind, _, refs = nodes[n]
        if kind == "Metadata" and refs:
            n = refs[0]
        elif kind == "App":
            args, n = [*refs[1:], *args], refs[0]
        else:
            return n, args


def fired(nodes: dict[int, Node], n: int) -> tuple[Rule, list[int]] | None:
    if nodes[n][0] != "App":
        return None
    head, args = spine(nodes, n)
    kind, name, _ = nodes[head]
    rule = RULES.get(name) if kind == "Const" and name else None
    return (rule, args) if rule and len(args) >= len(rule.slots) else None


def rewrite(nodes: dict[int, Node], view: str) -> tuple[dict[int, Node], dict[int, int]]:
    """The view's nodes, and which node stands for each of the original.

    ``instances`` drops instance slots; ``compact`` makes a conversion a marker
    over its other slots; ``erased`` lets its value stand for it, or applies the
    value to what arguments are left.
    """
    out: dict[int, Node] = {}
    alias: dict[int, int] = {}
    for n in sorted(nodes):
        kind, name, refs = nodes[n]
        hit = fired(nodes, n) if view != "original" else None
        alias[n] = n
        if hit is None:
            out[n] = (kind, name, [alias[c] for c in refs])
        else:
            rule, args = hit
            used, tail = args[: len(rule.slots)], [alias[c] for c in args[len(rule.slots) :]]
            kept = [alias[c] for c, s in zip(used, rule.slots, strict=True) if s != "I"]
            if rule.kind in CONVERSIONS and view == "compact":
                out[n] = ("Marker", rule.kind, kept + tail)
            elif rule.kind in CONVERSIONS and view == "erased":
                value = alias[used[-1]]
                if tail:
                    out[n] = ("App", None, [value, *tail])
                else:
                    alias[n] = value
            else:
                out[n] = ("App", None, [alias[spine(nodes, n)[0]], *kept, *tail])
        if view == "erased" and n in out:
            k, w, r = out[n]
            if k == "App" and out[r[0]][0] == "App":
                head, args = spine(out, n)
                out[n] = (k, w, [head, *args])
    return out, alias


def view_rows(exprs: DataFrame, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """``thm, view, id, kind, name, refs, alias`` of every view; ``exprs`` has ``thm, id, kind, name, refs``."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        nodes = {int(i): (k, w, [int(x) for x in r]) for i, k, w, r in zip(df["id"], df["kind"], df["name"], df["refs"], strict=True)}
        rows = []
        for view in views:
            out, alias = rewrite(nodes, view)
            for n in sorted(nodes):
                kind, name, refs = out.get(n, (None, None, None))
                rows.append((df["thm"].iloc[0], view, n, kind, name, refs, alias[n]))
        return pd.DataFrame(rows, columns=["thm", "view", "id", "kind", "name", "refs", "alias"])

    kind = exprs.schema["thm"].dataType.simpleString()
    return exprs.groupBy("thm").applyInPandas(one, f"thm {kind}, view string, id long, kind string, name string, refs array<long>, alias long")


