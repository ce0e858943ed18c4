"""Totals over theorems' canonical forms: what is alike is worked out once.

The kernels take ``thm, nodes``, one row a theorem, with ``nodes`` an array of
structs ``id, kind, refs`` and more (:func:`gather` makes it of node rows).  A
theorem is whole within a row, so counts of theorems add up over tasks.

Bounded fragments, patterns, signatures and views do not depend on how nodes are
numbered.  So every task numbers a theorem's nodes by first use from its last
node down, counts theorems that are the same then, and works each out once.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import identity as I
from .views import RULES, VIEWS, rewrite

#: Nodes of distinct theorems that a task keeps before it gives their totals.
KEPT_NODES = 200_000
#: Operand-free nodes whose identities a task keeps.
KEPT_LEAVES = 300_000
#: Rows of a batch to Spark.
ROWS = 20_000

Theorem = tuple[list[int], dict[int, list[int]], dict[int, object]]


def gather(exprs: DataFrame) -> DataFrame:
    """``thm, nodes`` of node rows ``thm, id, kind, refs`` and more."""
    return exprs.groupBy("thm").agg(F.collect_list(F.struct(*[c for c in exprs.columns if c != "thm"])).alias("nodes"))


def _plain(field: str, column: pa.Array) -> list:
    if field == "level":
        return [None if x is None else I.levels(json.loads(x)) for x in column.to_pylist()]
    if not pa.types.is_string(column.type):
        return column.to_pylist()
    coded = column.dictionary_encode()
    words = [*coded.dictionary.to_pylist(), None]
    return [words[k] for k in coded.indices.fill_null(len(words) - 1).to_numpy(zero_copy_only=False).tolist()]


def _theorems(batch: pa.RecordBatch, fields: tuple[str, ...]) -> Iterator[tuple[list[int], list[list[int]], list]]:
    """Every theorem's ids, operands and labels (of ``fields``), in order of id."""
    nodes = batch.column(batch.schema.get_field_index("nodes"))
    flat = nodes.flatten()
    columns = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    at = nodes.offsets.to_numpy()
    at = (at - at[0]).tolist()
    ids = columns["id"].to_numpy(zero_copy_only=False).tolist()
    ends = columns["refs"].offsets.to_numpy()
    ends = (ends - ends[0]).tolist()
    values = columns["refs"].flatten().to_numpy(zero_copy_only=False).tolist()
    refs = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    plain = [_plain(f, columns[f]) for f in fields]
    labels = plain[0] if len(plain) == 1 else list(zip(*plain, strict=True)) if plain else [None] * len(ids)
    for a, b in zip(at, at[1:], strict=False):
        i = ids[a:b]
        if all(x < y for x, y in zip(i, i[1:], strict=False)):
            yield i, refs[a:b], labels[a:b]
        else:
            order = sorted(range(a, b), key=ids.__getitem__)
            yield [ids[k] for k in order], [refs[k] for k in order], [labels[k] for k in order]


def shape(ids: list[int], refs: dict[int, list[int]], labels: dict[int, object]) -> tuple[tuple, list[int]]:
    """A key that is the same only for theorems that differ by numbering, and the nodes in its order."""
    place: dict[int, int] = {}
    order: list[int] = []
    key: list = []
    for top in reversed(ids):
        if top in place:
            continue
        done = place[top] = len(order)
        order.append(top)
        while done < len(order):
            n = order[done]
            done += 1
            r = refs[n]
            key += (labels[n], len(r))
            for c in r:
                k = place.get(c)
                if k is None:
                    k = place[c] = len(order)
                    order.append(c)
                key.append(k)
    return tuple(key), order


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == ROWS:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema)
            part = []
    if part:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema)


def by_shape(graphs: DataFrame, fields: tuple[str, ...], one: Callable[[Theorem, int], Iterator[tuple]], label: Callable | None, schema: pa.Schema, spark_schema: str) -> DataFrame:
    """``one(theorem, n)``'s rows for every shape, with how many theorems of a stretch of the input have it."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen: dict[tuple, list] = {}
        kept = 0
        for batch in it:
            for ids, r, names in _theorems(batch, fields):
                refs = dict(zip(ids, r, strict=True))
                labels = dict(zip(ids, map(label, names) if label else names, strict=True))
                key, _ = shape(ids, refs, labels)
                if (met := seen.get(key)) is not None:
                    met[0] += 1
                    continue
                seen[key] = [1, (ids, refs, labels)]
                kept += len(ids)
                if kept > KEPT_NODES:
                    for n, theorem in seen.values():
                        yield from one(theorem, n)
                    seen, kept = {}, 0
        for n, theorem in seen.values():
            yield from one(theorem, n)

    return graphs.select("nodes").mapInArrow(lambda it: _batches(rows(it), schema), spark_schema)


def fragment_totals(graphs: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """``depth, ident, occurrences, theorems, positions`` of all nodes' bounded fragments."""

    def one(theorem: Theorem, n: int) -> Iterator[tuple]:
        ids, refs, _ = theorem
        found = Counter((d, ident, len(nodes)) for _, d, ident, _, nodes in I.fragments(refs, ids, depths))
        for (d, ident, size), m in found.items():
            yield d, ident.hex(), m * n, n, size

    schema = pa.schema([("depth", pa.int32()), ("ident", pa.string()), ("occurrences", pa.int64()), ("theorems", pa.int64()), ("positions", pa.int32())])
    got = by_shape(graphs, (), one, None, schema, "depth int, ident string, occurrences long, theorems long, positions int")
    return got.groupBy("depth", "ident").agg(F.sum("occurrences").alias("occurrences"), F.sum("theorems").alias("theorems"), F.max("positions").alias("positions"))


def pattern_totals(graphs: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """``radius, flavour, digest, n`` of all nodes' local patterns."""

    def one(theorem: Theorem, n: int) -> Iterator[tuple]:
        ids, refs, kinds = theorem
        for (_, r, flavour, digest), m in Counter((0, *x[1:]) for x in I.patterns(refs, kinds, ids, radii)).items():
            yield r, flavour, digest, m * n

    schema = pa.schema([("radius", pa.int32()), ("flavour", pa.int32()), ("digest", pa.string()), ("n", pa.int64())])
    got = by_shape(graphs, ("kind",), one, None, schema, "radius int, flavour int, digest string, n long")
    return got.groupBy("radius", "flavour", "digest").agg(F.sum("n").alias("n"))


def signature_totals(graphs: DataFrame) -> DataFrame:
    """``topology, labelled, n`` of all nodes."""

    def one(theorem: Theorem, n: int) -> Iterator[tuple]:
        ids, refs, kinds = theorem
        for (plain, labelled), m in Counter((I.topology(refs, k), I.labelled_topology(refs, kinds, k)) for k in ids).items():
            yield plain.hex(), labelled.hex(), m * n

    schema = pa.schema([("topology", pa.string()), ("labelled", pa.string()), ("n", pa.int64())])
    got = by_shape(graphs, ("kind",), one, None, schema, "topology string, labelled string, n long")
    return got.groupBy("topology", "labelled").agg(F.sum("n").alias("n"))


def view_totals(graphs: DataFrame, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """``view, nodes, refs, aliased``: nodes left, their operands, and nodes that another stands for.

    Of names only those that a rule has as its head matter.
    """

    def one(theorem: Theorem, n: int) -> Iterator[tuple]:
        ids, refs, labels = theorem
        nodes = {k: (*labels[k], refs[k]) for k in ids}
        for view in views:
            out, alias = rewrite(nodes, view)
            yield view, len(out) * n, sum(len(r) for _, _, r in out.values()) * n, sum(alias[k] != k for k in ids) * n

    schema = pa.schema([("view", pa.string()), ("nodes", pa.int64()), ("refs", pa.int64()), ("aliased", pa.int64())])
    got = by_shape(graphs, ("kind", "name"), one, lambda x: (x[0], x[1] if x[1] in RULES else None), schema, "view string, nodes long, refs long, aliased long")
    return got.groupBy("view").agg(*[F.sum(c).alias(c) for c in ("nodes", "refs", "aliased")])


def alpha_totals(graphs: DataFrame) -> DataFrame:
    """``alpha, n, theorems, topology``: nodes and theorems of every identity, and its least topology.

    ``nodes`` has ``kind``, ``refs`` and any of :data:`~dagloom.operators.identity.PAYLOAD`.
    """
    fields = graphs.schema["nodes"].dataType.elementType.fieldNames()
    payload = tuple(c for c in I.PAYLOAD if c in fields)
    schema = pa.schema([("alpha", pa.binary()), ("n", pa.int64()), ("theorems", pa.int64()), ("topology", pa.binary())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known: dict[tuple, list[bytes]] = {}
        leaves: dict = {}
        kept = 0
        for batch in it:
            met: dict[bytes, list] = {}
            for ids, r, labels in _theorems(batch, ("kind", *payload)):
                labels = labels if payload else [(x,) for x in labels]
                refs = dict(zip(ids, r, strict=True))
                key, order = shape(ids, refs, dict.fromkeys(ids))
                plain = known.get(key)
                if plain is None:
                    if kept > KEPT_NODES:
                        known, kept = {}, 0
                    plain = known[key] = [I.topology(refs, k) for k in order]
                    kept += len(ids)
                if len(leaves) > KEPT_LEAVES:
                    leaves.clear()
                nodes = {k: I.node(x[0], list(x[1:]), c) for k, x, c in zip(ids, labels, r, strict=True)}
                alpha = I.alpha_identities(nodes, leaves)
                here = set()
                for k, top in zip(order, plain, strict=True):
                    a = alpha[k]
                    got = met.get(a)
                    if got is None:
                        met[a] = [1, 1, top]
                        here.add(a)
                        continue
                    got[0] += 1
                    if a not in here:
                        here.add(a)
                        got[1] += 1
                    if top < got[2]:
                        got[2] = top
            for a, (n, theorems, top) in met.items():
                yield a, n, theorems, top

    got = graphs.select("nodes").mapInArrow(lambda it: _batches(rows(it), schema), "alpha binary, n long, theorems long, topology binary")
    total = got.groupBy("alpha").agg(F.sum("n").alias("n"), F.sum("theorems").alias("theorems"), F.min("topology").alias("topology"))
    return total.select(F.lower(F.hex("alpha")).alias("alpha"), "n", "theorems", F.lower(F.hex("topology")).alias("topology"))
