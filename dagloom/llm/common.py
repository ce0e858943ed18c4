"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import BROADCAST_ROWS, settle, shared_dir, small

#: Tasks that a list of files or blocks is dealt to at most.
TASKS = 10_000


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    return settle(df, what)


def dealt(written: DataFrame) -> DataFrame:
    """A written list of work (files, blocks), a task for each row up to ``TASKS``."""
    return written.repartition(max(1, min(TASKS, written.count())))


broadcast_if_small = small


def release() -> None:
    """Give freed memory back to the system: Python workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], most: int = 4 << 20) -> Callable:
    """Turn a function of one record batch into a ``mapInArrow`` body; batches are cut by :func:`parts`."""

    def body(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in parts(batch, most=most):
                if (out := fn(part)) is not None and out.num_rows:
                    yield out
        release()

    return body


def parts(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``most`` bytes in each part.

    A row is never cut: one text beyond the bound is a part of its own.
    """
    i = batch.schema.get_field_index(column)
    if i < 0 or batch.nbytes <= most or batch.num_rows < 2:
        yield batch
        return
    size = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cut, cut[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def runs(key: str, fn: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable:
    """A ``mapInArrow`` body that calls ``fn`` with all rows of each ``key``.

    The input must hold equal keys next to each other.  Only the rows of the
    key being read are kept, so memory is bounded by the largest group.
    """

    def body(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in it:
            if not batch.num_rows:
                continue
            k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
            for a, b in zip(cut, cut[1:], strict=False):
                if held and k[a] != last:
                    if (out := fn(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
                last = k[a]
        if held and (out := fn(pa.Table.from_batches(held))) is not None:
            yield out
        release()

    return body


def texts(batch: pa.RecordBatch) -> pa.Array:
    """The text column, null as empty, with 64-bit offsets and no slice offset.

    String kernels of Arrow misread some slices, so a slice is copied first.
    """
    text = batch.column(batch.schema.get_field_index("text"))
    if text.offset:
        text = text.take(pa.array(np.arange(len(text))))
    return pc.fill_null(text, "").cast(pa.large_string())


def split_words(text: pa.Array, lower: bool) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """ASCII-whitespace words of every text.

    Returns where each text's words begin (one more entry than texts), the
    distinct words and, for all words in order, their number among these.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    at, flat = lists.offsets.to_numpy(), lists.flatten()
    coded = flat.cast(pa.large_binary()).dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate(([0], np.cumsum(full)))
    return before[at - at[0]], words, codes[full]


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def connected_components(edges: DataFrame, what: str = "links") -> DataFrame:
    """Smallest id reachable from every id, by alternating star contraction.

    ``edges`` has long columns ``a`` and ``b``.  Each round first points every
    neighbour above a vertex at the smallest neighbour, then does so for the
    neighbours below it; the component's smallest id wins.  Rounds go on until
    every vertex is the smallest of its neighbours or has but one.  Vertices
    with their smallest neighbour, and either star, are written to the shared
    folder, so a plan has one exchange as long as the vertices may be broadcast:
    the driver keeps every task and plan.  Rows of a vertex of high degree are
    spread over all tasks (:func:`_star`).

    Returns ``id`` and ``component`` for ids that have an edge; an edge from an
    id to itself is ignored.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = write_out(edges, what)
    while True:
        near = edges.toDF("v", "n").unionByName(edges.toDF("n", "v"))
        low = write_out(_lowest(near), what)
        vertices, rows, more = low.agg(F.count("*"), F.sum("k"), F.max((F.col("m") < F.col("v")) & (F.col("k") > 1))).first()
        if not more:
            return low.select(F.col("v").alias("id"), F.least("v", "m").alias("component"))
        met = _star(near, low, vertices, rows)
        large = met.where("n > v").select(F.col("n").alias("v"), F.least("v", "m").alias("n"))
        near = write_out(large.unionByName(low.where("m < v").select("v", F.col("m").alias("n"))), what)
        low = write_out(_lowest(near), what)
        small = _star(near, low, vertices, rows + vertices).select(F.col("n").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select(F.col("v").alias("a"), F.col("m").alias("b")))
        edges = write_out(small.where("a <> b").distinct(), what)


def _lowest(near: DataFrame) -> DataFrame:
    """``v, m, k``: every vertex of ``near`` (``v, n``) with its smallest neighbour and how many rows it has."""
    return near.groupBy("v").agg(F.min("n").alias("m"), F.count("*").alias("k"))


def _star(near: DataFrame, low: DataFrame, vertices: int, rows: int) -> DataFrame:
    """``v, n, m``: ``near`` with each vertex's smallest neighbour, from ``low``, which is written.

    ``vertices`` and ``rows`` are bounds of how many rows ``low`` and ``near``
    have.  Up to a fifth of ``BROADCAST_ROWS`` vertices are broadcast.  Of more,
    the rows of one with more than its share of ``rows`` (1000 at least) do not
    move: there are fewer than that fifth of such vertices, and they are broadcast.
    """
    most = max(1, BROADCAST_ROWS // 5)
    if vertices <= most:
        return near.join(F.broadcast(low.select("v", "m")), "v")
    hub = F.col("k") > max(1000, -(-rows // most))
    hubs = F.broadcast(low.where(hub).select("v", F.col("m").alias("hub_m")))
    # vertices without a hub's minimum meet theirs by shuffle; hubs' rows keep a key of their own there
    apart = near.join(hubs, "v", "left").withColumn("key", F.when(F.col("hub_m").isNull(), F.col("v")).otherwise(F.xxhash64("v", "n")))
    rest = low.where(~hub).select(F.col("v").alias("own_key"), F.col("v").alias("own"), "m")
    met = apart.join(rest, (F.col("key") == F.col("own_key")) & (F.col("v") == F.col("own")), "left")
    return met.select("v", "n", F.coalesce("hub_m", "m").alias("m"))


def join_small(rows: DataFrame, keyed: DataFrame, on: list[str], how: str, most: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Join ``rows`` with a written table that has each key once, whatever the keys' skew.

    ``keyed`` is broadcast if it is counted at ``most`` rows or fewer.  A larger
    one is repeated ``salts`` times and ``rows`` are dealt by key and salt, so a
    key that holds a third of all rows is in as many tasks.
    """
    if keyed.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(keyed), on, how)
    salted = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]), F.lit(salts)).cast("int"))
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")
