"""Harmonic packing of token ids into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces of at most
``capacity // k`` ids and each of its bins takes exactly k of them, so a bin is
filled without looking at any other.  A document is cut so that its pieces fit
their classes: whole sequences first, then the largest ``capacity // k`` that
the rest still holds, until the rest is at most ``tail`` ids and goes uncut to
its class.  Every task fills its own bins; there is no shuffle.  What is left
in a task's open bins at its end is laid end to end and cut at powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from .tokens import END_ID, WORD_BPE, encoder, tokenizer_path

CAPACITY, TAIL = 4096, 128
#: Chunks that a worker's encoder keeps: fewer than by default, as packing shares executors with other stages.
CACHE = 300_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[tuple[int, int]]:
    """Lengths of a document's pieces with their classes."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest > tail:
        k = -(-capacity // rest)
        out.append((capacity // k, k))
        rest -= capacity // k
    if rest:
        out.append((rest, capacity // rest))
    return out


class Bins:
    """Open bins of one task; ``done`` gets the rows of closed ones."""

    def __init__(self, task: int, capacity: int, tail: int):
        self.next, self.capacity, self.tail = task << 40, capacity, tail
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []
        self.bytes = 0

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), ids.tobytes(), total, self.next, at))
            at += len(ids)
            self.bytes += ids.nbytes
        self.next += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        start = 0
        for length, k in cut(len(ids), self.capacity, self.tail):
            piece = (doc, start, ids[start : start + length], len(ids))
            start += length
            if k == 1:
                self._close([piece])
                continue
            bin_ = self.open.setdefault(k, [])
            bin_.append(piece)
            if len(bin_) == k:
                self._close(self.open.pop(k))

    def own(self) -> None:
        """Copy the ids of open pieces, so that a batch's ids can go."""
        self.open = {k: [(d, s, i.copy(), t) for d, s, i, t in v] for k, v in self.open.items()}

    def finish(self) -> None:
        """Close what is open: end to end, cut where sequences need no padding."""
        left = [p for _, v in sorted(self.open.items()) for p in v]
        total, self.open = sum(len(p[2]) for p in left), {}
        room, now = 0, []
        for doc, start, ids, n in left:
            while len(ids):
                if not room:
                    if now:
                        self._close(now)
                    now, room = [], min(self.capacity, 1 << (total.bit_length() - 1))
                    total -= room
                now.append((doc, start, ids[:room], n))
                start, room, ids = start + len(now[-1][2]), room - len(now[-1][2]), ids[room:]
        if now:
            self._close(now)

    def rows(self) -> pa.RecordBatch | None:
        done, self.done, self.bytes = self.done, [], 0
        if not done:
            return None
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, tail: int = TAIL, end_id: int = END_ID) -> DataFrame:
    """Pack every document's ids; one row for each piece, with its ids.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null
    or empty text is the end id alone; a null doc_id stays null.  Rows that
    repeat a doc_id are packed each on its own; an empty table gives an empty
    result.  ``ids`` are
    little-endian unsigned 32-bit.  ``capacity`` must be a power of two.
    A task's result depends on its rows and their order only, so a task that
    runs again after a loss gives the same rows.
    """
    path = tokenizer or tokenizer_path(WORD_BPE)

    def body(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, enc = Bins(TaskContext.get().partitionId(), capacity, tail), encoder(path, CACHE)
        for batch in it:
            for part in C.parts(batch):
                ids, at = enc.encode_documents(C.texts(part), end_id)
                for doc, a, b in zip(part.column(0).to_pylist(), at, at[1:], strict=False):
                    bins.add(doc, ids[a:b])
                    if bins.bytes > 8 << 20:
                        yield bins.rows()
                bins.own()
                if (out := bins.rows()) is not None:
                    yield out
        bins.finish()
        if (out := bins.rows()) is not None:
            yield out
        C.release()

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(body, SCHEMA)
