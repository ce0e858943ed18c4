"""Token files of directly addressable codes.

An id is cut into chunks of 8 bits, the lowest first.  Level 0 holds the first
chunk of every id, level 1 the second chunk of those that have one, and so on.
A level's continuation bitmap tells which of its entries go on, and a rank
directory (ones before every block of 512 bits) turns an entry's place into
its place on the next level.  So the id at any position is found by one look
at each level, without decoding what lies before it.

A shard file: ``DAC2``, then little-endian unsigned 64-bit numbers: documents,
how many of them, the first ones, have no doc_id, levels, ids of each level;
document ids (0 where there is none) and first positions (documents + 1); for each level its chunks, its bitmap (bit i of byte i // 8, padded to 64
bytes) and its directory of unsigned 64-bit ranks (one more than blocks).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .files import load, save
from .tokens import BYTE_BPE, END_ID, encoder, tokenizer_path

MAGIC = b"DAC2"
BLOCK = 512
#: Ids after which a task begins its next shard.
SHARD_IDS = 4 << 20


def encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap and rank directory of each level."""
    out, rest = [], ids.astype(np.uint32)
    while len(rest) or not out:
        on = rest > 255
        blocks = -(-len(on) // BLOCK)
        bits = np.zeros(blocks * BLOCK, bool)
        bits[: len(on)] = on
        ranks = np.concatenate(([0], np.cumsum(bits.reshape(blocks, BLOCK).sum(1)))).astype("<u8")
        out.append(((rest & 255).astype(np.uint8), np.packbits(bits, bitorder="little"), ranks))
        rest = rest[on] >> 8
    return out


class Dac:
    """A shard as read from its file."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC2 file")
        at = 4

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        docs, self.unnamed, levels = (int(x) for x in take(3, "<u8"))
        sizes = [int(x) for x in take(levels, "<u8")]
        self.doc_ids, self.first = take(docs, "<i8"), take(docs + 1, "<u8").astype(np.int64)
        self.levels = []
        for n in sizes:
            blocks = -(-n // BLOCK)
            self.levels.append((take(n, "u1"), take(blocks * BLOCK // 8, "u1"), take(blocks + 1, "<u8")))

    def _rank(self, level: int, i: int) -> int:
        """Ones of the level's bitmap before ``i``."""
        _, bits, ranks = self.levels[level]
        b = i // BLOCK
        return int(ranks[b]) + int(np.unpackbits(bits[b * BLOCK // 8 : -(-i // 8)], bitorder="little", count=i - b * BLOCK).sum())

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        out, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return out

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids at positions ``a`` to ``b``, which is excluded."""
        out, where = np.zeros(b - a, np.uint32), np.arange(b - a)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if a >= b:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            low = a & ~7
            on = np.unpackbits(bits[low >> 3 : -(-b // 8)], bitorder="little")[a - low : b - low].astype(bool)
            if level + 1 < len(self.levels):
                a = self._rank(level, a)
                b = a + int(on.sum())
            where = where[on]
        return out


def save_shard(uri: str, doc_ids: np.ndarray, first: np.ndarray, ids: np.ndarray, unnamed: int = 0) -> None:
    levels = encode(ids)
    head = np.array([len(doc_ids), unnamed, len(levels), *(len(x[0]) for x in levels)], "<u8")
    save(uri, MAGIC, head, np.asarray(doc_ids, "<i8"), np.asarray(first, "<u8"), *(x for level in levels for x in level))


def write_corpus(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents' ids as shards below ``out``, in ascending doc_id order.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Returns
    ``task, shard, path, docs, ids, base`` of every shard, a row for some
    millions of ids, written to the shared folder; ``base`` counts the ids of
    all shards before it.  A text that is null is empty; documents without a
    doc_id come first; documents that share one are ordered by their texts; an
    empty table gives no shard.
    """
    path = tokenizer or tokenizer_path(BYTE_BPE)

    def body(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        docs, ids, lengths, unnamed = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal k, docs, ids, lengths, unnamed
            uri = f"{out}/part-{task:06d}-{k:05d}.dac"
            flat, n = np.concatenate(ids), np.concatenate(lengths)
            doc_ids = np.concatenate(docs)
            save_shard(uri, doc_ids, np.concatenate(([0], np.cumsum(n))), flat, unnamed)
            row = pa.record_batch([pa.array([task]), pa.array([k]), pa.array([uri]), pa.array([len(doc_ids)]), pa.array([len(flat)])], ["task", "shard", "path", "docs", "ids"])
            k, docs, ids, lengths, unnamed = k + 1, [], [], [], 0
            return row

        for batch in it:
            for part in C.parts(batch):
                x, at = enc.encode_documents(C.texts(part), end_id)
                docs.append(pc.fill_null(part.column(0), 0).to_numpy())
                unnamed += part.column(0).null_count
                ids.append(x)
                lengths.append(np.diff(at))
                if sum(map(len, ids)) >= SHARD_IDS:
                    yield flush()
        if docs:
            yield flush()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = C.write_out(dealt.mapInArrow(body, "task long, shard long, path string, docs long, ids long"), "dac-shards")
    # prefix scan in two steps: over the tasks, a row each, and within a task
    tasks = shards.groupBy("task").agg(F.sum("ids").alias("n"))
    before = tasks.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("ids").over(Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = shards.withColumn("within", within).join(before, "task").select("task", "shard", "path", "docs", "ids", (F.col("before") + F.col("within")).alias("base"))
    return C.write_out(based, "dac-bases")


def read_corpus(shards: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document, by random access into the files."""

    def body(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                dac = Dac(load(path))
                step = 500
                for lo in range(0, len(dac.doc_ids), step):
                    hi = min(lo + step, len(dac.doc_ids))
                    ids = [dac.ids(int(dac.first[k]), int(dac.first[k + 1])).astype("<u4").tobytes() for k in range(lo, hi)]
                    named = pa.array(dac.doc_ids[lo:hi], mask=np.arange(lo, hi) < dac.unnamed)
                    yield pa.record_batch([named, pa.array(dac.first[lo:hi] + base), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])
                del dac
        C.release()

    return C.dealt(shards.select("path", "base")).mapInArrow(body, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, out: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` and read them back; see :func:`write_corpus`."""
    return read_corpus(write_corpus(docs, out or C.new_dir(docs.sparkSession, "dac"), tokenizer))
