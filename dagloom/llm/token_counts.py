"""Token counts from flat, unindexed token files.

A flat file is nothing but little-endian ids, each document ended by a
separator.  Files are cut into blocks of equal size regardless of documents;
every block is searched for separators on its own, and a prefix scan over the
blocks' counts and last separators gives each document its number and its
start, also where it begins blocks before it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .files import load, save
from .tokens import BYTE_BPE, encoder, tokenizer_path

#: Ids of a block, and ids after which a task begins its next file.
BLOCK_IDS, FILE_IDS = 1 << 20, 16 << 20
SEPARATOR = 50256


def write_flat(docs: DataFrame, out: str, tokenizer: str | None = None, separator: int = SEPARATOR, kind: str = "<u2") -> DataFrame:
    """Write ids of all documents as flat files; ``file, ids, number, doc_id``.

    The result tells which document is a file's number 0, 1, ... and repeats
    the file's size.  It is written to the shared folder, as the files are.
    The wording of special tokens in a text is read as ordinary text, so that
    no separator occurs within a document.
    """
    path = tokenizer or tokenizer_path(BYTE_BPE)

    def body(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, docs, ids = TaskContext.get().partitionId(), 0, [], []
        enc = encoder(path, plain=True)

        def flush() -> pa.RecordBatch:
            nonlocal k, docs, ids
            uri, n = f"{out}/part-{task:06d}-{k:05d}.bin", sum(map(len, ids))
            save(uri, *(x.astype(kind) for x in ids))
            who = pa.concat_arrays(docs)
            k, docs, ids = k + 1, [], []
            return pa.record_batch([pa.array([uri] * len(who)), pa.array(np.full(len(who), n)), pa.array(np.arange(len(who))), who], ["file", "ids", "number", "doc_id"])

        for batch in it:
            for part in C.parts(batch):
                x, _ = enc.encode_documents(C.texts(part), separator)
                docs.append(part.column(0))
                ids.append(x.astype(kind))
                if sum(map(len, ids)) >= FILE_IDS:
                    yield flush()
        if docs:
            yield flush()

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(body, "file string, ids long, number long, doc_id long")
    return C.write_out(named, "flat-names")


def scan_flat(files: DataFrame, separator: int = SEPARATOR, kind: str = "<u2", block: int = BLOCK_IDS) -> DataFrame:
    """``file, number, start, n_tokens`` of every document of flat files.

    ``files`` has ``file`` and ``ids`` (its length).  ``n_tokens`` counts the
    separator.  Ids after a file's last separator are a last document without
    one.  A file without ids has no documents.
    """
    width = np.dtype(kind).itemsize
    blocks = files.where("ids > 0").select("file", "ids", F.explode(F.expr(f"sequence(0L, (ids - 1) div {block})")).alias("block"))

    def body(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for file, total, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = b * block
                ids = np.frombuffer(load(file, first * width, min(block, total - first) * width), kind)
                ends = np.flatnonzero(ids == separator) + first
                if first + len(ids) == total and ids[-1] != separator:
                    ends = np.append(ends, total - 1)
                yield pa.record_batch([pa.array([file]), pa.array([b]), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "ends"])

    found = C.dealt(C.write_out(blocks, "flat-blocks")).mapInArrow(body, "file string, block long, ends array<long>")
    found = C.write_out(found, "flat-ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("file", "block", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last")).select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("numbers"),
        F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)).alias("previous"),
    )
    met = found.join(scan, ["file", "block"]).select("file", "numbers", "previous", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("previous")).otherwise(F.expr("get(ends, i - 1)")) + 1
    return met.select("file", (F.col("numbers") + F.col("i")).alias("number"), start.alias("start"), (F.col("end") + 1 - start).alias("n_tokens"))


def count_tokens(docs: DataFrame, out: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Tokens of every document (``doc_id, file, number, start, n_tokens``) through flat files.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null
    or empty text is its separator alone; a null doc_id stays null; rows that
    repeat a doc_id are counted each on its own; an empty table gives an empty
    result.
    """
    named = write_flat(docs, out or C.new_dir(docs.sparkSession, "flat"), tokenizer)
    files = named.select("file", "ids").distinct()
    return named.select("file", "number", "doc_id").join(scan_flat(files), ["file", "number"]).select("doc_id", "file", "number", "start", "n_tokens")
