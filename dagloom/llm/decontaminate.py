"""Benchmark decontamination by template canonicalisation.

Words of benchmark items and documents are put in canonical form: numbers
become typed placeholders, all else is lower-cased without surrounding
punctuation; a capitalised word may also be a name, a unit after a number also
a unit and a spelled number also a number, and every reading of a window of
five words is hashed.  Windows with too few words besides placeholders are
hashed by their real values.

Both sides' windows are tables: a bit filter of bounded size, made of the
items' hashes, leaves few of the documents' windows, which are then hash-joined
with the items' in Spark.  Where enough of an item's windows occur, the values
behind the placeholders are compared: an item's value must stand for the same
value throughout the document, so a question with new numbers is caught, while
unrelated text of the same form is not.  Verdicts are of texts, not of rows:
rows of equal text have one.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH, SIMILARITY, LITERALS = 5, 0.8, 3
#: Bits of the filter at most (16 MiB); with more windows it passes more, and the join decides.
FILTER_BITS = 1 << 27
#: Windows whose readings are formed at once.
STEP = 1 << 17
UNITS = frozenset("kg g mg km m cm mm mile miles hour hours hr minute minutes min second seconds s day days week weeks month months year years dollar dollars euro euros cent cents percent liter liters litre litres l ml lb lbs pound pounds foot feet inch inches degree degrees mph kmh".split())
SPELLED = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
_NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(%|[a-z]{1,4})?")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_NONE, _WORD, _NUM, _UNIT, _NAME = range(5)


@dataclass
class Forms:
    """What a batch's distinct words are, apart from their context."""

    kind: np.ndarray
    literal: np.ndarray
    capital: np.ndarray
    unit: np.ndarray
    spelled: np.ndarray
    value: list[str]


def forms(words: list[bytes]) -> Forms:
    n = len(words)
    kind, value, plain = np.zeros(n, np.int8), [], []
    capital, unit, spelled = np.zeros((3, n), bool)
    for i, raw in enumerate(words):
        w = raw.decode()
        s = w if w.isalnum() else _EDGE.sub("", w)
        low = s.lower()
        value.append(low)
        plain.append(low.encode())
        if not any(c.isalnum() for c in s):
            continue
        kind[i] = _NUM if _NUMBER.fullmatch(low) else _WORD
        capital[i] = s[0].isupper() and s[1:].islower()
        unit[i], spelled[i] = low in UNITS, low in SPELLED
    return Forms(kind, C.word_hashes(plain), capital, unit, spelled, value)


@dataclass
class Words:
    """The words that count of a row of texts: what each may be read as."""

    text: np.ndarray
    code: np.ndarray
    number: np.ndarray
    name: np.ndarray
    unit: np.ndarray
    spelled: np.ndarray
    own: np.ndarray


def canonical(codes: np.ndarray, f: Forms, at: np.ndarray | None = None) -> Words:
    """For the words in ``codes`` that count; text k has those from ``at[k]`` to ``at[k + 1]``."""
    text = np.zeros(len(codes), np.int64) if at is None else np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = f.kind[codes] != _NONE
    codes, text = codes[keep], text[keep]
    number = f.kind[codes] == _NUM
    after = np.zeros(len(codes), bool)
    after[1:] = number[:-1] & (text[1:] == text[:-1])
    return Words(text, codes, number, f.capital[codes] & ~number, f.unit[codes] & ~number & after, f.spelled[codes] & ~number, np.where(number, np.uint64(_NUM), f.literal[codes]))


def _add(h: np.ndarray, word) -> np.ndarray:
    return C.mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def windows(w: Words, f: Forms, width: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of every reading of the windows at ``places``, and whether it is by form.

    A capitalised word is read as itself and as a name, a unit after a number as
    itself and as a unit, a spelled number as itself and as a number, so no reading hangs on what stands before the window.
    Readings of fewer than LITERALS words besides placeholders are left out; a
    window without any other is read by its real values instead.
    """
    least = min(width, LITERALS)
    at, h, slots = places, np.full(len(places), np.uint64(width)), np.zeros(len(places), np.int8)
    few = np.zeros(len(places), np.int64)
    for k in range(width):
        few += w.number[places + k]
        word = at + k
        number = w.number[word]
        ways = [(at, _add(h, w.own[word]), slots + number)]
        for may, kind in ((w.name, _NAME), (w.unit, _UNIT), (w.spelled, _NUM)):
            m = may[word] & (slots < width - least)
            if m.any():
                ways.append((at[m], _add(h[m], np.uint64(kind)), slots[m] + np.int8(1)))
        at, h, slots = (np.concatenate(x) for x in zip(*ways, strict=True)) if len(ways) > 1 else ways[0]
        if (over := slots > width - least).any():
            at, h, slots = at[~over], h[~over], slots[~over]
    exact = places[few > width - least]
    if not len(exact):
        return h, at, np.ones(len(at), bool)
    real = np.full(len(exact), np.uint64(~width & 0xFFFFFFFF))
    for k in range(width):
        real = _add(real, f.literal[w.code[exact + k]])
    return np.concatenate((h, real)), np.concatenate((at, exact)), np.arange(len(at) + len(exact)) < len(at)


def item_row(text: str | None) -> dict | None:
    """An item's words and windows; one of fewer words than a window is one window of its own length.

    ``values`` and ``slot`` are by word; ``window`` (which windows are equal) and
    ``by_form`` by place; ``h`` and ``place`` list every reading.
    """
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    f = forms(words)
    w = canonical(np.arange(len(words)), f)
    width = min(WIDTH, len(w.code))
    if not width:
        return None
    n = len(w.code) - width + 1
    h, at, form = windows(w, f, width, np.arange(n))
    # equal windows are one: by form those of the same words, else those of the same values
    by_form, window, seen = np.zeros(n, bool), [], {}
    by_form[at[form]] = True
    for p in range(n):
        words_of = w.own[p : p + width] if by_form[p] else f.literal[w.code[p : p + width]]
        window.append(seen.setdefault((bool(by_form[p]), words_of.tobytes()), len(seen)))
    slot = w.number | w.name | w.unit | w.spelled
    return {"width": width, "values": [f.value[c] for c in w.code], "slot": slot.tolist(), "window": window, "by_form": by_form.tolist(), "h": h.view(np.int64).tolist(), "place": at.tolist()}


def share_of(item: dict, found: list[tuple[int, int, list[str]]]) -> float:
    """Share of the item's windows found, at (place in document, in item, words there), with consistent values.

    Values are consistent if each stands for itself or each for what it mostly
    stands for.  The share is that of the windows by form or of all windows.
    """
    window, values, slot = item["window"], item["values"], item["slot"]
    every, by_form = set(window), {x for x, f in zip(window, item["by_form"], strict=True) if f}

    def share(of: set[int]) -> float:
        return max(len(of & s) / len(s) if s else 0.0 for s in (by_form, every))

    if share({window[p] for _, p, _ in found}) < SIMILARITY:
        return 0.0
    seen: dict[str, Counter] = defaultdict(Counter)
    slots = [[(values[p + k], v) for k, v in enumerate(there) if slot[p + k]] for _, p, there in found]
    for x in slots:
        for a, b in x:
            seen[a][b] += 1
    most = {a: max(c.items(), key=lambda kv: (kv[1], kv[0]))[0] for a, c in seen.items()}
    same = {window[p] for (_, p, _), x in zip(found, slots, strict=True) if all(a == b for a, b in x)}
    mostly = {window[p] for (_, p, _), x in zip(found, slots, strict=True) if all(most[a] == b for a, b in x)}
    return max(share(same), share(mostly))


def _items(benchmark: DataFrame) -> DataFrame:
    """A row of :func:`item_row` for every distinct item, with ``item_id`` and a number ``item``."""
    kinds = {"width": pa.int32(), "values": pa.list_(pa.string()), "slot": pa.list_(pa.bool_()), "window": pa.list_(pa.int32()), "by_form": pa.list_(pa.bool_()), "h": pa.list_(pa.int64()), "place": pa.list_(pa.int32())}

    def body(it):
        from pyspark import TaskContext

        item = TaskContext.get().partitionId() << 40
        for batch in it:
            for part in C.parts(batch):
                rows = [(k, r) for k, r in zip(part.column(0).to_pylist(), map(item_row, part.column(1).to_pylist()), strict=True) if r]
                columns = [pa.array([k for k, _ in rows], pa.int64()), pa.array(range(item, item + len(rows)), pa.int64())]
                item += len(rows)
                yield pa.record_batch([*columns, *(pa.array([r[c] for _, r in rows], t) for c, t in kinds.items())], ["item_id", "item", *kinds])

    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    schema = "item_id long, item long, width int, values array<string>, slot array<boolean>, window array<int>, by_form array<boolean>, h array<long>, place array<int>"
    return C.write_out(given.mapInArrow(body, schema), "benchmark-items")


def _filter(keys: DataFrame) -> np.ndarray:
    """Which low bits the hashes ``h`` have; at most ``FILTER_BITS`` bits, made in Spark."""
    n = min(FILTER_BITS, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    bit = F.col("h").bitwiseAND(n - 1)
    words = keys.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    there = np.zeros(n >> 6, np.int64)
    for r in words.toLocalIterator():
        there[r["at"]] = r["bits"]
    return there


def _survivors(batch: pa.RecordBatch, widths: list[int], there: np.ndarray) -> pa.RecordBatch | None:
    """``t1, t2, h, at, words``: the windows of a batch's distinct texts that pass the filter."""
    t1, t2 = (batch.column(k).to_numpy() for k in (0, 1))
    _, first = np.unique(np.stack((t1, t2)), axis=1, return_index=True)
    batch = batch.take(pa.array(np.sort(first)))
    t1, t2 = (batch.column(k).to_numpy() for k in (0, 1))
    at, words, codes = C.split_words(C.texts(batch), lower=False)
    f = forms(words)
    w = canonical(codes, f, np.asarray(at))
    begin = np.searchsorted(w.text, np.arange(len(t1)))
    mask = np.uint64(len(there) * 64 - 1)
    out = []
    for width in widths:
        starts = np.arange(max(0, len(w.code) - width + 1))
        starts = starts[w.text[starts] == w.text[starts + width - 1]] if len(starts) else starts
        for lo in range(0, len(starts), STEP):
            h, place, _ = windows(w, f, width, starts[lo : lo + STEP])
            bit = (h & mask).astype(np.int64)
            hit = np.flatnonzero(there[bit >> 6] >> (bit & 63) & 1)
            if len(hit):
                out.append((h[hit].view(np.int64), place[hit], np.full(len(hit), width)))
    if not out:
        return None
    h, place, width = (np.concatenate(x) for x in zip(*out, strict=True))
    text = w.text[place]
    value = [[f.value[c] for c in w.code[p : p + n]] for p, n in zip(place.tolist(), width.tolist(), strict=True)]
    return pa.record_batch([pa.array(t1[text]), pa.array(t2[text]), pa.array(h), pa.array(place - begin[text]), pa.array(value, pa.list_(pa.string()))], ["t1", "t2", "h", "at", "words"])


def _told(docs: DataFrame) -> DataFrame:
    """``docs`` with a 128-bit name of each text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"t1": F.xxhash64(F.lit(1), text), "t2": F.xxhash64(F.lit(2), text)})


def _scores(batch: pa.RecordBatch) -> pa.RecordBatch:
    score = []
    for r in batch.to_pylist():
        found = sorted((x["at"], x["place"], x["words"]) for x in r["found"])
        score.append(share_of(r, found))
    return pa.record_batch([*(batch.column(c) for c in ("t1", "t2", "item_id")), pa.array(score, pa.float64())], ["t1", "t2", "item_id", "score"])


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``t1, t2, n_items, best_item, best_score`` of the texts that hold an item."""
    items = _items(benchmark)
    keys = items.select("item", F.explode(F.arrays_zip("h", "place")).alias("r")).select("item", "r.*").distinct()
    keys = C.write_out(keys.groupBy("h").agg(F.collect_list(F.struct("item", "place")).alias("of")), "benchmark-windows")
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    there = docs.sparkSession.sparkContext.broadcast(_filter(keys.select("h")))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        return _survivors(batch, widths, there.value)

    left = _told(docs.select("text")).select("t1", "t2", "text").mapInArrow(C.batches(one), "t1 long, t2 long, h long, at long, words array<string>")
    met = C.join_small(left, keys, ["h"], "inner").select("t1", "t2", "at", "words", F.explode("of").alias("of")).select("t1", "t2", "of.item", "at", "of.place", "words")
    # copies of a text meet the same items: each hit counts once, spread by its place too
    hits = met.dropDuplicates(["t1", "t2", "item", "at", "place"]).groupBy("t1", "t2", "item").agg(F.collect_list(F.struct("at", "place", "words")).alias("found"))
    judged = C.join_small(hits, items.drop("h", "place", "width"), ["item"], "inner").drop("item")
    scored = judged.mapInArrow(C.batches(_scores), "t1 long, t2 long, item_id long, score double").where(F.col("score") >= SIMILARITY)
    by_item = scored.groupBy("t1", "t2", "item_id").agg(F.max("score").alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("item_id").isNull().alias("unnamed"), "item_id"))
    out = by_item.groupBy("t1", "t2").agg(F.count("*").alias("n_items"), best.alias("best"))
    return C.write_out(out.select("t1", "t2", "n_items", F.col("best.item_id").alias("best_item"), (-F.col("best.s")).alias("best_score")), "contaminated")


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, best_item, best_score`` of every document.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and
    ``text``; other columns are ignored.  An item counts if 0.8 or more of its
    distinct windows occur with consistent values, either of those by form or of
    all; ties of the best go to the smallest item_id.  Windows of fewer than
    three words besides placeholders have no form and occur only with their real
    values.  Items of one item_id are counted once, by their best; items without
    one count together as one item.  A null or empty text holds nothing, as does
    an empty benchmark; repeated rows are each given; a null doc_id stays null;
    an empty table gives an empty result.
    """
    named = _told(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "t1", "t2")
    got = C.join_small(named, verdicts(docs, benchmark), ["t1", "t2"], "left")
    n = F.coalesce("n_items", F.lit(0).cast("long"))
    return got.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), "best_item", "best_score")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows (see :func:`find`), all columns as they are."""
    t1, t2 = (f"_t{k}_{uuid.uuid4().hex}" for k in (1, 2))
    text = F.coalesce("text", F.lit(""))
    named = docs.withColumns({t1: F.xxhash64(F.lit(1), text), t2: F.xxhash64(F.lit(2), text)})
    bad = verdicts(docs, benchmark).select(F.col("t1").alias(t1), F.col("t2").alias(t2))
    return C.join_small(named, bad, [t1, t2], "left_anti").select(*docs.columns)
