"""Exact n-gram Jaccard join as a metric-space join.

Jaccard distance is a metric, so a link (distance <= eps) can be confined to a
few regions of the space.  Three levels of regions are used, each exact:

1. *Rings about the empty set.*  The distance of a set from the empty set in
   the symmetric-difference metric is its size.  Linked sets differ in size by
   a factor of at most ``1 - eps``, so rings of that ratio are formed and every
   set is replicated to the next ring (its triangle-inequality window).
2. *Regions of equal projection.*  Within a ring the symmetric difference of a
   linked pair is at most ``delta``.  The shingle space is cut into K slices; a
   linked pair is equal (distance 0) in K - delta of them at least, so the sets'
   own projections are the centres of regions of radius 0.  K is such that sets
   have fewer empty slices than that; one with more is projected again under
   another cut, so no region consists of sets that merely lack the same shingles.
3. *Voronoi regions of pivots.*  Sets that meet in some region form candidate
   groups.  A group over the bound takes some members as pivots; each member is
   at home in the cell of its nearest pivot and is replicated to every cell whose
   pivot is at most 2 * eps farther (triangle inequality: a linked pair meets in
   the home cell of either set).  Cells over the bound are divided in the same way
   again.  A link counts in the region where its set of the smaller number is at
   home at every level, so exactly once.  A region that pivots do not divide (near
   copies that are all about equally far from them) is cut into blocks, and two
   blocks are compared only if their intervals of distance to every pivot come
   within eps of each other.

Pivots of the whole space instead of level 2 do not work on text: sets of
unrelated documents are all at a distance near 1 from any pivot, so windows of
2 * eps replicate nearly every document to every region (``replication``
measures it).

Equal sets are one class before anything else, so groups of copies of any size
cost one row.  Shingles and classes are identified by 64-bit and 128-bit
hashes; sizes, intersections and the threshold are exact over these.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words; two sets are linked at a similarity of ``num / den`` or more.

    It must be 2/3 or more: below, a small set may have no slice in common with a
    larger one that it is linked with but for empty ones.
    """

    width: int = 3
    num: int = 90
    den: int = 100

    def __post_init__(self) -> None:
        if not 2 * self.den <= 3 * self.num <= 3 * self.den or self.width < 1:
            raise ValueError(f"no such rule: {self}")

    @property
    def eps(self) -> float:
        """The largest distance of a link, with room for rounding."""
        return (self.den - self.num) / self.den + 1e-9

    def linked(self, a, b, both):
        return both * self.den >= (a + b - both) * self.num

    def most_apart(self, size: int) -> int:
        """Largest symmetric difference of a linked pair of sets of at most ``size`` each."""
        return (self.den - self.num) * 2 * size // (self.den + self.num)


#: The join's own rule, and that of stages that look for near duplicates.
LINKED, NEAR_DUPLICATE = Rule(), Rule(5, 80, 100)
#: Members, and bytes of shingles, that one block of a candidate group may hold.
BLOCK_ROWS, BLOCK_BYTES = 128, 32 << 20
#: Pivots of a region above a block, and the share of it that its largest cell may have for it to count as divided.
PIVOTS, DIVIDED = 6, 0.7
#: Bytes of pivots that may be broadcast.
PIVOT_BYTES = 64 << 20


def shingle_hashes(codes: np.ndarray, hashes: np.ndarray, width: int = LINKED.width) -> np.ndarray:
    """Distinct shingles of one document's words, sorted (uint64)."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64)
    h = hashes[codes]
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), n)], np.uint64)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = C.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k])
    return np.unique(out)


def sets_of(batch: pa.RecordBatch, width: int = LINKED.width):
    """The shingle set of every row's text (null: empty)."""
    at, words, codes = C.split_words(C.texts(batch), lower=True)
    hashes = C.word_hashes(words)
    return (shingle_hashes(codes[a:b], hashes, width) for a, b in zip(at, at[1:], strict=False))


def digest(s: np.ndarray) -> tuple[int | None, int | None]:
    if not len(s):
        return None, None
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Rings:
    """Sizes cut so that a linked pair is in the same ring or in neighbours."""

    def __init__(self, rule: Rule = LINKED) -> None:
        self.rule, self.cut = rule, {}
        self.low, n = [], 1
        while n < 1 << 40:
            self.low.append(n)
            n = max(n + 1, n * rule.den // rule.num + 1)
        self.low = np.array(self.low, np.int64)

    def of(self, n: int) -> list[int]:
        r = int(np.searchsorted(self.low, n, "right")) - 1
        nxt = int(self.low[r + 1])
        return [r, r + 1] if n * self.rule.den >= nxt * self.rule.num else [r]

    def slices(self, r: int) -> tuple[int, int]:
        """How many slices ring ``r`` has, and how many of them are equal at least in a linked pair.

        Slices are added until the equal ones are likely to be more than a set's
        empty ones, of which a set of the ring has K * exp(-size / K) on average.
        """
        if r not in self.cut:
            delta = self.rule.most_apart(int(self.low[r + 1]) - 1)
            k, size = delta + 1, max(1, int(self.low[r]) * self.rule.num // self.rule.den)
            while delta and k - delta <= (mean := k * math.exp(-size / k)) + 3 * math.sqrt(mean) and k < size:
                k += 1
            self.cut[r] = k, k - delta
        return self.cut[r]


def signatures(s: np.ndarray, rings: Rings) -> np.ndarray:
    """Names of the regions of a set (int64).

    Under each cut of the shingle space the set's non-empty slices are named.
    Cuts go on until the set has fewer empty slices than are equal in any linked
    pair, so that one equal slice at least is not empty; of a pair the first set
    to be done decides.  Rings of one slice hold only pairs of equal sets, which
    are one class already, and are left out.
    """
    out = []
    for r in rings.of(len(s)):
        k, equal = rings.slices(r)
        if k < 2:
            continue
        for cut in count():
            salt = C.mix(np.array([r << 32 | cut], np.uint64))[0]
            h = C.mix(s ^ salt)
            part = (h % np.uint64(k)).astype(np.int64)
            total = np.zeros(k, np.uint64)
            np.add.at(total, part, C.mix(h + salt))
            there = np.bincount(part, minlength=k) > 0
            out.append(C.mix(total[there] * np.uint64(2 * k + 1) + np.flatnonzero(there).astype(np.uint64) * salt))
            if k - there.sum() < equal:
                break
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def classes(docs: DataFrame, width: int = LINKED.width) -> DataFrame:
    """All columns but ``text`` and ``n_shingles, d1, d2`` of every row; no digest if its set is empty."""
    kept = [c for c in docs.columns if c != "text"]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, d = [], []
        for s in sets_of(batch, width):
            n.append(len(s))
            d.append(digest(s))
        columns = [*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64())]
        return pa.record_batch(columns, [*kept, "n_shingles", "d1", "d2"])

    kinds = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in ("n_shingles", "d1", "d2"))])
    return docs.select(*kept, "text").mapInArrow(C.batches(one), kinds)


def _region_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """``sig, d, o``: a class in a region, with a class known to be there, by the first halves of their digests.

    Within a batch all classes of a region but the smallest leave the region
    with a link to that one (their ``sig`` becomes their own, so that they
    spread), which keeps a region's rows near the number of batches.
    """
    rings = Rings(rule)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        seen: dict[int, int] = {}
        sigs = []
        for s in sets_of(batch, rule.width):
            d = digest(s)[0]
            if d is not None and d not in seen:
                seen[d] = len(seen)
                sigs.append(signatures(s, rings))
        if not sigs or not sum(map(len, sigs)):
            return None
        ids = np.array(list(seen), np.int64)
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        who = np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
        sig = np.concatenate(sigs)
        by = np.lexsort((rank[who], sig))
        sig, who = sig[by], who[by]
        first = np.concatenate(([True], sig[1:] != sig[:-1]))
        head = who[np.flatnonzero(first)[np.cumsum(first) - 1]]
        # links of the same two classes by many regions are kept once
        keep = first.copy()
        later = np.flatnonzero(~first & (who != head))
        keep[later[np.unique(who[later] * np.int64(len(ids)) + head[later], return_index=True)[1]]] = True
        sig, who, head, first = sig[keep], who[keep], head[keep], first[keep]
        return pa.record_batch([pa.array(np.where(first, sig, ids[who])), pa.array(ids[who]), pa.array(ids[head])], ["sig", "d", "o"])

    return docs.select("doc_id", "text").mapInArrow(C.batches(one, 1 << 20), "sig long, d long, o long")


def _meetings(regions: DataFrame) -> DataFrame:
    """``d, o``: two classes that meet in some region, along stars."""

    def body(it):
        last = None  # the region being read, and its first class
        for batch in it:
            if not batch.num_rows:
                continue
            sig, d, o = (c.to_numpy() for c in batch.columns)
            own = d == o
            rows = [np.stack([d[~own], o[~own]])]
            sig, d = sig[own], d[own]
            if len(sig):
                start = np.concatenate(([True], sig[1:] != sig[:-1]))
                head = d[np.flatnonzero(start)[np.cumsum(start) - 1]]
                if last is not None and sig[0] == last[0]:
                    head[sig == last[0]] = last[1]
                last = (sig[-1], head[-1])
                met = head != d
                rows.append(np.stack([d[met], head[met]]))
            rows = np.concatenate(rows, axis=1)
            if rows.shape[1]:
                yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in rows], ["d", "o"])

    dealt = regions.repartition("sig").sortWithinPartitions("sig", "d")
    return dealt.mapInArrow(body, "d long, o long").distinct()


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 1 - both / (len(a) + len(b) - both)


def _u64(x) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def _block_matrix(side: np.ndarray, inner: np.ndarray, sets: list[np.ndarray], rule: Rule) -> np.ndarray:
    """Which sets are linked, between sides 0 and 1 or within side 2, above the diagonal and where the first is ``inner``."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = times[code] > 1
    code, row = np.unique(code[shared], return_inverse=True)[1], row[shared]
    both = np.zeros((n, n), np.float64)
    step = 1 << 13
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, (lo, lo + step))
        m = np.zeros((n, step), np.float32)
        m[row[a:b], code[a:b] - lo] = 1
        both += m @ m.T
    link = rule.linked(size[:, None], size[None, :], both)
    link &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    return np.triu(link & inner[:, None], 1)


def _verify(members: DataFrame, pairs: bool, rule: Rule = LINKED) -> DataFrame:
    """All exact links within every ``task``; columns task, cid, side, inner, s.

    With ``pairs`` one row a link: ``a, b``.  Otherwise one row a set with links:
    ``a``, its ``n`` links, and ``b``, the same for all sets joined by them.
    """

    def one(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        ids, side, inner = (t.column(c).to_numpy() for c in ("cid", "side", "inner"))
        link = _block_matrix(side, inner, [_u64(x) for x in t.column("s").to_pylist()], rule)
        i, j = np.nonzero(link)
        if not len(i):
            return None
        if pairs:
            return pa.record_batch([pa.array(ids[i]), pa.array(ids[j])], names)
        there = np.unique(np.concatenate((i, j)))
        link, part = link | link.T, np.full(len(ids), -1)
        for k in there:
            todo = [k] if part[k] < 0 else []
            part[todo] = k
            while todo:
                new = np.flatnonzero(link[todo.pop()] & (part < 0))
                part[new] = k
                todo += new.tolist()
        return pa.record_batch([pa.array(ids[there]), pa.array(ids[part[there]]), pa.array(link.sum(1)[there])], names)

    names = ["a", "b"] if pairs else ["a", "b", "n"]
    dealt = members.select("task", "cid", "side", "inner", "s").repartition("task").sortWithinPartitions("task", "cid")
    return dealt.mapInArrow(C.runs("task", one), ", ".join(f"{c} long" for c in names))


def _pivot_parts(sets: list[np.ndarray], rule: Rule) -> list[int]:
    """For every pivot the first pivot that it is joined with by links of pivots."""
    top = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if rule.linked(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))):
                    top[i] = top[j] = min(top[i], top[j])
    return top


def _to_pivots(members: DataFrame, pivots: DataFrame, rule: Rule) -> DataFrame:
    """``region, cid, inner, s, d, near, core`` of every member.

    ``d`` are the distances to the region's pivots, in their order, ``near`` the
    numbers of those it is linked with, and ``core`` names a part of the pivots
    that these join it with (-1: none).
    """

    def body(it):
        known: dict[int, list[int]] = {}
        for batch in it:
            for part in C.parts(batch, "s"):
                rows = []
                for region, s, p in zip(*(part.column(k).to_pylist() for k in ("region", "s", "p")), strict=True):
                    s, sets = _u64(s), [_u64(q["s"]) for q in p]
                    if region not in known:
                        known[region] = _pivot_parts(sets, rule)
                    both = [len(np.intersect1d(s, q, assume_unique=True)) for q in sets]
                    near = [i for i, q in enumerate(sets) if rule.linked(len(s), len(q), both[i])]
                    d = [1 - n / (len(s) + len(q) - n) for n, q in zip(both, sets, strict=True)]
                    rows.append((d, [p[i]["cid"] for i in near], known[region][near[0]] if near else -1))
                if rows:
                    d, near, core = zip(*rows, strict=True)
                    own = [part.column(c) for c in ("region", "cid", "inner", "s")]
                    yield pa.record_batch([*own, pa.array(d, pa.list_(pa.float64())), pa.array(near, pa.list_(pa.int64())), pa.array(core, pa.int32())], ["region", "cid", "inner", "s", "d", "near", "core"])
        C.release()

    size = pivots.agg(F.sum(F.expr("aggregate(p, 0L, (a, x) -> a + length(x.s))"))).first()[0] or 0
    met = C.join_small(members, pivots, ["region"], "inner", C.BROADCAST_ROWS if size <= PIVOT_BYTES else 0)
    return met.select("region", "cid", "inner", "s", "p").mapInArrow(body, "region long, cid long, inner boolean, s binary, d array<double>, near array<long>, core int")


def _cells(far: DataFrame, rule: Rule) -> DataFrame:
    """A row for each cell that a member is at home in or within the window of: ``cell``, and ``inner`` there."""
    near = F.array_min("d")
    home = F.array_position("d", near).cast("int")
    window = F.filter(F.transform("d", lambda x, i: F.when(x <= near + 2 * rule.eps, i + 1)), lambda c: c.isNotNull())
    return far.withColumn("home", home).withColumn("cell", F.explode(window)).withColumn("inner", F.col("inner") & (F.col("cell") == F.col("home")))


def regions(members: DataFrame, rule: Rule = LINKED, keep: list | None = None, through: list | None = None) -> list[DataFrame]:
    """Divide candidate groups (``g, cid, s``) recursively; tables of ``task, cid, side, inner, s`` to compare.

    Two members meet in a task, with the smaller cid ``inner``, exactly once if
    they are linked; ``keep`` gets a row (members, replicas) for each division.
    With ``through``, which gets tables of links ``a, b`` with pivots, members of
    an undivided region that these links join need not meet.
    """
    state = members.select(F.col("g").alias("region"), "cid", "s", F.lit(True).alias("inner"))
    done = []
    for level in count():
        sizes = state.groupBy("region").agg(F.count("*").alias("rows"), F.sum(F.length("s")).alias("bytes"))
        large = C.write_out(sizes.where((F.col("rows") > BLOCK_ROWS) | (F.col("bytes") > BLOCK_BYTES) & (F.col("rows") > 2)).select("region", "rows"), "jaccard-large")
        if large.isEmpty():
            done.append(state.select(F.col("region").alias("task"), "cid", F.lit(2).alias("side"), "inner", "s"))
            return done
        small = state.join(C.broadcast_if_small(large), "region", "left_anti")
        done.append(small.select(F.col("region").alias("task"), "cid", F.lit(2).alias("side"), "inner", "s"))
        big = C.join_small(state, large.select("region"), ["region"], "left_semi")
        order = F.xxhash64("cid", F.lit(level))
        best = big.groupBy("region", F.pmod(order, F.lit(PIVOTS)).alias("k")).agg(F.max_by(F.struct("cid", "s"), F.struct("inner", order, "cid")).alias("p"))
        pivots = C.write_out(best.groupBy("region").agg(F.array_sort(F.collect_list("p")).alias("p")), "jaccard-pivots")
        far = C.write_out(_to_pivots(big, pivots, rule), "jaccard-distances")
        stats = _cells(far, rule).groupBy("region", "cell").agg(F.count("*").alias("n"), F.min(F.when(F.col("inner"), F.col("cid"))).alias("least"))
        stats = C.write_out(stats.join(large, "region").select("region", "cell", "least", "n", "rows"), "jaccard-cells")
        whole = C.write_out(stats.groupBy("region").agg(F.max("n").alias("n"), F.first("rows").alias("rows")).where(F.col("n") > DIVIDED * F.col("rows")).select("region"), "jaccard-whole")
        if not whole.isEmpty():
            dense = C.join_small(far, whole, ["region"], "left_semi")
            if through is not None:
                through.append(dense.select(F.col("cid").alias("a"), F.explode("near").alias("b")).where("a <> b"))
            done.append(_blocks(dense, rule.eps, through is None))
        parts = stats.where("least is not null").select("region", "cell", "least")
        # a replica of a smaller number than all that are at home there meets none that counts
        placed = C.join_small(_cells(C.join_small(far, whole, ["region"], "left_anti"), rule), C.write_out(parts, "jaccard-parts"), ["region", "cell"], "inner")
        placed = placed.where(F.col("inner") | (F.col("cid") > F.col("least")))
        state = C.write_out(placed.select(F.xxhash64("region", "cell", F.lit(level)).alias("region"), "cid", "s", "inner"), "jaccard-state")
        if keep is not None:
            keep.append((far.count(), state.count()))
        if state.isEmpty():
            return done


def _blocks(far: DataFrame, eps: float, every: bool) -> DataFrame:
    """Pairs of blocks of undivided regions that may hold a link, as tasks of two sides or one.

    Unless ``every`` link is wanted, blocks that pivots join are not paired.
    """
    far = far.withColumns({"cell": F.array_position("d", F.array_min("d")).cast("int"), "ring": F.floor(F.array_min("d") / (eps / 2)).cast("int")})
    place = ["region", "cell", "ring", "core"]
    size = far.groupBy(*place).agg(F.count("*").alias("rows"), F.sum(F.length("s")).alias("bytes"))
    cuts = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    placed = C.join_small(far, C.write_out(size.select(*place, cuts.alias("cuts")), "jaccard-sizes"), place, "inner")
    part = F.pmod(F.xxhash64("cid", F.lit(7)), F.col("cuts")).cast("int")
    placed = C.write_out(placed.withColumn("block", F.xxhash64(*place, part)).select("region", "block", "core", "cid", "inner", "s", "d"), "jaccard-blocks")
    low, high = [F.min(F.get("d", F.lit(i))).alias(f"l{i}") for i in range(PIVOTS)], [F.max(F.get("d", F.lit(i))).alias(f"h{i}") for i in range(PIVOTS)]
    block = C.write_out(placed.groupBy("region", "block").agg(*low, *high, F.max("inner").alias("inner"), F.first("core").alias("core")), "jaccard-intervals")
    x, y = block.alias("x"), block.alias("y")
    meet = (F.col("x.block") <= F.col("y.block")) & (F.col("x.inner") | F.col("y.inner"))
    if not every:
        meet = meet & ~((F.col("x.core") == F.col("y.core")) & (F.col("x.core") >= 0))
    for i in range(PIVOTS):
        apart = (F.col(f"x.l{i}") > F.col(f"y.h{i}") + eps) | (F.col(f"y.l{i}") > F.col(f"x.h{i}") + eps)
        meet = meet & ~F.coalesce(apart, F.lit(False))
    pairs = x.join(y, (F.col("x.region") == F.col("y.region")) & meet).select(F.col("x.block").alias("x"), F.col("y.block").alias("y"))
    pairs = pairs.withColumn("task", F.xxhash64("x", "y"))
    same = F.col("x") == F.col("y")
    sides = pairs.select("task", F.col("x").alias("block"), F.when(same, 2).otherwise(0).alias("side")).unionByName(
        pairs.where(~same).select("task", F.col("y").alias("block"), F.lit(1).alias("side"))
    )
    return placed.join(sides, "block").select("task", "cid", "side", "inner", "s")


def replication(docs: DataFrame, pivots: int = 64, rule: Rule = LINKED) -> float:
    """Regions per document if ``pivots`` documents divided the whole space in one step (a measurement)."""
    d = docs.select("doc_id", "text")
    some = [s for s in (s for b in [pa.RecordBatch.from_pylist([{"text": r.text} for r in d.where("text is not null").orderBy(F.xxhash64("doc_id")).limit(pivots).collect()])] for s in sets_of(b, rule.width)) if len(s)]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = []
        for s in sets_of(batch, rule.width):
            far = np.array([_distance(s, p) for p in some]) if len(s) else np.zeros(0)
            n.append(int((far <= far.min() + 2 * rule.eps).sum()) if len(far) else 0)
        return pa.record_batch([pa.array(n, pa.int64())], ["n"])

    return d.mapInArrow(C.batches(one), "n long").where("n > 0").agg(F.avg("n")).first()[0] or 0.0


class Found:
    """What one join finds: a row's class, classes, and links of classes.

    ``rows`` has the kept columns, ``n_shingles, d1, d2`` of every row; ``reps``
    a row for each class of equal sets: ``d1, d2, cid``, its smallest doc_id
    ``rep`` and how many ``rows`` it has.
    """

    def __init__(self, docs: DataFrame, rule: Rule = LINKED, keep: tuple[str, ...] = ()):
        self.rule = rule
        text = F.coalesce("text", F.lit(""))
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), text).alias("t"), *keep, "text")
        self.rows = C.write_out(classes(self.docs, rule.width), "jaccard-classes")
        each = self.rows.where("d1 is not null").groupBy("d1", "d2", "doc_id", "t").agg(F.count("*").alias("n"))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "t", "n")).alias("m")
        reps = each.groupBy("d1", "d2").agg(least, F.sum("n").alias("rows"))
        reps = reps.select("d1", "d2", F.monotonically_increasing_id().alias("cid"), F.col("m.doc_id").alias("rep"), "m.t", "m.n", "rows")
        self.reps = C.write_out(reps, "jaccard-reps")

    def members(self) -> DataFrame:
        """``g, cid, s``: candidate groups of two classes or more, with their sets."""
        met = C.write_out(_meetings(_region_rows(self.docs, self.rule)), "jaccard-meetings")
        id_of = self.reps.select("d1", "cid")
        # the head of a star may be in very many rows: heads are told apart first
        heads = met.select("o").distinct().join(id_of.toDF("o", "b"), "o")
        met = C.join_small(met.join(id_of.toDF("d", "cid"), "d"), C.write_out(heads, "jaccard-heads"), ["o"], "inner")
        groups = C.connected_components(C.write_out(met.select(F.col("cid").alias("a"), "b"), "jaccard-edges"), "jaccard-candidates")
        wanted = C.write_out(self.reps.join(groups.toDF("cid", "g"), "cid").drop("rows"), "jaccard-wanted").toDF(*(f"w_{c}" for c in ("cid", "d1", "d2", "rep", "t", "n", "g")))
        width = self.rule.width

        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            told = list(zip(batch.column("w_d1").to_pylist(), batch.column("w_d2").to_pylist(), strict=True))
            sets = list(sets_of(batch, width))
            keep = np.array([digest(s) == d for s, d in zip(sets, told, strict=True)])
            if not keep.any():
                return None
            s = pa.array([x.tobytes() for x, k in zip(sets, keep, strict=True) if k], pa.binary())
            return pa.record_batch([*(batch.column(c).filter(pa.array(keep)) for c in ("w_g", "w_cid", "w_n")), s], ["g", "cid", "n", "s"])

        same = (F.col("t") == F.col("w_t")) & F.col("doc_id").eqNullSafe(F.col("w_rep"))
        got = self.docs.select("doc_id", "t", "text").join(C.broadcast_if_small(wanted), same).mapInArrow(C.batches(one), "g long, cid long, n long, s binary")
        got = C.write_out(got, "jaccard-members")
        # rows that repeat a doc_id and its text are one member
        return got.where("n = 1").unionByName(got.where("n > 1").dropDuplicates(["cid"])).drop("n")

    def links(self, pairs: bool) -> DataFrame:
        """Links of classes (see :func:`_verify`), verified region by region."""
        got = [_verify(part, pairs, self.rule) for part in regions(self.members(), self.rule)]
        return C.write_out(reduce(DataFrame.unionByName, got), "jaccard-verified")

    def joining(self) -> DataFrame:
        """Links ``a, b`` of classes that join the same components as all do, without comparing what pivots join."""
        through: list[DataFrame] = []
        got = [_verify(part, False, self.rule).select("a", "b") for part in regions(self.members(), self.rule, through=through)]
        return C.write_out(reduce(DataFrame.unionByName, got + through), "jaccard-joining")

    def components(self, links: DataFrame) -> DataFrame:
        """``cid, component, part``: of linked classes, the smallest doc_id of the component and its number."""
        joined = C.write_out(C.connected_components(links.select("a", "b"), "jaccard-links").toDF("cid", "part"), "jaccard-parts")
        named = joined.join(self.reps.select("cid", "rep"), "cid")
        least = C.write_out(named.groupBy("part").agg(F.min("rep").alias("component")), "jaccard-components")
        return C.join_small(joined, least, ["part"], "inner").select("cid", "component", "part")


def jaccard_join(docs: DataFrame, rule: Rule = LINKED, keep: tuple[str, ...] = (), every: bool = True) -> DataFrame:
    """Links and components of documents whose shingle sets are linked by ``rule``: three words and a Jaccard similarity of 0.9.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, but those
    in ``keep`` are given back (no names of the result's own).  Returns
    ``doc_id, n_shingles, class_id, n_links, component_id, part`` per row.  Words
    are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer
    words than a shingle's is one; a null, empty or blank text has none, is
    linked with nothing and is its own component.

    Rows of equal sets are one class, named by its smallest doc_id; ``n_links``
    counts the other classes that a row's class is linked with (null unless
    ``every`` link is wanted, not just the components); ``part`` is a number that rows of one component share, and null for a row without a
    shingle or alone in its component.  Rows that repeat a doc_id are documents
    of their own that share the id, so ``part`` tells components apart where
    ``component_id`` does not; a null doc_id stays null and counts as larger than
    any.  An empty table gives an empty result.
    """
    found = Found(docs, rule, keep)
    links = found.links(pairs=False) if every else found.joining()
    linked = found.components(links).withColumn("n", F.lit(None).cast("long"))
    if every:
        linked = linked.drop("n").join(links.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n")), "cid", "left")
    # classes of one row without a link need no names
    top = found.reps.drop("n").join(linked, "cid", "left").where("rows > 1 or part is not null")
    top = C.write_out(top.select("d1", "d2", "rep", F.col("n").alias("links"), F.coalesce("part", "cid").alias("part"), F.coalesce("component", "rep").alias("component")), "jaccard-top")
    out = C.join_small(found.rows, top, ["d1", "d2"], "left")
    return out.select(
        "doc_id", *keep, "n_shingles",
        F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0 if every else None).cast("long")).alias("n_links"),
        F.coalesce("component", "doc_id").alias("component_id"), "part",
    )


def jaccard_components(docs: DataFrame, rule: Rule = LINKED, keep: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`jaccard_join`, without counting links: what pivots join is not compared."""
    return jaccard_join(docs, rule, keep, every=False)


def jaccard_pairs(docs: DataFrame, rule: Rule = LINKED) -> DataFrame:
    """Every linked pair of classes once: ``a, b`` (their smallest doc_ids), their digests ``d1, d2`` and ``o1, o2``.

    ``classes`` gives the members by digest.
    """
    found = Found(docs, rule)
    links, reps = found.links(pairs=True), found.reps
    x = reps.select(F.col("cid").alias("a"), "d1", "d2", F.col("rep").alias("left"))
    y = reps.select(F.col("cid").alias("b"), F.col("d1").alias("o1"), F.col("d2").alias("o2"), F.col("rep").alias("right"))
    return links.join(x, "a").join(y, "b").select(F.col("left").alias("a"), F.col("right").alias("b"), "d1", "d2", "o1", "o2")
