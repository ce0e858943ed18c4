"""Derived measures: logarithmic ratios, motifs, spines, descriptor inputs, raster readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import log_count
from . import distribution as D
from . import ranking as R
from .tables import settle


def frequency_frame(totals: DataFrame, population: str, single: str = "dag") -> DataFrame:
    """``distinct_log, expanded_log, total, dominance, repetition`` of each pair of sizes.

    ``totals`` has a total and a largest count (``_most``) of every population.
    Dominance needs a total of 10 or more; repetition compares with ``single``.
    """
    n = F.col(population)
    got = totals.where(n > 0)
    return got.select(
        F.log10("distinct").alias("distinct_log"),
        F.log10("expanded").alias("expanded_log"),
        F.log10(n).alias("total"),
        F.when(n >= 10, F.col(f"{population}_most") / n).alias("dominance"),
        (F.log10(n) - log_count(F.col(single))).alias("repetition"),
    )


def context_ratios(states: DataFrame) -> DataFrame:
    """Concentration, mean size and sharing across roots of every state's hypotheses.

    ``states`` has ``state, hyps, ctx_expanded, largest, individual_distinct, state_distinct``.
    """
    hyps = log_count(F.col("hyps"))
    return states.select(
        "state",
        hyps.alias("hyps_log"),
        log_count(F.col("largest") * F.col("hyps") / F.col("ctx_expanded")).alias("largest_to_mean_log"),
        (log_count(F.col("ctx_expanded")) - hyps).alias("mean_hyp_size"),
        log_count(F.col("individual_distinct") / F.col("state_distinct")).alias("cross_root_sharing"),
    )


def novelty(sizes: DataFrame) -> DataFrame:
    """``root, nodes_log, novel_log, novel_frac`` from ``root, nodes, novel``."""
    return sizes.select("root", log_count(F.col("nodes")).alias("nodes_log"), F.log10(F.col("novel") + 1).alias("novel_log"), F.try_divide("novel", "nodes").alias("novel_frac"))


def hashed_bin(text: Column, bins: int = 64) -> Column:
    """A text's bin: the first byte of its SHA-256, modulo ``bins`` (at most 256)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("long") % bins


def two_edge_motifs(reach: DataFrame, edges: DataFrame, kind) -> DataFrame:
    """``root, bin, n``: two-edge walks in every root's closure by kinds and operand places.

    Walks are joined once for the whole graph and brought to roots afterwards.
    """
    up = edges.select("parent", F.col("pos").alias("p1"), F.col("child").alias("mid"))
    down = edges.select(F.col("parent").alias("mid"), F.col("pos").alias("p2"), F.col("child").alias("low"))
    text = F.concat_ws("|", kind("parent"), F.least("p1", F.lit(3)).cast("string"), kind("mid"), F.least("p2", F.lit(3)).cast("string"), kind("low"))
    walks = up.join(down, "mid").groupBy(F.col("parent").alias("node"), hashed_bin(text).alias("bin")).agg(F.count("*").alias("n"))
    return reach.select("root", "node").join(walks, "node").groupBy("root", "bin").agg(F.sum("n").alias("n"))


def spines(edges: DataFrame, max_depth: int) -> DataFrame:
    """``node, head, spine``: the end of every node's chain of first operands, and its length.

    One join by level, each level written once; a chain longer than ``max_depth`` is an error.
    Of several first operands (repeated rows) the smallest counts.
    """
    first = settle(edges.where("pos = 0").groupBy(F.col("parent").alias("at")).agg(F.min("child").alias("child")))
    going = first.select(F.col("at").alias("node"), F.col("child").alias("head"), F.lit(1).cast("long").alias("spine"))
    done = None
    for _ in range(max_depth):
        met = settle(going.join(first, F.col("head") == F.col("at"), "left"))
        ended = met.where("child is null").select("node", "head", "spine")
        done = ended if done is None else done.unionByName(ended)
        going = met.where("child is not null").select("node", F.col("child").alias("head"), (F.col("spine") + 1).alias("spine"))
    if not going.isEmpty():
        raise ValueError(f"a chain of first operands is longer than {max_depth}")
    return done


def descriptor_inputs(histograms: DataFrame, blocks: int) -> DataFrame:
    """``root, block, bin, val``: square roots of each block's shares, blocks of equal weight.

    A root's values have norm 1 if it has all ``blocks`` blocks.
    """
    some = histograms.where("n > 0")
    total = some.groupBy("root", "block").agg(F.sum("n").alias("total"))
    return some.join(total, ["root", "block"]).select("root", "block", "bin", F.sqrt(F.col("n") / F.col("total") / blocks).alias("val"))


def coverage_at_ranks(weights: DataFrame, keys: Sequence[str], value: str, points: int = 1000) -> DataFrame:
    """``keys, rank, share``: coverage at geometric ranks, linear between the counts' groups.

    Every group of equal weights yields the ranks it holds, so there is no join by range.
    """
    run = D.running_by_value(weights.where(F.col(value) > 0), keys, value, F.col(value))
    run = run.withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    steps = F.greatest(F.least(F.lit(points), F.col("_all")) - 1, F.lit(1))
    ranks = F.transform(F.sequence(F.lit(0).cast("long"), steps), lambda k: F.rint(F.pow(F.col("_all").cast("double"), k / steps)).cast("long"))
    own = F.filter(F.array_distinct(ranks), lambda r: (r > F.col("rank") - F.col("n")) & (r <= F.col("rank")))
    got = run.select(*keys, value, "cum", "total", F.col("rank").alias("_last"), F.explode(own).alias("rank"))
    return got.select(*keys, "rank", ((F.col("cum") - (F.col("_last") - F.col("rank")) * F.col(value)) / F.col("total")).alias("share"))


def rotated_cells(points: DataFrame, cells: int) -> DataFrame:
    """``a, b, n``: points of Lorenz curves along and above the diagonal."""
    x = (F.col("i") + 0.5) / cells
    place = lambda v: F.least(F.greatest(F.floor(F.round(v, 9)), F.lit(0)), F.lit(cells - 1)).cast("long")
    return points.groupBy(place(cells / 2 * (x + F.col("share"))).alias("a"), place(cells * (F.col("share") - x)).alias("b")).agg(F.count("*").alias("n"))


def name_pool(scores: DataFrame, name: str, label: str, score: str, count: str, support: DataFrame, most: int) -> DataFrame:
    """At most ``most`` names: three quarters by association, the rest by ``support`` (name, support)."""
    ranked = settle(R.rank_names(scores, name, label, score, count).limit(most - most // 4).select(name))
    rest = R.top(support.join(F.broadcast(ranked), name, "left_anti"), most - ranked.count(), F.desc("support"), name)
    return ranked.withColumn("chosen_by", F.lit("association")).unionByName(rest.select(name, F.lit("support").alias("chosen_by")))
