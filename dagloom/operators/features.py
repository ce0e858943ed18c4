"""Sparse count features in long form: ``thm, step, col, val``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_KINDS = 13


def layout(entries: DataFrame) -> DataFrame:
    """``entry, positions, offset``: columns of every vocabulary entry, in order (a bounded table)."""
    width = F.col("positions") * NODE_KINDS
    before = Window.orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("offset", F.coalesce(F.sum(width).over(before), F.lit(0)))


def positional_columns(matched: DataFrame, placed: DataFrame) -> DataFrame:
    """``thm, node, col, n``: column offset + position * 13 + kind of every matched position.

    ``matched`` has ``thm, anchor, entry, pos, kind``; an entry found at an
    anchor under several depths counts once.
    """
    once = matched.select("thm", "anchor", "entry", "pos", "kind").distinct()
    col = F.col("offset") + F.col("pos") * NODE_KINDS + F.col("kind")
    return once.join(F.broadcast(placed), "entry").groupBy("thm", F.col("anchor").alias("node"), col.alias("col")).agg(F.count("*").alias("n"))


def root_columns(reach: DataFrame, anchored: DataFrame) -> DataFrame:
    """``root, col, n``: what a root's closure holds."""
    return reach.select("root", "node").join(anchored, "node").groupBy("root", "col").agg(F.sum("n").alias("n"))


def role_blocks(state_roots: DataFrame, root_cols: DataFrame, width: int) -> DataFrame:
    """``thm, step, col, val``: goals (role 0) and hypotheses (role 1) in blocks of ``width``."""
    met = state_roots.join(root_cols, "root")
    return met.groupBy("thm", "step", (F.col("col") + F.col("role") * width).alias("col")).agg(F.sum("n").alias("val")).where("val <> 0")


def presence(features: DataFrame, width: int) -> DataFrame:
    """``thm, step, entry``: columns of either role, once."""
    return features.where("val > 0").select("thm", "step", F.pmod("col", F.lit(width)).alias("entry")).distinct()


def active_histogram(features: DataFrame) -> DataFrame:
    """How many rows have how many active columns."""
    return features.groupBy("thm", "step").agg(F.count("*").alias("active")).groupBy("active").agg(F.count("*").alias("rows"))


def cooccurrence(present: DataFrame, first: int) -> DataFrame:
    """``a, b, pairs, jaccard`` of the first entries (a bounded prefix of the vocabulary)."""
    rows = present.where(F.col("entry") < first).groupBy("thm", "step").agg(F.sort_array(F.collect_set("entry")).alias("e"))
    one = rows.select(F.posexplode("e").alias("i", "a"), "e")
    pairs = one.select("a", F.explode(F.expr("slice(e, i + 1, size(e))")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("pairs"))
    own = F.broadcast(pairs.where("a = b").select(F.col("a").alias("k"), F.col("pairs").alias("d")))
    got = pairs.join(own.withColumnsRenamed({"k": "a", "d": "da"}), "a").join(own.withColumnsRenamed({"k": "b", "d": "db"}), "b")
    return got.select("a", "b", "pairs", (F.col("pairs") / (F.col("da") + F.col("db") - F.col("pairs"))).alias("jaccard"))


def state_statistics(goal: DataFrame, hyps: DataFrame, fields: list[str], mean: tuple[str, ...] = ("shared_frac",), slots: int = 32) -> DataFrame:
    """Per state the goal's fields, and over its hypotheses sums (means where named), maxima and overflow sums."""
    inside = hyps.groupBy("state").agg(
        F.count("*").alias("hyps"),
        *[(F.avg(f) if f in mean else F.sum(f)).alias(f"ctx_{f}") for f in fields],
        *[F.max(f).alias(f"max_{f}") for f in fields],
        *[F.sum(F.when(F.col("slot") >= slots, F.col(f)).otherwise(0)).alias(f"over_{f}") for f in fields],
    )
    return goal.select("state", *[F.col(f).alias(f"goal_{f}") for f in fields]).join(inside, "state", "left").na.fill(0)


def slot_columns(hyps: DataFrame, fields: list[str], slots: int = 32) -> DataFrame:
    """Long ``state, col, val`` of the first ``slots`` hypotheses: slot * fields + field."""
    kept = hyps.where(F.col("slot") < slots)
    parts = [kept.select("state", (F.col("slot") * len(fields) + k).alias("col"), F.col(f).cast("double").alias("val")) for k, f in enumerate(fields)]
    return reduce(DataFrame.unionByName, parts).where("val <> 0")


def scale_columns(features: DataFrame, policy: str, rows: int, counted: Column | None = None) -> DataFrame:
    """Add ``scaled`` by a policy fitted on ``features``.

    ``none``, ``maxabs``, ``log_maxabs``, ``log_standard``: logs apply to
    count columns only; nothing is centred; the standard deviation is that of
    the population with its zeros, and a scale of 0 becomes 1.
    """
    counted = F.lit(True) if counted is None else counted
    v = F.when(counted, F.log1p("val")).otherwise(F.col("val")) if policy.startswith("log") else F.col("val").cast("double")
    d = features.withColumn("_v", v)
    if policy == "none":
        return d.withColumnRenamed("_v", "scaled")
    if policy.endswith("maxabs"):
        scale = F.max(F.abs("_v"))
    else:
        scale = F.sqrt(F.greatest(F.sum(F.col("_v") * F.col("_v")) / rows - F.pow(F.sum("_v") / rows, F.lit(2)), F.lit(0.0)))
    s = d.groupBy("col").agg(scale.alias("_s"))
    if policy == "log_standard":
        s = s.withColumn("_s", F.when(counted, F.col("_s")).otherwise(1.0))
    s = s.withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0))
    return d.join(s, "col").withColumn("scaled", F.col("_v") / F.col("_s")).drop("_v", "_s")
