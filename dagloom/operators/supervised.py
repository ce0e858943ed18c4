"""Class-conditional statistics of sparse channels: moments, correlation, chi-square, redundancy.

Long tables: a row's channels are ``row, channel, x`` and rows are
``row, label``.  All statistics are sums with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("total"))


def moments(channels: DataFrame, rows: DataFrame) -> DataFrame:
    """``channel, label, s, ss, support``: sums, sums of squares and rows by label."""
    return channels.join(rows, "row").groupBy("channel", "label").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count("*").alias("support"))


def squared_correlation(m: DataFrame, totals: DataFrame, min_support: int = 3) -> DataFrame:
    """r2 of a count channel with each label's indicator; 0 where undefined or too rare."""
    n = totals.agg(F.sum("total").alias("n"))
    whole = m.groupBy("channel").agg(F.sum("s").alias("sum"), F.sum("ss").alias("squares"), F.sum("support").alias("rows"))
    grid = whole.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(n))  # labels are few: the policy declares them
    grid = grid.join(m.select("channel", "label", "s"), ["channel", "label"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    p = F.col("total") / F.col("n")
    var = F.greatest(F.col("squares") - F.col("sum") * F.col("sum") / F.col("n"), F.lit(0.0))
    cov = F.col("s") - p * F.col("sum")
    den = var * F.col("n") * p * (1 - p)
    r2 = F.when((den > 0) & (F.col("rows") >= min_support), F.least(F.greatest(cov * cov / den, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return grid.select("channel", "label", F.col("rows").alias("support"), r2.alias("r2"))


def best_channel(r2: DataFrame, group) -> DataFrame:
    """Per group and label the channel of the highest r2, the first channel on ties."""
    w = Window.partitionBy("grp", "label").orderBy(F.desc("r2"), "channel")
    return r2.withColumn("grp", group).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def chi_square(channels: DataFrame, rows: DataFrame) -> DataFrame:
    """Presence association of every channel: over all labels, and each label against the rest."""
    totals = label_totals(rows)
    n = totals.agg(F.sum("total").alias("n"))
    seen = channels.where("x > 0").join(rows, "row").groupBy("channel", "label").agg(F.count("*").alias("o"))
    present = seen.groupBy("channel").agg(F.sum("o").alias("present"))
    grid = present.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(n)).join(seen, ["channel", "label"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    p = F.col("total") / F.col("n")
    e = F.col("present") * p
    d = (F.col("o") - e) * (F.col("o") - e)
    return grid.select("channel", "label", "o", "present", (d / e).alias("part"), (d / e + F.coalesce(F.try_divide(d, F.col("present") * (1 - p)), F.lit(0.0))).alias("one_vs_rest"))


def pair_products(channels: DataFrame, rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Dot products of pairs of chosen channels by label (``chosen``: a bounded shortlist)."""
    few = channels.join(F.broadcast(chosen.select("channel")), "channel", "left_semi").join(rows, "row")
    per_row = few.groupBy("row", "label").agg(F.sort_array(F.collect_list(F.struct("channel", "x"))).alias("c"))
    pairs = per_row.select("label", "c", F.posexplode("c").alias("i", "a")).select("label", "a", F.explode(F.expr("slice(c, i + 1, size(c))")).alias("b"))
    return pairs.groupBy("label", F.col("a.channel").alias("a"), F.col("b.channel").alias("b")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("dot"))
