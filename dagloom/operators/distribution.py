"""Distributions: coverage curves, quantiles, entropy, bands and rasters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_by_value(df: DataFrame, keys: Sequence[str], value: str, weight: Column) -> DataFrame:
    """``keys, value, n, rank, cum, total``: weights summed per distinct value, from the largest.

    Equal values are aggregated before the window, so a window holds distinct
    values only; ``rank`` and ``cum`` are those of a value's last row.
    """
    got = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return got.select(*keys, value, "n", F.sum("n").over(w).alias("rank"), F.sum("_w").over(w).alias("cum"), F.sum("_w").over(whole).alias("total"))


def coverage_curve(weights: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Cumulative share of the total by rank of weight, one row for each distinct weight."""
    run = running_by_value(weights.where(F.col(value) > 0), keys, value, F.col(value))
    return run.select(*keys, value, "n", "rank", (F.col("cum") / F.col("total")).alias("share"))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Nearest-rank quantiles of positive values (index ceil(q n) - 1)."""
    got = df.where(F.col(value) > 0)
    names = [f"p{str(q * 100).rstrip('0').rstrip('.').replace('.', '_')}" for q in qs]
    return got.groupBy(*keys).agg(F.count("*").alias("n"), *[F.expr(f"percentile_disc({q}) within group (order by {value})").alias(n) for q, n in zip(qs, names, strict=True)])


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, qs: Sequence[float]) -> DataFrame:
    """First value, ascending, whose cumulative weight reaches q of the total."""
    got = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = got.select(*keys, value, F.sum("w").over(up).alias("cum"), F.sum("w").over(Window.partitionBy(*keys)).alias("total"))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("cum") >= q * F.col("total"), F.col(value))).alias(f"q{round(q * 100)}") for q in qs])


def entropy(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Shannon entropy, effective number and singletons of positive weights."""
    total = df.where(F.col(weight) > 0).groupBy(*keys).agg(F.sum(weight).alias("total"))
    p = F.col(weight) / F.col("total")
    parts = df.where(F.col(weight) > 0).join(total, list(keys)) if keys else df.where(F.col(weight) > 0).crossJoin(F.broadcast(total))
    got = parts.groupBy(*keys).agg(F.count("*").alias("patterns"), F.count_if(F.col(weight) == 1).alias("singletons"), F.sum(-p * F.log2(p)).alias("entropy"))
    return got.withColumn("effective", F.pow(F.lit(2.0), F.col("entropy")))


def size_band(size: Column) -> Column:
    """0 to 3: below 8, 32, 128, or more."""
    return F.when(size < 8, 0).when(size < 32, 1).when(size < 128, 2).otherwise(3)


def percentile_band(df: DataFrame, value: str, bounds: Sequence[float] = (0.5, 0.9, 0.95, 0.99, 0.999, 1.0)) -> DataFrame:
    """Add ``band`` by the mid-rank percentile of ``value``: (rows below + rows up to + 1) / 2n.

    Ranks come from counts of distinct values, not from a window over rows.
    """
    count = df.groupBy(value).agg(F.count("*").alias("_n"))
    up = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_n").over(Window.partitionBy())
    mid = (2 * F.sum("_n").over(up) - F.col("_n") + 1) / (2 * total)
    band = F.lit(len(bounds) - 1)
    for k in reversed(range(len(bounds) - 1)):
        band = F.when(F.col("_mid") <= bounds[k], k).otherwise(band)
    ranked = count.withColumn("_mid", mid).select(value, band.alias("band"))
    return df.join(ranked, value)


def concentration_points(sizes: DataFrame, key: str, value: str, cells: int = 1000) -> DataFrame:
    """``key, i, share``: every group's Lorenz curve (largest first), read at cell middles.

    Groups are one state's hypotheses, which are collected as one short array.
    """
    got = sizes.groupBy(key).agg(F.sort_array(F.collect_list(F.col(value).cast("double")), asc=False).alias("v"))
    run = F.aggregate("v", F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    got = got.withColumn("c", run).withColumn("k", F.size("v"))
    got = got.select(key, "c", "k", F.element_at("c", -1).alias("total")).where("total > 0")
    got = got.select(key, "c", "k", "total", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("i"))
    x = (F.col("i") + 0.5) / cells * F.col("k")
    at = F.least(F.floor(x).cast("int"), F.col("k") - 1)
    y = (F.get("c", at) + (x - at) * (F.get("c", at + 1) - F.get("c", at))) / F.col("total")
    return got.select(key, "i", y.alias("share"))


def density_raster(points: DataFrame, x: str, y: str, weight: str, width: int, height: int, keys: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Count, sum, max, mean and median (of ``least`` points or more) for every pixel.

    Bounds are the data's, padded by 1.5 percent of their range or by 0.1 where
    it is 0, and shared by all ``keys``.
    """
    fine = points.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in (x, y, weight)))
    b = fine.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])

    def place(c: str, cells: int) -> Column:
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        pad = F.when(span > 0, 0.015 * span).otherwise(0.1)
        return F.least(F.floor((F.col(c) - F.col(f"lo_{c}") + pad) / (span + 2 * pad) * cells), F.lit(cells - 1)).cast("int")

    met = fine.crossJoin(F.broadcast(b)).select(*keys, place(x, width).alias("px"), place(y, height).alias("py"), F.col(weight).alias("w"))
    return met.groupBy(*keys, "px", "py").agg(F.count("*").alias("n"), F.sum("w").alias("total"), F.max("w").alias("highest"), F.avg("w").alias("mean"), F.when(F.count("*") >= least, F.median("w")).alias("median"))
