"""Order-dependent choices: top-k, bottom-k samples, extremes, shortlists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows in an order (bounded top-k, no full sort)."""
    return df.orderBy(*order).limit(k)


def bottom_k(df: DataFrame, name: str, root: str, k: int) -> DataFrame:
    """The ``k`` rows whose SHA-256 of ``name:root`` is smallest: a sample that no order changes."""
    priority = F.sha2(F.concat(F.col(name).cast("string"), F.lit(":"), F.col(root).cast("string")), 256)
    return df.withColumn("priority", priority).orderBy("priority", name, root).limit(k)


def per_group(df: DataFrame, keys: Sequence[str], k: int, *order) -> DataFrame:
    """The first ``k`` rows of every group with ``place`` from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def extremes(df: DataFrame, keys: Sequence[str], item: str, fields: Sequence[str]) -> DataFrame:
    """For every field the item with the largest value, the smallest item on ties."""
    best = [F.max_by(item, F.struct(F.col(f), -F.col(item))).alias(f"most_{f}") for f in fields]
    return df.groupBy(*keys).agg(*best, *[F.max(f).alias(f"max_{f}") for f in fields])


def shortlist(scores: DataFrame, item: str, label: str, score: str, overall: int, per_label: int) -> DataFrame:
    """Union of the items best over all labels and the best of each label."""
    best = scores.groupBy(item).agg(F.max(score).alias(score)).where(F.col(score) > 0)
    a = top(best, overall, F.desc(score), item).select(item)
    b = per_group(scores.where(F.col(score) > 0), [label], per_label, F.desc(score), item).select(item)
    return a.unionByName(b).distinct()


def rank_names(scores: DataFrame, name: str, label: str, score: str, count: str) -> DataFrame:
    """Names by score relative to the best of its label, then count, then name."""
    best = scores.groupBy(label).agg(F.max(score).alias("best"))
    rel = scores.join(best, label).withColumn("relative", F.coalesce(F.try_divide(score, "best"), F.lit(0.0)))
    return rel.groupBy(name).agg(F.max("relative").alias("relative"), F.sum(count).alias("count")).orderBy(F.desc("relative"), F.desc("count"), name)
