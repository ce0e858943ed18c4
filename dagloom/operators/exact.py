"""Exact naturals of any size: a BIGINT lane, and a lane of decimal strings beyond it."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


def _no_digit_limit() -> None:
    """Naturals of any length may be read and written (Python's default stops at 4300 digits)."""
    sys.set_int_max_str_digits(0)


@pandas_udf(StringType())
def _sum_digits(v: pd.Series) -> str:
    _no_digit_limit()
    return str(sum(int(x) for x in v.dropna()))


@pandas_udf(DoubleType())
def _log10(v: pd.Series) -> pd.Series:
    _no_digit_limit()

    def one(x):
        if x is None or (n := int(x)) <= 0:
            return None
        shift = max(0, n.bit_length() - 1000)
        return math.log10(n >> shift) + shift * math.log10(2)

    return v.map(one)


def exact_sum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, exact``: the sum of naturals given as strings or integers, as a string.

    Values of at most 18 digits are summed as decimals in the JVM; longer ones
    are first summed as Python integers, group by group and partition by
    partition of their leading length, so that no group meets in one task whole.
    """
    v = F.col(value).cast("string")
    short = df.where(F.length(v) <= 18).groupBy(*keys).agg(F.sum(v.cast("decimal(18,0)")).cast("string").alias("part"))
    long = df.where(F.length(v) > 18).groupBy(*keys, F.pmod(F.xxhash64(v), F.lit(64)).alias("_salt")).agg(_sum_digits(v).alias("part")).drop("_salt")
    return short.unionByName(long).groupBy(*keys).agg(_sum_digits(F.col("part")).alias("exact"))


def log10_exact(value: Column) -> Column:
    """log10 of a natural given as a string, null if it is not positive."""
    return _log10(value)
