"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_of(tactic: Column, policy: dict[str, str], unmapped: str = "drop", other: str | None = None) -> Column:
    """Label of a tactic kind by an exact policy.

    ``unmapped`` is ``drop`` (null), ``other`` (the label ``other``) or
    ``error`` (the query fails on the first unmapped kind).
    """
    pairs = [F.lit(x) for kv in policy.items() for x in kv]
    got = F.get(F.array(F.element_at(F.create_map(*pairs), tactic)), F.lit(0)) if pairs else F.lit(None).cast("string")
    if unmapped == "other":
        return F.coalesce(got, F.lit(other))
    if unmapped == "error":
        return F.coalesce(got, F.raise_error(F.concat(F.lit("unmapped kind: "), tactic)))
    return got


def log_count(x: Column) -> Column:
    """log10 of a positive count, else null."""
    return F.when(x > 0, F.log10(x))


def removed_percent(before: Column, after: Column) -> Column:
    """100 (1 - after / before), 0 where before is 0."""
    return F.coalesce(100 * (1 - F.try_divide(after, before)), F.lit(0.0))


def variable_bin(index: Column) -> Column:
    """min(4, bits of the index)."""
    return F.least(F.lit(4), F.when(index <= 0, 0).otherwise(F.floor(F.log2(index)).cast("int") + 1))


def camel(name: Column) -> Column:
    """snake_case to camelCase."""
    words = F.split(name, "_")
    rest = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    return F.concat(F.get(words, F.lit(0)), F.array_join(rest, ""))


def natural_kind(value: Column) -> Column:
    """Attribute of a natural literal: 0, 1 or other."""
    return F.when(value == "0", "nat0").when(value == "1", "nat1").otherwise("nat_other")


def expression_attributes(kind: Column, index: Column, value: Column, level: Column, binders: Column) -> Column:
    """Names of an expression's attributes, as an array without nulls.

    Bound variables by index (3 and more together), natural literals by value,
    the sort of level 0, and for binders one entry each and one for its form.
    """
    some = F.array(
        F.when(kind == "Bvar", F.concat(F.lit("bvar"), F.when(index < 3, index.cast("string")).otherwise("3+"))),
        F.when(kind == "NatLiteral", natural_kind(value)),
        F.when((kind == "Sort") & (level == "0"), "prop"),
    )
    each = F.flatten(F.transform(F.coalesce(binders, F.array().cast("array<string>")), lambda b: F.array(F.lit("binder"), F.concat(F.lit("binder_"), b))))
    return F.concat(F.array_compact(some), F.when(kind.isin("Lambda", "Forall"), each).otherwise(F.array().cast("array<string>")))
