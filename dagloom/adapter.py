"""The star schema seen as a corpus of expression graphs.

A theorem is a customer, a transition (proof state) is one of its orders, a
goal root is the order's node and its hypothesis roots are its line items.
Node ids are longs: a key times 8 plus the kind's number in ``KINDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Node kinds; a node's id modulo 8 is its kind's place here.
KINDS = ["region", "nation", "supplier", "part", "line", "order"]


class Tables:
    """The driver's tables of one directory, read on demand, and what one query has derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.kept: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def node(key: Column | str, kind: str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return key.cast("long") * 8 + KINDS.index(kind)


def line_node() -> Column:
    return node(F.col("l_orderkey") * 8 + F.col("l_linenumber"), "line")


def kind_of(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.pmod(col, F.lit(8)) + 1).cast("int"))


def edges(t: Tables) -> DataFrame:
    """``parent, pos, child``: ordered operands; a node that occurs twice is shared."""
    li = t.lineitem
    first = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    return (
        li.select(node("l_orderkey", "order").alias("parent"), first.cast("int").alias("pos"), line_node().alias("child"))
        .unionByName(li.select(line_node().alias("parent"), F.lit(0).alias("pos"), node("l_partkey", "part").alias("child")))
        .unionByName(li.select(line_node().alias("parent"), F.lit(1).alias("pos"), node("l_suppkey", "supplier").alias("child")))
        .unionByName(t.supplier.select(node("s_suppkey", "supplier").alias("parent"), F.lit(0).alias("pos"), node("s_nationkey", "nation").alias("child")))
        .unionByName(t.nation.select(node("n_nationkey", "nation").alias("parent"), F.lit(0).alias("pos"), node("n_regionkey", "region").alias("child")))
    )


def states(t: Tables) -> DataFrame:
    """``thm, step, state, goal, label``: transitions in order, by customer."""
    step = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return t.orders.select(F.col("o_custkey").alias("thm"), step.cast("int").alias("step"), F.col("o_orderkey").alias("state"), node("o_orderkey", "order").alias("goal"), F.col("o_orderpriority").alias("tactic"))


def hypotheses(t: Tables) -> DataFrame:
    """``state, slot, root``: hypothesis roots in order."""
    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    return t.lineitem.select(F.col("l_orderkey").alias("state"), slot.cast("int").alias("slot"), line_node().alias("root"))


def roots(t: Tables) -> DataFrame:
    """``state, root`` of goals that have operands."""
    return t.lineitem.select(F.col("l_orderkey").alias("state")).distinct().select("state", node("state", "order").alias("root"))
