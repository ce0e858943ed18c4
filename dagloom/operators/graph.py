"""Closures and measures of shared expression graphs, as joins by level.

Graphs are edge tables ``parent, pos, child``; repeated operands are separate
rows.  A level holds how many paths lead from a root to a node, so repeated
and shared operands cost one row.  All sizes count in BIGINT; the exact lane
for larger ones is :mod:`dagloom.operators.exact`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settle


def path_levels(roots: DataFrame, edges: DataFrame, max_depth: int, whole: bool = True) -> DataFrame:
    """``root, node, depth, paths``: paths of each length from every root, roots at depth 1.

    Every level is written before the next one joins it, so each is computed once.
    A longer path than ``max_depth`` nodes is an error, unless only the paths of at
    most that many nodes are asked for (``whole`` is false).
    """
    level = roots.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(1).alias("depth"), F.lit(1).cast("long").alias("paths"))
    out = [level]
    step = edges.select(F.col("parent").alias("node"), "child")
    for depth in range(2, max_depth + 1):
        level = settle(level.join(step, "node").groupBy("root", F.col("child").alias("node")).agg(F.sum("paths").alias("paths")).select("root", "node", F.lit(depth).alias("depth"), "paths"))
        out.append(level)
    if whole and not level.select("node").distinct().join(step, "node", "left_semi").isEmpty():
        raise ValueError(f"a path of more than {max_depth} nodes")
    return reduce(DataFrame.unionByName, out)


def closures(roots: DataFrame, edges: DataFrame, max_depth: int = 1000) -> DataFrame:
    """``root, node, paths, depth`` of every root: what it reaches, by how many paths, and the longest.

    Downwards, only distinct nodes and their edges are followed, level by level;
    upwards, each node's closure is made once of its operands' closures.  So a
    node that very many roots share is joined by its users, not by all roots.
    Levels are followed until none is left; a path of more than ``max_depth``
    nodes (a cycle, in a graph that has one) is an error.
    """
    now = settle(roots.select(F.col("root").alias("node")).distinct())
    levels, below = [now], []
    while True:
        kids = settle(edges.join(now.select(F.col("node").alias("parent")), "parent", "left_semi").groupBy("parent", "child").agg(F.count("*").alias("m")))
        if kids.isEmpty():
            break
        if len(levels) >= max_depth:
            raise ValueError(f"a path of more than {max_depth} nodes")
        below.append(kids)
        now = settle(kids.select(F.col("child").alias("node")).distinct())
        levels.append(now)
    out = None
    for now, kids in zip(reversed(levels), [None, *reversed(below)], strict=True):
        out = settle(_upwards(now, kids, out))
    return out


def _upwards(nodes: DataFrame, kids: DataFrame | None, known: DataFrame | None) -> DataFrame:
    own = nodes.select(F.col("node").alias("root"), "node", F.lit(1).cast("long").alias("paths"), F.lit(1).alias("depth"))
    if kids is None:
        return own
    met = kids.join(known.withColumnRenamed("root", "child"), "child")
    up = met.groupBy(F.col("parent").alias("root"), "node").agg(F.sum(F.col("m") * F.col("paths")).alias("paths"), (F.max("depth") + 1).alias("depth"))
    return own.unionByName(up)


def extend(roots: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """Closures of roots all of whose operands have closures in ``known``, in one step."""
    now = roots.select(F.col("root").alias("node")).distinct()
    kids = edges.join(now.select(F.col("node").alias("parent")), "parent", "left_semi").groupBy("parent", "child").agg(F.count("*").alias("m"))
    return _upwards(now, kids, known)


def closure(levels: DataFrame) -> DataFrame:
    """``root, node, paths, depth``: reachable nodes, all paths, and the longest."""
    return levels.groupBy("root", "node").agg(F.sum("paths").alias("paths"), F.max("depth").alias("depth"))


def measure_roots(reach: DataFrame) -> DataFrame:
    """``root, expanded, distinct, depth`` from a closure."""
    return reach.groupBy("root").agg(F.sum("paths").alias("expanded"), F.count("*").alias("distinct"), F.max("depth").alias("depth"))


def indegrees(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """``root, node, indegree``: operand references to a node within the root's closure."""
    return reach.select("root", F.col("node").alias("parent")).join(edges, "parent").groupBy("root", F.col("child").alias("node")).agg(F.count("*").alias("indegree"))


def sharing(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """``root, refs, shared, shared_frac``: operand references and nodes referred to more than once."""
    size = reach.groupBy("root").agg(F.count("*").alias("distinct"))
    into = indegrees(reach, edges).groupBy("root").agg(F.sum("indegree").alias("refs"), F.count_if(F.col("indegree") > 1).alias("shared"))
    got = size.join(into, "root", "left").select("root", "distinct", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("shared", F.lit(0)).alias("shared"))
    return got.withColumn("shared_frac", F.col("shared") / F.greatest("distinct", F.lit(1)))


def kind_histogram(reach: DataFrame, kinds: list[str], kind) -> DataFrame:
    """``root`` and a count of distinct nodes for each kind."""
    return reach.groupBy("root").agg(*[F.count_if(kind == k).alias(f"n_{k}") for k in kinds])


def ancestors(targets: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """``node``: everything that reaches a target, targets included."""
    seen = level = targets.select("node").distinct()
    for _ in range(max_depth - 1):
        level = edges.join(level.withColumnRenamed("node", "child"), "child", "left_semi").select(F.col("parent").alias("node")).distinct()
        level = settle(level)
        seen = seen.unionByName(level)
    if not edges.join(level.withColumnRenamed("node", "child"), "child", "left_semi").isEmpty():
        raise ValueError(f"a path of more than {max_depth} nodes")
    return seen.distinct()


def reduced_sizes(roots: DataFrame, edges: DataFrame, expanded: DataFrame, reusable: DataFrame, max_depth: int) -> DataFrame:
    """Sizes after every reusable node that costs less than it saves is replaced by a leaf.

    ``expanded`` has ``node, expanded``; ``reusable`` has ``node, cost``.
    Returns ``root, reduced_tree, reduced_dag, novel``.
    """
    cut = reusable.join(expanded, "node").where("cost < expanded").select("node", "cost")
    inner = edges.join(cut.select(F.col("node").alias("parent")), "parent", "left_anti")
    reach = closures(roots, inner, max_depth)
    priced = reach.join(cut, "node", "left").withColumn("cost", F.coalesce("cost", F.lit(1)).cast("long"))
    flagged = priced.join(reusable.select("node", F.lit(1).alias("known")).distinct(), "node", "left")
    return flagged.groupBy("root").agg(F.sum(F.col("paths") * F.col("cost")).alias("reduced_tree"), F.sum("cost").alias("reduced_dag"), F.count_if(F.col("known").isNull()).alias("novel"))


def occurrence_counts(reach: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``node, top, root_dag, expanded_tree`` over a multiset of roots (``root, n``)."""
    met = reach.join(occurrences, "root")
    return met.groupBy("node").agg(
        F.sum(F.when(F.col("node") == F.col("root"), F.col("n")).otherwise(0)).alias("top"),
        F.sum("n").alias("root_dag"),
        F.sum(F.col("n") * F.col("paths")).alias("expanded_tree"),
    )


def post_order_violations(nodes: DataFrame) -> DataFrame:
    """Rows of ``thm, id, refs`` with an operand that does not come before the node."""
    return nodes.where(F.exists("refs", lambda r: (r >= F.col("id")) | (r < 0)))


def match_rules(exprs: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that fire: equal head and at least the rule's slots as arguments (rules are a fixed, small table)."""
    r = F.broadcast(rules.withColumnRenamed("head", "rule_head"))
    return exprs.join(r, (F.col("head") == F.col("rule_head")) & (F.col("arity") >= F.col("slots"))).drop("rule_head")
