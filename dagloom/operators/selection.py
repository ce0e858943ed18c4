"""Coverage of roots by shapes, and choices under a budget of columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incidence(root_shapes: DataFrame) -> DataFrame:
    """Boolean ``thm, root, shape``."""
    return root_shapes.select("thm", "root", "shape").distinct()


def support(inc: DataFrame) -> DataFrame:
    """``shape, theorems, roots``."""
    return inc.groupBy("shape").agg(F.count_distinct("thm").alias("theorems"), F.count("*").alias("roots"))


def eligible(shapes: DataFrame, min_nodes: int, min_support: int) -> DataFrame:
    return shapes.where((F.col("nodes") >= min_nodes) & (F.col("theorems") >= min_support))


def uncovered(roots: DataFrame, inc: DataFrame, chosen: DataFrame) -> DataFrame:
    """Roots that no chosen shape covers."""
    met = inc.join(F.broadcast(chosen.select("shape")), "shape", "left_semi").select("root").distinct()
    return roots.join(met, "root", "left_anti")


def greedy_cover(inc: DataFrame, cost: dict, first=None) -> list:
    """Shapes that cover every root that any shape covers: cheapest per newly covered root first.

    ``first`` is fixed and not pruned.  What a shape covers is reduced in Spark
    to signatures (the set of shapes of a root) with their counts, so the
    driver's table grows with distinct signatures of the bounded candidate
    vocabulary ``cost``, not with roots.  Shapes that others make redundant are
    dropped afterwards, dearest first.
    """
    known = inc.where(F.col("shape").isin(list(cost)))
    sig = known.groupBy("root").agg(F.sort_array(F.collect_set("shape")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    rows = [(frozenset(r.s), r.n) for r in sig.collect()]
    chosen, left = [], rows
    if first is not None:
        chosen, left = [first], [x for x in rows if first not in x[0]]
    while left:
        gain: dict = {}
        for s, n in left:
            for x in s:
                gain[x] = gain.get(x, 0) + n
        best = min(gain, key=lambda x: (-gain[x] / cost[x], str(x)))
        chosen.append(best)
        left = [x for x in left if best not in x[0]]
    for x in sorted(chosen, key=lambda x: (-cost[x], str(x))):
        rest = set(chosen) - {x}
        if x != first and all(s & rest for s, _ in rows):
            chosen.remove(x)
    return chosen


def enrich(scores: dict, costs: dict, similar, baseline: list, budget: int, redundancy: float = 0.5) -> list:
    """Label-balanced choice of shapes under a budget of columns.

    ``scores[shape][label]`` is its score, ``similar(a, b)`` a cosine.  A
    shape's gain for a label is its score over the label's best, damped by its
    likeness to what is chosen; its priority is the sum over labels of
    log1p(gain / (0.1 + strength)) per column, and ties go to the first name.
    """
    labels = sorted({k for s in scores.values() for k in s})
    best = {k: max((s.get(k, 0.0) for s in scores.values()), default=0.0) for k in labels}
    profile = {x: {k: s.get(k, 0.0) / best[k] if best[k] > 0 else 0.0 for k in labels} for x, s in scores.items()}
    strength = {k: sum(profile.get(x, {}).get(k, 0.0) for x in baseline) for k in labels}
    near = {x: max((similar(x, b) for b in baseline), default=0.0) for x in scores}
    chosen, open_ = [], sorted(set(scores) - set(baseline), key=str)
    while True:
        top, pick = 0.0, None
        for x in open_:
            if costs[x] <= budget:
                gains = {k: profile[x][k] / (1 + redundancy * near[x]) for k in labels}
                p = sum(math.log1p(g / (0.1 + strength[k])) for k, g in gains.items()) / costs[x]
                if p > top + 1e-15:
                    top, pick, now = p, x, gains
        if pick is None:
            return chosen
        chosen.append(pick)
        open_.remove(pick)
        budget -= costs[pick]
        for k in labels:
            strength[k] += now[k]
        for x in open_:
            near[x] = max(near[x], similar(x, pick))
