"""Splits that keep theorems whole."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_counts(transitions: DataFrame) -> DataFrame:
    """``thm, label, n`` of labelled transitions."""
    return transitions.where("label is not null").groupBy("thm", "label").agg(F.count("*").alias("n"))


def subset_stats(transitions: DataFrame, roles: DataFrame) -> DataFrame:
    """Per role and label: transitions and distinct theorems."""
    return transitions.join(roles, "thm").groupBy("role", "label").agg(F.count("*").alias("transitions"), F.count_distinct("thm").alias("theorems"))


@dataclass(frozen=True)
class Holdout:
    test: list
    train: list
    repaired: int
    feasible: bool
    #: a repair by local search is not proven to be the smallest
    optimal: bool


def grouped_holdout(counts: dict, fraction: float = 0.2, seed: int = 0, min_transitions: int = 1, min_theorems: int = 1) -> Holdout:
    """Hold out whole theorems so that every label keeps its minima on both sides.

    ``counts[thm][label]`` are transitions.  A seeded permutation picks the
    first choice; if a minimum fails, single moves that mend most are made
    until all hold or none helps.
    """
    names = sorted(counts)
    n = len(names)
    if n < 2:
        return Holdout([], names, 0, False, True)
    take = min(max(round(n * fraction), 1), n - 1)
    held = {names[k] for k in np.random.default_rng(seed).permutation(n)[:take]}
    labels = sorted({k for c in counts.values() for k in c})

    def lacks(side: set) -> int:
        out = 0
        for k in labels:
            for part in (side, set(names) - side):
                own = [counts[t][k] for t in part if counts[t].get(k)]
                out += max(0, min_transitions - sum(own)) + max(0, min_theorems - len(own))
        return out

    moves, now = 0, lacks(held)
    while now:
        options = [(lacks(held ^ {t}), t) for t in names if 0 < len(held ^ {t}) < n]
        best = min(options, default=(now, None))
        if best[0] >= now:
            return Holdout(sorted(held), sorted(set(names) - held), moves, False, False)
        held, now, moves = held ^ {best[1]}, best[0], moves + 1
    return Holdout(sorted(held), sorted(set(names) - held), moves, True, moves <= 1)


def stratified_folds(counts: dict, folds: int, seed: int = 0) -> dict:
    """Fold of every theorem: those with the most uneven labels first, each to the fold it evens most.

    Theorems without labelled transitions go to the smallest fold in seeded order.
    """
    labels = sorted({k for c in counts.values() for k in c})
    names = sorted(counts)
    order = [names[k] for k in np.random.default_rng(seed).permutation(len(names))]
    m = {t: np.array([counts[t].get(k, 0) for k in labels], float) for t in names}
    total = sum(m.values(), np.zeros(len(labels)))
    total[total == 0] = 1
    state, out, size = np.zeros((folds, len(labels))), {}, [0] * folds
    for t in sorted((t for t in order if m[t].sum()), key=lambda t: -m[t].std()):
        def worth(f: int) -> tuple:
            s = state.copy()
            s[f] += m[t]
            return (float((s / total).std(axis=0).mean()), float(state[f].sum()), f)
        f = min(range(folds), key=worth)
        state[f] += m[t]
        out[t] = f
        size[f] += 1
    for t in order:
        if t not in out:
            f = min(range(folds), key=lambda f: (size[f], f))
            out[t], size[f] = f, size[f] + 1
    return out


def roles_frame(spark, holdout: Holdout, sample: DataFrame) -> DataFrame:
    """``thm, role`` rows of a holdout, in the type of ``sample.thm``."""
    kind = sample.schema["thm"].dataType.simpleString()
    return spark.createDataFrame([(t, "test") for t in holdout.test] + [(t, "train") for t in holdout.train], f"thm {kind}, role string")
