"""Whole runs: split a corpus, prepare features, train, evaluate, compare, analyse."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import label_of
from ..operators.tables import settle
from ..operators import evaluate as V
from ..operators import features as X
from ..operators import identity as I
from ..operators import models as M
from ..operators import selection as S
from ..operators import splits as P
from ..operators.views import VIEWS, view_rows
from ..sources.policies import LabelPolicy
from ..sources.store import Store
from ..sources.theorems import KINDS


def partition_corpus(transitions: DataFrame, policy: LabelPolicy, fraction: float = 0.2, seed: int = 0, minima: tuple[int, int] = (1, 1)) -> tuple[DataFrame, DataFrame]:
    """Roles of theorems (train, test) and the statistics of both parts.

    The driver holds the theorem by label counts only; theorems whose
    transitions are all dropped stay whole in one part.
    """
    labelled = transitions.withColumn("label", label_of(F.col("tactic"), policy.kinds, policy.unmapped, policy.other_label))
    counts: dict = {r.thm: {} for r in labelled.select("thm").distinct().collect()}
    for r in P.label_counts(labelled).collect():
        counts[r.thm][r.label] = r.n
    got = P.grouped_holdout(counts, fraction, seed, *minima)
    if not got.feasible:
        raise ValueError("no split keeps the minima of every label")
    roles = P.roles_frame(transitions.sparkSession, got, transitions)
    return roles, P.subset_stats(labelled, roles)


@dataclass(frozen=True)
class FitConfig:
    depths: tuple[int, ...] = (1, 2, 3)
    min_support: int = 3
    min_nodes: int = 1
    dims: int = 100_000


def fit_vocabulary(exprs: DataFrame, roots: DataFrame, cfg: FitConfig = FitConfig()) -> DataFrame:
    """``entry, ident, edges, positions``: shapes that cover the training roots, then the commonest, within ``dims``.

    ``roots`` has ``thm, root``; fit on training theorems only.
    """
    frags = I.mine_fragments(exprs, cfg.depths)
    shapes = frags.groupBy("ident").agg(F.min("edges").alias("edges"), F.count_distinct("thm").alias("theorems"), F.max(F.size("nodes")).alias("positions"))
    good = shapes.where((F.col("positions") >= cfg.min_nodes) & (F.col("theorems") >= cfg.min_support))
    refs = exprs.select("thm", F.col("id").alias("parent"), F.explode("refs").alias("child"))
    reach = roots.select("thm", "root", F.col("root").alias("node"))
    level = reach
    while True:  # operands come before their users, so this ends
        level = settle(level.join(refs, (level.thm == refs.thm) & (level.node == refs.parent)).select(level.thm, "root", F.col("child").cast("long").alias("node")).distinct())
        if level.isEmpty():
            break
        reach = reach.unionByName(level.select("thm", F.col("root").cast("long").alias("root"), "node"))
    inc = S.incidence(reach.distinct().join(frags.select("thm", F.col("anchor").alias("node"), F.col("ident").alias("shape")), ["thm", "node"]))
    cost = {r.ident: r.positions * 2 * X.NODE_KINDS for r in good.select("ident", "positions").collect()}  # every eligible shape: rare ones may be the only ones of a root
    cover = S.greedy_cover(inc, cost) if cost else []
    chosen, used = [], 0
    for x in [*cover, *sorted(set(cost) - set(cover))]:
        if used + cost[x] <= cfg.dims:
            chosen.append(x)
            used += cost[x]
    kept = exprs.sparkSession.createDataFrame(list(enumerate(chosen)), "entry long, ident string")
    return kept.join(good, "ident").select("entry", "ident", "edges", "positions")


def encode(exprs: DataFrame, state_roots: DataFrame, vocabulary: DataFrame, depths: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, int]:
    """``thm, step, col, val`` of a frozen vocabulary, and the width of a role's block.

    ``state_roots`` has ``thm, step, root, role``.
    """
    placed = X.layout(vocabulary.select("entry", "positions"))
    width = int(placed.agg(F.sum(F.col("positions") * X.NODE_KINDS)).first()[0] or 0)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    kinds = exprs.select("thm", F.col("id").cast("long").alias("node"), number.alias("kind"))
    met = I.mine_fragments(exprs, depths).join(F.broadcast(vocabulary.select("ident", "entry")), "ident").select("thm", "anchor", "entry", F.posexplode("nodes").alias("pos", "node"))
    matched = met.join(kinds, ["thm", "node"])
    anchored = X.positional_columns(matched, placed.select("entry", "offset"))
    refs = exprs.select("thm", F.col("id").cast("long").alias("parent"), F.explode("refs").alias("child"))
    level = reach = state_roots.select("thm", "root", F.col("root").cast("long").alias("node")).distinct()
    while not level.isEmpty():
        level = level.join(refs, (level.thm == refs.thm) & (level.node == refs.parent)).select(level.thm, "root", F.col("child").cast("long").alias("node")).distinct()
        reach = reach.unionByName(level).distinct()
    cols = reach.join(anchored, ["thm", "node"]).groupBy("thm", "root", "col").agg(F.sum("n").alias("n"))
    out = state_roots.join(cols, ["thm", "root"]).groupBy("thm", "step", (F.col("col") + F.col("role") * width).alias("col")).agg(F.sum("n").alias("val"))
    return out, width


def train_logistic(train: M.Sparse, valid: M.Sparse, classes: int, **cfg) -> tuple[M.Logistic, M.History]:
    return M.fit_logistic(train, valid, classes, **cfg)


@dataclass
class Run:
    name: str
    settings: dict = field(default_factory=dict)


def run_plan(train: M.Sparse, valid: M.Sparse, classes: int, runs: list[Run], defaults: dict | None = None) -> list[dict]:
    """Train every run's MLP with the defaults and its own settings; one result row each, in order."""
    names = [r.name for r in runs]
    if len(set(names)) != len(names) or any(not re.fullmatch(r"[A-Za-z0-9._-]+", n) for n in names):
        raise ValueError("run names must be distinct and plain")
    out = []
    for r in runs:
        cfg = (defaults or {}) | r.settings
        model, h = M.fit_mlp(train, valid, classes, **cfg)
        pred = model.probabilities(valid).argmax(1)
        out.append({"name": r.name, "settings": cfg, "best_epoch": h.best, "epochs": len(h.losses), "loss": h.losses[h.best], "accuracy": float((pred == valid.label).mean())})
    return out


def compare_runs(results: DataFrame) -> DataFrame:
    """``name, accuracy, macro_f1`` in order with the relative change of F1 from run to run."""
    return V.relative_change(results.withColumn("_all", F.lit(1)), ["_all"], "place", "macro_f1").drop("_all")


def analyze(exprs: DataFrame, store: Store, radii: tuple[int, ...] = (1, 2, 3)) -> list[str]:
    """Publish views, identities and pattern counts of a corpus; stages that are there are kept."""
    made = []
    settings = {"radii": list(radii)}
    if not store.done("views"):
        store.publish("views", {v: view_rows(exprs, (v,)).where("refs is not null") for v in VIEWS})
        made.append("views")
    if not store.done("identities"):
        store.publish("identities", {"nodes": I.identities(exprs)})
        made.append("identities")
    if not store.done("patterns", settings):
        counts = I.local_patterns(exprs, radii).groupBy("radius", "flavour", "digest").agg(F.count("*").alias("n"), F.count_distinct("thm").alias("theorems"))
        store.publish("patterns", {"counts": counts}, settings)
        made.append("patterns")
    return made


def pattern_coverage(counts: DataFrame, ranks: int = 1500) -> DataFrame:
    """Share of occurrences that the commonest patterns make, by radius and flavour.

    Patterns of equal counts are one row of a histogram, whose cumulative sums give
    the share at any rank; it is given at up to ``ranks`` ranks that grow
    geometrically from 1 to the number of patterns, the last one included.
    """
    by = ["radius", "flavour"]
    hist = counts.groupBy(*by, "n").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumns({"last": F.sum("k").over(run), "mass": F.sum(F.col("k") * F.col("n")).over(run)})
    whole = Window.partitionBy(*by)
    hist = hist.withColumns({"all": F.max("last").over(whole), "total": F.max("mass").over(whole)})
    step = F.when(F.lit(ranks) > 1, F.pow("all", F.lit(1.0 / max(ranks - 1, 1)))).otherwise(F.lit(1.0))
    points = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(ranks - 1)), lambda i: F.least(F.col("all"), F.round(F.pow(step, i)).cast("long"))))
    at = hist.select(*by, "all").distinct().select(*by, F.explode(F.array_union(points, F.array("all"))).alias("rank"))
    met = at.join(hist, by).where((F.col("rank") > F.col("last") - F.col("k")) & (F.col("rank") <= F.col("last")))
    return met.select(*by, "rank", ((F.col("mass") - (F.col("last") - F.col("rank")) * F.col("n")) / F.col("total")).alias("share"))
