"""Quality rules: learned decision lists over native text statistics.

Statistics of every text are Spark expressions.  A bounded sample of labelled
rows is fitted on the driver by sequential covering: a rule for low quality is
grown one threshold condition at a time by information gain on two thirds of
the rows, pruned from its end on the other third, and kept while it is precise
there; the rows it covers are then removed.  The list is emitted as one ordered
conditional expression, so the main path stays within the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit reads at most (chosen by a hash of doc_id).
SAMPLE_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVERED = 12, 4, 0.95, 5
WORD = r"[^\x20\x09-\x0D]+"
FEATURES = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "n_words"]


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts and the shares that rules use.

    Windows of three words are told apart by a 64-bit hash.  A null text has
    no words; every count is then 0.
    """
    text = F.coalesce("text", F.lit(""))
    gone = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        gone("#*$%&|<>").cast("long").alias("n_symbols"),
        gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"),
        gone("0123456789").alias("digits"),
        gone("!?|").alias("marks"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("words")
    window = F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    d = d.select(
        "doc_id", "word_chars", "n_symbols", "upper", "digits", "marks",
        n.cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window.alias("h"),
    )
    placed = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.withColumn("s", placed).drop("h")
    twice = F.transform("s", lambda e, k: F.when((e["h"] == F.get("s", k - 1)["h"]) | (e["h"] == F.get("s", k + 1)["h"]), e["i"]))
    d = d.withColumn("at", F.sort_array(F.array_compact(twice))).drop("s")
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    share = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(0.0))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("upper", "word_chars").alias("upper_share"),
        share("digits", "word_chars").alias("digit_share"),
        share("marks", "word_chars").alias("mark_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature).cast("double")
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, thresholds: list[np.ndarray]) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (p := int(bad[inside].sum())) and (n := int((~bad[inside]).sum())):
        best, gain = None, 1e-9
        old = np.log2(p / (p + n))
        xs, b = x[inside], bad[inside]
        for f, cuts in enumerate(thresholds):
            at = np.searchsorted(cuts, xs[:, f], "left")
            below_p = np.cumsum(np.bincount(at[b], minlength=len(cuts) + 1))[:-1]
            below_n = np.cumsum(np.bincount(at[~b], minlength=len(cuts) + 1))[:-1]
            for above, ps, ns in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(ps >= MIN_COVERED, ps * (np.log2(ps / (ps + ns)) - old), -1)
                if len(g) and g.max() > gain:
                    k = int(g.argmax())
                    best, gain = Condition(FEATURES[f], above, float(cuts[k])), float(g[k])
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[Rule, float]:
    def worth(r: Rule) -> float:
        c = _covers(r, x)
        p, n = int(bad[c].sum()), int((~bad[c]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())
    c = _covers(best, x)
    return best, float(bad[c].mean()) if best and c.any() else 0.0


def fit_rules(x: np.ndarray, bad: np.ndarray, seed: int = 0) -> list[Rule]:
    """An ordered list of rules for low quality, from feature rows and labels."""
    order = np.random.default_rng(seed).permutation(len(x))
    part = np.zeros(len(x), bool)
    part[order[: 2 * len(x) // 3]] = True
    gx, gb, px, pb = x[part], bad[part], x[~part], bad[~part]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and gb.sum() >= MIN_COVERED:
        cuts = []
        for f in range(x.shape[1]):
            v = np.unique(np.concatenate((np.quantile(gx[:, f], np.linspace(0, 1, 65)), gx[gb, f]) if len(gx) else [0.0]))
            cuts.append((v[1:] + v[:-1]) / 2)
        rule, precision = _prune(_grow(gx, gb, cuts), px, pb)
        if not rule or precision < MIN_PRECISION:
            break
        rules.append(rule)
        keep = ~_covers(rule, gx)
        gx, gb = gx[keep], gb[keep]
        keep = ~_covers(rule, px)
        px, pb = px[keep], pb[keep]
    return rules


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Fit rules on at most about ``rows`` labelled documents (``labels.quality`` 0: low)."""
    labelled = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = labelled.count()
    share = min(1.0, rows / max(n, 1))
    picked = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    some = text_stats(docs.join(F.broadcast(picked), "doc_id", "left_semi")).join(F.broadcast(picked), "doc_id").select("quality", *FEATURES)
    got = sorted(some.limit(2 * rows).collect())
    if not got:
        return []
    table = np.array([[float(v) for v in r] for r in got])
    return fit_rules(table[:, 1:], table[:, 0] == 0)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that a row meets, from 1; else null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        both = F.lit(True)
        for c in rule:
            both = both & c.column()
        out = F.when(both, F.lit(k)).otherwise(out)
    return out


def quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Base counts, ``base_failed``, ``rule`` and ``kept`` of every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null
    or empty text has no words and fails; repeated rows are judged each on its
    own; an empty table gives an empty result; without rules, what passes the
    base is kept.
    """
    d = text_stats(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    d = d.withColumns({"base_failed": failed, "rule": verdict(rules)})
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
