"""Evaluation of classifiers: ``row, label, pred`` and long probabilities ``row, cls, p``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "pred").agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame, declared: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every declared class; 0 where undefined."""
    tp = matrix.where("label = pred").groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("tp"))
    support = matrix.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    guessed = matrix.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("guessed"))
    got = declared.select("cls").join(tp, "cls", "left").join(support, "cls", "left").join(guessed, "cls", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    got = got.select("cls", "support", ratio("tp", "guessed").alias("precision"), ratio("tp", "support").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return got.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def macro(scores: DataFrame, matrix: DataFrame) -> DataFrame:
    """Accuracy, and F1 averaged over declared classes, those without support included."""
    acc = matrix.agg((F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return scores.agg(F.avg("f1").alias("macro_f1")).crossJoin(acc)


def top_k(probabilities: DataFrame, labels: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Share of rows whose label is among the k likeliest; ties go to the lowest class."""
    w = Window.partitionBy("row").orderBy(F.desc("p"), "cls")
    placed = probabilities.withColumn("place", F.row_number().over(w)).join(labels, "row").where("cls = label")
    return placed.agg(F.count("*").alias("n"), *[F.avg((F.col("place") <= k).cast("double")).alias(f"top{k}") for k in ks])


def cross_entropy(probabilities: DataFrame, labels: DataFrame, floor: float = 1e-15) -> DataFrame:
    met = probabilities.join(labels, "row").where("cls = label")
    return met.agg(F.avg(-F.log(F.greatest("p", F.lit(floor)))).alias("cross_entropy"))


def class_weights(labels: DataFrame) -> DataFrame:
    """``balanced`` N / (K n_c) over observed classes and ``inverse_sqrt`` rescaled to a sample mean of 1."""
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    b = n.crossJoin(F.broadcast(whole)).withColumn("balanced", F.col("rows") / (F.col("classes") * F.col("n"))).withColumn("root", F.sqrt("balanced"))
    mean = b.agg((F.sum(F.col("root") * F.col("n")) / F.sum("n")).alias("mean"))
    return b.crossJoin(F.broadcast(mean)).select("label", "n", "balanced", (F.col("root") / F.col("mean")).alias("inverse_sqrt"))


def early_stopping(history: DataFrame, min_delta: float, patience: int) -> DataFrame:
    """``run, best_epoch, best_loss, stop_epoch`` of loss histories (``run, epoch, loss``).

    The best epoch has the strictly lowest loss so far; training stops once
    ``patience`` epochs in a row fail to undercut the stop loss by ``min_delta``.
    Histories are one short array per run.
    """
    runs = history.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "loss"))).alias("h"))
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).cast("long").alias("at"), F.lit(float("inf")).alias("stop"), F.lit(0).alias("stale"), F.lit(-1).cast("long").alias("end"))

    def step(a, e):
        better, less = e["loss"] < a["best"], e["loss"] < a["stop"] - min_delta
        stale = F.when(less, 0).otherwise(a["stale"] + 1)
        end = F.when(stale >= patience, e["epoch"].cast("long")).otherwise(a["end"])
        new = F.struct(F.when(better, e["loss"]).otherwise(a["best"]).alias("best"), F.when(better, e["epoch"].cast("long")).otherwise(a["at"]).alias("at"), F.when(less, e["loss"]).otherwise(a["stop"]).alias("stop"), stale.alias("stale"), end.alias("end"))
        return F.when(a["end"] >= 0, a).otherwise(new)

    got = runs.withColumn("r", F.aggregate("h", zero, step))
    return got.select("run", F.col("r.at").alias("best_epoch"), F.col("r.best").alias("best_loss"), F.when(F.col("r.end") >= 0, F.col("r.end")).alias("stop_epoch"))


def relative_change(scores: DataFrame, keys, order: str, value: str) -> DataFrame:
    """Percent change from the run before; null for the first and where that is 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    return scores.withColumn("change", F.try_divide(100 * (F.col(value) - before), before))
