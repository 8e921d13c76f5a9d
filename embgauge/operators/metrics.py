"""Classification metrics as aggregations over a prediction table ``(*by, label, pred)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from embgauge.operators.ranks import running_totals
from embgauge.session import keep


def confusion(predictions: DataFrame, by: list[str] = ()) -> DataFrame:
    """``(*by, label, pred, n)`` for the pairs that occur."""
    return predictions.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame, classes: list, by: list[str] = ()) -> DataFrame:
    """One row per true class, one count column per predicted class."""
    wide = confusion(predictions, by).groupBy(*by, "label").pivot("pred", classes).sum("n")
    return wide.na.fill(0)


def accuracy(predictions: DataFrame, by: list[str] = (), out: str = "accuracy") -> DataFrame:
    """Percentage right, two places, halves to even."""
    hit = F.avg((F.col("label") == F.col("pred")).cast("int"))
    return predictions.groupBy(*by).agg(F.bround(100 * hit, 2).alias(out))


def f1_weighted(predictions: DataFrame, by: list[str] = (), out: str = "f1_weighted") -> DataFrame:
    """Per-class F1 weighted by the class's rows, as a whole percentage."""
    by = list(by)
    cells = confusion(predictions, by)
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    truth = cells.groupBy(*by, "label").agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    guessed = cells.groupBy(*by, F.col("pred").alias("label")).agg(F.sum("n").alias("guessed"))
    per_class = truth.join(guessed, [*by, "label"], "left")
    f1 = 2 * F.col("tp") / (F.col("support") + F.coalesce("guessed", F.lit(0)))
    weighted = F.sum(F.col("support") * f1) / F.sum("support")
    return per_class.groupBy(*by).agg(F.bround(100 * weighted, 0).alias(out))


def roc_auc_weighted(
    predictions: DataFrame, classes: list, by: list[str] = (), scores: str = "scores", out: str = "rocauc_weighted"
) -> DataFrame:
    """One-vs-rest AUC per class, weighted by the class's rows, as a percentage.

    The AUC is the share of (positive, negative) pairs in the right order, ties counting half. It
    comes from counts per distinct score and the negatives below each, so nothing is joined back
    to the rows and no pair is formed. Classes without both kinds of rows are left out.
    """
    by = list(by)
    long = predictions.select(*by, "label", F.posexplode(scores).alias("_c", "_score"))
    positive = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("_c") + 1) == F.col("label")
    values = keep(
        long.groupBy(*by, "_c", "_score").agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )
    below = running_totals(values, "_score", ["neg"], [*by, "_c"])
    per_class = below.groupBy(*by, "_c").agg(
        F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("won"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    )
    usable = per_class.where((F.col("p") > 0) & (F.col("n") > 0))
    auc = F.col("won") / (F.col("p").cast("double") * F.col("n"))
    return usable.groupBy(*by).agg((100 * F.sum(F.col("p") * auc) / F.sum("p")).alias(out))


def fold_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean over folds or runs, two places."""
    return results.groupBy(*by).agg(F.bround(F.avg("value"), 2).alias("value"))


def best_reg(scores: DataFrame, by: list[str] = (), reg: str = "reg", value: str = "value") -> DataFrame:
    """``(*by, best_reg, best_score)``: highest mean score, the smallest setting winning ties."""
    means = scores.groupBy(*by, reg).agg(F.bround(F.avg(value), 2).alias("_mean"))
    return means.groupBy(*by).agg(
        F.min_by(reg, F.struct(-F.col("_mean"), F.col(reg))).alias("best_reg"), F.max("_mean").alias("best_score")
    )
