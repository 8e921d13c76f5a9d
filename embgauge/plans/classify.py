"""Probing classification, raw and whitened, with the isotropy of the vectors alongside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from embgauge.operators.metrics import fold_summary
from embgauge.operators.moments import isoscore_of, moments, moments_without
from embgauge.operators.probe import ProbeSettings, probe, with_folds
from embgauge.operators.whiten import NONE, solve_whitening, whiten
from embgauge.plans.sweep import Sweep, load_features, run_sweep
from embgauge.session import cache_scope, fetched, keep


def evaluate_classification(
    rows: DataFrame,
    classifier: str = "softmax",
    methods: list = (NONE,),
    settings: ProbeSettings = ProbeSettings(),
    fit_on: str = "all",
) -> DataFrame:
    """``(whitening, metric, fold, value)`` of one table of ``(row_id, label, embedding)``.

    The moments are taken once and give the isotropy and every whitening map; the isotropy of
    whitened vectors follows from the mapped covariance without another scan. ``fit_on='all'`` fits
    the map on all rows, test folds included; ``'train'`` fits it anew on each train set, from
    sums per fold that one more scan takes for all folds and methods.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on must be 'all' or 'train', not {fit_on!r}")
    with cache_scope():
        base = keep(with_folds(rows.select("row_id", "label", "embedding"), classifier, settings))
        whole = moments(base)
        seen = moments_without(base) if fit_on == "train" and set(methods) != {NONE} else None
        parts = [_one_method(base, whole, m, classifier, settings, seen) for m in methods]
        return reduce(DataFrame.unionByName, parts)


def _one_method(base: DataFrame, whole, method: str, classifier: str, settings: ProbeSettings, seen: dict | None):
    if method == NONE:
        isotropy, found = whole.isoscore, _figures(base, classifier, settings)
    else:
        model = solve_whitening(whole, method)
        isotropy = isoscore_of(model.whiten @ whole.cov @ model.whiten.T)
        if seen is None:
            found = _figures(whiten(base, [model]).drop("whitening"), classifier, settings)
        else:
            found = _figures_by_fold(base, method, classifier, settings, seen)
    constant = base.sparkSession.createDataFrame([("isoscore", None, isotropy)], "metric string, fold int, value double")
    return found.unionByName(constant).select(F.lit(method).alias("whitening"), "metric", "fold", "value")


def _figures(table: DataFrame, classifier: str, settings: ProbeSettings, outer: list | None = None) -> DataFrame:
    """``(metric, fold, value)``; the tables cached for it are released."""
    with cache_scope():
        return fetched(probe(table, classifier, settings, outer).results().select("metric", "fold", "value"))


def _figures_by_fold(base: DataFrame, method: str, classifier: str, settings: ProbeSettings, seen: dict) -> DataFrame:
    """As ``_figures``, with the map of each held-out fold fitted on the moments of the others."""
    parts = []
    for held_out in sorted(seen):
        model = solve_whitening(seen[held_out], method)
        parts.append(_figures(whiten(base, [model]).drop("whitening"), classifier, settings, [held_out]))
    per_fold = reduce(DataFrame.unionByName, parts).where(F.col("fold").isNotNull())
    means = fold_summary(per_fold.where(~F.col("metric").isin("best_l2", "iterations", "converged")), ["metric"])
    return per_fold.unionByName(means.withColumn("fold", F.lit(None).cast("int")))


def eval_classify(spark: SparkSession, sweep: Sweep) -> DataFrame:
    """The sweep over datasets, encoders and whitening methods for ``sweep.classifier``."""

    def work(dataset, encoder, methods):
        rows = load_features(spark, sweep, dataset, encoder)
        return evaluate_classification(rows, sweep.classifier, methods, sweep.settings, sweep.fit_on)

    return run_sweep(spark, sweep, "classification", sweep.classifier, work, (sweep.settings, sweep.fit_on))
