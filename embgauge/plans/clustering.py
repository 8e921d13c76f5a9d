"""Clustering quality: silhouette of repeated mini-batch k-means, raw and whitened."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from embgauge.operators.cluster import BATCH_RAW, BATCH_WHITENED, RUNS, assign, fit_mini_batches
from embgauge.operators.moments import moments
from embgauge.operators.probe import classes_of
from embgauge.operators.silhouette import silhouette
from embgauge.operators.whiten import METHODS, NONE, solve_whitening, whiten
from embgauge.plans.sweep import Sweep, load_features, run_sweep
from embgauge.session import cache_scope, keep


def evaluate_clustering(rows: DataFrame, methods: list = (NONE, *METHODS), runs: int = RUNS, seed: int = 0) -> DataFrame:
    """``(whitening, metric, fold, value)``: silhouette per run (``fold`` = run) and its mean, the ``steps`` that the
    runs took, and whether their centers ``converged`` (1 or 0).

    As many clusters as classes. The runs of one method share the assigning scan and the
    distances. Values are percentages with two places. Maps that differ by a rotation only have the same distances, and
    so the same clusters and figures: they are clustered once.
    """
    with cache_scope():
        base = keep(rows.select("row_id", "label", "embedding"))
        k = len(classes_of(base))
        whole = moments(base) if any(m != NONE for m in methods) else None
        parts = []
        for alike in _alike(whole, methods):
            found = _runs_of(base, whole, alike[0], k, runs, seed)
            parts += [(method, *row) for method in alike for row in found]
    found = rows.sparkSession.createDataFrame(parts, "whitening string, metric string, fold int, value double")
    means = found.where("metric = 'silhouette'").groupBy("whitening", "metric").agg(F.bround(F.avg("value"), 2).alias("value"))
    return found.unionByName(means.withColumn("fold", F.lit(None).cast("int")))


def _alike(whole, methods: list) -> list[list]:
    """The methods in groups whose maps give all rows the same distances: the same Gram matrix of the map."""
    out, grams = [], []
    for method in methods:
        gram = None if method == NONE else (w := solve_whitening(whole, method).whiten).T @ w
        same = [i for i, g in enumerate(grams) if gram is not None and g is not None and np.allclose(g, gram, rtol=1e-9, atol=1e-9 * np.abs(gram).max())]
        if same:
            out[same[0]].append(method)
        else:
            out.append([method])
            grams.append(gram)
    return out


def _runs_of(base: DataFrame, whole, method: str, k: int, runs: int, seed: int) -> list:
    """``(metric, fold, value)``: the silhouette of every run of one method, and how its fit ended."""
    mapped = base if method == NONE else whiten(base, [solve_whitening(whole, method)]).drop("whitening")
    batch = BATCH_RAW if method == NONE else BATCH_WHITENED
    with cache_scope():
        centers, steps, converged = fit_mini_batches(mapped, k, runs, batch, seed)
        scores = silhouette(keep(assign(mapped, centers))).collect()
    ended = [("steps", None, float(steps)), ("converged", None, float(converged))]
    return [("silhouette", r["run"], round(100 * r["silhouette"], 2)) for r in scores] + ended


def eval_cluster(spark: SparkSession, sweep: Sweep) -> DataFrame:
    """The sweep over datasets, encoders and whitening methods."""

    def work(dataset, encoder, methods):
        return evaluate_clustering(load_features(spark, sweep, dataset, encoder), methods, sweep.runs, sweep.settings.seed)

    return run_sweep(spark, sweep, "clustering", "mini_batch_k_means", work, (sweep.runs, sweep.settings.seed))
