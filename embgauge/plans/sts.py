"""Semantic textual similarity: correlation of pair cosines with gold scores, raw and whitened."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from embgauge.operators.moments import moments
from embgauge.operators.pairs import check_keys, join_sides
from embgauge.operators.ranks import spearman
from embgauge.operators.whiten import METHODS, NONE, Unchanged, solve_whitening, whitened_pair_cosine
from embgauge.plans.sweep import Sweep, label_of, run_sweep
from embgauge.session import cache_scope, fetched, keep
from embgauge.sources.embeddings import read_embeddings
from embgauge.sources.results import write_pair_scores


def pair_models(rows: DataFrame, methods: list) -> list:
    """Maps for the methods; whitening is fitted once, on both sides stacked."""
    fitted = moments(rows) if any(m != NONE for m in methods) else None
    return [Unchanged() if m == NONE else solve_whitening(fitted, m) for m in methods]


def score_pairs(rows: DataFrame, gold: DataFrame, methods: list = (NONE, *METHODS)) -> DataFrame:
    """``(pair_id, score, whitening, cos_sim)``.

    The sides meet in one equi-join on raw vectors; all methods are scored inside that stage. Every
    pair must have both sides and one gold score, and every gold score a pair.
    """
    check_keys(rows.where("side = 1"), gold, "gold scores")
    pairs = join_sides(rows).join(gold.select("pair_id", "score"), "pair_id")
    return whitened_pair_cosine(pairs, pair_models(rows, list(methods)))


def correlations(scores: DataFrame, by: list[str] = ("whitening",)) -> DataFrame:
    """``(*by, pearson, spearman, anisotropy)``, the correlations as percentages."""
    by = list(by)
    linear = scores.groupBy(*by).agg(F.corr("cos_sim", "score").alias("pearson"), F.avg("cos_sim").alias("anisotropy"))
    ranked = spearman(scores, "cos_sim", "score", by)
    return linear.join(ranked, by).select(
        *by, (100 * F.col("pearson")).alias("pearson"), (100 * F.col("spearman")).alias("spearman"), "anisotropy"
    )


def evaluate_sts(
    rows: DataFrame,
    gold: DataFrame,
    methods: list = (NONE, *METHODS),
    write: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """``(whitening, metric, value, fold)`` rows; ``write`` gets the pair scores they come from."""
    with cache_scope():
        scores = keep(score_pairs(rows, gold, methods))
        if write:
            write(scores)
        figures = correlations(scores).unpivot("whitening", ["pearson", "spearman", "anisotropy"], "metric", "value")
        return fetched(figures.withColumn("fold", F.lit(None).cast("int")))


def eval_sts(spark: SparkSession, sweep: Sweep) -> DataFrame:
    """The sweep over datasets, encoders and methods; pair scores go to ``sweep.pair_scores``."""

    def work(dataset, encoder, methods):
        rows = read_embeddings(spark, sweep.store, dataset, encoder).withColumnRenamed("row_id", "pair_id")

        def write(scores):
            names = {"dataset": F.lit(dataset), "encoder": F.lit(encoder), "whitening": label_of("whitening")}
            write_pair_scores(scores.withColumns(names), sweep.pair_scores)

        return evaluate_sts(rows, sweep.gold(spark, dataset), methods, write if sweep.pair_scores else None)

    return run_sweep(spark, sweep, "sts", "cosine", work, ())
