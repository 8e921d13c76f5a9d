"""Settings of an evaluation sweep, and the resume rule: keys that have results are not run again."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from embgauge.functions.text import method_label
from embgauge.operators.pairs import join_sides, labelled_pair_features
from embgauge.operators.probe import ProbeSettings
from embgauge.operators.whiten import METHODS, NONE
from embgauge.sources.datasets import apply_contract
from embgauge.sources.embeddings import read_embeddings
from embgauge.sources.results import RESULT_SCHEMA, SWEEP_KEY, append_results, pending, read_results

# The encoders compared by default, and the datasets of sentence pairs with labels.
ENCODERS = [
    "bert",
    "all-mpnet-base-v2",
    "simcse",
    "angle-bert",
    "angle-llama",
    "llama-7B",
    "llama2-7B",
    "text-embedding-3-small",
]
PAIR_DATASETS = ["mrpc"]


@dataclass(frozen=True)
class Sweep:
    """What to evaluate and where things lie.

    ``store`` is the embedding table's folder and ``results`` the result table's. ``gold`` gives
    the gold scores of a pair dataset as ``(pair_id, score)`` and ``pair_labels`` the labels of a
    labelled pair dataset as ``(pair_id, label)``.
    """

    store: str
    results: str
    datasets: list
    encoders: list = field(default_factory=lambda: list(ENCODERS))
    methods: list = field(default_factory=lambda: [NONE, *METHODS])
    classifier: str = "softmax"
    settings: ProbeSettings = ProbeSettings()
    fit_on: str = "all"
    runs: int = 5
    run_id: str = "run"
    pair_scores: str | None = None
    gold: Callable[[SparkSession, str], DataFrame] | None = None
    pair_labels: Callable[[SparkSession, str], DataFrame] | None = None


def load_features(spark: SparkSession, sweep: Sweep, dataset: str, encoder: str) -> DataFrame:
    """``(row_id, label, embedding)`` of one dataset, with pair features for labelled pairs."""
    rows = read_embeddings(spark, sweep.store, dataset, encoder)
    if dataset not in PAIR_DATASETS:
        return apply_contract(rows.select("row_id", "text", "label", "embedding")).drop("text")
    pairs = join_sides(rows.withColumnRenamed("row_id", "pair_id"))
    return labelled_pair_features(pairs, sweep.pair_labels(spark, dataset)).select(
        F.col("pair_id").alias("row_id"), "label", "embedding"
    )


def run_sweep(
    spark: SparkSession, sweep: Sweep, task: str, model: str, work: Callable[[str, str, list], DataFrame], settings: tuple
) -> DataFrame:
    """Run ``work(dataset, encoder, methods)`` for what has no result yet and append its rows.

    ``work`` returns ``(whitening, metric, fold, value)``. Results are written after each dataset
    and encoder, so a stopped sweep goes on where it ended. ``settings`` holds what else the figures
    depend on; results under other settings do not count as done. Returns the task's results under
    these settings.
    """
    identity = hashlib.md5(repr(settings).encode()).hexdigest()
    labels = {method_label(m): m for m in sweep.methods}
    wanted = [(task, d, e, w, model, identity) for d in sweep.datasets for e in sweep.encoders for w in labels]
    open_keys = pending(spark, spark.createDataFrame(wanted, ", ".join(f"{c} string" for c in SWEEP_KEY)), sweep.results)
    todo: dict = {}
    for row in open_keys.collect():
        todo.setdefault((row["dataset"], row["encoder"]), set()).add(labels[row["whitening"]])
    for dataset in sweep.datasets:
        for encoder in sweep.encoders:
            methods = [m for m in sweep.methods if m in todo.get((dataset, encoder), ())]
            if not methods:
                continue
            found = work(dataset, encoder, methods)
            keyed = found.select(
                F.lit(task).alias("task"),
                F.lit(dataset).alias("dataset"),
                F.lit(encoder).alias("encoder"),
                label_of("whitening").alias("whitening"),
                F.lit(model).alias("model"),
                "metric",
                F.col("fold").cast("int").alias("fold"),
                F.col("value").cast("double").alias("value"),
                F.lit(sweep.run_id).alias("run_id"),
                F.lit(identity).alias("settings"),
                F.current_timestamp().alias("written_at"),
            )
            append_results(keyed, sweep.results)
    return read_results(spark, sweep.results).where((F.col("task") == task) & (F.col("settings") == identity)).select(
        *[part.split()[0] for part in RESULT_SCHEMA.split(", ")]
    )


def label_of(column: str):
    """Method name as results show it."""
    return F.replace(F.col(column), F.lit("_cor"), F.lit("-cor"))
