"""Result and pair-score sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

RESULT_SCHEMA = (
    "task string, dataset string, encoder string, whitening string, model string, "
    "metric string, fold int, value double, run_id string, settings string, written_at timestamp"
)
SWEEP_KEY = ["task", "dataset", "encoder", "whitening", "model", "settings"]


def results_frame(spark: SparkSession, rows) -> DataFrame:
    """Rows of the result table; settings and time may be left out."""
    full = len(RESULT_SCHEMA.split(", "))
    late = ("", datetime.now())
    padded = [tuple(r) + late[len(r) - full :] if len(r) < full else tuple(r) for r in rows]
    return spark.createDataFrame(padded, RESULT_SCHEMA)


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """All results so far; none when nothing was written yet."""
    try:
        return spark.read.schema(RESULT_SCHEMA).parquet(root)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return results_frame(spark, [])


def pending(spark: SparkSession, wanted: DataFrame, root: str) -> DataFrame:
    """Sweep keys of ``wanted`` that have no result yet; a result under other settings is none."""
    keys = [c for c in SWEEP_KEY if c in wanted.columns]
    done = read_results(spark, root).select(*keys).distinct()
    return wanted.join(done, keys, "left_anti")


def append_results(results: DataFrame, root: str) -> None:
    results.write.mode("append").partitionBy("task", "dataset").parquet(root)


def export_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_pair_scores(scores: DataFrame, root: str) -> None:
    """``(dataset, encoder, whitening, pair_id, cos_sim, score)`` partitioned by sweep key.

    Partitions that are written again are replaced, so a sweep that goes on doubles nothing.
    """
    replacing = scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    replacing.partitionBy("dataset", "encoder", "whitening").parquet(root)


def latest(results: DataFrame) -> DataFrame:
    """One row per key and metric: the one written last."""
    key = [*SWEEP_KEY, "metric", "fold"]
    return results.groupBy(*key).agg(F.max_by("value", "written_at").alias("value"), F.max_by("run_id", "written_at").alias("run_id"))
