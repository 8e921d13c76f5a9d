"""Embedding tables on disk: Parquet partitioned by dataset and encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embgauge.functions.vectors import assemble
from embgauge.sources.datasets import TSV_OPTIONS, read_tsv
from embgauge.sources.tsv import read_records

PARTITIONS = ["dataset", "encoder"]


def write_embeddings(df: DataFrame, root: str, mode: str = "append") -> None:
    """Write ``(dataset, encoder, split, side, row_id, text, label, embedding)`` rows.

    ``mode`` is ``append``, or ``replace`` for the datasets and encoders that are written.
    """
    missing = [c for c in (*PARTITIONS, "row_id", "embedding") if c not in df.columns]
    if missing:
        raise ValueError(f"embedding rows lack {missing}")
    writer = df.write.mode("overwrite" if mode == "replace" else mode)
    if mode == "replace":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*PARTITIONS).parquet(root)


def read_embeddings(spark: SparkSession, root: str, dataset: str, encoder: str, split: str | None = None) -> DataFrame:
    """One dataset under one encoder; other partitions are pruned, both splits are one table."""
    rows = spark.read.parquet(root).where((F.col("dataset") == dataset) & (F.col("encoder") == encoder))
    if split is not None:
        rows = rows.where(F.col("split") == split)
    return rows


def from_wide(df: DataFrame, leading: int = 2) -> DataFrame:
    """Wide layout (``leading`` named columns, then one column per dimension) to a vector column."""
    keep, dims = df.columns[:leading], df.columns[leading:]
    return df.select(*keep, assemble([F.col(f"`{c}`") for c in dims]).alias("embedding"))


def read_wide(spark: SparkSession, path: str, leading: int = 2) -> DataFrame:
    """Wide TSV embeddings as ``(row_id, <leading columns>, embedding)``, numbered in file order."""
    header = ", ".join(f"`{name}` string" for name in read_tsv(spark, path).columns)
    wide, _ = read_records(spark, path, header, "row_id")
    return from_wide(wide, leading + 1)


def write_wide(df: DataFrame, width: int, path: str) -> None:
    """Embeddings as wide TSV, one column per dimension, in ``row_id`` order."""
    to_wide(df.orderBy("row_id").drop("row_id"), width).write.options(**TSV_OPTIONS).mode("overwrite").csv(path)


def to_wide(df: DataFrame, width: int) -> DataFrame:
    """Vector column to one column per dimension, named by position."""
    keep = [c for c in df.columns if c != "embedding"]
    return df.select(*keep, *[F.col("embedding")[i].alias(str(i)) for i in range(width)])
