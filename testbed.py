"""The given tables in the shapes the library works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embgauge.functions.text import token_table
from embgauge.functions.vectors import as_doubles, at_places
from embgauge.sources.catalogue import Catalogue, Entry
from embgauge.sources.datasets import read_dataset

LAYERS = 4
TOKEN_WIDTH = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def catalogue(sf: str) -> Catalogue:
    return Catalogue(
        [
            Entry(
                "docs",
                "unsplit",
                {"all": f"{sf}/documents.parquet"},
                "parquet",
                {"row_id": "doc_id", "text": "text"},
                spread=True,
            ),
            Entry(
                "vectors",
                "unsplit",
                {"all": f"{sf}/embeddings.parquet"},
                "parquet",
                {"row_id": "vec_id", "label": "label", "embedding": "embedding"},
            ),
        ]
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """``(row_id, text)`` of every document."""
    return read_dataset(spark, "docs", catalogue(sf)).select("row_id", "text")


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """``(dataset, split, row_id, text, label)``: documents that have a quality label."""
    return _with_labels(spark, sf, "inner")


def all_documents(spark: SparkSession, sf: str) -> DataFrame:
    """``(dataset, split, row_id, text, label)`` of every document; the label is null where there is none."""
    return _with_labels(spark, sf, "left")


def _with_labels(spark: SparkSession, sf: str, how: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    rows = read_dataset(spark, "docs", catalogue(sf)).join(labels, "row_id", how)
    last = F.substring(F.md5(F.col("row_id").cast("string")), 32, 1)
    return rows.withColumn("split", F.when(last.isin("0", "1", "2"), "test").otherwise("train")).select(
        "dataset", "split", "row_id", "text", "label"
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``(row_id, label, embedding)`` of every vector."""
    rows = read_dataset(spark, "vectors", catalogue(sf))
    return rows.select("row_id", "label", "embedding")


def sides(spark: SparkSession, sf: str) -> DataFrame:
    """Two consecutive vectors are the two sides of a pair: ``(pair_id, side, label, embedding)``."""
    pair, side = F.expr("row_id div 2"), (F.col("row_id") % 2 + 1).cast("int")
    return vectors(spark, sf).select(pair.alias("pair_id"), side.alias("side"), "label", "embedding")


def _side_labels(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("label")))
    return sides(spark, sf).groupBy("pair_id").agg(of(1).alias("l1"), of(2).alias("l2"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """``(pair_id, score)``: 5 for equal labels, less with their distance."""
    return _side_labels(spark, sf).select(
        "pair_id", (F.lit(5.0) - F.abs(F.col("l1") - F.col("l2")) * F.lit(5.0) / 9).alias("score")
    )


def pair_labels(spark: SparkSession, sf: str) -> DataFrame:
    """``(pair_id, label)``: whether both sides carry the same label."""
    return _side_labels(spark, sf).select("pair_id", (F.col("l1") == F.col("l2")).cast("int").alias("label"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Hidden states of all tokens of all documents: ``(row_id, layer, token_pos, attended, embedding)``.

    The vector is made of eight 7-bit numbers from the digest of layer and token; their roots keep
    means off exact decimal halves, which two engines may round apart.
    """
    layers = F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1))).alias("layer")
    rows = token_table(documents(spark, sf)).select("row_id", "token_pos", "token", layers)
    digest = F.md5(F.concat_ws(":", F.col("layer").cast("string"), F.col("token")))
    bits = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    number = lambda i: F.shiftright("bits", 7 * i).bitwiseAND(F.lit(127).cast("bigint")).cast("double")
    entry = lambda i: F.sqrt(number(i) + 1) / 6 - 1
    return rows.withColumn("bits", bits).select(
        "row_id",
        "layer",
        "token_pos",
        (F.length("token") > 2).alias("attended"),
        F.array(*[entry(i) for i in range(TOKEN_WIDTH)]).alias("embedding"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn with the assistant's answer, missing when there is none."""
    conversations = table(spark, sf, "conversations")
    answer = conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_2")
    )
    asked = conversations.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("text_1"))
    return asked.join(answer, ["conv_id", "turn"], "left")


def entries(df: DataFrame, *keys: str, column: str = "embedding", places: int = 6) -> DataFrame:
    """One row per vector entry, rounded."""
    return df.select(*keys, F.posexplode(as_doubles(column)).alias("dim", "v")).select(
        *keys, "dim", at_places(F.col("v"), places).alias("value")
    )
