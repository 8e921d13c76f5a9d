"""Sentence pairs: joining the two sides, checks, features and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from embgauge.functions.vectors import cosine, pair_features


def side(df: DataFrame, number: int, out: str, key: str = "pair_id", column: str = "embedding") -> DataFrame:
    return df.where(F.col("side") == number).select(key, F.col(column).alias(out))


def join_sides(df: DataFrame, key: str = "pair_id", column: str = "embedding") -> DataFrame:
    """``(key, e1, e2)`` by an equi-join on the pair key, which each side must hold once."""
    check_sides(df, key)
    return side(df, 1, "e1", key, column).join(side(df, 2, "e2", key, column), key)


def pair_integrity(df: DataFrame, key: str = "pair_id") -> DataFrame:
    """Row counts of both sides and of keys that lack a partner; only keys are shuffled."""
    has = df.groupBy(key).agg(
        F.count_if(F.col("side") == 1).alias("s1"), F.count_if(F.col("side") == 2).alias("s2")
    )
    return has.agg(
        F.coalesce(F.sum("s1"), F.lit(0)).alias("side_1"),
        F.coalesce(F.sum("s2"), F.lit(0)).alias("side_2"),
        F.count_if((F.col("s1") != 1) | (F.col("s2") != 1)).alias("unmatched"),
    )


def check_sides(df: DataFrame, key: str = "pair_id") -> None:
    found = pair_integrity(df, key).first()
    if found["unmatched"]:
        raise ValueError(f"pair sides do not match: {found.asDict()}")


def check_keys(left: DataFrame, right: DataFrame, what: str, key: str = "pair_id") -> None:
    """An error with counts unless both tables hold the same keys, each once; only keys are shuffled."""
    both = left.select(key, F.lit(1).alias("side")).unionByName(right.select(key, F.lit(2).alias("side")))
    found = pair_integrity(both, key).first()
    if found["unmatched"]:
        raise ValueError(
            f"pairs and {what} do not match: {found['side_1']} pairs, {found['side_2']} {what}, "
            f"{found['unmatched']} keys without exactly one of each"
        )


def pair_cosine(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("cos_sim", cosine("e1", "e2"))


def labelled_pair_features(pairs: DataFrame, labels: DataFrame, key: str = "pair_id") -> DataFrame:
    """``(key, text, label, embedding)``: ``[|e1-e2| ; e1*e2]`` with the pair's label.

    Every pair must have one label and every label a pair.
    """
    check_keys(pairs, labels, "labels", key)
    features = pairs.select(key, pair_features("e1", "e2").alias("embedding"))
    return features.join(labels.select(key, "label"), key).select(
        key, F.lit("text").alias("text"), "label", "embedding"
    )
