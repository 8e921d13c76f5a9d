"""Exact running totals and ranks over a whole table, and the correlations built on them."""

from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from embgauge.session import checkpointed, keep

# A value held by more than 1/HOT_SHARE of the rows is joined by broadcast; there are at most
# HOT_SHARE such values per column, whatever the size of the table.
HOT_SHARE = 10_000


def running_totals(df: DataFrame, order: str, amounts: list[str], by: list[str] = ()) -> DataFrame:
    """Add ``before_<amount>``: the sum over rows of the group that sort before this row.

    ``(*by, order)`` must be unique. The table is range-sorted over the cluster, each partition adds
    up its own rows, and the totals of earlier partitions are added from a table of one row per
    partition and group; no task sees a whole group, so a group with most of the rows is no
    bottleneck.
    """
    by = list(by)
    group = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    local = [f"before_{a}" for a in amounts]
    schema = T.StructType(
        [*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in local], T.StructField("_part", T.IntegerType())]
    )

    def add_up(frames):
        part = TaskContext.get().partitionId()
        last_key, carried = None, [0] * len(amounts)
        for frame in frames:
            if frame.empty:
                continue
            grouped = frame.groupby(group, sort=False, dropna=False)
            totals = grouped[amounts].cumsum()
            keys = pd.MultiIndex.from_frame(frame[group])
            opening = keys == keys[0]
            continued = last_key == keys[0]
            for amount, name, carry in zip(amounts, local, carried):
                before = totals[amount] - frame[amount]
                frame[name] = before + (opening * carry if continued else 0)
            carried = [int(frame[name].iloc[-1] + frame[amount].iloc[-1]) for amount, name in zip(amounts, local)]
            last_key = keys[-1]
            frame["_part"] = part
            yield frame

    ordered = rows.repartitionByRange(*group, order).sortWithinPartitions(*group, order)
    # Which rows share a partition is decided by sampling, so it is written down once and read twice.
    fixed = checkpointed(ordered.mapInPandas(add_up, schema))
    per_part = fixed.groupBy(*group, "_part").agg(*[F.sum(a).alias(f"_t_{a}") for a in amounts])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *group, "_part", *[F.coalesce(F.sum(f"_t_{a}").over(earlier), F.lit(0)).alias(f"_o_{a}") for a in amounts]
    )
    joined = fixed.join(F.broadcast(offsets), [*group, "_part"])
    return joined.select(
        *df.columns, *[(F.col(f"before_{a}") + F.col(f"_o_{a}")).alias(f"before_{a}") for a in amounts]
    )


def _ranked(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Average rank per distinct value from the number of rows that hold it."""
    totals = running_totals(values, column, ["n"], by)
    return totals.withColumn("avg_rank", F.col("before_n") + (F.col("n") + 1) / 2).drop("before_n")


def average_ranks(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """``(*by, column, n, avg_rank)``: rank of every distinct value, ties sharing their mean rank."""
    return _ranked(df.groupBy(*by, column).agg(F.count("*").alias("n")), column, list(by))


def with_average_rank(df: DataFrame, column: str, out: str, by: list[str] = ()) -> DataFrame:
    """Attach the average rank of ``column`` within ``by``.

    The ranks are one row per distinct value. Values that many rows share are broadcast, at most
    ``HOT_SHARE`` of them; the rest, none of which is hot, is joined by shuffle.
    """
    by = list(by)
    keys = [*by, column]
    values = keep(df.groupBy(*keys).agg(F.count("*").alias("n")))
    rows = values.agg(F.sum("n").alias("rows")).first()["rows"] or 0
    ranks = keep(_ranked(values, column, by))
    is_hot = F.col("n") > rows / HOT_SHARE
    hot = ranks.where(is_hot).select(*keys, F.col("avg_rank").alias("_hot"))
    cold = ranks.where(~is_hot).select(*keys, F.col("avg_rank").alias(out))
    tagged = df.join(F.broadcast(hot), keys, "left")
    in_hot = tagged.where(F.col("_hot").isNotNull()).withColumnRenamed("_hot", out)
    in_cold = tagged.where(F.col("_hot").isNull()).drop("_hot").join(cold, keys)
    return in_hot.unionByName(in_cold)


def pearson(df: DataFrame, a: str, b: str, by: list[str] = (), out: str = "pearson") -> DataFrame:
    return df.groupBy(*by).agg(F.corr(a, b).alias(out))


def spearman(df: DataFrame, a: str, b: str, by: list[str] = (), out: str = "spearman") -> DataFrame:
    """Rank correlation with average ranks for ties."""
    narrow = df.select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"))
    ranked = with_average_rank(narrow, "_a", "_ra", by)
    ranked = with_average_rank(ranked, "_b", "_rb", by)
    return ranked.groupBy(*by).agg(F.corr("_ra", "_rb").alias(out))


def anisotropy(df: DataFrame, column: str = "cos_sim", by: list[str] = (), out: str = "anisotropy") -> DataFrame:
    """Mean cosine over the pairs."""
    return df.groupBy(*by).agg(F.avg(column).alias(out))
