"""Seeded splits whose sizes are exact: stratified folds, nested folds, hold-out.

Rows are ordered by ``md5(seed:row_id)`` and cut at exact ranks. Finding the cut rows takes a
count per hash prefix and a look into the few prefixes that hold a cut; giving every row its fold
is then a comparison with those cut rows. Wide rows are never shuffled or sorted for it, and a
class with most of the rows is spread over all hash prefixes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# 4096 prefixes per class: the rows looked into are a few 4096ths of the class.
PREFIX_DIGITS = 3
MAX_STRATA = 100_000


def shuffle_key(seed: int, key: str = "row_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _fold_ends(n: Column, k: int) -> Column:
    """Last rank of folds 0..k-2 when n rows are dealt into k folds."""
    return F.array(*[F.floor(n * f / k) for f in range(1, k)])


def rank_cuts(df: DataFrame, strata: list[str], ranks, seed: int, key: str = "row_id") -> DataFrame:
    """``(*strata, empty, cuts)``: the rows that stand at the wanted ranks of each stratum.

    ``ranks`` maps a stratum's row count to an array of 1-based ranks; rank 0 has no row and is
    counted in ``empty``. A row's position among the cuts is ``empty`` plus the cuts sorting
    before it.
    """
    keyed = df.select(*strata, F.col(key).alias("id"), shuffle_key(seed, key).alias("h")).withColumn(
        "prefix", F.substring("h", 1, PREFIX_DIGITS)
    )
    whole = Window.partitionBy(*strata)
    earlier = whole.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        keyed.groupBy(*strata, "prefix")
        .agg(F.count("*").alias("c"))
        .withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
        .withColumn("n", F.sum("c").over(whole))
    )
    inside = lambda t: (t > F.col("before")) & (t <= F.col("before") + F.col("c"))
    wanted = counted.select(
        *strata, "prefix", "before", F.explode(F.filter(ranks(F.col("n")), inside)).alias("rank")
    )
    in_prefix = Window.partitionBy(*strata, "prefix").orderBy("h", "id")
    near = keyed.join(wanted.select(*strata, "prefix").distinct(), [*strata, "prefix"], "left_semi")
    numbered = near.withColumn("at", F.row_number().over(in_prefix))
    found = (
        numbered.join(wanted, [*strata, "prefix"])
        .where(F.col("at") == F.col("rank") - F.col("before"))
        .groupBy(*strata)
        .agg(F.sort_array(F.collect_list(F.struct("h", "id"))).alias("cuts"))
    )
    empty = counted.groupBy(*strata).agg(
        F.max(F.size(F.filter(ranks(F.col("n")), lambda t: t == 0))).alias("empty")
    )
    none = F.array().cast("array<struct<h:string,id:bigint>>")
    return empty.join(found, strata, "left").select(
        *strata, "empty", F.coalesce(F.col("cuts").cast("array<struct<h:string,id:bigint>>"), none).alias("cuts")
    )


def _bounded(cuts: DataFrame) -> DataFrame:
    """The cut table, fetched once and checked to be small enough to send to every executor.

    Fetching it fixes the cuts and keeps the plans of everything built on the folds short.
    """
    rows = cuts.limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata; the label is no class label")
    return F.broadcast(cuts.sparkSession.createDataFrame(rows, cuts.schema))


def _position(cut: Column, own: Column, k: int) -> Column:
    """Fold of a row: the cuts before it. Spelled out per cut, so it stays generated code."""
    passed = [F.coalesce(F.get(cut["cuts"], F.lit(i)) < own, F.lit(False)).cast("int") for i in range(k - 1)]
    return reduce(lambda a, b: a + b, passed, cut["empty"]).cast("int")


def _with_sort_key(df: DataFrame, seed: int, key: str) -> DataFrame:
    own = F.struct(shuffle_key(seed, key).alias("h"), F.col(key).cast("bigint").alias("id"))
    return df.withColumn("_own", own)


def _labelled(df: DataFrame, label: str) -> DataFrame:
    """A row without a label belongs to no class; it must not vanish in the join by class."""
    return df.withColumn(label, F.coalesce(label, F.raise_error(f"row without a {label}").cast(df.schema[label].dataType)))


def stratified_folds(
    df: DataFrame, k: int = 5, seed: int = 0, label: str = "label", key: str = "row_id", out: str = "fold"
) -> DataFrame:
    """Add ``fold`` in 0..k-1; within each class fold sizes differ by at most one."""
    if k < 2:
        raise ValueError("k-fold needs k >= 2")
    df = _labelled(df, label)
    cuts = rank_cuts(df, [label], lambda n: _fold_ends(n, k), seed, key)
    placed = _with_sort_key(df, seed, key).join(_bounded(cuts.select(label, F.struct("empty", "cuts").alias("_cut"))), label)
    return placed.withColumn(out, _position(F.col("_cut"), F.col("_own"), k)).select(*df.columns, out)


def nested_folds(
    df: DataFrame, k: int = 5, seed: int = 0, label: str = "label", key: str = "row_id"
) -> DataFrame:
    """Add ``fold`` and ``inner``: entry o is the row's inner fold when fold o is held out.

    ``inner[fold]`` is null, as a held-out row is in no inner fold. Inner folds are stratified
    within the remaining rows of each outer fold, in a shuffle order of their own.
    """
    outer = stratified_folds(df, k, seed, label, key)
    inner_seed = seed + 1
    narrow = outer.select(label, key, "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("outer"))
    narrow = narrow.where(F.col("outer") != F.col("fold"))
    cuts = rank_cuts(narrow, ["outer", label], lambda n: _fold_ends(n, k), inner_seed, key)
    names = [f"_cut{o}" for o in range(k)]
    per_label = cuts.groupBy(label).pivot("outer", list(range(k))).agg(F.first(F.struct("empty", "cuts")))
    placed = _with_sort_key(outer, inner_seed, key).join(_bounded(per_label.toDF(label, *names)), label)
    inner = [
        F.when(F.col("fold") != o, _position(F.col(name), F.col("_own"), k)) for o, name in enumerate(names)
    ]
    return placed.withColumn("inner", F.array(*inner)).select(*outer.columns, "inner")


def holdout(df: DataFrame, share: float = 0.05, seed: int = 0, key: str = "row_id", out: str = "dev") -> DataFrame:
    """Add ``dev``: true for exactly ``floor(share * n)`` rows."""
    if not 0 < share < 1:
        raise ValueError("share must be between 0 and 1")
    whole = df.withColumn("_all", F.lit(0))
    cuts = rank_cuts(whole, ["_all"], lambda n: F.array(F.floor(n * F.lit(share))), seed, key)
    placed = _with_sort_key(whole, seed, key).join(_bounded(cuts), "_all")
    return placed.withColumn(out, (F.col("empty") == 0) & (F.col("_own") <= F.get("cuts", F.lit(0)))).select(
        *df.columns, out
    )
