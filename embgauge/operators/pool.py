"""Token vectors to one vector per text.

The token table is ``(row_id, layer, token_pos, embedding)``. Every strategy is one aggregation by
text with partial aggregation on the map side, so what is shuffled is one vector per text and
input partition, whatever the number of tokens of a text. Vectors are aggregated entry by entry:
buffers of plain numbers stay in Spark's hash aggregation, while one buffer object per text would
make it sort, and spill, all tokens. ``width`` is the vectors' width, looked up if it is not given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embgauge.functions.vectors import mean_by_entry, vector_at_most

# Fixed value: the layer pooled by default.
DEFAULT_LAYER = 32


def _last_layer(tokens: DataFrame, layers: int | None) -> Column:
    """Number of the last layer: known from the model, or else looked up in the table."""
    return tokens.agg(F.max("layer")).scalar() if layers is None else F.lit(layers - 1)


def _width(tokens: DataFrame, width: int | None) -> int:
    """Width of the vectors: known from the model, or else looked up in the table; 0 for an empty one."""
    if width is not None:
        return width
    first = tokens.select(F.size("embedding").alias("d")).where("d >= 0").first()
    return first["d"] if first else 0


def mean_pool(tokens: DataFrame, key: str = "row_id", masked: bool = False, width: int | None = None) -> DataFrame:
    """Mean over token positions; ``masked`` leaves out positions whose ``attended`` is false."""
    rows = tokens.where(F.col("attended")) if masked else tokens
    return rows.groupBy(key).agg(mean_by_entry("embedding", _width(tokens, width)).alias("embedding"))


def last_token(
    tokens: DataFrame, key: str = "row_id", layers: int | None = None, width: int | None = None
) -> DataFrame:
    """Vector of the last position of the last layer."""
    last = tokens.where(F.col("layer") == _last_layer(tokens, layers))
    vector = vector_at_most("embedding", "token_pos", _width(tokens, width))
    return last.groupBy(key).agg(vector.alias("embedding"))


def pool(
    tokens: DataFrame,
    strategy: str = "layer",
    pooling=DEFAULT_LAYER,
    key: str = "row_id",
    masked: bool = False,
    layers: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """``layer``: one layer; ``range``: mean of the last k layers; ``pair``: sum of two layers.

    Each is followed by the mean over tokens. As all layers hold the same positions, the mean over
    layers and then tokens is one mean, and the sum of two layers is twice their common mean.
    """
    whole = isinstance(pooling, int) and not isinstance(pooling, bool)
    if strategy == "layer" and whole:
        return mean_pool(tokens.where(F.col("layer") == pooling), key, masked, width)
    if strategy == "range" and whole:
        return mean_pool(tokens.where(F.col("layer") > _last_layer(tokens, layers) - pooling), key, masked, width)
    if strategy == "pair" and isinstance(pooling, tuple) and len(pooling) == 2:
        rows = tokens.where(F.col("layer").isin(*pooling))
        rows = rows.where(F.col("attended")) if masked else rows
        both = (F.min("layer") == min(pooling)) & (F.max("layer") == max(pooling))
        found = rows.groupBy(key).agg(mean_by_entry("embedding", _width(tokens, width)).alias("m"), both.alias("both"))
        twice = F.transform("m", lambda x: 2 * x)
        missing = F.raise_error(f"a text lacks one of the layers {pooling}").cast("array<double>")
        return found.select(key, F.when(F.col("both"), twice).otherwise(missing).alias("embedding"))
    raise ValueError(f"unknown pooling: {strategy!r} with {pooling!r}")
