"""Whitening: fit five linear maps from one set of moments, apply and undo them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from embgauge.functions.kernels import share, to_lists, to_matrix
from embgauge.functions.vectors import cosine_of
from embgauge.operators.moments import Moments, moments

# Method names, and the constants added to and bounding the eigenvalues.
METHODS = ["pca", "zca", "pca_cor", "zca_cor", "cholesky"]
REGULARIZATION = 1e-5
FLOOR = float(np.finfo(np.float64).eps)
NONE = "none"


@dataclass(frozen=True)
class Whitening:
    """A fitted map: ``z = (x - mean) whiten^T`` and back ``x = z dewhiten^T + mean``."""

    method: str
    mean: np.ndarray
    whiten: np.ndarray
    dewhiten: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.whiten.T

    def invert(self, z: np.ndarray) -> np.ndarray:
        return z @ self.dewhiten.T + self.mean

    def plain(self, inverse: bool = False) -> tuple:
        """``(method, before, matrix, after)``: ``(x - before) @ matrix + after``, in arrays that any worker can read."""
        if inverse:
            return self.method, None, self.dewhiten.T, self.mean
        return self.method, self.mean, self.whiten.T, None


@dataclass(frozen=True)
class Unchanged:
    """The raw vectors, as one more method of a sweep."""

    method: str = NONE

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x

    def plain(self, inverse: bool = False) -> tuple:
        return self.method, None, None, None


def mapped(x: np.ndarray, plain: tuple) -> np.ndarray:
    """Rows under a map in plain form."""
    _, before, matrix, after = plain
    x = x if before is None else x - before
    x = x if matrix is None else x @ matrix
    return x if after is None else x + after


def principal_axes(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues descending with their axes as columns, each axis with a diagonal entry >= 0."""
    values, axes = np.linalg.eigh(symmetric)
    order = np.argsort(-values, kind="stable")
    axes = axes[:, order]
    return values[order], np.where(np.diagonal(axes) < 0, -axes, axes)


def solve_whitening(m: Moments, method: str, regularization: float = 0.0) -> Whitening:
    """One map from the moments. The d x d solution is driver work on a bounded width."""
    if method not in METHODS:
        raise ValueError(f"unknown whitening method {method!r}")
    correlated = method.endswith("_cor")
    scale = m.std if correlated else np.ones(m.width)
    values, axes = principal_axes(m.scaled_cov if correlated else m.cov)
    values = np.maximum(values + max(regularization, REGULARIZATION), FLOOR)
    if method == "cholesky":
        lower = np.linalg.cholesky((axes / values) @ axes.T)
        return Whitening(method, m.mean, lower.T, m.cov @ lower)
    stretch = np.sqrt(values)
    shrink, grow = (axes / stretch).T, axes * stretch
    if method.startswith("zca"):
        shrink, grow = axes @ shrink, grow @ axes.T
    return Whitening(method, m.mean, shrink / scale, scale[:, None] * grow)


def fit_whitening(
    df: DataFrame, methods=tuple(METHODS), column: str = "embedding", regularization: float = 0.0
) -> list[Whitening]:
    """All methods from a single scan of the table."""
    m = moments(df, column)
    return [solve_whitening(m, method, regularization) for method in methods]


def _shared(df: DataFrame, models: list, inverse: bool = False):
    maps = [model.plain(inverse) for model in models]
    size = sum(part.nbytes for one in maps for part in one[1:] if part is not None)
    return share(df.sparkSession, maps, size, "whitening maps")


def whiten(df: DataFrame, models: list, column: str = "embedding", inverse: bool = False) -> DataFrame:
    """Apply every model in one pass: a copy of each row per method, told apart by ``whitening``.

    One matrix product per Arrow batch and method, no shuffle. ``inverse`` undoes the map instead.
    """
    shared = _shared(df, models, inverse)
    others = [c for c in df.columns if c not in (column, "whitening")]
    schema = T.StructType(
        [df.schema[c] for c in others]
        + [T.StructField("whitening", T.StringType()), T.StructField(column, T.ArrayType(T.DoubleType()))]
    )

    def project(batches):
        for batch in batches:
            x = to_matrix(batch.column(batch.num_columns - 1))
            rest = batch.columns[:-1]
            for one in shared.value:
                method = pa.array([one[0]] * len(x), pa.string())
                yield pa.RecordBatch.from_arrays([*rest, method, to_lists(mapped(x, one))], names=schema.names)

    return df.select(*others, column).mapInArrow(project, schema)


def whitened_pair_cosine(pairs: DataFrame, models: list, a: str = "e1", b: str = "e2") -> DataFrame:
    """Cosine of each pair under every model: ``(others, whitening, cos_sim)``.

    The pairs are joined once; each batch is mapped and scored for all methods, so no whitened
    vector is ever shuffled or written.
    """
    shared = _shared(pairs, models)
    others = [c for c in pairs.columns if c not in (a, b)]
    schema = T.StructType(
        [pairs.schema[c] for c in others]
        + [T.StructField("whitening", T.StringType()), T.StructField("cos_sim", T.DoubleType())]
    )

    def score(batches):
        for batch in batches:
            x, y = (to_matrix(batch.column(batch.num_columns - k)) for k in (2, 1))
            rest = batch.columns[:-2]
            for one in shared.value:
                cos = pa.array(cosine_of(mapped(x, one), mapped(y, one)))
                method = pa.array([one[0]] * len(x), pa.string())
                yield pa.RecordBatch.from_arrays([*rest, method, cos], names=schema.names)

    return pairs.select(*others, a, b).mapInArrow(score, schema)


def dewhiten(df: DataFrame, models: list, column: str = "embedding") -> DataFrame:
    """Undo the maps: back to the original vectors."""
    return whiten(df, models, column, inverse=True)


MODEL_SCHEMA = "method string, mean array<double>, whiten array<array<double>>, dewhiten array<array<double>>"


def models_frame(spark: SparkSession, models: list[Whitening]) -> DataFrame:
    """Fitted maps as rows, to be stored."""
    return spark.createDataFrame(
        [(m.method, m.mean.tolist(), m.whiten.tolist(), m.dewhiten.tolist()) for m in models], MODEL_SCHEMA
    )


def read_models(df: DataFrame) -> list[Whitening]:
    """Maps from stored rows; there are as many as methods."""
    return [
        Whitening(r["method"], np.array(r["mean"]), np.array(r["whiten"]), np.array(r["dewhiten"]))
        for r in df.select("method", "mean", "whiten", "dewhiten").collect()
    ]


def whiten_pairs(df: DataFrame, method: str, column: str = "embedding") -> DataFrame:
    """Both sides of a pair table under one map fitted on the two sides stacked.

    ``df`` holds both sides as rows, told apart by ``side``; it stays in that shape.
    """
    sides = {r["side"]: r["n"] for r in df.groupBy("side").agg(F.count("*").alias("n")).collect()}
    if set(sides) != {1, 2} or sides[1] != sides[2]:
        raise ValueError(f"the two sides differ in size: {sides}")
    return whiten(df, fit_whitening(df, [method], column), column)


def pca_2d(df: DataFrame, column: str = "embedding") -> DataFrame:
    """First two principal coordinates ``(x, y)`` of every row.

    The sign of an axis is set so that its entry of largest size is positive.
    """
    m = moments(df, column)
    _, axes = principal_axes(m.cov)
    top = axes[:, :2]
    signs = np.sign(top[np.argmax(np.abs(top), axis=0), [0, 1]])
    model = Whitening("pca2d", m.mean, (top * signs).T, top * signs)
    flat = whiten(df, [model], column).drop("whitening")
    return flat.select(
        *[c for c in flat.columns if c != column], F.col(column)[0].alias("x"), F.col(column)[1].alias("y")
    )
