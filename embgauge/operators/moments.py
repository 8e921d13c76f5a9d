"""Mean, covariance and isotropy of an embedding column, from one scan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from embgauge.functions.kernels import MAX_BROADCAST_BYTES, MAX_WIDTH, row_chunks, to_lists, to_matrix
from embgauge.functions.vectors import mean_vector, subtract, sum_vector
from embgauge.session import parallelism


@dataclass(frozen=True)
class Moments:
    """Row count, mean and covariance (divisor n-1) of a vector column."""

    n: int
    mean: np.ndarray
    cov: np.ndarray

    @property
    def width(self) -> int:
        return len(self.mean)

    @property
    def std(self) -> np.ndarray:
        """Population standard deviation (divisor n)."""
        return np.sqrt(np.clip(np.diagonal(self.cov), 0.0, None) * (self.n - 1) / self.n)

    @property
    def scaled_cov(self) -> np.ndarray:
        """Covariance over the outer product of the population deviations.

        The two divisors differ, so its diagonal is n/(n-1). A constant dimension has no scale and
        is an error that names it.
        """
        sd = self.std
        flat = np.flatnonzero(sd <= 1e-12 * max(1.0, float(np.abs(self.mean).max())))
        if len(flat):
            raise ValueError(f"constant dimension(s) {flat.tolist()} cannot be scaled")
        return self.cov / np.outer(sd, sd)

    @property
    def isoscore(self) -> float:
        return isoscore_of(self.cov)


def isoscore_of(cov: np.ndarray) -> float:
    """Isotropy in [0, 1] from the covariance entries alone (closed form, no eigenvalues)."""
    d = len(cov)
    if d < 2:
        raise ValueError("isotropy needs at least two dimensions")
    norm = float((cov * cov).sum())
    if norm == 0.0:
        raise ValueError("isotropy of a constant table is undefined")
    return (float(np.trace(cov)) ** 2 / norm - 1.0) / (d - 1)


#: Columns of a tile of the Gram matrix.
TILE = 256


def _gram_tiles(df: DataFrame, column: str, origin: np.ndarray, by: str | None = None) -> DataFrame:
    """Rows ``(part, i, j, g)``: tiles of the upper triangle of the Gram matrix of ``[1, x - origin]``, by block pair, for
    each value of the integer column ``by`` (without it, part 0).

    Splits are merged before anything is shuffled: there are as many tasks as the cluster has cores, each folds the
    rows of its splits with BLAS, block pair by block pair, and emits one set of tiles. The shuffle adds up the tiles,
    equally large keys that spread over the cluster; what it moves follows the cores, not the splits. A task holds
    half a matrix per part.
    """
    width = len(origin) + 1
    cuts = [slice(at, min(at + TILE, width)) for at in range(0, width, TILE)]

    def fold(batches):
        tiles = {}
        for batch in batches:
            parts, vectors = batch.column(0).to_numpy(), batch.column(1)
            for rows in row_chunks(len(vectors), width):
                x = to_matrix(vectors.slice(rows.start, rows.stop - rows.start), width - 1) - origin
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                found = np.unique(parts[rows])
                for part in found.tolist():
                    y = x if len(found) == 1 else x[parts[rows] == part]
                    for i, left in enumerate(cuts):
                        for j in range(i, len(cuts)):
                            g = y[:, left].T @ y[:, cuts[j]]
                            if (part, i, j) in tiles:
                                tiles[part, i, j] += g
                            else:
                                tiles[part, i, j] = g
        for key, g in tiles.items():
            place = [pa.array([n], pa.int32()) for n in key]
            yield pa.RecordBatch.from_arrays([*place, to_lists(g.reshape(1, -1))], names=["part", "i", "j", "g"])

    group = F.lit(0) if by is None else F.col(by).cast("int")
    merged = df.select(group.alias("part"), column).coalesce(parallelism(df.sparkSession))
    partial = merged.mapInArrow(fold, "part int, i int, j int, g array<double>")
    return partial.groupBy("part", "i", "j").agg(sum_vector("g").alias("g"))


def grams(df: DataFrame, column: str, origin: np.ndarray, by: str | None = None) -> dict[int, np.ndarray]:
    """Sums of products of ``[1, x - origin]`` for each value of ``by``, from one scan."""
    width = len(origin) + 1
    out = {}
    tiles = _gram_tiles(df, column, origin, by).toArrow()
    for part, i, j, g in zip(*(tiles[c] for c in ("part", "i", "j", "g"))):
        left, right = (slice(n.as_py() * TILE, min(n.as_py() * TILE + TILE, width)) for n in (i, j))
        tile = g.values.to_numpy().reshape(left.stop - left.start, -1)
        whole = out.setdefault(part.as_py(), np.zeros((width, width)))
        whole[left, right] = tile
        whole[right, left] = tile.T
    return out


def gram(df: DataFrame, column: str, origin: np.ndarray) -> np.ndarray:
    """Sums of products of ``[1, x - origin]``, from one scan."""
    return grams(df, column, origin).get(0, np.zeros((len(origin) + 1,) * 2))


def moments(df: DataFrame, column: str = "embedding") -> Moments:
    """Count, mean and covariance in one pass.

    The data are shifted by one of their own rows, which keeps the one-pass sums free of
    cancellation. Only the (d+1)^2 sums reach the driver; d is bounded.
    """
    origin = _origin(df, column)
    return _moments_of(gram(df, column, origin), origin)


def moments_without(df: DataFrame, by: str = "fold", column: str = "embedding") -> dict[int, Moments]:
    """For each value of the integer column ``by`` the moments of all rows of other values.

    One scan adds up each value's rows; the sums of the others are added, not subtracted from a total, so nothing
    cancels. As many matrices as values reach the driver; where they are too large for that, each value has its own scan.
    """
    origin = _origin(df, column)
    parts = sorted(r[0] for r in df.select(F.col(by).cast("int")).distinct().collect())
    if len(parts) * (len(origin) + 1) ** 2 * 8 > MAX_BROADCAST_BYTES:
        return {part: moments(df.where(F.col(by) != part), column) for part in parts}
    sums = grams(df, column, origin, by)
    return {part: _moments_of(sum(sums[other] for other in parts if other != part), origin) for part in parts}


def _origin(df: DataFrame, column: str) -> np.ndarray:
    first = df.select(F.col(column).alias("v")).first()
    if first is None or first.v is None:
        raise ValueError("moments need at least one vector")
    origin = np.asarray(first.v, dtype=np.float64)
    if len(origin) > MAX_WIDTH:
        raise ValueError(f"embedding width {len(origin)} is above {MAX_WIDTH}")
    return origin


def _moments_of(sums_of: np.ndarray, origin: np.ndarray) -> Moments:
    if not np.isfinite(sums_of).all():
        raise ValueError("embedding column holds NaN or infinite entries")
    n = int(round(sums_of[0, 0]))
    sums = sums_of[0, 1:]
    cov = (sums_of[1:, 1:] - np.outer(sums, sums) / n) / max(n - 1, 1)
    return Moments(n, origin + sums / n, (cov + cov.T) / 2)


def dim_mean(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``(dim, value)``: mean per dimension."""
    means = df.agg(mean_vector(column).alias("m"))
    return means.select(F.posexplode("m").alias("dim", "value"))


def center(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors less the mean vector, which enters as a one-value subquery."""
    mean = df.agg(mean_vector(column)).scalar()
    return df.withColumn("_mean", mean).withColumn(column, subtract(column, "_mean")).drop("_mean")


def vector_frame(spark: SparkSession, vector: np.ndarray) -> DataFrame:
    """``(dim, value)`` of a small model vector."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(vector)], "dim int, value double")


def matrix_frame(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """``(i, j, value)`` of a small model matrix."""
    rows = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(matrix)], "i int, g array<double>"
    )
    return rows.select("i", F.posexplode("g").alias("j", "value"))
