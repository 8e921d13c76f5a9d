"""Exact Euclidean silhouette.

The measure needs the summed distance of every row to every cluster, so it is quadratic by
definition. Rows are put into blocks of bounded size by a hash of their key, whatever cluster they
are in. Every pair of blocks is one small task that computes its distances with BLAS and emits, per
row, the distance sums per cluster; the sums are added up by row. Distances are computed a tile at a
time and never emitted, and no task holds more than two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embgauge.functions.kernels import to_lists, to_matrix
from embgauge.functions.vectors import sum_vector
from embgauge.session import parallelism

BLOCK_BYTES = 32 << 20
MIN_BLOCK_ROWS = 512
MAX_CLUSTERS = 10_000

# Rows of each side whose distances are computed at a time: their matrix stays in the processor's cache.
TILE = 512

# Up to so many clusters a run, sums by cluster are a product with the matrix of members; beyond, rows are sorted.
MATRIX_CLUSTERS = 64


def _block_count(rows: int, width: int, tasks: int, block_rows: int | None, codes: int = 1) -> int:
    """Blocks small enough for a task, and enough of them to give every core a pair of blocks.

    A block's vectors and its sums per cluster both fit. Of b blocks b * (b + 1) / 2 pairs are tasks, and a row is sent
    to b of them, about the root of twice their number.
    """
    if block_rows is not None:
        return max(1, math.ceil(rows / block_rows))
    fits = math.ceil(rows * max(width, codes) * 8 / BLOCK_BYTES)
    busy = min(math.ceil(math.sqrt(2 * tasks)), math.ceil(rows / MIN_BLOCK_ROWS))
    return max(1, fits, busy)


def silhouette_samples(
    df: DataFrame, clusters: str = "clusters", key: str = "row_id", column: str = "embedding", block_rows: int | None = None
) -> DataFrame:
    """``(key, run, cluster, silhouette)`` for each clustering of the rows.

    ``clusters`` is an array of cluster numbers, one per clustering ("run"); all runs share the
    distances. A row alone in its cluster scores 0.
    """
    rows = df.select(
        F.col(key).cast("bigint").alias("id"),
        F.col(clusters).cast("array<int>").alias("clusters"),
        F.col(column).alias("v"),
    )
    sizes = _cluster_sizes(rows)
    runs = 1 + max(run for run, _ in sizes)
    codes = {pair: i for i, pair in enumerate(sorted(sizes))}
    counts = np.array([sizes[pair] for pair in sorted(sizes)], dtype=np.float64)
    run_of = np.array([run for run, _ in sorted(sizes)])
    total = int(counts[run_of == 0].sum())
    width = df.select(F.size(column)).first()[0]
    blocks = _block_count(total, width, parallelism(df.sparkSession), block_rows, len(codes))

    sums = _distance_sums(rows, blocks, codes)
    scored = sums.select("id", "clusters", "sums").mapInArrow(
        _scorer(codes, counts, run_of, runs), "id bigint, run int, cluster int, silhouette double"
    )
    return scored.withColumnRenamed("id", key)


def silhouette(df: DataFrame, clusters: str = "clusters", **options) -> DataFrame:
    """``(run, silhouette)``: mean over rows, as a fraction."""
    return silhouette_samples(df, clusters, **options).groupBy("run").agg(F.avg("silhouette").alias("silhouette"))


def _cluster_sizes(rows: DataFrame) -> dict:
    counted = rows.select(F.posexplode("clusters").alias("run", "cluster")).groupBy("run", "cluster").count()
    found = counted.limit(MAX_CLUSTERS + 1).collect()
    if not found:
        raise ValueError("no rows")
    if len(found) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    return {(r["run"], r["cluster"]): r["count"] for r in found}


def _distance_sums(rows: DataFrame, blocks: int, codes: dict) -> DataFrame:
    """``(id, clusters, sums)``: distance of each row to all rows of each (run, cluster) code."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    placed = rows.withColumn("block", block).withColumn("other", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cells = placed.select((low.cast("bigint") * blocks + high).alias("cell"), "block", "id", "clusters", "v")
    cell_count = blocks * (blocks + 1) // 2
    spread = cells.repartition(min(2 * cell_count, 20_000), "cell")

    def one_cell(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        low_block = cell // blocks
        at = table.column("block").to_numpy()
        left = table.filter(pa.array(at == low_block))
        right = left if cell % blocks == low_block else table.filter(pa.array(at != low_block))
        x, y = to_matrix(left.column("v")), to_matrix(right.column("v"))
        if not len(x) or not len(y):
            return _sum_table([], np.zeros((0, len(codes))))
        center = x.mean(axis=0)
        x, y = x - center, y - center
        sum_x, sum_y = _Sums(left, codes), _Sums(right, codes)
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        to_right = np.zeros((len(x), len(codes)))
        to_left = np.zeros((len(y), len(codes)))
        y = 2.0 * y
        for rows in _tiles(len(x)):
            for others in _tiles(len(y)):
                gap = np.add.outer(xx[rows], yy[others])
                gap -= x[rows] @ y[others].T
                distance = np.sqrt(np.maximum(gap, 0.0, out=gap), out=gap)
                if left is right and rows == others:
                    np.fill_diagonal(distance, 0.0)
                sum_y.add(distance, to_right[rows], others)
                if left is not right:
                    sum_x.add(distance.T, to_left[others], rows)
        if left is right:
            return _sum_table([left], to_right)
        return _sum_table([left, right], np.vstack([to_right, to_left]))

    partial = spread.groupBy("cell").applyInArrow(one_cell, "id bigint, clusters array<int>, sums array<double>")
    return partial.groupBy("id").agg(F.any_value("clusters").alias("clusters"), sum_vector("sums").alias("sums"))


def _sum_table(sides: list, sums: np.ndarray) -> pa.Table:
    if not sides:
        empty = [pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(empty, names=["id", "clusters", "sums"])
    stacked = pa.concat_tables([s.select(["id", "clusters"]) for s in sides]).combine_chunks()
    return stacked.append_column("sums", pa.chunked_array([to_lists(sums)]))


def _codes_of(clusters: pa.Array, codes: dict) -> np.ndarray:
    """Rows x runs matrix of (run, cluster) codes."""
    numbers = to_matrix(clusters).astype(np.int64)
    out = np.empty_like(numbers)
    for run in range(numbers.shape[1]):
        found, back = np.unique(numbers[:, run], return_inverse=True)
        out[:, run] = np.array([codes[(run, int(c))] for c in found])[back]
    return out


def _tiles(rows: int):
    return [slice(start, min(start + TILE, rows)) for start in range(0, rows, TILE)]


class _Sums:
    """Sums of distances over the rows of each code."""

    def __init__(self, side: pa.Table, codes: dict):
        self.member, self.marks = _codes_of(side.column("clusters"), codes), None
        if len(codes) <= MATRIX_CLUSTERS * self.member.shape[1]:
            self.marks = np.zeros((len(self.member), len(codes)))
            np.put_along_axis(self.marks, self.member, 1.0, axis=1)

    def add(self, distance: np.ndarray, out: np.ndarray, part: slice) -> None:
        """Add the sums over the columns of ``distance``, which are the rows ``part`` of the side, to ``out`` by code."""
        if self.marks is not None:
            out += distance @ self.marks[part]
            return
        for member in self.member[part].T:
            order = np.argsort(member, kind="stable")
            member = member[order]
            first = np.flatnonzero(np.append(True, member[1:] != member[:-1]))
            out[:, member[first]] += np.add.reduceat(distance[:, order], first, axis=1)


def _scorer(codes: dict, counts: np.ndarray, run_of: np.ndarray, runs: int):
    names = {code: cluster for (_, cluster), code in codes.items()}

    def score(batches):
        for batch in batches:
            ids, clusters, sums = batch.columns
            member, total = _codes_of(clusters, codes), to_matrix(sums)
            row = np.arange(len(total))
            for run in range(runs):
                own = member[:, run]
                mean = np.where(run_of == run, total / counts, np.inf)
                size = counts[own]
                inside = total[row, own] / np.maximum(size - 1, 1)
                mean[row, own] = np.inf
                nearest = mean.min(axis=1)
                widest = np.maximum(inside, nearest)
                usable = (size > 1) & np.isfinite(nearest) & (widest > 0)
                value = np.where(usable, (nearest - inside) / np.where(usable, widest, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.full(len(row), run, dtype=np.int32)),
                        pa.array(np.array([names[int(c)] for c in own], dtype=np.int32)),
                        pa.array(value),
                    ],
                    names=["id", "run", "cluster", "silhouette"],
                )

    return score
