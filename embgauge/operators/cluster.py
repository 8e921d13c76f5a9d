"""k-means in three forms: mini-batch over several runs, MLlib full batch, and fixed-start Lloyd."""

from __future__ import annotations

import math
import pickle
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from embgauge.functions.kernels import share as share_model
from embgauge.functions.kernels import to_lists, to_matrix
from embgauge.functions.vectors import as_doubles, sum_vector
from embgauge.operators.folds import shuffle_key
from embgauge.session import discard, stored

# Runs per setting, and batch sizes for raw and whitened vectors.
RUNS = 5
BATCH_RAW = 500
BATCH_WHITENED = 5000

# Passes over the table, if the centers do not settle before; rows for the start centers, per center.
PASSES = 100
START_ROWS = 10

# Steps without a better smoothed inertia that end a run, the least weight of a batch in it, so that steps
# do not follow the rows, and the share of the rows of the fullest center below which a center is drawn anew.
PATIENCE = 10
LEAST_WEIGHT = 0.1
STARVED = 0.01

# Steps that a task takes at a time, if their rows fit in so many bytes.
SLICE_STEPS = 64
SLICE_BYTES = 64 << 20


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    gap = (x * x).sum(axis=1)[:, None] + (centers * centers).sum(axis=1)[None, :] - 2.0 * (x @ centers.T)
    return np.maximum(gap, 0.0)


def assign(df: DataFrame, centers: np.ndarray, column: str = "embedding", out: str = "clusters") -> DataFrame:
    """Add the nearest center per run; ``centers`` is runs x k x d and small."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    others = df.columns
    shared = share_model(df.sparkSession, centers, centers.nbytes, "cluster centers")

    def nearest(batches):
        for batch in batches:
            x = to_matrix(batch.column(batch.num_columns - 1))
            picks = np.stack([squared_distances(x, c).argmin(axis=1) for c in shared.value], axis=1).astype(np.float64)
            chosen = to_lists(picks).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], chosen], names=schema.names)

    return df.select(*others, F.col(column).alias("_v")).mapInArrow(nearest, schema)


def first_rows(df: DataFrame, k: int, seed: int = 0, key: str = "row_id", column: str = "embedding") -> np.ndarray:
    """Start centers: the k rows that come first in seeded hash order."""
    top = df.select(F.col(column).alias("v"), shuffle_key(seed, key).alias("h"), key).orderBy("h", key).limit(k)
    return np.array([r["v"] for r in top.collect()], dtype=np.float64)


def lloyd(df: DataFrame, centers: np.ndarray, iterations: int, column: str = "embedding") -> np.ndarray:
    """Full-batch k-means from given centers (runs x k x d).

    An iteration is one scan: every task sums its rows per center and the shuffle adds up one
    partial sum per task and center. All runs share the scan. A center without rows stays.
    """
    centers = np.array(centers, dtype=np.float64)
    runs, k, width = centers.shape
    vectors = df.select(F.col(column).alias("v"))

    def step(current):
        shared = share_model(df.sparkSession, current, current.nbytes, "cluster centers")

        def fold(batches):
            sums, sizes = np.zeros((runs * k, width)), np.zeros(runs * k, dtype=np.int64)
            for batch in batches:
                x = to_matrix(batch.column(0), width)
                for run in range(runs):
                    pick = squared_distances(x, shared.value[run]).argmin(axis=1)
                    marks = np.zeros((len(x), k))
                    marks[np.arange(len(x)), pick] = 1.0
                    sums[run * k : (run + 1) * k] += marks.T @ x
                    sizes[run * k : (run + 1) * k] += np.bincount(pick, minlength=k)
            held = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.astype(np.int32)), pa.array(sizes[held]), to_lists(sums[held])], names=["c", "n", "s"]
            )

        partial = vectors.mapInArrow(fold, "c int, n bigint, s array<double>")
        found = partial.groupBy("c").agg(F.sum("n").alias("n"), sum_vector("s").alias("s")).collect()
        shared.unpersist()
        return found

    for _ in range(iterations):
        moved = centers.copy()
        for row in step(centers):
            moved[row["c"] // k, row["c"] % k] = np.asarray(row["s"]) / row["n"]
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def kmeans(df: DataFrame, k: int, seed: int = 0, max_iter: int = 20, column: str = "embedding") -> DataFrame:
    """Full-batch k-means by MLlib; adds ``cluster``."""
    featured = df.withColumn("_f", array_to_vector(as_doubles(column)))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="cluster").fit(featured)
    return model.transform(featured).drop("_f")


# ------------------------------------------------------------------ mini-batch


def spread_centers(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """Start centers far from each other: each new one drawn by squared distance to the nearest."""
    centers = [x[draw.integers(len(x))]]
    nearest = squared_distances(x, centers[0][None])[:, 0]
    while len(centers) < k:
        total = nearest.sum()
        pick = draw.integers(len(x)) if total <= 0 else draw.choice(len(x), p=nearest / total)
        centers.append(x[pick])
        nearest = np.minimum(nearest, squared_distances(x, x[pick][None])[:, 0])
    return np.array(centers)


def steps_of_a_pass(share: float) -> int:
    return max(math.ceil(1 / share - 1e-9), 1)


def batch_number(turn: int, steps: int, run: int, seed: int, key: str = "row_id"):
    """The step, of ``steps``, in which a row is part of a run's batch: a hash of seed, pass and key."""
    if steps == 1:
        return F.lit(0)
    digest = F.md5(F.concat_ws(":", F.lit(str(run + seed)), F.lit(str(turn)), F.col(key).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % steps).cast("int")


def batch_of(step: int, share: float, runs: int, seed: int, key: str = "row_id"):
    """The runs whose batch of this step a row belongs to. A row is in one batch of each pass."""
    steps = steps_of_a_pass(share)
    member = [batch_number(step // steps, steps, run, seed, key) == step % steps for run in range(runs)]
    return F.filter(F.array(*[F.when(m, F.lit(run)) for run, m in enumerate(member)]), lambda run: run.isNotNull())


@dataclass
class BatchRun:
    """A mini-batch run between two steps."""

    centers: np.ndarray
    seen: np.ndarray
    before: np.ndarray
    steps: int = 0
    since: int = 0
    smooth: float | None = None
    best: float | None = None
    stale: int = 0
    settled: bool = False

    def step(self, x: np.ndarray, share: float) -> None:
        """Move every center by the batch's share of the rows it has seen, and judge the batch's inertia.

        The inertia is smoothed over batches, with a weight of twice the batch's share of the table, and of
        ``LEAST_WEIGHT`` at least. A run is settled after ``PATIENCE`` steps without a better one. Centers that have seen next to no rows go to the batch's rows that
        are farthest from their centers; this is looked at when a center has none, and every ten rows a center.
        """
        self.steps += 1
        if not len(x):
            return
        gaps = squared_distances(x, self.centers)
        pick = gaps.argmin(axis=1)
        nearest = gaps[np.arange(len(x)), pick]
        size = np.bincount(pick, minlength=len(self.centers))
        sums = np.zeros_like(self.centers)
        np.add.at(sums, pick, x)
        self.seen = self.seen + size
        held = size > 0
        self.centers = self.centers.copy()
        self.centers[held] += (sums[held] - size[held, None] * self.centers[held]) / self.seen[held, None]
        self._redraw(x, nearest)
        weight = min(max(2 * share, LEAST_WEIGHT), 1.0)
        inertia = float(nearest.mean())
        self.smooth = inertia if self.smooth is None else self.smooth + weight * (inertia - self.smooth)
        if self.best is None or self.smooth < self.best:
            self.best, self.stale = self.smooth, 0
        else:
            self.stale += 1
        self.settled = self.stale >= PATIENCE

    def _redraw(self, x: np.ndarray, nearest: np.ndarray) -> None:
        self.since += len(x)
        if (self.seen > 0).all() and self.since < 10 * len(self.centers):
            return
        self.since = 0
        starved = np.flatnonzero(self.seen < STARVED * self.seen.max())[: len(x) // 2]
        if len(starved):
            self.centers[starved] = x[np.argsort(-nearest, kind="stable")[: len(starved)]]
            rest = np.delete(self.seen, starved)
            self.seen[starved] = rest.min() if len(rest) else 1

    def end_pass(self, least_move: float) -> None:
        """A pass that moved no center by ``least_move``, a squared distance, settles the run."""
        self.settled = self.settled or ((self.centers - self.before) ** 2).sum(axis=1).max() < least_move
        self.before = self.centers


def _slices(df: DataFrame, active: list, first: int, last: int, taken: int, per_pass: int, seed: int, key: str, column: str):
    """``(slice, run, id, v, steps)``: rows of the steps from ``first`` to before ``last``, ``taken`` steps in a slice."""
    turns = range(first // per_pass, (last - 1) // per_pass + 1)

    def steps_of(run):
        at = [F.lit(turn * per_pass) + batch_number(turn, per_pass, run, seed, key) for turn in turns]
        return F.filter(F.array(*at), lambda step: (step >= first) & (step < last))

    each = [F.struct(F.lit(run).alias("run"), steps_of(run).alias("steps")) for run in active]
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(column).alias("v"), F.inline(F.array(*each)))
    number = lambda step: F.floor((step - first) / taken).cast("int")
    cut = F.explode(F.array_distinct(F.transform("steps", number)))
    rows = rows.where(F.size("steps") > 0).withColumn("slice", cut)
    own = F.filter("steps", lambda step: number(step) == F.col("slice"))
    return rows.select("slice", "run", "id", "v", own.alias("steps"))


def _advanced(rows: DataFrame, states: list, first: int, last: int, per_pass: int, share: float, least_move: float):
    """The runs after the steps from ``first`` to before ``last``, each in a task of its own."""
    k, width = states[0].centers.shape
    sent = share_model(rows.sparkSession, states, len(states) * states[0].centers.nbytes * 2, "cluster centers")
    schema = "run int, state binary"

    def advance(table: pa.Table) -> pa.Table:
        run = table.column("run")[0].as_py()
        state = sent.value[run]
        table = table.sort_by("id")
        x, lists = to_matrix(table.column("v"), width), table.column("steps").combine_chunks()
        row = np.repeat(np.arange(len(x)), np.diff(np.asarray(lists.offsets)))
        member = lists.flatten().to_numpy()
        for step in range(first, last):
            if state.settled:
                break
            state.step(x[row[member == step]], share)
            if (step + 1) % per_pass == 0:
                state.end_pass(least_move)
        return pa.table({"run": pa.array([run], pa.int32()), "state": [pickle.dumps(state)]})

    found = rows.select("run", "id", "v", "steps").groupBy("run").applyInArrow(advance, schema).collect()
    sent.unpersist()
    for r in found:
        states[r["run"]] = pickle.loads(r["state"])
    return states


def fit_mini_batches(
    df: DataFrame,
    k: int,
    runs: int,
    batch_size: int,
    seed: int,
    steps: int | None = None,
    tolerance: float = 1e-4,
    key: str = "row_id",
    column: str = "embedding",
    passes: int = PASSES,
) -> tuple[np.ndarray, int, bool]:
    """Centers (runs x k x d), the most steps of a run, and whether all runs settled.

    Start centers come from the ``START_ROWS * k`` rows that are first in a run's hash order. A pass deals all rows
    into batches of about ``batch_size``, anew for each pass and run. A run ends by its smoothed inertia
    (``BatchRun.step``), or with a pass that moves no center by ``tolerance``, after ``passes``, or after ``steps``.

    Steps follow each other, so a run is one task at a time, which takes a slice of a few steps and bytes. Slices are
    written by a scan of the table and read one by one; each scan writes as many as all before it, so a pass over
    any number of rows scans the table some ten to twenty times, and a run that settles early reads what it needs.
    """
    n = df.count()
    if n < k:
        raise ValueError(f"{n} rows cannot form {k} clusters")
    start = [first_rows(df, START_ROWS * k, seed + run, key, column) for run in range(runs)]
    spread = [spread_centers(x, k, np.random.default_rng(seed + run)) for run, x in enumerate(start)]
    states = [BatchRun(centers, np.zeros(k, np.int64), centers) for centers in spread]
    width, share = spread[0].shape[1], batch_size / n
    least_move = tolerance * max(float(np.concatenate(start).var(axis=0).sum()), 1e-300)
    per_pass = steps_of_a_pass(share)
    limit = passes * per_pass if steps is None else min(steps, passes * per_pass)
    taken = max(1, min(SLICE_STEPS, SLICE_BYTES // (8 * width * min(batch_size, n))))
    first, many = 0, 1
    while first < limit and (active := [run for run, state in enumerate(states) if not state.settled]):
        last = min(first + many * taken, limit)
        rows = _slices(df, active, first, last, taken, per_pass, seed, key, column)
        # a single slice is read as it is; more are written in one scan, and each read on its own
        held = rows if many == 1 else stored(rows, "slice")
        for at in range(first, last, taken):
            if all(state.settled for state in states):
                break
            own = held.where(F.col("slice") == (at - first) // taken)
            states = _advanced(own, states, at, min(at + taken, last), per_pass, share, least_move)
        if many > 1:
            discard(held)
        first, many = last, 2 * many
    return np.stack([s.centers for s in states]), max(s.steps for s in states), all(s.settled for s in states)


def mini_batch_kmeans(
    df: DataFrame, k: int, runs: int = RUNS, batch_size: int = BATCH_RAW, seed: int = 0, column: str = "embedding"
) -> DataFrame:
    """Add ``clusters``: one mini-batch clustering per run, seeds ``seed .. seed + runs - 1``.

    Centers that have not settled after ``PASSES`` are a warning.
    """
    centers, steps, converged = fit_mini_batches(df, k, runs, batch_size, seed, column=column)
    if not converged:
        warnings.warn(f"mini-batch k-means has not settled after {steps} steps", RuntimeWarning, stacklevel=2)
    return assign(df, centers, column)
