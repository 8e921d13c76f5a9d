"""Many L2-penalised logistic models over one table, fitted side by side.

The models differ by penalty and by the rows they see (folds of folds), not by the table. Their weights stand side by
side in one matrix, so that a scan gives the losses and gradients of all of them with two matrix products per Arrow
batch; a model that has converged leaves the matrix. Weights are found by L-BFGS, a step of every model in each scan.
Its first guess of the curvature is the bound of the loss's by the vectors' Gram matrix, which comes from one scan for all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embgauge.functions.kernels import row_chunks, share, to_lists, to_matrix
from embgauge.functions.vectors import sum_vector
from embgauge.operators.moments import gram
from embgauge.session import parallelism

# Steps that L-BFGS remembers, the least part of the promised descent that a step must bring, and its shortest length.
MEMORY = 10
DESCENT = 1e-4
SHORTEST = 1e-10

# Bytes of the class probabilities that a task computes at a time, for all models; a few such matrices are held at once.
CHUNK_BYTES = 8 << 20


@dataclass(frozen=True)
class Part:
    """The rows of a model: those outside the fold ``outer``; of them those outside an inner fold, or outside the dev set."""

    outer: int
    inner: int | None = None
    dev: bool = False

    def seen(self, rows: dict) -> np.ndarray:
        mask = rows["fold"] != self.outer
        if self.inner is not None:
            mask = mask & (rows["inner"][:, self.outer] != self.inner)
        return mask & ~rows["dev"] if self.dev else mask

    def held(self, rows: dict) -> np.ndarray:
        """Rows to try the model on: the inner fold's or the dev set's."""
        mask = rows["fold"] != self.outer
        return mask & (rows["inner"][:, self.outer] == self.inner if self.inner is not None else rows["dev"])


@dataclass
class Models:
    """Weights (models x (1 + width) x classes, the intercept first), and how their fits ended."""

    weights: np.ndarray
    iterations: np.ndarray
    converged: np.ndarray


def _columns(table: DataFrame) -> list:
    out = [F.col("label_ix").cast("int").alias("label_ix"), F.col("fold").cast("int").alias("fold")]
    out += [c for c in ("inner", "dev") if c in table.columns]
    return [*out, F.col("embedding").alias("v")]


def _batch(batch: pa.RecordBatch, part: slice, width: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """Vectors with a one in front, labels and split columns of some rows."""
    batch = batch.slice(part.start, part.stop - part.start)
    x = to_matrix(batch.column("v"), width)
    rows = {"fold": batch.column("fold").to_numpy()}
    if "inner" in batch.schema.names:
        inner = batch.column("inner")
        rows["inner"] = inner.flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(len(x), -1)
    if "dev" in batch.schema.names:
        rows["dev"] = batch.column("dev").to_numpy(zero_copy_only=False).astype(bool)
    return np.concatenate([np.ones((len(x), 1)), x], axis=1), batch.column("label_ix").to_numpy(), rows


def _probabilities(x: np.ndarray, flat: np.ndarray, models: int) -> np.ndarray:
    logits = (x @ flat).reshape(len(x), models, -1)
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    return logits / logits.sum(axis=2, keepdims=True)


def _losses(table: DataFrame, parts: list, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean loss and its gradient for every model, without the penalty, from one scan."""
    models, size, classes = weights.shape
    flat = np.ascontiguousarray(weights.transpose(1, 0, 2)).reshape(size, -1)
    sent = share(table.sparkSession, (parts, flat), flat.nbytes, "logistic models")

    def fold(batches):
        own, matrix = sent.value
        loss, n, slope = np.zeros(models), np.zeros(models, np.int64), np.zeros(matrix.shape)
        for batch in batches:
            for rows_at in row_chunks(len(batch), matrix.shape[1], CHUNK_BYTES):
                x, label, rows = _batch(batch, rows_at, size - 1)
                mask = np.stack([part.seen(rows) for part in own], axis=1)
                p = _probabilities(x, matrix, models)
                right = p[np.arange(len(x))[:, None], np.arange(models), label[:, None]]
                loss -= (np.log(np.maximum(right, 1e-300)) * mask).sum(axis=0)
                n += mask.sum(axis=0)
                p[np.arange(len(x))[:, None], np.arange(models), label[:, None]] -= 1
                p *= mask[:, :, None]
                slope += x.T @ p.reshape(len(x), -1)
        if n.any():
            slopes = slope.reshape(size, models, classes).transpose(1, 0, 2).reshape(models, -1)
            number = pa.array(np.arange(models, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([number, pa.array(n), pa.array(loss), to_lists(slopes)], names=["m", "n", "l", "g"])

    merged = table.select(_columns(table)).coalesce(parallelism(table.sparkSession))
    partial = merged.mapInArrow(fold, "m int, n bigint, l double, g array<double>")
    found = partial.groupBy("m").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), sum_vector("g").alias("g")).toArrow()
    sent.unpersist()
    if found.num_rows < models or not found["n"].to_numpy().all():
        raise ValueError("a model has no rows to be fitted on")
    found = found.sort_by("m").combine_chunks()
    n = found["n"].to_numpy()
    slope = to_matrix(found["g"]).reshape(weights.shape)
    return found["l"].to_numpy() / n, slope / n[:, None, None]


@dataclass
class _Descent:
    """L-BFGS of one model between two scans."""

    x: np.ndarray
    curve: np.ndarray
    f: float = np.inf
    g: np.ndarray | None = None
    d: np.ndarray | None = None
    t: float = 1.0
    iterations: int = 0
    ended: bool = False
    converged: bool = False
    pairs: list = field(default_factory=list)

    def trial(self) -> np.ndarray:
        return self.x if self.d is None else self.x + self.t * self.d

    def told(self, f: float, g: np.ndarray, tolerance: float, most: int) -> None:
        """Loss and gradient at the trial point: take it or try a shorter step."""
        if self.d is not None:
            promised = float((self.g * self.d).sum())
            if f > self.f + DESCENT * self.t * promised + 1e-15 * (1 + abs(self.f)):
                self.t *= 0.5
                self.ended = self.t < SHORTEST
                return
            s, y = self.t * self.d, g - self.g
            if (s * y).sum() > 1e-14 * (y * y).sum():
                self.pairs = [*self.pairs[1 - MEMORY :], (s, y, 1 / (s * y).sum())]
            self.x, self.iterations = self.trial(), self.iterations + 1
        self.f, self.g, self.t = f, g, 1.0
        self.converged = bool(np.abs(g).max() <= tolerance)
        self.ended = self.converged or self.iterations >= most
        self.d = -self._curved(g)
        if (self.d * g).sum() >= 0:
            self.pairs, self.d = [], -(self.curve @ g)

    def _curved(self, g: np.ndarray) -> np.ndarray:
        q, taken = g.copy(), []
        for s, y, r in reversed(self.pairs):
            a = r * (s * q).sum()
            q -= a * y
            taken.append(a)
        q = self.curve @ q
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s * y).sum() / (y * (self.curve @ y)).sum()
        for (s, y, r), a in zip(self.pairs, reversed(taken)):
            q += s * (a - r * (y * q).sum())
        return q


def fit(
    table: DataFrame, parts: list, penalties: list, classes: int, width: int, one_sided: bool, most: int, tolerance: float
) -> Models:
    """Models that minimise ``mean(-log p(label)) + penalty / 2 * |weights|^2``, one for each of ``parts``.

    ``table`` has ``label_ix, fold, embedding`` and what the parts ask for; it is scanned once per step and should be
    cached. The intercept is not penalised. ``one_sided`` keeps the first of two classes at zero, which is the
    two-class form with one weight vector. A model has converged when no entry of its gradient is above ``tolerance``.
    """
    whole = gram(table, "embedding", np.zeros(width))
    whole /= whole[0, 0]
    free = np.ones(width + 1)
    free[0] = 0.0
    ridge = 1e-12 * np.trace(whole) / len(whole)
    curves = {p: np.linalg.inv(0.5 * whole + np.diag(p * free + ridge)) for p in set(penalties)}
    runs = [_Descent(np.zeros((width + 1, classes)), curves[p]) for p in penalties]
    while active := [i for i, run in enumerate(runs) if not run.ended]:
        trials = np.stack([runs[i].trial() for i in active])
        losses, slopes = _losses(table, [parts[i] for i in active], trials)
        for i, x, f, g in zip(active, trials, losses, slopes):
            held = x * free[:, None]
            g = g + penalties[i] * held
            if one_sided:
                g[:, 0] = 0.0
            runs[i].told(f + penalties[i] / 2 * (held * held).sum(), g, tolerance, most)
    ends = np.array([run.iterations for run in runs]), np.array([run.converged for run in runs])
    return Models(np.stack([run.x for run in runs]), *ends)


def hits(table: DataFrame, parts: list, weights: np.ndarray) -> np.ndarray:
    """Share of the held rows of every part that its model gets right, from one scan; nan without rows."""
    models, size, _ = weights.shape
    flat = np.ascontiguousarray(weights.transpose(1, 0, 2)).reshape(size, -1)
    sent = share(table.sparkSession, (parts, flat), flat.nbytes, "logistic models")

    def count(batches):
        own, matrix = sent.value
        n, right = np.zeros(models, np.int64), np.zeros(models, np.int64)
        for batch in batches:
            for rows_at in row_chunks(len(batch), matrix.shape[1], CHUNK_BYTES):
                x, label, rows = _batch(batch, rows_at, size - 1)
                mask = np.stack([part.held(rows) for part in own], axis=1)
                pick = (x @ matrix).reshape(len(x), models, -1).argmax(axis=2)
                n += mask.sum(axis=0)
                right += (mask & (pick == label[:, None])).sum(axis=0)
        number = pa.array(np.arange(models, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([number, pa.array(n), pa.array(right)], names=["m", "n", "r"])

    counted = table.select(_columns(table)).mapInArrow(count, "m int, n bigint, r bigint")
    found = counted.groupBy("m").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).toArrow().sort_by("m")
    sent.unpersist()
    n, right = found["n"].to_numpy(), found["r"].to_numpy()
    return np.divide(right, n, out=np.full(models, np.nan), where=n > 0)


def predictions(table: DataFrame, outer: list, weights: np.ndarray, classes: list) -> DataFrame:
    """``(row_id, fold, label, pred, scores)``: rows of the folds ``outer``, each by its fold's model."""
    names, size = np.array([int(c) for c in classes], np.int32), weights.shape[1]
    sent = share(table.sparkSession, weights, weights.nbytes, "logistic models")

    def score(batches):
        for batch in batches:
            fold, x = batch.column("fold").to_numpy(), to_matrix(batch.column("v"), size - 1)
            p = np.zeros((len(x), len(names)))
            for own, held_out in zip(sent.value, outer):
                mine = fold == held_out
                p[mine] = _probabilities(np.insert(x[mine], 0, 1.0, axis=1), own, 1)[:, 0]
            made = [batch.column(c) for c in ("row_id", "fold", "label")]
            yield pa.RecordBatch.from_arrays(
                [*made, pa.array(names[p.argmax(axis=1)]), to_lists(p)], names=["row_id", "fold", "label", "pred", "scores"]
            )

    rows = table.where(F.col("fold").isin(outer)).select("row_id", F.col("fold").cast("int").alias("fold"), "label", F.col("embedding").alias("v"))
    return rows.mapInArrow(score, "row_id bigint, fold int, label int, pred int, scores array<double>")
