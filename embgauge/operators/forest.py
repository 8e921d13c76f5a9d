"""Random forests of deep trees, each grown by one task from binned rows.

MLlib grows all trees level by level and gathers a table of statistics, features x bins x classes, for each node from each
partition. Deep trees have about as many nodes as rows, and such a table for a node of a few rows is nearly empty. Here a
row is a byte per dimension, a task holds all rows and grows whole trees: a level costs what its rows cost, and no tree
leaves its task. The trees are those of MLlib's method (Poisson bootstrap, a root's worth of features per node, quantile
bins, Gini, siblings of one prediction merged) with draws of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from embgauge.functions.kernels import share, to_lists, to_matrix
from embgauge.session import parallelism, stored

BINS = 32

# Bytes of rows and trees that a task holds at most, and those of a row besides its cells and its nodes' class counts.
TASK_BYTES = 400 << 20
ROW_BYTES = 200


def fits_task(rows: int, width: int, n_classes: int) -> bool:
    return rows * (width + ROW_BYTES + 24 * n_classes) <= TASK_BYTES


# ------------------------------------------------------------------ bins


def quantile_cuts(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between distinct values: all of them if few, else those nearest to equal counts, as MLlib sets them."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) < bins:
        return between
    seen = np.cumsum(counts)
    middle = (seen[:-1] + seen[1:]) / 2
    cuts, at = [], 0
    for target in np.arange(1, len(between) + 1) * (len(values) / bins):
        at = max(at, int(np.searchsorted(middle, target, side="right")))
        if at >= len(between):
            break
        cuts.append(between[at])
        at += 1
    return np.array(cuts)


def fold_cuts(rows: DataFrame, wanted: list[int], width: int, bins: int) -> dict[int, list[np.ndarray]]:
    """The cuts of each dimension for each held-out fold, from all rows of the other folds."""

    def columns(batches):
        for batch in batches:
            x = to_matrix(batch.column(1), width)
            lists = pa.array([batch.column(0)] * width, pa.list_(pa.int32())) if len(x) else None
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(width, dtype=np.int32)), lists, to_lists(x.T)], names=["dim", "folds", "numbers"]
                )

    def cut(table):
        dim = table.column("dim")[0].as_py()
        fold = table.column("folds").combine_chunks().flatten().to_numpy()
        values = table.column("numbers").combine_chunks().flatten().to_numpy()
        found = [quantile_cuts(values[fold != f], bins).tolist() for f in wanted]
        return pa.table(
            [pa.array([dim] * len(wanted), pa.int32()), pa.array(wanted, pa.int32()), pa.array(found, pa.list_(pa.float64()))],
            names=["dim", "held_out", "cuts"],
        )

    by_dim = rows.select(F.col("fold").cast("int"), "numbers").mapInArrow(columns, "dim int, folds array<int>, numbers array<double>")
    found = by_dim.groupBy("dim").applyInArrow(cut, "dim int, held_out int, cuts array<double>").collect()
    cuts = {f: [np.zeros(0)] * width for f in wanted}
    for r in found:
        cuts[r["held_out"]][r["dim"]] = np.array(r["cuts"])
    return cuts


# ------------------------------------------------------------------ one tree


class Tree:
    """Nodes in order of their levels: the feature split on (-1: a leaf), the last bin that goes left, the left child (the
    right one follows it) and the weights of the classes."""

    def __init__(self, levels: list[tuple]):
        self.feature, self.cut, self.left, self.counts = (np.concatenate(part) for part in zip(*levels))
        ends = np.cumsum([0, *[len(level[0]) for level in levels]])
        spans = [slice(a, b) for a, b in zip(ends, ends[1:])]
        self._merge(spans)
        self.depth = self._reached(spans)

    def _merge(self, spans: list[slice]) -> None:
        """Siblings that are leaves and predict the same become their parent's."""
        best = self.counts.argmax(axis=1)
        for span in reversed(spans):
            inner = span.start + np.flatnonzero(self.feature[span] >= 0)
            left = self.left[inner]
            same = (self.feature[left] < 0) & (self.feature[left + 1] < 0) & (best[left] == best[left + 1])
            self.feature[inner[same]] = -1

    def _reached(self, spans: list[slice]) -> int:
        at, depth = np.zeros(1, dtype=np.int64), 0
        for depth in range(len(spans)):
            inner = at[self.feature[at] >= 0]
            if not len(inner):
                break
            at = np.concatenate([self.left[inner], self.left[inner] + 1])
        return depth

    def leaves(self, cells: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(cells), dtype=np.int64), np.arange(len(cells))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            node = at[rows]
            at[rows] = self.left[node] + (cells[rows, self.feature[node]] > self.cut[node])
        return at

    def shares(self, cells: np.ndarray) -> np.ndarray:
        """The class shares of each row's leaf."""
        found = self.counts[self.leaves(cells)]
        return found / found.sum(axis=1, keepdims=True)


def drawn_features(nodes: int, width: int, size: int, draw) -> np.ndarray:
    """``size`` different features for each node, every set as likely as another (Floyd's method)."""
    chosen = np.empty((nodes, size), dtype=np.int64)
    for i, last in enumerate(range(width - size, width)):
        one = draw.integers(0, last + 1, nodes)
        taken = (chosen[:, :i] == one[:, None]).any(axis=1)
        chosen[:, i] = np.where(taken, last, one)
    return chosen


def _tried_dense(node, bins, label, weight, counts, n_bins):
    """``(node, bin, score)`` of every cut of a feature, from a table of all bins; few nodes with many rows."""
    m, n_classes = counts.shape
    table = np.bincount((node * n_classes + label) * n_bins + bins, weight, m * n_classes * n_bins)
    left = table.reshape(m, n_classes, n_bins).cumsum(axis=2)[:, :, :-1]
    right = counts[:, :, None] - left
    own, other = left.sum(axis=1), right.sum(axis=1)
    at, cut = np.nonzero((own > 0) & (other > 0))
    squares = lambda part: (part * part).sum(axis=1)[at, cut]
    return at, cut, squares(left) / own[at, cut] + squares(right) / other[at, cut]


def _tried_sorted(node, bins, label, weight, counts, n_bins):
    """The same from sorted rows; many nodes with few rows. Rows are ordered by node and class.

    A row of weight w and of a class that has l on the left adds w (2 l + w) to the left's sum of squares.
    """
    n_classes = counts.shape[1]
    group = node * n_classes + label
    order = np.argsort(group * n_bins + bins)
    weight = weight[order]
    before = np.cumsum(weight) - weight
    start = np.concatenate([[True], group[1:] != group[:-1]])
    before -= before[start][np.cumsum(start) - 1]
    squares, cross = weight * (2 * before + weight), weight * counts.ravel()[group]
    key = (node * n_bins)[order] + bins[order]
    again = np.argsort(key)
    key = key[again]
    at = key // n_bins
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]]))
    nth = np.cumsum(np.concatenate([[0], at[1:] != at[:-1]]))

    def summed(values):
        run = np.cumsum(values[again])
        base = (run - values[again])[start]
        return run[last] - base[nth[last]]

    own, left, mixed = summed(weight), summed(squares), summed(cross)
    at, cut = at[last], key[last] % n_bins
    other = counts.sum(axis=1)[at] - own
    inside = other > 0
    at, cut, own, left, mixed, other = (v[inside] for v in (at, cut, own, left, mixed, other))
    right = (counts * counts).sum(axis=1)[at] - 2 * mixed + left
    return at, cut, left / own + right / other


def best_splits(cells, labels, weights, rows, node, counts, per_node: int, n_bins: int, draw):
    """The best cut of each node among features drawn for it: ``(feature, last bin that goes left)``, -1 if none gains."""
    m, n_classes = counts.shape
    chosen = drawn_features(m, cells.shape[1], per_node, draw)
    label, weight = labels[rows], weights[rows]
    tried = _tried_dense if m * n_classes * n_bins <= 4 * len(rows) else _tried_sorted
    total = counts.sum(axis=1)
    best = (counts * counts).sum(axis=1) / total * (1 + 1e-12)
    feature, cut = np.full(m, -1), np.zeros(m, dtype=np.int64)
    for k in range(per_node):
        at, bins, score = tried(node, cells[rows, chosen[node, k]].astype(np.int64), label, weight, counts, n_bins)
        if not len(at):
            continue
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        most = np.maximum.reduceat(score, start)
        owner = at[start]
        first = np.flatnonzero(score == most[np.cumsum(np.concatenate([[0], at[1:] != at[:-1]]))])[::-1]
        place = np.empty(m, dtype=np.int64)
        place[at[first]] = bins[first]
        better = most > best[owner]
        owner, most = owner[better], most[better]
        best[owner], feature[owner], cut[owner] = most, chosen[owner, k], place[owner]
    return feature, cut


def grow(cells, labels, weights, n_classes: int, depth: int, per_node: int, n_bins: int, draw) -> Tree:
    """A tree from rows of ``cells`` (bins) that count ``weights`` times, level by level until all leaves are pure."""
    rows = np.flatnonzero(weights)
    node = np.zeros(len(rows), dtype=np.int64)
    counts = np.bincount(labels[rows], weights[rows], n_classes)[None]
    levels, above = [], 0
    for level in range(depth + 1):
        m = len(counts)
        feature, cut, left = np.full(m, -1), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        open_ = np.flatnonzero((counts > 0).sum(axis=1) > 1) if level < depth else np.zeros(0, dtype=np.int64)
        above += m
        levels.append((feature, cut, left, counts))
        if not len(open_):
            break
        number = np.full(m, -1)
        number[open_] = np.arange(len(open_))
        rows, node = rows[number[node] >= 0], number[node[number[node] >= 0]]
        order = np.argsort(node * n_classes + labels[rows])
        rows, node = rows[order], node[order]
        found = best_splits(cells, labels, weights, rows, node, counts[open_], per_node, n_bins, draw)
        feature[open_], cut[open_] = found
        split = found[0] >= 0
        left[open_[split]] = above + 2 * np.arange(split.sum())
        if not split.any():
            break
        kept = split[node]
        rows, node = rows[kept], node[kept]
        child = 2 * (np.cumsum(split) - 1)[node] + (cells[rows, found[0][node]] > found[1][node])
        node, m = child, 2 * int(split.sum())
        counts = np.bincount(node * n_classes + labels[rows], weights[rows], m * n_classes).reshape(m, n_classes)
    return Tree(levels)


# ------------------------------------------------------------------ all folds


def _matrix_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Binary values of ``width`` bytes each as the rows of a matrix, without an object for each."""
    parts = []
    for chunk in column.chunks:
        _, offsets, values = chunk.buffers()
        ends = np.frombuffer(offsets, dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(values, dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(chunk), width))
    return np.concatenate(parts)


def votes(table: DataFrame, wanted: list[int], width: int, n_classes: int, trees: int, depth: int, seed: int, n_bins: int = BINS):
    """Each row of the wanted folds with the votes of the forest that was grown on the other folds, and the depth of its
    deepest tree: ``(row_id, label, fold, depth, votes)``, written.

    Rows go to every task, a byte per dimension; a task grows its share of a fold's trees. A tree's draws follow the
    seed, the fold and its number, and rows are ordered by their values, so they do not depend on tasks or partitions.
    """
    spark = table.sparkSession
    per_fold = max(1, min(trees, -(-2 * parallelism(spark) // len(wanted))))
    per_node = width if trees == 1 else int(np.ceil(np.sqrt(width)))
    rows = table.select(
        F.monotonically_increasing_id().alias("at"), "row_id", "label", F.col("fold").cast("int").alias("fold"),
        F.col("label_ix").cast("int").alias("class"), vector_to_array("features").alias("numbers"),
    )
    cuts = fold_cuts(rows, wanted, width, n_bins)
    shared = share(spark, cuts, 8 * n_bins * width * len(wanted), "forest bins")

    def binned(batches):
        for batch in batches:
            x = to_matrix(batch.column(5), width)
            for f in wanted:
                cells = np.empty(x.shape, dtype=np.uint8)
                for j, own in enumerate(shared.value[f]):
                    cells[:, j] = np.searchsorted(own, x[:, j])
                packed = pa.array([r.tobytes() for r in cells], pa.binary())
                held = pa.array(np.full(len(x), f, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:5], held, packed], names=["at", "row_id", "label", "fold", "class", "held_out", "cells"]
                )

    def grown(group):
        held_out, part = group.column("held_out")[0].as_py(), group.column("part")[0].as_py()
        column = lambda name: group.column(name).fill_null(0).to_numpy()
        cells = _matrix_of(group.column("cells"), width)
        order = np.lexsort((cells.view(f"S{width}").ravel(), column("class"), column("row_id")))
        train = order[column("fold")[order] != held_out]
        tested = np.flatnonzero(column("fold") == held_out)
        own, labels, other = cells[train], column("class")[train].astype(np.int64), cells[tested]
        total, deepest = np.zeros((len(tested), n_classes)), 0
        for number in range(part, trees, per_fold):
            draw = np.random.default_rng([seed, held_out, number])
            weights = draw.poisson(1.0, len(train)).astype(np.float64)
            tree = grow(own, labels, weights, n_classes, depth, min(per_node, width), n_bins, draw)
            total += tree.shares(other)
            deepest = max(deepest, tree.depth)
        same = lambda value: pa.array(np.full(len(tested), value, dtype=np.int32))
        kept = [group.column(c).take(pa.array(tested)).combine_chunks() for c in ("at", "row_id", "label", "fold")]
        return pa.table(
            [*kept, same(part), same(deepest), to_lists(total)], names=["at", "row_id", "label", "fold", "part", "depth", "votes"]
        )

    keyed = "at bigint, row_id bigint, label int, fold int"
    cells = rows.mapInArrow(binned, f"{keyed}, class int, held_out int, cells binary")
    dealt = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_fold - 1))).alias("part"))
    # as many tasks as parts: a plain grouping would put several into one, as their rows are few bytes
    apart = dealt.repartitionByRange(per_fold * len(wanted), "held_out", "part")
    parts = apart.groupBy("held_out", "part").applyInArrow(grown, f"{keyed}, part int, depth int, votes array<double>")
    together = parts.groupBy("at", "row_id", "label", "fold").agg(
        F.max("depth").alias("depth"), F.array_sort(F.collect_list(F.struct("part", "votes"))).alias("_p")
    )
    none = F.array_repeat(F.lit(0.0), n_classes)
    added = F.aggregate("_p", none, lambda s, p: F.zip_with(s, p["votes"], lambda a, b: a + b))
    return stored(together.select("row_id", "label", "fold", "depth", added.alias("votes")))
