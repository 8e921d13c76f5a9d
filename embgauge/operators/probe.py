"""Probing classifiers over folds.

``softmax`` and ``lr`` are convex: the models of all folds, settings and inner folds are fitted side by side, each step of
all of them in one scan. ``nb`` needs only per-class sums, so all folds are fitted by one aggregation and scored by one
pass. ``mlp`` and ``svm`` are MLlib estimators fitted per fold from driver threads over one cached table; so is ``rf``,
a fold and a few trees at a time, but for deep trees over many rows, which ``forest`` grows for all folds at once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    LinearSVC,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from embgauge.functions import kernels
from embgauge.functions.kernels import share, to_lists, to_matrix
from embgauge.functions.vectors import as_doubles
from embgauge.operators import forest, logistic, metrics
from embgauge.operators.folds import holdout, nested_folds, stratified_folds
from embgauge.session import checkpointed, discard, fetched, keep, stored

# The L2 settings tried, the forest size, and the share added to variances.
L2_GRID = [1e-5, 1e-4, 1e-3, 1e-2]
FOREST_TREES = 100
VAR_SMOOTHING = 1e-9
DEV_SHARE = 0.05

# MLlib grows trees on the driver: bytes of them that are held at a time, and bytes of a node without and per class.
FOREST_BYTES = 128 << 20
NODE_BYTES, NODE_CLASS_BYTES = 250, 24
# Nodes a tree may have for MLlib, which gathers a table of statistics for each of them from each partition.
MLLIB_NODES = 4096

# Bytes of wide SVM features that all executors together hold at a time.
SVM_BYTES = 4 << 30

CLASSIFIERS = ["softmax", "mlp", "lr", "svm", "rf", "nb"]
MAX_CLASSES = 10_000


def classes_of(df: DataFrame, label: str = "label") -> list:
    """Sorted distinct labels; their number is bounded."""
    found = [r[0] for r in df.select(label).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes; the label is no class label")
    if len(found) < 2:
        raise ValueError("classification needs at least two classes")
    return sorted(found)


def class_count(df: DataFrame, label: str = "label", out: str = "n_classes") -> DataFrame:
    return df.agg(F.countDistinct(label).alias(out))


# ------------------------------------------------------------------ per-group moments


@dataclass(frozen=True)
class GroupMoments:
    """Rows, mean and summed squared deviations of one group; groups add up exactly."""

    n: int
    mean: np.ndarray
    dev: np.ndarray

    def __add__(self, other: "GroupMoments") -> "GroupMoments":
        n = self.n + other.n
        gap = other.mean - self.mean
        return GroupMoments(
            n, self.mean + gap * (other.n / n), self.dev + other.dev + gap * gap * (self.n * other.n / n)
        )

    @property
    def var(self) -> np.ndarray:
        return self.dev / self.n


def group_moments(df: DataFrame, by: list[str], column: str = "embedding") -> dict:
    """Moments per group from one scan. The groups are folds and classes; what is fetched is bounded."""
    first = df.select(F.size(column).alias("d")).first()
    most = kernels.MAX_BROADCAST_BYTES // (16 * max(first["d"] if first else 1, 1))
    stats = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(as_doubles(column)))
    found = df.groupBy(*by).agg(stats.alias("s")).select(*by, "s.count", "s.mean", "s.variance")
    rows = found.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups; their moments are too large to fetch")
    return {
        tuple(r[c] for c in by): GroupMoments(
            r["count"], r["mean"].toArray(), r["variance"].toArray() * max(r["count"] - 1, 0)
        )
        for r in rows
    }


# ------------------------------------------------------------------ standard scaling


def standardize(df: DataFrame, column: str = "embedding", fit_on: DataFrame | None = None) -> DataFrame:
    """``(x - mean) / std`` with the population deviation; a constant dimension is only centred."""
    whole = group_moments((fit_on or df).select(column), [], column)[()]
    return _scaled(df, column, whole)


def _scaled(df: DataFrame, column: str, m: GroupMoments) -> DataFrame:
    std = np.sqrt(m.var)
    std[std == 0] = 1.0
    mean = m.mean
    others = [c for c in df.columns if c != column]
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(column, T.ArrayType(T.DoubleType()))])

    def scale(batches):
        for batch in batches:
            z = (to_matrix(batch.column(batch.num_columns - 1), len(mean)) - mean) / std
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], to_lists(z)], names=schema.names)

    return df.select(*others, column).mapInArrow(scale, schema)


# ------------------------------------------------------------------ Gaussian naive Bayes


def nb_predictions(df: DataFrame, fold: str = "fold", smoothing: list[float] = (VAR_SMOOTHING,)) -> DataFrame:
    """Out-of-fold predictions ``(row_id, fold, reg, label, pred, scores)`` of Gaussian naive Bayes.

    One aggregation by (fold, class) fits every fold: the model for fold f is the sum of all other
    folds. One pass then scores each row under the model that has not seen it. ``smoothing``
    settings are scored side by side; ``scores`` are joint log likelihoods in class order.
    """
    classes = classes_of(df)
    parts = group_moments(df.select(fold, "label", "embedding"), [fold, "label"])
    folds = sorted({f for f, _ in parts})
    models = {}
    for f in folds:
        seen = {c: _sum([m for (g, label), m in parts.items() if label == c and g != f]) for c in classes}
        per_class = [seen[c] for c in classes]
        widest = _sum([m for m in per_class if m is not None]).var.max()
        models[f] = [_nb_weights(per_class, s * widest) for s in smoothing]

    schema = "row_id bigint, fold int, reg double, label int, pred int, scores array<double>"
    class_codes = np.asarray(classes)
    size = sum(part.nbytes for grid in models.values() for weights in grid for part in weights)
    shared = share(df.sparkSession, models, size, "class models")

    def score(batches):
        for batch in batches:
            ids, fold_of, labels, vectors = batch.columns
            x, at = to_matrix(vectors), np.asarray(fold_of)
            for index, setting in enumerate(smoothing):
                joint = np.empty((len(x), len(class_codes)))
                for f in np.unique(at):
                    mine = at == f
                    square, linear, constant = shared.value[int(f)][index]
                    joint[mine] = (x[mine] ** 2) @ square + x[mine] @ linear + constant
                pred = pa.array(class_codes[joint.argmax(axis=1)].astype(np.int32))
                reg = pa.array(np.full(len(x), float(setting)))
                yield pa.RecordBatch.from_arrays(
                    [ids, fold_of, reg, labels, pred, to_lists(joint)],
                    names=["row_id", "fold", "reg", "label", "pred", "scores"],
                )

    rows = df.select(
        F.col("row_id").cast("bigint"), F.col(fold).cast("int"), F.col("label").cast("int"), "embedding"
    )
    return rows.mapInArrow(score, schema)


def _sum(parts: list):
    return reduce(lambda a, b: a + b, parts) if parts else None


def _nb_weights(per_class: list, extra: float):
    """Log joint likelihood as ``x^2 @ square + x @ linear + constant``; an unseen class never wins."""
    width = len(next(m for m in per_class if m is not None).mean)
    total = sum(m.n for m in per_class if m is not None)
    square, linear = np.zeros((width, len(per_class))), np.zeros((width, len(per_class)))
    constant = np.full(len(per_class), -np.inf)
    for c, m in enumerate(per_class):
        if m is None:
            continue
        var = m.var + extra
        square[:, c] = -0.5 / var
        linear[:, c] = m.mean / var
        constant[c] = np.log(m.n / total) - 0.5 * (np.log(2 * np.pi * var) + m.mean**2 / var).sum()
    return square, linear, constant


# ------------------------------------------------------------------ kernel features for the SVM


def fourier_features(df: DataFrame, fit: GroupMoments, out_width: int, seed: int, column: str = "embedding"):
    """Standard scaling, then random cosine features whose inner product approximates the RBF kernel
    with gamma = 1 / (d * variance of the scaled data)."""
    std = np.sqrt(fit.var)
    varying = std > 0
    gamma = 1.0 / max(int(varying.sum()), 1)
    std = np.where(varying, std, 1.0)
    mean = fit.mean
    draw = np.random.default_rng(seed)
    directions = draw.normal(scale=np.sqrt(2 * gamma), size=(len(mean), out_width))
    phase = draw.uniform(0, 2 * np.pi, out_width)
    others = [c for c in df.columns if c != column]
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(column, T.ArrayType(T.DoubleType()))])

    def lift(batches):
        for batch in batches:
            x = (to_matrix(batch.column(batch.num_columns - 1), len(mean)) - mean) / std
            z = np.sqrt(2.0 / out_width) * np.cos(x @ directions + phase)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], to_lists(z)], names=schema.names)

    return df.select(*others, column).mapInArrow(lift, schema)


# ------------------------------------------------------------------ MLlib classifiers


@dataclass(frozen=True)
class ProbeSettings:
    k: int = 5
    seed: int = 0
    l2_grid: tuple = tuple(L2_GRID)
    max_iter: int = 5000
    tolerance: float = 1e-6
    mlp_iter: int = 100
    hidden: int = 32
    trees: int = FOREST_TREES
    depth: int = 20
    svm_width: int = 512
    svm_iter: int = 30
    parallelism: int = 8


def _estimator(name: str, rows: int, width: int, n_classes: int, s: ProbeSettings):
    common = dict(featuresCol="features", labelCol="label_ix")
    if name == "mlp":
        return MultilayerPerceptronClassifier(
            layers=[width, s.hidden, n_classes], seed=s.seed, maxIter=min(s.max_iter, s.mlp_iter), **common
        )
    if name == "svm":
        svc = LinearSVC(regParam=1.0 / rows, standardization=False, maxIter=s.svm_iter, **common)
        return svc if n_classes == 2 else OneVsRest(classifier=svc, parallelism=s.parallelism, **common)
    if name == "rf":
        return RandomForestClassifier(
            numTrees=s.trees, maxDepth=s.depth, seed=s.seed, maxMemoryInMB=512, minInstancesPerNode=1, **common
        )
    raise ValueError(f"unknown classifier {name!r}")


def fit_ends(model, s: ProbeSettings) -> tuple[int, bool]:
    """The iterations of a fit, the most of its parts, and whether it ended by its tolerance. For a forest: the deepest
    tree's depth, and whether none was stopped by the limit."""
    if hasattr(model, "trees"):
        deepest = max(tree.depth for tree in model.trees)
        return deepest, deepest < s.depth
    ends = []
    for part in getattr(model, "models", [model]):
        summary = part.summary() if callable(part.summary) else part.summary
        ends.append((summary.totalIterations, summary.totalIterations < part.getMaxIter()))
    return max(n for n, _ in ends), all(settled for _, settled in ends)


def _end_rows(fold: int, ends: list[tuple[int, bool]]) -> list[tuple]:
    """Result rows on how the fits of a fold ended: the most iterations, and 1 if all of them converged, else 0."""
    most, settled = max(n for n, _ in ends), all(done for _, done in ends)
    return [(fold, "iterations", float(most)), (fold, "converged", float(settled))]


def _table(df: DataFrame, classes: list, vectors: list) -> DataFrame:
    """Cached ML table with class positions as labels and the vector columns a classifier reads."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    extra = [c for c in ("inner", "dev") if c in df.columns]
    return df.select(
        F.col("row_id").cast("bigint").alias("row_id"),
        F.col("label").cast("int").alias("label"),
        "fold",
        *extra,
        position.cast("double").alias("label_ix"),
        *vectors,
    )


def _predicted(model, test: DataFrame, classes: list) -> DataFrame:
    out = model.transform(test)
    pred = F.element_at(F.array(*[F.lit(int(c)) for c in classes]), F.col("prediction").cast("int") + 1)
    scored = next((c for c in ("probability", "rawPrediction") if c in out.columns), None)
    scores = [vector_to_array(scored).alias("scores")] if scored else []
    return out.select("row_id", "fold", "label", pred.alias("pred"), *scores)


def _in_threads(work, items, threads: int) -> list:
    """Independent driver-side jobs side by side, each in a thread of its own."""
    with ThreadPool(min(threads, len(items))) as pool:
        return pool.map(work, items, chunksize=1)


def _logistic(table: DataFrame, classifier: str, outer: list[int], sizes: dict, classes: list, width: int, s: ProbeSettings):
    """Predictions and result rows of the logistic classifiers.

    ``lr`` has the penalty 1/(C n) with C = 1, as the loss is a mean. ``softmax`` first fits a model for every outer fold,
    L2 setting and inner fold, all in the same scans; the setting with the best mean accuracy on the inner folds (percent,
    two places), the first among equals, is fitted on the outer train set less a 5 % dev split.
    """
    size = dict(classes=len(classes), width=width, most=s.max_iter, tolerance=s.tolerance)
    if classifier == "lr":
        parts = [logistic.Part(o) for o in outer]
        penalties = [1.0 / (sum(sizes.values()) - sizes[o]) for o in outer]
        models = logistic.fit(table, parts, penalties, one_sided=len(classes) == 2, **size)
        ends = {o: [(int(n), bool(c))] for o, n, c in zip(outer, models.iterations, models.converged)}
        rows = [row for o in outer for row in _end_rows(o, ends[o])]
        return logistic.predictions(table, outer, models.weights, classes), rows
    grid = [(o, reg, i) for o in outer for reg in s.l2_grid for i in range(s.k)]
    parts = [logistic.Part(o, inner=i) for o, _, i in grid]
    tried = logistic.fit(table, parts, [reg for _, reg, _ in grid], one_sided=False, **size)
    right = dict(zip(grid, logistic.hits(table, parts, tried.weights)))
    ends = dict(zip(grid, zip(tried.iterations.tolist(), tried.converged.tolist())))
    scores = {o: [round(100 * float(np.nanmean([right[o, reg, i] for i in range(s.k)])), 2) for reg in s.l2_grid] for o in outer}
    best = {o: int(np.argmax(scores[o])) for o in outer}
    parts = [logistic.Part(o, dev=True) for o in outer]
    models = logistic.fit(table, parts, [s.l2_grid[best[o]] for o in outer], one_sided=False, **size)
    rows = []
    for o, held, n, settled in zip(outer, logistic.hits(table, parts, models.weights), models.iterations, models.converged):
        rows += [(o, "dev_accuracy", scores[o][best[o]]), (o, "best_l2", float(s.l2_grid[best[o]]))]
        if not np.isnan(held):
            rows.append((o, "holdout_accuracy", round(100 * float(held), 2)))
        own = [ends[o, reg, i] for reg in s.l2_grid for i in range(s.k)]
        rows += _end_rows(o, [*own, (int(n), bool(settled))])
    return logistic.predictions(table, outer, models.weights, classes), rows


def tree_nodes(rows: int, s: ProbeSettings) -> int:
    """A bound: a tree has no more leaves than rows or than its depth allows."""
    return min(2 * rows, 2 ** (s.depth + 1))


def trees_at_a_time(rows: int, n_classes: int, s: ProbeSettings) -> int:
    """Trees whose nodes fit in ``FOREST_BYTES``, one at least."""
    return max(1, min(s.trees, FOREST_BYTES // (tree_nodes(rows, s) * (NODE_BYTES + NODE_CLASS_BYTES * n_classes))))


def svm_fits_at_a_time(rows: int, n_classes: int, s: ProbeSettings) -> tuple[int, int]:
    """Folds, and classes of each, whose copies of the wide features fit in ``SVM_BYTES``, one at least: a fold caches its
    train rows, and the fit of each class blocks of its own."""
    copies = SVM_BYTES // max(rows * s.svm_width * 8, 1)
    most = max(min(s.parallelism, n_classes), 1)
    folds = 2 if copies >= 2 * (most + 1) else 1
    return folds, max(1, min(most, copies // folds - 1))


def _forest(table: DataFrame, held_out: int, rows: int, classes: list, s: ProbeSettings) -> tuple[DataFrame, list[tuple]]:
    """Predictions for a fold by a forest that is grown a few trees at a time, and how its fits ended.

    The driver holds these trees only: their votes are added to the rows', which are written, and the trees let go. The
    first trees have the settings' seed, so a forest that is grown at once is the plain one; later ones count on from it.
    """
    train, at_once = table.where(F.col("fold") != held_out), trees_at_a_time(rows, len(classes), s)
    voted = table.where(F.col("fold") == held_out).withColumn("votes", F.array_repeat(F.lit(0.0), len(classes)))
    ends, before = [], None
    for first in range(0, s.trees, at_once):
        own = replace(s, trees=min(at_once, s.trees - first), seed=s.seed + first)
        model = _estimator("rf", rows, 0, len(classes), own).fit(train)
        ends.append(fit_ends(model, own))
        added = F.zip_with("votes", vector_to_array("rawPrediction"), lambda a, b: a + b)
        voted = stored(model.transform(voted).withColumn("votes", added).select(*voted.columns))
        del model
        if before is not None:
            discard(before)
        before = voted
    return _elected(voted, classes), _end_rows(held_out, ends)


def _elected(voted: DataFrame, classes: list) -> DataFrame:
    """Predictions from the rows' votes."""
    # array_position finds the first of equal votes, as the plain forest does
    best = F.array_position("votes", F.array_max("votes")).cast("int")
    pred = F.element_at(F.array(*[F.lit(int(c)) for c in classes]), best)
    # divided by their own sum, as MLlib does, so that equal probabilities are the same ones
    total = F.aggregate("votes", F.lit(0.0), lambda a, b: a + b)
    named = voted.withColumn("_total", total).withColumn("_share", F.transform("votes", lambda v: v / F.col("_total")))
    return named.select("row_id", "fold", "label", pred.alias("pred"), F.col("_share").alias("scores"))


def _deep_forests(table: DataFrame, wanted: list[int], width: int, classes: list, s: ProbeSettings) -> tuple[DataFrame, list[tuple]]:
    """Predictions for all wanted folds by forests that are grown whole trees at a time, and how they ended."""
    voted = forest.votes(table, wanted, width, len(classes), s.trees, s.depth, s.seed)
    deepest = {r["fold"]: r["d"] for r in voted.groupBy("fold").agg(F.max("depth").alias("d")).collect()}
    return _elected(voted, classes), [row for f in wanted for row in _end_rows(f, [(deepest[f], deepest[f] < s.depth)])]


@dataclass
class ProbeResult:
    """Out-of-fold predictions, how the fits of each fold ended, and for the tuned classifier its settings and dev
    figures per fold."""

    predictions: DataFrame
    classes: list
    scored: bool
    tuning: list

    def results(self) -> DataFrame:
        """``(metric, fold, value)``: per-fold figures, and their means under a null fold."""
        by_fold = metrics.accuracy(self.predictions, ["fold"]).join(
            metrics.f1_weighted(self.predictions, ["fold"]), "fold"
        )
        names = ["accuracy", "f1_weighted"]
        if self.scored:
            auc = metrics.roc_auc_weighted(self.predictions, self.classes, ["fold"])
            by_fold = by_fold.join(auc, "fold", "left")
            names.append("rocauc_weighted")
        long = by_fold.unpivot("fold", names, "metric", "value").where(F.col("value").isNotNull())
        if self.tuning:
            spark = self.predictions.sparkSession
            tuned = spark.createDataFrame(self.tuning, "fold int, metric string, value double")
            long = long.unionByName(tuned)
        long = fetched(long)
        mean = metrics.fold_summary(long.where(~F.col("metric").isin("best_l2", "iterations", "converged")), ["metric"])
        return long.unionByName(mean.withColumn("fold", F.lit(None).cast("int")))


def with_folds(df: DataFrame, classifier: str, settings: ProbeSettings = ProbeSettings()) -> DataFrame:
    """Rows with the split columns the classifier needs: ``fold``, and for the tuned one ``inner``, ``dev``."""
    if classifier == "softmax":
        return holdout(nested_folds(df, settings.k, settings.seed), DEV_SHARE, settings.seed)
    return stratified_folds(df, settings.k, settings.seed)


def probe(
    df: DataFrame, classifier: str, settings: ProbeSettings = ProbeSettings(), outer: list[int] | None = None
) -> ProbeResult:
    """k-fold probing of ``(row_id, label, embedding)`` rows with one classifier.

    Rows that already carry ``fold`` (see ``with_folds``) keep their folds; ``outer`` restricts the
    run to some held-out folds.
    """
    if classifier not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {classifier!r}")
    s = settings
    classes = classes_of(df)
    split = [c for c in ("fold", "inner", "dev") if c in df.columns]
    folds = df.select("row_id", "label", "embedding", *split)
    if not split:
        folds = with_folds(folds, classifier, s)
    if classifier == "nb":
        predictions = nb_predictions(keep(folds)).drop("reg")
        if outer is not None:
            predictions = predictions.where(F.col("fold").isin(outer))
        return ProbeResult(keep(predictions), classes, True, [])
    features = array_to_vector(as_doubles("embedding")).alias("features")
    vector = F.col("embedding") if classifier in ("softmax", "lr", "svm") else features
    # Written once: the many fits then plan against a plain table and survive lost executors.
    table = keep(checkpointed(_table(folds, classes, [vector])))
    sizes = {r["fold"]: r["n"] for r in table.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    total, width = sum(sizes.values()), df.select(F.size("embedding")).first()[0]
    wanted = sorted(sizes) if outer is None else outer
    if classifier in ("softmax", "lr"):
        predictions, rows = _logistic(table, classifier, wanted, sizes, classes, width, s)
        return ProbeResult(keep(predictions), classes, True, rows)
    if classifier == "rf" and tree_nodes(total, s) > MLLIB_NODES and forest.fits_task(total, width, len(classes)):
        predictions, rows = _deep_forests(table, wanted, width, classes, s)
        return ProbeResult(keep(predictions), classes, True, rows)
    fold_stats = group_moments(table.select("fold", "embedding"), ["fold"]) if classifier == "svm" else {}
    svm_folds, svm_classes = svm_fits_at_a_time(total, len(classes), s)

    def run(held_out: int):
        if classifier == "rf":
            return _forest(table, held_out, total - sizes[held_out], classes, s)
        train, test = table.where(F.col("fold") != held_out), table.where(F.col("fold") == held_out)
        own = replace(s, parallelism=svm_classes) if classifier == "svm" else s
        estimator = _estimator(classifier, total - sizes[held_out], width, len(classes), own)
        if classifier == "svm":
            fit = _sum([m for (f,), m in fold_stats.items() if f != held_out])
            lifted = fourier_features(table, fit, s.svm_width, s.seed)
            lifted = lifted.withColumn("features", array_to_vector("embedding")).drop("embedding")
            cached = lifted.where(F.col("fold") != held_out).persist()
            model = estimator.fit(cached)
            cached.unpersist()
            return _predicted(model, lifted.where(F.col("fold") == held_out), classes), _end_rows(held_out, [fit_ends(model, s)])
        model = estimator.fit(train)
        return _predicted(model, test, classes), _end_rows(held_out, [fit_ends(model, s)])

    # An SVM fold caches its own wide features, so few of them run at once; a forest's trees are on the driver.
    done = _in_threads(run, wanted, {"svm": svm_folds, "rf": 1}.get(classifier, s.parallelism))
    predictions = keep(reduce(DataFrame.unionByName, [p for p, _ in done]))
    scored = "scores" in predictions.columns
    return ProbeResult(predictions, classes, scored, [row for _, rows in done for row in rows])

