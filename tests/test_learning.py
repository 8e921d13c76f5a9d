import hashlib

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from conftest import frame, matrix
from pyspark.sql import functions as F

from embgauge import session
from embgauge.functions import kernels
from embgauge.operators import cluster, folds, logistic, metrics, moments, probe, silhouette, whiten
from embgauge.plans.clustering import evaluate_clustering

# ------------------------------------------------------------------ folds


def labelled(spark, sizes, parts=5):
    rows = [(int(i), int(c)) for i, c in enumerate(np.repeat(np.arange(len(sizes)), sizes))]
    return spark.createDataFrame(rows, "row_id long, label int").repartition(parts)


def test_fold_sizes_are_exact_even_for_rare_and_hot_classes(spark):
    rows = folds.stratified_folds(labelled(spark, [1000, 33, 3, 1]), 5, 4).toPandas()
    assert sorted(rows.row_id) == list(range(1037))
    for label, size in enumerate([1000, 33, 3, 1]):
        counts = rows[rows.label == label].fold.value_counts().reindex(range(5), fill_value=0)
        assert counts.sum() == size and counts.max() - counts.min() <= 1


def test_folds_depend_on_the_seed_only(spark):
    read = lambda parts, seed: folds.stratified_folds(labelled(spark, [80, 40], parts), 4, seed).orderBy("row_id").toPandas()
    assert read(1, 1).equals(read(8, 1))
    assert not read(1, 1).fold.equals(read(1, 2).fold)
    with pytest.raises(ValueError):
        folds.stratified_folds(labelled(spark, [9]), 1)


def test_inner_folds_split_the_outer_train_set(spark):
    rows = folds.nested_folds(labelled(spark, [50, 27, 2]), 5, 3).toPandas()
    for outer in range(5):
        inner = rows.inner.map(lambda v: v[outer])
        assert (inner.isna() == (rows.fold == outer)).all()
        for label in range(2):
            mine = inner[(rows.label == label) & (rows.fold != outer)].value_counts().reindex(range(5), fill_value=0)
            assert mine.max() - mine.min() <= 1


def test_holdout_is_exact(spark):
    rows = folds.holdout(labelled(spark, [333]), 0.05, 9).toPandas()
    assert rows.dev.sum() == 16 and len(rows) == 333
    assert folds.holdout(labelled(spark, [9]), 0.05).where("dev").count() == 0


def test_a_row_without_a_label_is_an_error(spark):
    rows = spark.createDataFrame([(0, 1), (1, None), (2, 1)], "row_id long, label int")
    with pytest.raises(Exception, match="row without a label"):
        folds.stratified_folds(rows, 2).collect()


# ------------------------------------------------------------------ metrics


@pytest.fixture(scope="module")
def predictions(spark):
    draw = np.random.default_rng(5)
    label = draw.integers(0, 3, 90)
    scores = draw.normal(size=(90, 3)).round(1)
    data = pd.DataFrame({"fold": np.arange(90) % 2, "label": label, "pred": scores.argmax(axis=1), "scores": scores.tolist()})
    return data, spark.createDataFrame(data)


def test_accuracy_and_f1(predictions):
    data, df = predictions
    accuracy = {r.fold: r.accuracy for r in metrics.accuracy(df, ["fold"]).collect()}
    f1 = {r.fold: r.f1_weighted for r in metrics.f1_weighted(df, ["fold"]).collect()}
    for fold, part in data.groupby("fold"):
        assert accuracy[fold] == round(100 * (part.label == part.pred).mean(), 2)
        total = 0
        for c, mine in part.groupby("label"):
            tp = (mine.pred == c).sum()
            total += len(mine) * 2 * tp / (len(mine) + (part.pred == c).sum())
        assert f1[fold] == round(100 * total / len(part))


def test_confusion(predictions):
    data, df = predictions
    wide = metrics.confusion_matrix(df, [0, 1, 2]).toPandas().set_index("label").sort_index()
    expected = pd.crosstab(data.label, data.pred)
    assert wide.to_numpy().tolist() == expected.to_numpy().tolist()


def test_auc_counts_pairs(predictions):
    data, df = predictions
    scores = np.array(data.scores.tolist())
    total = weight = 0
    for c in range(3):
        good, bad = scores[data.label == c, c], scores[data.label != c, c]
        gap = good[:, None] - bad[None, :]
        total += len(good) * ((gap > 0) + 0.5 * (gap == 0)).mean()
        weight += len(good)
    assert metrics.roc_auc_weighted(df, [0, 1, 2]).first()[0] == pytest.approx(100 * total / weight)


def test_summary_and_best_setting(spark):
    df = spark.createDataFrame(
        [(0.1, 50.0), (0.1, 70.0), (0.01, 60.0), (0.01, 60.0), (1.0, 10.0), (1.0, 10.0)], "reg double, value double"
    )
    assert tuple(metrics.best_reg(df).first()) == (0.01, 60.0)
    assert {tuple(r) for r in metrics.fold_summary(df, ["reg"]).collect()} == {(0.1, 60.0), (0.01, 60.0), (1.0, 10.0)}


# ------------------------------------------------------------------ classifiers


QUICK = probe.ProbeSettings(k=3, trees=10, depth=5, svm_width=64, svm_iter=10, max_iter=30, l2_grid=(1e-4, 1e-2))


@pytest.mark.parametrize("classifier", probe.CLASSIFIERS)
def test_every_classifier_separates_blobs(spark, blobs, classifier):
    _, labels, df = blobs
    shifted = df.withColumn("label", F.col("label") * 3 + 2)
    found = probe.probe(shifted, classifier, QUICK)
    assert found.predictions.count() == 180 and found.predictions.select("row_id").distinct().count() == 180
    assert {r.pred for r in found.predictions.select("pred").distinct().collect()} <= {2, 5, 8}
    means = {r.metric: r.value for r in found.results().where("fold is null").collect()}
    assert means["accuracy"] > 95 and means["f1_weighted"] > 95 and means["rocauc_weighted"] > 95
    if classifier == "softmax":
        assert {"dev_accuracy", "holdout_accuracy"} <= set(means)


@pytest.mark.parametrize("classifier", ["softmax", "mlp", "lr", "svm", "rf"])
def test_results_say_how_the_fits_ended(spark, classifier):
    draw = np.random.default_rng(5)
    df = frame(spark, draw.normal(size=(90, 4)) * [1, 10, 100, 1000], draw.integers(0, 3, 90))
    short = probe.ProbeSettings(k=2, trees=3, depth=1, svm_width=8, svm_iter=1, max_iter=1, l2_grid=(1e-4,))
    ended = lambda s: {(r.metric, r.fold): r.value for r in probe.probe(df, classifier, s).results().collect()}
    found = ended(short)
    assert [found["converged", f] for f in (0, 1)] == [0.0, 0.0] and [found["iterations", f] for f in (0, 1)] == [1.0, 1.0]
    if classifier == "lr":
        full = ended(probe.ProbeSettings(k=2))
        assert [full["converged", f] for f in (0, 1)] == [1.0, 1.0] and full["iterations", 0] > 1


def test_naive_bayes_matches_brute_force(spark, blobs):
    x, labels, df = blobs
    noisy = x + np.random.default_rng(0).normal(scale=6, size=x.shape)
    rows = folds.stratified_folds(frame(spark, noisy, labels), 3, 1)
    fold = np.array([r.fold for r in rows.orderBy("row_id").collect()])
    found = probe.nb_predictions(rows).orderBy("row_id").toPandas()
    for f in range(3):
        train, test = fold != f, fold == f
        eps = 1e-9 * noisy[train].var(axis=0).max()
        joint = []
        for c in range(3):
            part = noisy[train & (labels == c)]
            var = part.var(axis=0) + eps
            prior = np.log(len(part) / train.sum())
            joint.append(prior - 0.5 * (np.log(2 * np.pi * var) + (noisy[test] - part.mean(axis=0)) ** 2 / var).sum(axis=1))
        joint = np.array(joint).T
        np.testing.assert_allclose(np.array(found.scores[test].tolist()), joint, atol=1e-8)
        assert found.pred[test].tolist() == joint.argmax(axis=1).tolist()


def test_logistic_regression_solves_the_stated_objective(spark):
    draw = np.random.default_rng(6)
    x, labels = draw.normal(size=(120, 3)), draw.integers(0, 2, 120)
    found = probe.probe(frame(spark, x, labels), "lr", probe.ProbeSettings(k=3, seed=2))
    rows = found.predictions.orderBy("row_id").toPandas()
    for f in range(3):
        train, test = (rows.fold != f).to_numpy(), (rows.fold == f).to_numpy()
        a = np.c_[x[train], np.ones(train.sum())]
        w, penalty = np.zeros(4), np.diag([1.0, 1.0, 1.0, 0.0])
        for _ in range(30):  # Newton steps on |w|^2 / 2 + sum of losses, intercept free
            p = 1 / (1 + np.exp(-a @ w))
            w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - labels[train]) + penalty @ w)
        expected = 1 / (1 + np.exp(-np.c_[x[test], np.ones(test.sum())] @ w))
        np.testing.assert_allclose([s[1] for s in rows.scores[test]], expected, atol=2e-3)


def test_models_side_by_side_meet_their_optimum(spark):
    """The gradient of every model, computed here from its weights, is nought; equal settings alone give the same."""
    from embgauge.operators import logistic

    draw = np.random.default_rng(8)
    x, labels = draw.normal(size=(150, 5)) * [1, 3, 0.2, 10, 1] + 2, draw.integers(0, 3, 150)
    rows = probe.with_folds(frame(spark, x, labels), "softmax", probe.ProbeSettings(k=3, seed=1))
    table = probe._table(rows, [0, 1, 2], [F.col("embedding")]).cache()
    held = table.orderBy("row_id").toPandas()
    parts = [logistic.Part(o, inner=i) for o in range(3) for i in range(3)] + [logistic.Part(1, dev=True), logistic.Part(2)]
    penalties = [(1e-5, 1e-3, 1e-1)[j % 3] for j in range(len(parts))]
    found = logistic.fit(table, parts, penalties, 3, 5, False, 500, 1e-6)
    assert found.converged.all() and 3 < found.iterations.max() < 200
    a = np.insert(np.array(held.embedding.tolist()), 0, 1.0, axis=1)
    inner = np.array([[-1 if v is None else v for v in r] for r in held.inner], dtype=float)
    for part, penalty, w in zip(parts, penalties, found.weights):
        seen = (held.fold != part.outer).to_numpy()
        if part.inner is not None:
            seen &= np.nan_to_num(inner[:, part.outer], nan=-1) != part.inner
        if part.dev:
            seen &= ~held.dev.to_numpy()
        z = a[seen] @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(seen.sum()), held.label_ix[seen].astype(int)] -= 1
        free = np.insert(w[1:], 0, 0.0, axis=0)
        assert np.abs(a[seen].T @ p / seen.sum() + penalty * free).max() <= 1.1e-6
    alone = logistic.fit(table, parts[4:5], penalties[4:5], 3, 5, False, 500, 1e-6)
    np.testing.assert_allclose(alone.weights[0], found.weights[4], atol=1e-9)
    share = logistic.hits(table, parts, found.weights)
    seen = np.nan_to_num(inner[:, 0], nan=-1) == 1
    assert abs(share[1] - ((a[seen] @ found.weights[1]).argmax(axis=1) == held.label_ix[seen]).mean()) < 1e-12
    with pytest.raises(ValueError, match="no rows"):
        logistic.fit(table.where("fold = 0"), [logistic.Part(0)], [1.0], 3, 5, False, 5, 1e-6)


def test_a_step_of_all_models_is_one_scan(spark, blobs):
    from embgauge.operators import logistic

    _, _, df = blobs
    rows = probe.with_folds(df, "softmax", probe.ProbeSettings(k=3))
    table = probe._table(rows, [0, 1, 2], [F.col("embedding")]).cache()
    calls, plain = [], logistic._losses
    logistic._losses = lambda t, parts, w: calls.append(len(parts)) or plain(t, parts, w)
    try:
        parts = [logistic.Part(o, inner=i) for o in range(3) for i in range(3)]
        found = logistic.fit(table, parts, [1e-2] * 9, 3, 8, False, 50, 1e-6)
    finally:
        logistic._losses = plain
    assert calls[0] == 9 and len(calls) <= found.iterations.max() + 15


def test_models_too_large_to_send_are_refused(spark, blobs, monkeypatch):
    x, _, df = blobs
    monkeypatch.setattr(kernels, "MAX_BROADCAST_BYTES", 200)
    with pytest.raises(ValueError, match="too large"):
        cluster.assign(df, x[None, :6])
    with pytest.raises(ValueError, match="too large"):
        probe.group_moments(df, ["row_id"])


def test_standardize_keeps_constant_dimension(spark):
    x = np.array([[1.0, 5.0], [3.0, 5.0], [8.0, 5.0]])
    z = matrix(probe.standardize(frame(spark, x)))
    np.testing.assert_allclose(z[:, 0], (x[:, 0] - 4) / x[:, 0].std())
    assert z[:, 1].tolist() == [0.0, 0.0, 0.0]


def test_one_class_or_unknown_classifier_is_refused(spark):
    df = frame(spark, np.eye(4))
    with pytest.raises(ValueError, match="two classes"):
        probe.probe(df, "nb")
    with pytest.raises(ValueError, match="unknown classifier"):
        probe.probe(df, "knn")


def test_fourier_features_approximate_the_kernel(spark):
    x = np.random.default_rng(1).normal(size=(30, 4))
    fit = probe.group_moments(frame(spark, x), [])[()]
    z = matrix(probe.fourier_features(frame(spark, x), fit, 4000, 0))
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    kernel = np.exp(-0.25 * ((scaled[:, None] - scaled[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.12


# ------------------------------------------------------------------ clusters


def test_svm_fits_hold_bounded_copies_of_the_wide_features():
    s = probe.ProbeSettings()
    for rows in (0, 10_256, 102_564, 615_384, 50_000_000):
        for classes in (2, 10, 100):
            at_once, each = probe.svm_fits_at_a_time(rows, classes, s)
            held = at_once * (each + 1) * rows * s.svm_width * 8
            assert 1 <= at_once <= 2 and 1 <= each <= s.parallelism and (held <= probe.SVM_BYTES or at_once == each == 1)
    assert probe.svm_fits_at_a_time(10_256, 10, s) == (2, 8)
    assert probe.svm_fits_at_a_time(615_384, 10, s) == (1, 1)


def brute_silhouette(x, own):
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, c in enumerate(own):
        mine = own == c
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = distance[i, mine].sum() / (mine.sum() - 1)
        b = min(distance[i, own == o].mean() for o in set(own) - {c})
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_distance_sums_by_cluster_need_no_sort_for_few_clusters():
    draw = np.random.default_rng(4)
    distance = draw.random((7, 40))
    for k, matrix in ((3, True), (2000, False)):
        clusters = draw.integers(0, k, (40, 2))
        codes = {(run, c): run * k + c for run in range(2) for c in range(k)}
        sums = silhouette._Sums(pa.table({"clusters": pa.array(clusters.tolist(), pa.list_(pa.int32()))}), codes)
        assert (sums.marks is not None) == matrix
        found = np.zeros((7, 2 * k))
        for part in (slice(0, 25), slice(25, 40)):
            sums.add(distance[:, part], found, part)
        for (run, c), code in codes.items():
            np.testing.assert_allclose(found[:, code], distance[:, clusters[:, run] == c].sum(axis=1))


def test_silhouette_of_blocks_of_several_tiles(spark):
    draw = np.random.default_rng(5)
    x, own = draw.normal(size=(1300, 3)), draw.integers(0, 4, 1300)
    df = spark.createDataFrame([(i, v.tolist(), [int(c)]) for i, (v, c) in enumerate(zip(x, own))], "row_id long, embedding array<double>, clusters array<int>")
    for block_rows in (1300, 800):
        found = silhouette.silhouette_samples(df, block_rows=block_rows).toPandas().sort_values("row_id")
        np.testing.assert_allclose(found.silhouette, brute_silhouette(x, own), atol=1e-6)


@pytest.mark.parametrize("block_rows", [None, 40])
def test_silhouette_of_several_runs_with_a_singleton_and_a_hot_cluster(spark, block_rows):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(150, 5)) + 50
    x[60:90] = x[0]
    first = np.where(np.arange(150) < 100, 0, draw.integers(1, 4, 150))
    first[149] = 9
    second = draw.integers(0, 2, 150)
    df = frame(spark, x)
    runs = spark.createDataFrame([(i, [int(a), int(b)]) for i, (a, b) in enumerate(zip(first, second))], "row_id long, clusters array<int>")
    found = silhouette.silhouette_samples(df.join(runs, "row_id"), block_rows=block_rows).toPandas()
    for run, own in enumerate([first, second]):
        part = found[found.run == run].sort_values("row_id")
        assert part.cluster.tolist() == own.tolist()
        np.testing.assert_allclose(part.silhouette, brute_silhouette(x, own), atol=1e-6)


def test_block_count_grows_with_the_table():
    small, large = (silhouette._block_count(n, 768, 8, None) for n in (1000, 10_000_000))
    assert small == 2 and 10_000_000 / large * 768 * 8 <= silhouette.BLOCK_BYTES


def test_blocks_follow_the_number_of_clusters(spark):
    assert silhouette._block_count(100_000, 64, 1, None, 20_000) > 100 * silhouette._block_count(100_000, 64, 1, None, 50)
    draw = np.random.default_rng(4)
    x = draw.normal(size=(2600, 4))
    picks = np.stack([draw.permutation(2600) % 2000, draw.permutation(2600) % 7], axis=1)
    rows = [(i, [int(c) for c in p], [float(v) for v in r]) for i, (p, r) in enumerate(zip(picks, x))]
    df = spark.createDataFrame(rows, "row_id long, clusters array<int>, embedding array<double>")
    found = {(r.row_id, r.run): r.silhouette for r in silhouette.silhouette_samples(df).collect()}
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for run in range(2):
        own = picks[:, run]
        sums = np.stack([gaps[:, own == c].sum(axis=1) for c in range(own.max() + 1)], axis=1)
        sizes = np.bincount(own)
        for i in range(0, 2600, 37):
            mean = sums[i] / sizes
            other = np.delete(mean, own[i]).min()
            inside = sums[i, own[i]] / max(sizes[own[i]] - 1, 1)
            want = 0.0 if sizes[own[i]] == 1 else (other - inside) / max(other, inside)
            assert abs(found[i, run] - want) < 1e-9


def test_lloyd_matches_numpy_for_two_runs_and_keeps_empty_centers(spark, blobs):
    x, _, df = blobs
    starts = np.stack([x[[0, 70, 130]], np.vstack([x[[1, 2]], np.full((1, 8), 1e3)])])
    found = cluster.lloyd(df, starts, 4)
    for run in range(2):
        centers = starts[run].copy()
        for _ in range(4):
            pick = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
            centers = np.array([x[pick == c].mean(axis=0) if (pick == c).any() else centers[c] for c in range(3)])
        np.testing.assert_allclose(found[run], centers, atol=1e-9)


def test_mini_batch_runs_find_the_blobs(spark, blobs):
    x, labels, df = blobs
    found = cluster.mini_batch_kmeans(df, 3, runs=3, batch_size=50, seed=1).orderBy("row_id").toPandas()
    per_run = np.array(found.clusters.tolist()).T
    agree = [max(((run == c) & (labels == l)).sum() for c in range(3)) for run in per_run for l in range(3)]
    assert np.mean(agree) > 45
    again = cluster.mini_batch_kmeans(df.repartition(7), 3, runs=3, batch_size=50, seed=1).orderBy("row_id").toPandas()
    assert np.array_equal(per_run, np.array(again.clusters.tolist()).T)
    with pytest.raises(Exception, match="cannot form"):
        cluster.mini_batch_kmeans(df.where("row_id < 2"), 3)


def test_batches_are_new_in_every_step_and_follow_the_seed(spark):
    rows = spark.range(3000).withColumnRenamed("id", "row_id")
    drawn = lambda step, seed: {
        r.row_id: tuple(r.runs)
        for r in rows.select("row_id", cluster.batch_of(step, 0.1, 2, seed).alias("runs")).where(F.size("runs") > 0).collect()
    }
    first, second = drawn(0, 0), drawn(1, 0)
    for found in (first, second):
        assert all(200 < sum(run in runs for runs in found.values()) < 400 for run in (0, 1))
    assert first != second and first == drawn(0, 0)
    assert {i for i, runs in first.items() if 1 in runs} == {i for i, runs in drawn(0, 1).items() if 0 in runs}


def test_a_mini_batch_step_matches_numpy(spark, blobs):
    x, _, df = blobs
    found, steps, settled = cluster.fit_mini_batches(df, 3, 2, len(x), 4, steps=1)
    assert steps == 1 and not settled
    for run in range(2):
        start = cluster.first_rows(df, 30, 4 + run)
        centers = cluster.spread_centers(start, 3, np.random.default_rng(4 + run))
        pick = cluster.squared_distances(x, centers).argmin(axis=1)
        np.testing.assert_allclose(found[run], [x[pick == c].mean(axis=0) for c in range(3)], atol=1e-9)


def test_a_pass_takes_every_row_once_and_passes_go_on_until_settled(spark, blobs):
    x, _, df = blobs
    rows = spark.range(1000).withColumnRenamed("id", "row_id")
    for turn in range(2):
        steps = range(turn * 7, turn * 7 + 7)
        found = rows.select(F.explode(F.flatten(F.array(*[cluster.batch_of(s, 0.15, 2, 3) for s in steps]))).alias("run"))
        drawn = rows.select("row_id", F.concat(*[cluster.batch_of(s, 0.15, 2, 3) for s in steps]).alias("runs"))
        assert found.count() == 2000 and drawn.where(F.array_sort("runs") != F.array(F.lit(0), F.lit(1))).count() == 0
    # the inertia of batches of ten settles a run before a pass moves no center
    _, steps, settled = cluster.fit_mini_batches(df, 3, 2, 10, 1)
    assert settled and steps > cluster.PATIENCE
    assert cluster.fit_mini_batches(df, 3, 2, 60, 1, tolerance=0.0, passes=2)[1:] == (6, False)
    found = evaluate_clustering(df, ["none"], runs=2).where("metric <> 'silhouette'").collect()
    ended = {r.metric: r.value for r in found}
    assert ended["converged"] == 1 and ended["steps"] >= 2 and all(r.fold is None for r in found)


def plain_mini_batches(rows, k, runs, batch, seed, tolerance, passes, start):
    """Step by step in one process: centers and steps of every run."""
    ids, x = [r for r, _ in rows], np.array([v for _, v in rows])
    per_pass, out = -(-len(x) // batch), []
    digest = lambda run, turn, i: int(hashlib.md5(f"{run + seed}:{turn}:{i}".encode()).hexdigest()[:8], 16)
    least = tolerance * np.concatenate(start).var(axis=0).sum()
    for run in range(runs):
        centers = cluster.spread_centers(start[run], k, np.random.default_rng(seed + run))
        seen, smooth, best, stale, since, done, old = np.zeros(k), None, None, 0, 0, 0, centers
        for t in range(passes * per_pass):
            mine = np.array([per_pass == 1 or digest(run, t // per_pass, i) % per_pass == t % per_pass for i in ids])
            own = x[mine][np.argsort([str(i) for i, m in zip(ids, mine) if m], kind="stable")]
            done += 1
            if len(own):
                gaps = ((own[:, None] - centers[None]) ** 2).sum(axis=2)
                pick, near = gaps.argmin(axis=1), gaps.min(axis=1)
                centers = centers.copy()
                for c in set(pick.tolist()):
                    seen[c] += (pick == c).sum()
                    centers[c] += (own[pick == c] - centers[c]).sum(axis=0) / seen[c]
                since += len(own)
                if (seen == 0).any() or since >= 10 * k:
                    since, poor = 0, np.flatnonzero(seen < 0.01 * seen.max())[: len(own) // 2]
                    if len(poor):
                        centers[poor] = own[np.argsort(-near, kind="stable")[: len(poor)]]
                        seen[poor] = np.delete(seen, poor).min()
                smooth = near.mean() if smooth is None else smooth + min(max(2 * batch / len(x), 0.1), 1) * (near.mean() - smooth)
                best, stale = (smooth, 0) if best is None or smooth < best else (best, stale + 1)
            ended = (t + 1) % per_pass == 0 and ((centers - old) ** 2).sum(axis=1).max() < least
            old = centers if (t + 1) % per_pass == 0 else old
            if ended or stale >= 10:
                break
        out.append((centers, done))
    return out


@pytest.mark.parametrize("batch, slice_steps, passes", [(20, 4, 6), (20, 64, 3), (60, 3, 4), (500, 5, 9)])
def test_mini_batches_match_a_plain_run(spark, monkeypatch, batch, slice_steps, passes):
    monkeypatch.setattr(cluster, "SLICE_STEPS", slice_steps)
    draw = np.random.default_rng(3)
    # two clouds and a far row, which starves a center
    x = np.concatenate([draw.normal(size=(90, 4)), draw.normal(size=(89, 4)) + 3, np.full((1, 4), 60.0)])
    df = frame(spark, x)
    rows = [(r.row_id, r.embedding) for r in df.orderBy("row_id").collect()]
    start = [cluster.first_rows(df, 40, 2 + run) for run in range(3)]
    want = plain_mini_batches(rows, 4, 3, batch, 2, 1e-4, passes, start)
    found, steps, _ = cluster.fit_mini_batches(df, 4, 3, batch, 2, passes=passes)
    assert steps == max(done for _, done in want)
    for mine, (centers, _) in zip(found, want):
        np.testing.assert_allclose(mine, centers, atol=1e-9)


def test_steps_do_not_follow_the_rows(spark):
    draw = np.random.default_rng(1)
    centers = draw.normal(size=(3, 4)) * 8
    taken = []
    for n in (2000, 16000):
        x = centers[draw.integers(0, 3, n)] + draw.normal(size=(n, 4))
        _, steps, settled = cluster.fit_mini_batches(frame(spark, x), 3, 2, 100, 0)
        assert settled
        taken.append(steps)
    # a pass over the larger table has 160 steps
    assert max(taken) < 100


def test_a_written_slice_is_read_alone(spark):
    held = session.stored(spark.range(100).selectExpr("id", "id % 5 AS slice"), "slice")
    plan = held.where("slice = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slice" in plan and held.where("slice = 3").count() == 20
    session.discard(held)


def test_maps_that_rotate_are_clustered_once(spark, blobs):
    from embgauge.plans.clustering import _alike

    _, _, df = blobs
    whole = moments.moments(df)
    alike = {frozenset(g) for g in _alike(whole, ["none", *whiten.METHODS])}
    assert alike == {frozenset(["none"]), frozenset(["zca", "pca", "cholesky"]), frozenset(["zca_cor", "pca_cor"])}
    found = {(r.whitening, r.metric, r.fold): r.value for r in evaluate_clustering(df, ["none", "zca", "cholesky"], runs=2).collect()}
    alone = {(r.whitening, r.metric, r.fold): r.value for r in evaluate_clustering(df, ["cholesky"], runs=2).collect()}
    assert all(found[k] == v for k, v in alone.items())
    assert {k[1:]: v for k, v in found.items() if k[0] == "zca"} == {k[1:]: v for k, v in found.items() if k[0] == "cholesky"}


def test_mllib_kmeans(spark, blobs):
    _, labels, df = blobs
    found = cluster.kmeans(df, 3, seed=1).withColumn("clusters", F.array("cluster"))
    assert silhouette.silhouette(found).first().silhouette > 0.5


def test_a_forest_grown_in_parts_votes_as_its_trees_together(spark, blobs, monkeypatch):
    _, _, rows = blobs
    settings = probe.ProbeSettings(k=2, trees=3, depth=3)
    assert probe.trees_at_a_time(180, 3, settings) == 3
    assert probe.trees_at_a_time(10**9, 3, probe.ProbeSettings()) == 1
    folded = probe.with_folds(rows, "rf", settings)
    kept = lambda seed: probe.probe(folded, "rf", probe.ProbeSettings(k=2, trees=1, depth=3, seed=seed)).predictions
    votes = [{r.row_id: np.array(r.scores) for r in kept(seed).collect()} for seed in range(3)]
    monkeypatch.setattr(probe, "FOREST_BYTES", 1)
    found = probe.probe(folded, "rf", settings)
    got = found.predictions.collect()
    assert sorted(r.row_id for r in got) == list(range(180)) and len(found.tuning) == 4
    for r in got:
        expected = sum(v[r.row_id] for v in votes) / 3
        np.testing.assert_allclose(r.scores, expected, atol=1e-12)
        assert r.pred == found.classes[int(np.argmax(expected))]


def test_a_forest_grown_at_once_is_the_plain_one(spark, blobs):
    _, _, rows = blobs
    settings = probe.ProbeSettings(k=2, trees=5, depth=3)
    folded = probe.with_folds(rows, "rf", settings).localCheckpoint()
    got = {r.row_id: r for r in probe.probe(folded, "rf", settings, outer=[0]).predictions.collect()}
    table = probe._table(folded, [0, 1, 2], [probe.array_to_vector("embedding").alias("features")])
    model = probe._estimator("rf", 90, 8, 3, settings).fit(table.where("fold <> 0"))
    plain = probe._predicted(model, table.where("fold = 0"), [0, 1, 2]).collect()
    assert {r.row_id for r in plain} == set(got)
    for r in plain:
        assert r.pred == got[r.row_id].pred and list(r.scores) == list(got[r.row_id].scores)


def test_probabilities_of_many_models_are_computed_in_small_steps():
    assert logistic.CHUNK_BYTES <= 8 << 20
    steps = list(logistic.row_chunks(10_000, 1050, logistic.CHUNK_BYTES))
    assert max(s.stop - s.start for s in steps) * 1050 * 8 <= 8 << 20 and steps[-1].stop == 10_000
