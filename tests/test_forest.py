import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from embgauge.operators import forest, probe


def brute_scores(cells, labels, weights, feature, n_classes, n_bins):
    """Sum over both sides of a cut of the squared class weights by the side's weight."""
    found = {}
    for cut in range(n_bins - 1):
        left = cells[:, feature] <= cut
        sides = [np.bincount(labels[s], weights[s], n_classes) for s in (left, ~left)]
        if all(s.sum() for s in sides):
            found[cut] = sum((s * s).sum() / s.sum() for s in sides)
    return found


@pytest.mark.parametrize("nodes", [1, 4, 60])
def test_cuts_score_as_by_brute_force(nodes):
    draw = np.random.default_rng(nodes)
    n, n_classes, n_bins = 240, 3, 6
    node = np.concatenate([np.arange(nodes), draw.integers(0, nodes, n - nodes)])
    labels, weights, cells = draw.integers(0, n_classes, n), draw.integers(1, 4, n).astype(float), draw.integers(0, n_bins, (n, 1))
    order = np.argsort(node * n_classes + labels)
    node, labels, weights, cells = node[order], labels[order], weights[order], cells[order]
    counts = np.bincount(node * n_classes + labels, weights, nodes * n_classes).reshape(nodes, n_classes)
    for tried in (forest._tried_dense, forest._tried_sorted):
        at, cut, score = tried(node, cells[:, 0], labels, weights, counts, n_bins)
        best = {}
        for i, s in zip(at, score):
            best[i] = max(best.get(i, 0), s)
        for i in range(nodes):
            mine = node == i
            expected = brute_scores(cells[mine], labels[mine], weights[mine], 0, n_classes, n_bins)
            assert best.get(i) == pytest.approx(max(expected.values())) if expected else i not in best
            for c, s in zip(cut[at == i], score[at == i]):
                assert s == pytest.approx(expected[c])


def test_cuts_lie_between_values_and_are_all_of_them_if_few():
    np.testing.assert_array_equal(forest.quantile_cuts(np.array([3.0, 1, 1, 2])), [1.5, 2.5])
    assert len(forest.quantile_cuts(np.ones(5))) == 0
    cuts = forest.quantile_cuts(np.arange(320.0))
    np.testing.assert_array_equal(cuts, np.arange(1, 32) * 10 - 0.5)


def test_a_tree_of_all_rows_and_features_ends_in_pure_leaves():
    draw = np.random.default_rng(2)
    cells = np.unique(draw.integers(0, 32, (500, 4)), axis=0).astype(np.uint8)
    labels = draw.integers(0, 3, len(cells))
    tree = forest.grow(cells, labels, np.ones(len(cells)), 3, 40, 4, 32, draw)
    np.testing.assert_array_equal(tree.shares(cells), np.eye(3)[labels])
    flat = forest.grow(cells, labels, np.ones(len(cells)), 3, 2, 4, 32, draw)
    assert flat.depth <= 2 < tree.depth and not (flat.shares(cells).max(axis=1) == 1).all()
    alone = forest.grow(cells[:1], labels[:1], np.ones(1), 3, 40, 4, 32, draw)
    assert alone.depth == 0 and alone.shares(cells)[:, labels[0]].min() == 1


def test_leaves_of_one_prediction_are_merged():
    cells, labels = np.array([[0], [0], [0], [1], [1]], dtype=np.uint8), np.array([0, 0, 1, 0, 0])
    tree = forest.grow(cells, labels, np.ones(5), 2, 5, 1, 32, np.random.default_rng(0))
    assert tree.depth == 0
    np.testing.assert_allclose(tree.shares(cells), [[0.8, 0.2]] * 5)


def test_features_of_a_node_differ():
    drawn = forest.drawn_features(4000, 5, 3, np.random.default_rng(0))
    assert all(len(set(r)) == 3 for r in drawn)
    np.testing.assert_allclose(np.bincount(drawn.ravel()) / 4000, 0.6, atol=0.05)


def test_deep_forests_over_many_rows_are_not_grown_by_tables_of_statistics(spark, monkeypatch):
    """A node of a few rows had a table of statistics in every partition; one row of a key that comes twice stays two."""
    draw = np.random.default_rng(3)
    labels = np.repeat([2, 5, 9], 800)
    x = draw.normal(size=(2400, 6)) + 3 * draw.normal(size=(10, 6))[labels]
    rows = frame(spark, x, labels).withColumn("row_id", F.expr("if(row_id = 1, 0, row_id)"))
    settings = probe.ProbeSettings(k=2, trees=8)
    monkeypatch.setattr(probe, "_estimator", None)  # MLlib's forest
    folded = probe.with_folds(rows, "rf", settings).localCheckpoint()
    found = probe.probe(folded, "rf", settings)
    ended = {(r.metric, r.fold): r.value for r in found.results().collect()}
    assert ended["accuracy", None] > 80 and ended["rocauc_weighted", None] > 90 and 1 < ended["iterations", 0] <= 20
    got = found.predictions.collect()
    assert len(got) == 2400 and sum(r.row_id == 0 for r in got) == 2
    for r in got:
        assert sum(r.scores) == pytest.approx(1) and r.pred == [2, 5, 9][int(np.argmax(r.scores))]
    again = probe.probe(folded.repartition(7), "rf", settings, outer=[1]).predictions.collect()
    by_key = lambda rows: sorted((r.row_id, r.label, r.pred, [round(v, 9) for v in r.scores]) for r in rows if r.fold == 1)
    assert by_key(again) == by_key(got)


def test_rows_a_task_can_hold_are_bounded():
    assert forest.fits_task(600_000, 64, 10) and not forest.fits_task(10_000_000, 64, 10)
