import numpy as np
import pytest
from pyspark.sql import functions as F

from embgauge.operators import moments, pairs, probe, whiten
from embgauge.plans import classify, clustering, sts
from embgauge.plans.sweep import Sweep
from embgauge.sources.embeddings import write_embeddings
from embgauge.sources.results import write_pair_scores


@pytest.fixture(scope="module")
def store(spark, blobs, tmp_path_factory):
    """One labelled dataset and one pair dataset under two encoders."""
    root = str(tmp_path_factory.mktemp("store"))
    x, labels, df = blobs
    single = df.selectExpr("'mr' dataset", "'all' split", "cast(null as int) side", "row_id", "'t' text", "label", "embedding")
    sides = lambda name: df.selectExpr(
        f"'{name}' dataset", "'test' split", "cast(row_id % 2 + 1 as int) side",
        "cast(row_id div 2 as bigint) row_id", "'t' text", "cast(null as int) label", "embedding",
    )
    for encoder in ("bert", "simcse"):
        for rows in (single, sides("stsb"), sides("mrpc")):
            write_embeddings(rows.withColumn("encoder", F.lit(encoder)), root)
    return root


def gold(spark, dataset):
    return spark.range(90).selectExpr("id pair_id", "cast(id % 7 as double) score")


def labels(spark, dataset):
    return spark.range(90).selectExpr("id pair_id", "cast(id % 2 as int) label")


def test_sts_sweep_resumes(spark, store, tmp_path):
    sweep = Sweep(store, str(tmp_path / "r"), ["stsb"], ["bert"], gold=gold, pair_scores=str(tmp_path / "p"))
    found = sts.eval_sts(spark, sweep).collect()
    assert {r.whitening for r in found} == {"none", "pca", "zca", "pca-cor", "zca-cor", "cholesky"} and len(found) == 18
    value = {(r.whitening, r.metric): r.value for r in found}
    assert value["zca", "spearman"] == pytest.approx(value["cholesky", "spearman"], abs=1e-6)
    assert all(r.dataset == "stsb" and r.encoder == "bert" and r.task == "sts" for r in found)
    more = Sweep(store, sweep.results, ["stsb"], ["bert", "simcse"], gold=gold, run_id="second")
    again = sts.eval_sts(spark, more).collect()
    assert len(again) == 36 and {r.encoder for r in again if r.run_id == "second"} == {"simcse"}
    scores = spark.read.parquet(sweep.pair_scores)
    assert scores.count() == 90 * 6 and {"cos_sim", "score", "pair_id"} <= set(scores.columns)


def test_clustering_sweep(spark, store, tmp_path):
    sweep = Sweep(store, str(tmp_path / "r"), ["mr"], ["bert"], methods=["none", "zca_cor"], runs=2)
    found = clustering.eval_cluster(spark, sweep).collect()
    assert {(r.whitening, r.fold) for r in found} == {(w, f) for w in ("none", "zca-cor") for f in (0, 1, None)}
    assert all(-100 <= r.value <= 100 for r in found)


def test_classification_sweep_with_pairs(spark, store, tmp_path):
    quick = probe.ProbeSettings(k=3)
    sweep = Sweep(store, str(tmp_path / "r"), ["mr", "mrpc"], ["bert"], ["none", "zca"], "nb", quick, pair_labels=labels)
    found = classify.eval_classify(spark, sweep).collect()
    value = {(r.dataset, r.whitening, r.metric): r.value for r in found if r.fold is None}
    assert value["mr", "none", "accuracy"] > 95
    assert value["mr", "zca", "isoscore"] == pytest.approx(1.0, abs=1e-6)
    assert 0 <= value["mrpc", "none", "isoscore"] <= 1
    assert len([r for r in found if r.metric == "accuracy" and r.dataset == "mrpc"]) == 8


def test_whitening_fitted_without_the_test_fold(spark, blobs):
    _, _, df = blobs
    quick = probe.ProbeSettings(k=3)
    found = classify.evaluate_classification(df, "nb", ["pca"], quick, fit_on="train").collect()
    accuracy = {r.fold: r.value for r in found if r.metric == "accuracy"}
    assert set(accuracy) == {0, 1, 2, None}
    assert accuracy[None] == pytest.approx(np.mean([accuracy[f] for f in range(3)]), abs=0.01)
    with pytest.raises(ValueError):
        classify.evaluate_classification(df, "nb", ["pca"], quick, fit_on="half")


def test_all_methods_without_the_test_fold_share_one_scan(spark, blobs, monkeypatch):
    _, _, df = blobs
    scans, tiles = [], moments._gram_tiles
    monkeypatch.setattr(moments, "_gram_tiles", lambda *a: scans.append(a) or tiles(*a))
    quick = probe.ProbeSettings(k=3)
    found = classify.evaluate_classification(df, "nb", ["pca", "zca"], quick, fit_on="train").collect()
    assert len(scans) == 2
    base = probe.with_folds(df, "nb", quick)
    seen = whiten.fit_whitening(base.where("fold <> 1"), ["pca"])
    alone = probe.probe(whiten.whiten(base, seen).drop("whitening"), "nb", quick, [1]).results().collect()
    accuracy = lambda rows, method=None: [
        r.value for r in rows if r.metric == "accuracy" and r.fold == 1 and (method is None or r["whitening"] == method)
    ]
    assert accuracy(found, "pca") == accuracy(alone)


def test_missing_gold_labels_or_sides_are_errors(spark, blobs):
    _, _, df = blobs
    rows = df.selectExpr("cast(row_id div 2 as bigint) pair_id", "cast(row_id % 2 + 1 as int) side", "embedding")
    with pytest.raises(ValueError, match="gold scores do not match: 90 pairs, 50"):
        sts.score_pairs(rows, gold(spark, "x").where("pair_id < 50"))
    with pytest.raises(ValueError, match="do not match"):
        sts.score_pairs(rows.where("not (pair_id = 1 and side = 2)"), gold(spark, "x"))
    joined = pairs.join_sides(rows)
    with pytest.raises(ValueError, match="labels do not match"):
        pairs.labelled_pair_features(joined, labels(spark, "x").unionByName(labels(spark, "x").limit(1)))


def test_other_settings_are_run_and_repeats_double_nothing(spark, store, tmp_path):
    make = lambda k, fit_on: Sweep(
        store, str(tmp_path / "r"), ["mr"], ["bert"], ["zca"], "nb", probe.ProbeSettings(k=k), fit_on=fit_on
    )
    folds = lambda found: {r.fold for r in found if r.metric == "accuracy"}
    assert folds(classify.eval_classify(spark, make(3, "all")).collect()) == {0, 1, 2, None}
    assert folds(classify.eval_classify(spark, make(4, "all")).collect()) == {0, 1, 2, 3, None}
    assert len(spark.read.parquet(str(tmp_path / "r")).select("settings").distinct().collect()) == 2
    scores = spark.range(5).selectExpr("'d' dataset", "'e' encoder", "'none' whitening", "id pair_id", "1D cos_sim", "1D score")
    for _ in range(2):
        write_pair_scores(scores, str(tmp_path / "p"))
    write_pair_scores(scores.withColumn("whitening", F.lit("zca")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 10
