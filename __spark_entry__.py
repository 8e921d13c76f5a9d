"""Queries over the given tables, one per operator, and the same results as SQL."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F

import oracles
import testbed as t
from embgauge.functions.text import Profile, clean_text, decorate, token_table, truncate_tokens
from embgauge.functions.vectors import as_doubles, at_places, cosine, euclidean
from embgauge.operators import cluster, folds, metrics, moments, pairs, pool, probe, ranks, silhouette, whiten
from embgauge.operators.encode import encode, encode_hashed, encode_word2vec, hashed_ngrams
from embgauge.plans.classify import evaluate_classification
from embgauge.plans.clustering import evaluate_clustering
from embgauge.plans.sts import evaluate_sts, score_pairs
from embgauge.plans.sweep import label_of
from embgauge.session import keep
from embgauge.sources.datasets import apply_contract
from embgauge.sources.embeddings import from_wide, to_wide

try:
    from embgauge.llm import queries as llm
except ImportError as error:  # the subpackage may be left out; what it needs may not
    if error.name not in ("embgauge.llm", "embgauge.llm.queries"):
        raise
    llm = None

SMOKE_DIR = "/root/testdata/sf0.001"
SMOOTHING_GRID = (1e-3, 1e-2, 1e-1, 1.0)
PROMPT = 'Sentence: "{text}" means in one word:'


# ------------------------------------------------------------------ sources and text


def src_dataset(spark, sf, documents=t.labelled_documents):
    rows = documents(spark, sf)
    return rows.select("dataset", "split", "row_id", F.md5("text").alias("text_md5"), "label")


def src_embeddings(spark, sf):
    e = as_doubles("embedding")
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return t.vectors(spark, sf).select(
        "row_id",
        "label",
        F.size(e).alias("width"),
        at_places(add(e)).alias("total"),
        at_places(F.sqrt(add(F.transform(e, lambda x: x * x)))).alias("norm"),
    )


def src_union_splits(spark, sf, documents=t.labelled_documents):
    rows = documents(spark, sf)
    stacked = rows.where(F.col("split") == "train").unionByName(rows.where(F.col("split") == "test"))
    return stacked.groupBy("split", "label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def contract(spark, sf, documents=t.labelled_documents):
    raw = documents(spark, sf).select(
        "row_id", F.col("label").cast("string").alias("label"), F.col("text").alias("SMILES")
    )
    return apply_contract(raw).select("row_id", F.md5("text").alias("text_md5"), "label")


def assemble(spark, sf):
    rows = t.vectors(spark, sf)
    width = len(rows.first()["embedding"])
    return t.entries(from_wide(to_wide(rows, width)), "row_id", "label")


def class_count(spark, sf):
    counted = lambda name, rows: probe.class_count(rows).select(F.lit(name).alias("dataset"), "n_classes")
    return counted("vectors", t.vectors(spark, sf)).unionByName(counted("docs", t.all_documents(spark, sf)))


def _of_all(query):
    """The query over every document, with and without a label."""
    return lambda spark, sf: query(spark, sf, t.all_documents)


def text_clean(spark, sf):
    answers = t.turns(spark, sf).select(F.col("text_2").alias("text"))
    lines = t.documents(spark, sf).select(F.explode(F.split("text", "\n")).alias("text"))
    rules = ["keep", "blank_to_space", "null_to_blank", "null_to_space"]
    cleaned = F.array(*[F.struct(F.lit(r).alias("rule"), clean_text(F.col("text"), r).alias("t")) for r in rules])
    long = answers.unionByName(lines).select(F.inline(cleaned))
    return long.groupBy("rule").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("t").isNull()).alias("n_null"),
        F.count_if(F.col("t") == "").alias("n_blank"),
        F.count_if(F.col("t") == " ").alias("n_space"),
        F.sum(F.length("t")).alias("chars"),
    )


def prompt(spark, sf):
    return t.documents(spark, sf).select("row_id", F.md5(decorate(F.col("text"), PROMPT)).alias("prompt_md5"))


def truncate(spark, sf):
    kept = truncate_tokens(token_table(t.documents(spark, sf)))
    return kept.groupBy("row_id").agg(
        F.count("*").alias("n_tokens"),
        F.sum(F.length("token")).alias("chars"),
        F.max_by("token", "token_pos").alias("last_token"),
    )


# ------------------------------------------------------------------ pairs and vector functions


def sts_pairs(spark, sf):
    zipped = F.arrays_zip(as_doubles("e1").alias("e1"), as_doubles("e2").alias("e2"))
    both = pairs.join_sides(t.sides(spark, sf)).select("pair_id", F.posexplode(zipped).alias("dim", "v"))
    return both.select("pair_id", "dim", at_places(F.col("v.e1")).alias("v1"), at_places(F.col("v.e2")).alias("v2"))


def pair_labels(spark, sf):
    last = F.substring(F.md5(F.col("pair_id").cast("string")), 32, 1)
    split = F.when(last.isin("0", "1", "2"), "test").otherwise("train")
    return t.pair_labels(spark, sf).select("pair_id", split.alias("split"), "label")


def _scored(spark, sf):
    return score_pairs(t.sides(spark, sf), t.gold(spark, sf), [whiten.NONE])


def sts_scores(spark, sf):
    rounded = [at_places(F.col(c)).alias(c) for c in ("cos_sim", "score")]
    return _scored(spark, sf).select("pair_id", *rounded)


def cosine_query(spark, sf):
    rows = pairs.join_sides(t.sides(spark, sf))
    return rows.select("pair_id", at_places(cosine("e1", "e2")).alias("cos_sim"))


def pairwise_l2(spark, sf):
    rows = pairs.join_sides(t.sides(spark, sf))
    return rows.select("pair_id", at_places(euclidean("e1", "e2")).alias("distance"))


def pair_features(spark, sf):
    rows = pairs.labelled_pair_features(pairs.join_sides(t.sides(spark, sf)), t.pair_labels(spark, sf))
    return t.entries(rows, "pair_id", "label")


def pair_integrity(spark, sf):
    one = t.documents(spark, sf).select(F.col("row_id").alias("pair_id"), F.lit(1).alias("side"))
    two = t.table(spark, sf, "labels").select(F.col("doc_id").alias("pair_id"), F.lit(2).alias("side"))
    return pairs.pair_integrity(one.unionByName(two))


# ------------------------------------------------------------------ statistics


def center(spark, sf):
    return t.entries(moments.center(t.vectors(spark, sf)), "row_id")


def _rounded(frame, places=6):
    return frame.withColumn("value", at_places(F.col("value"), places))


def dim_mean(spark, sf):
    return _rounded(moments.dim_mean(t.vectors(spark, sf)))


def dim_std(spark, sf):
    return _rounded(moments.vector_frame(spark, moments.moments(t.vectors(spark, sf)).std))


def cov(spark, sf):
    return _rounded(moments.matrix_frame(spark, moments.moments(t.vectors(spark, sf)).cov), 8)


def cor_matrix(spark, sf):
    return _rounded(moments.matrix_frame(spark, moments.moments(t.vectors(spark, sf)).scaled_cov))


def isoscore(spark, sf):
    value = moments.moments(t.vectors(spark, sf)).isoscore
    return spark.createDataFrame([(value,)], "v double").select(at_places(F.col("v")).alias("isoscore"))


def isoscore_whitened(spark, sf):
    found = moments.moments(t.vectors(spark, sf))
    maps = [whiten.solve_whitening(found, m) for m in whiten.METHODS]
    values = [(m.method, moments.isoscore_of(m.whiten @ found.cov @ m.whiten.T)) for m in maps]
    return spark.createDataFrame(values, "whitening string, v double").select(
        "whitening", at_places(F.col("v")).alias("isoscore")
    )


def anisotropy(spark, sf):
    return ranks.anisotropy(_scored(spark, sf)).select(at_places(F.col("anisotropy")).alias("anisotropy"))


def pearson(spark, sf):
    return ranks.pearson(_scored(spark, sf), "cos_sim", "score").select(at_places(F.col("pearson")).alias("pearson"))


def spearman(spark, sf):
    found = ranks.spearman(_scored(spark, sf).persist(), "cos_sim", "score")
    return found.select(at_places(F.col("spearman")).alias("spearman"))


# ------------------------------------------------------------------ whitening


def _whitened(method):
    def query(spark, sf):
        rows = t.vectors(spark, sf).select("row_id", "embedding")
        return t.entries(whiten.whiten(rows, whiten.fit_whitening(rows, [method])), "row_id")

    return query


def dewhiten(spark, sf, methods=("pca", "zca", "pca_cor", "zca_cor")):
    rows = t.vectors(spark, sf).select("row_id", "embedding")
    models = whiten.fit_whitening(rows, list(methods))
    back = [whiten.dewhiten(whiten.whiten(rows, [m]), [m]) for m in models]
    stacked = back[0]
    for frame in back[1:]:
        stacked = stacked.unionByName(frame)
    return t.entries(stacked, "whitening", "row_id")


def dewhiten_cholesky(spark, sf):
    return dewhiten(spark, sf, ["cholesky"])


def sts_whitened(spark, sf):
    scores = score_pairs(t.sides(spark, sf), t.gold(spark, sf), whiten.METHODS)
    return scores.select("pair_id", label_of("whitening").alias("whitening"), at_places(F.col("cos_sim")).alias("cos_sim"))


def eval_sts(spark, sf):
    figures = evaluate_sts(t.sides(spark, sf), t.gold(spark, sf))
    return figures.select(label_of("whitening").alias("whitening"), "metric", at_places(F.col("value")).alias("value"))


def pca2d(spark, sf):
    flat = whiten.pca_2d(t.vectors(spark, sf).select("row_id", "embedding"))
    return flat.select("row_id", at_places(F.col("x")).alias("x"), at_places(F.col("y")).alias("y"))


# ------------------------------------------------------------------ pooling and encoding


def _layer(n):
    return lambda spark, sf: t.tokens(spark, sf).where(F.col("layer") == n)


def pool_mean(spark, sf):
    return t.entries(pool.mean_pool(_layer(3)(spark, sf), width=t.TOKEN_WIDTH), "row_id")


def pool_masked(spark, sf):
    return t.entries(pool.mean_pool(_layer(3)(spark, sf), masked=True, width=t.TOKEN_WIDTH), "row_id")


def pool_layer(spark, sf):
    return t.entries(pool.pool(t.tokens(spark, sf), "layer", 2, width=t.TOKEN_WIDTH), "row_id")


def pool_range(spark, sf):
    return t.entries(pool.pool(t.tokens(spark, sf), "range", 2, layers=t.LAYERS, width=t.TOKEN_WIDTH), "row_id")


def pool_pair(spark, sf):
    return t.entries(pool.pool(t.tokens(spark, sf), "pair", (0, 3), width=t.TOKEN_WIDTH), "row_id")


def pool_last(spark, sf):
    return t.entries(pool.last_token(t.tokens(spark, sf), layers=t.LAYERS, width=t.TOKEN_WIDTH), "row_id")


def encode_hash(spark, sf):
    return t.entries(encode_hashed(t.documents(spark, sf)), "row_id")


def encode_job(spark, sf):
    rows = encode(t.documents(spark, sf), hashed_ngrams(), profile=Profile.of("all-mpnet-base-v2"))
    return t.entries(rows, "row_id")


def encode_w2v(spark, sf):
    return t.entries(encode_word2vec(t.documents(spark, sf)), "row_id")


# ------------------------------------------------------------------ folds, classifiers, metrics


def stratified_folds(spark, sf):
    return folds.stratified_folds(t.vectors(spark, sf).select("row_id", "label"))


def nested_folds(spark, sf):
    rows = folds.nested_folds(t.vectors(spark, sf).select("row_id", "label"))
    long = rows.select("row_id", "fold", F.posexplode("inner").alias("held_out", "inner_fold"))
    return long.where(F.col("inner_fold").isNotNull())


def holdout(spark, sf):
    return folds.holdout(t.documents(spark, sf).select("row_id")).select("row_id", "dev")


def _bayes(spark, sf, smoothing=(probe.VAR_SMOOTHING,)):
    return probe.nb_predictions(keep(folds.stratified_folds(t.vectors(spark, sf))), smoothing=smoothing)


def clf_nb(spark, sf):
    return _bayes(spark, sf).select("row_id", "fold", "label", "pred")


def accuracy(spark, sf):
    return metrics.accuracy(_bayes(spark, sf), ["fold"])


def f1_weighted(spark, sf):
    return metrics.f1_weighted(_bayes(spark, sf).persist(), ["fold"])


def confusion(spark, sf):
    return metrics.confusion(_bayes(spark, sf))


def rocauc_weighted(spark, sf):
    classes = probe.classes_of(t.vectors(spark, sf))
    found = metrics.roc_auc_weighted(_bayes(spark, sf), classes, ["fold"])
    return found.select("fold", at_places(F.col("rocauc_weighted")).alias("rocauc_weighted"))


def fold_summary(spark, sf):
    predictions = _bayes(spark, sf).persist()
    by_fold = metrics.accuracy(predictions, ["fold"]).join(metrics.f1_weighted(predictions, ["fold"]), "fold")
    return metrics.fold_summary(by_fold.unpivot("fold", ["accuracy", "f1_weighted"], "metric", "value"), ["metric"])


def best_reg(spark, sf):
    scores = metrics.accuracy(_bayes(spark, sf, SMOOTHING_GRID), ["fold", "reg"], "value")
    return metrics.best_reg(scores)


def standardize(spark, sf):
    return t.entries(probe.standardize(t.vectors(spark, sf).select("row_id", "embedding")), "row_id")


def _probed(classifier):
    def query(spark, sf):
        return probe.probe(t.vectors(spark, sf), classifier).results()

    return query


def nested_cv(spark, sf):
    found = probe.probe(t.vectors(spark, sf), "softmax").results()
    return found.where(F.col("metric").isin("dev_accuracy", "best_l2", "holdout_accuracy"))


def eval_classify(spark, sf):
    return evaluate_classification(t.vectors(spark, sf), "lr")


def _report(frame):
    return frame.withColumn("value", at_places(F.col("value")))


def eval_classify_nb(spark, sf):
    return _report(evaluate_classification(t.vectors(spark, sf), "nb"))


def eval_classify_whitened(spark, sf):
    return _report(evaluate_classification(t.vectors(spark, sf), "nb", whiten.METHODS))


def eval_classify_pairs(spark, sf):
    rows = pairs.labelled_pair_features(pairs.join_sides(t.sides(spark, sf)), t.pair_labels(spark, sf))
    return _report(evaluate_classification(rows.withColumnRenamed("pair_id", "row_id"), "nb"))


def encode_classify(spark, sf):
    rows = encode(t.labelled_documents(spark, sf), hashed_ngrams(), profile=Profile.of("all-mpnet-base-v2"))
    rounded = F.transform("embedding", lambda v: at_places(v))
    # kept, as the cuts between folds are looked for in several scans, and a scan must not encode again
    coded = folds.stratified_folds(keep(rows.select("row_id", "label", rounded.alias("embedding"))))
    return metrics.accuracy(probe.nb_predictions(keep(coded)), ["fold"])


# ------------------------------------------------------------------ clustering


def silhouette_query(spark, sf):
    rows = t.vectors(spark, sf).withColumn("clusters", F.array("label"))
    found = silhouette.silhouette_samples(rows)
    return found.select("row_id", "cluster", at_places(F.col("silhouette")).alias("silhouette"))


def kmeans_lloyd(spark, sf):
    rows = t.vectors(spark, sf)
    start = cluster.first_rows(rows, 10)
    centers = cluster.lloyd(rows, start[None], 3)
    return cluster.assign(rows, centers).select("row_id", F.col("clusters")[0].alias("cluster"))


def kmeans(spark, sf):
    rows = t.vectors(spark, sf)
    return cluster.kmeans(rows, len(probe.classes_of(rows))).select("row_id", "cluster")


def kmeans_runs(spark, sf):
    rows = t.vectors(spark, sf)
    found = cluster.mini_batch_kmeans(rows, len(probe.classes_of(rows)))
    return found.select("row_id", F.posexplode("clusters").alias("run", "cluster"))


def eval_cluster(spark, sf):
    return evaluate_clustering(t.vectors(spark, sf))


def entry(spark: SparkSession) -> DataFrame:
    """Similarity evaluation: correlation of pair cosines with gold scores, raw and whitened five ways."""
    return eval_sts(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        src_dataset, src_embeddings, src_union_splits, contract, assemble, class_count, text_clean, prompt, truncate,
        sts_pairs, pair_labels, sts_scores, pairwise_l2, pair_features, pair_integrity,
        center, dim_mean, dim_std, cov, cor_matrix, isoscore, isoscore_whitened, anisotropy, pearson, spearman,
        dewhiten, dewhiten_cholesky, sts_whitened, eval_sts, pca2d,
        pool_mean, pool_masked, pool_layer, pool_range, pool_pair, pool_last, encode_hash, encode_job, encode_w2v,
        stratified_folds, nested_folds, holdout, clf_nb, accuracy, f1_weighted, confusion, rocauc_weighted,
        fold_summary, best_reg, standardize, nested_cv, eval_classify, eval_classify_nb, eval_classify_whitened,
        eval_classify_pairs, encode_classify,
        kmeans_lloyd, kmeans, kmeans_runs, eval_cluster,
    ]
    named = {f.__name__: f for f in plain}
    named |= {f"{f.__name__}_all": _of_all(f) for f in (src_dataset, src_union_splits, contract)}
    named |= {"cosine": cosine_query, "silhouette": silhouette_query}
    named |= {f"whiten_{m}": _whitened(m) for m in whiten.METHODS}
    named |= {f"clf_{c}": _probed(c) for c in ("softmax", "mlp", "lr", "svm", "rf")}
    return named | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    return oracles.sql() | (llm.oracle_sql() if llm else {})
