import numpy as np
import pandas as pd
import pytest
from conftest import frame, matrix
from pyspark.sql import functions as F

from embgauge.operators import moments, pairs, ranks, whiten


@pytest.fixture(scope="module")
def x():
    draw = np.random.default_rng(3)
    return draw.normal(size=(120, 6)) @ draw.normal(size=(6, 6)) + 100.0


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_moments_do_not_depend_on_partitions(spark, x, parts):
    m = moments.moments(frame(spark, x, parts=parts))
    assert m.n == 120
    np.testing.assert_allclose(m.mean, x.mean(axis=0), rtol=1e-13)
    np.testing.assert_allclose(m.cov, np.cov(x.T), rtol=1e-9)
    np.testing.assert_allclose(m.std, x.std(axis=0), rtol=1e-10)
    np.testing.assert_allclose(np.diagonal(m.scaled_cov), 120 / 119, rtol=1e-10)


def test_moments_refuse_bad_input(spark, x):
    with pytest.raises(ValueError, match="at least one"):
        moments.moments(frame(spark, x).where("row_id < 0"))
    y = x.copy()
    y[5, 2] = np.nan
    with pytest.raises(ValueError, match="NaN"):
        moments.moments(frame(spark, y))
    y[:, 2] = 4.0
    with pytest.raises(ValueError, match=r"\[2\]"):
        moments.moments(frame(spark, y)).scaled_cov


def test_what_moments_shuffle_follows_the_cores_not_the_splits(spark, x):
    df = frame(spark, x)
    counts = []
    for parts in (16, 64):
        tiles = moments._gram_tiles(df.repartition(parts), "embedding", np.zeros(x.shape[1]))
        plan = tiles._jdf.queryExecution().executedPlan().toString()
        assert "Coalesce" in plan
        counts.append(df.repartition(parts).select("embedding").coalesce(8).rdd.getNumPartitions())
    assert counts == [8, 8]


@pytest.mark.parametrize("width, tile", [(7, 3), (9, 4), (300, 256), (4096, 256)])
def test_moments_by_column_blocks(spark, monkeypatch, width, tile):
    monkeypatch.setattr(moments, "TILE", tile)
    x = np.random.default_rng(2).normal(size=(30, width)) + 5
    found = moments.moments(frame(spark, x))
    np.testing.assert_allclose(found.cov, np.cov(x.T), atol=1e-10)
    np.testing.assert_allclose(found.mean, x.mean(axis=0), atol=1e-10)


def test_isoscore_equals_spectral_form(spark, x):
    cov = np.cov(x.T)
    d = len(cov)
    lam = np.linalg.eigvalsh(cov)
    scaled = np.sqrt(d) * lam / np.linalg.norm(lam)
    gap = np.linalg.norm(scaled - 1) / np.sqrt(2 * (d - np.sqrt(d)))
    phi = (d - gap**2 * (d - np.sqrt(d))) ** 2 / d**2
    assert moments.moments(frame(spark, x)).isoscore == pytest.approx((d * phi - 1) / (d - 1), abs=1e-9)
    assert moments.isoscore_of(np.eye(5)) == pytest.approx(1.0)
    assert moments.isoscore_of(np.diag([1.0, 0, 0])) == pytest.approx(0.0)


def scaled_covariance(x, method):
    cov = np.cov(x.T)
    scale = np.diag(x.std(axis=0)) if method.endswith("cor") else np.eye(len(cov))
    return np.linalg.inv(scale) @ cov @ np.linalg.inv(scale), scale


def textbook_map(x, method):
    """Whitening matrix by its textbook formula."""
    inner, scale = scaled_covariance(x, method)
    inner = inner + 1e-5 * np.eye(len(inner))
    lam, u = np.linalg.eigh(inner)
    u, lam = u[:, ::-1], lam[::-1]
    u = u * np.sign(np.diagonal(u))
    if method == "cholesky":
        return np.linalg.cholesky(np.linalg.inv(inner)).T
    w = np.diag(lam**-0.5) @ u.T
    return (u @ w if method.startswith("zca") else w) @ np.linalg.inv(scale)


@pytest.mark.parametrize("method", whiten.METHODS)
def test_whitening(spark, x, method):
    rows = frame(spark, x)
    (model,) = whiten.fit_whitening(rows, [method])
    np.testing.assert_allclose(model.whiten, textbook_map(x, method), rtol=1e-6, atol=1e-8)
    z = matrix(whiten.whiten(rows, [model]))
    np.testing.assert_allclose(z, (x - x.mean(axis=0)) @ textbook_map(x, method).T, atol=1e-6)
    # The added 1e-5 leaves an eigenvalue l at l / (l + 1e-5) instead of 1.
    smallest = np.linalg.eigvalsh(scaled_covariance(x, method)[0])[0]
    assert np.abs(np.cov(z.T) - np.eye(6)).max() < 1.01e-5 / smallest
    back = matrix(whiten.whiten(whiten.whiten(rows, [model]), [model], inverse=True))
    np.testing.assert_allclose(back, x, atol=1e-6 if method != "cholesky" else 1e-1)


def test_whitening_all_methods_in_one_pass_and_symmetry(spark, x):
    models = whiten.fit_whitening(frame(spark, x))
    out = whiten.whiten(frame(spark, x), [whiten.Unchanged(), *models])
    assert {r.whitening: r.n for r in out.groupBy("whitening").agg(F.count("*").alias("n")).collect()} == {
        m: 120 for m in ["none", *whiten.METHODS]
    }
    zca = next(m for m in models if m.method == "zca").whiten
    np.testing.assert_allclose(zca, zca.T, atol=1e-9)


def test_whitening_of_few_rows_and_unknown_method(spark):
    x = np.random.default_rng(0).normal(size=(4, 9))
    models = whiten.fit_whitening(frame(spark, x), ["zca", "pca", "cholesky"])
    assert all(np.isfinite(m.whiten).all() for m in models)
    with pytest.raises(ValueError, match="unknown whitening"):
        whiten.fit_whitening(frame(spark, x), ["ica"])


def test_models_can_be_stored(spark, x, tmp_path):
    models = whiten.fit_whitening(frame(spark, x), ["zca", "pca_cor"])
    whiten.models_frame(spark, models).write.parquet(str(tmp_path / "m"))
    back = {m.method: m for m in whiten.read_models(spark.read.parquet(str(tmp_path / "m")))}
    for m in models:
        np.testing.assert_array_equal(back[m.method].whiten, m.whiten)
        np.testing.assert_array_equal(back[m.method].dewhiten, m.dewhiten)


def test_float_vectors_are_computed_in_double(spark, x):
    floats = frame(spark, x).withColumn("embedding", F.col("embedding").cast("array<float>"))
    single = x.astype(np.float32).astype(np.float64)
    np.testing.assert_allclose(moments.moments(floats).cov, np.cov(single.T), rtol=1e-9)


def sided(spark, x):
    return frame(spark, x).selectExpr(
        "cast(row_id div 2 as bigint) pair_id", "cast(row_id % 2 + 1 as int) side", "embedding"
    )


def test_pairs_need_equal_sides(spark, x):
    rows = sided(spark, x[:7])
    with pytest.raises(ValueError, match="differ"):
        whiten.whiten_pairs(rows, "zca")
    with pytest.raises(ValueError, match="do not match"):
        pairs.check_sides(rows)
    assert tuple(pairs.pair_integrity(rows).first()) == (4, 3, 1)
    pairs.check_sides(sided(spark, x[:8]))


def test_pair_whitening_equals_scoring_in_one_pass(spark, x):
    rows = sided(spark, x)
    joined = pairs.join_sides(rows)
    for method in ("zca", "pca_cor"):
        apart = pairs.pair_cosine(pairs.join_sides(whiten.whiten_pairs(rows, method)))
        at_once = whiten.whitened_pair_cosine(joined, whiten.fit_whitening(rows, [method]))
        a = [r.cos_sim for r in apart.orderBy("pair_id").collect()]
        b = [r.cos_sim for r in at_once.orderBy("pair_id").collect()]
        np.testing.assert_allclose(a, b, atol=1e-12)


def test_rotations_leave_cosine_alone(spark, x):
    scored = whiten.whitened_pair_cosine(pairs.join_sides(sided(spark, x)), whiten.fit_whitening(sided(spark, x)))
    wide = scored.groupBy("pair_id").pivot("whitening").max("cos_sim").toPandas()
    np.testing.assert_allclose(wide["zca"], wide["pca"], atol=1e-8)
    np.testing.assert_allclose(wide["zca"], wide["cholesky"], atol=1e-8)
    np.testing.assert_allclose(wide["zca_cor"], wide["pca_cor"], atol=1e-8)


def test_moments_without_each_fold(spark, x):
    df = frame(spark, x, np.arange(len(x)) % 4).withColumnRenamed("label", "fold")
    found = moments.moments_without(df)
    assert sorted(found) == [0, 1, 2, 3]
    for fold, m in found.items():
        rest = x[np.arange(len(x)) % 4 != fold]
        assert m.n == len(rest)
        np.testing.assert_allclose(m.mean, rest.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(m.cov, np.cov(rest.T), rtol=1e-9)


def test_moments_without_folds_too_large_to_fetch_together(spark, x, monkeypatch):
    df = frame(spark, x, np.arange(len(x)) % 3).withColumnRenamed("label", "fold")
    together = moments.moments_without(df)
    monkeypatch.setattr(moments, "MAX_BROADCAST_BYTES", 0)
    apart = moments.moments_without(df)
    for fold, m in together.items():
        np.testing.assert_allclose(m.cov, apart[fold].cov, rtol=1e-9)


def test_pca_2d(spark, x):
    found = matrix(whiten.pca_2d(frame(spark, x).select("row_id", "embedding")).selectExpr("row_id", "array(x, y) embedding"))
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(np.abs(found), np.abs(u[:, :2] * s[:2]), atol=1e-6)


@pytest.mark.parametrize("share", [10_000, 10])
def test_spearman_with_ties_and_a_hot_value(spark, share, monkeypatch):
    monkeypatch.setattr(ranks, "HOT_SHARE", share)
    draw = np.random.default_rng(1)
    frame_ = pd.DataFrame(
        {"g": np.repeat([0, 1], 150), "a": draw.normal(size=300).round(1), "b": draw.integers(0, 6, 300).astype(float)}
    )
    frame_.loc[frame_.index % 3 == 0, "a"] = 0.5
    df = spark.createDataFrame(frame_).repartition(5)
    found = {r.g: r.spearman for r in ranks.spearman(df, "a", "b", ["g"]).collect()}
    for g, part in frame_.groupby("g"):
        assert found[g] == pytest.approx(part["a"].rank().corr(part["b"].rank()), abs=1e-12)
    whole = ranks.spearman(df, "a", "b").first().spearman
    assert whole == pytest.approx(frame_["a"].rank().corr(frame_["b"].rank()), abs=1e-12)


def test_running_totals(spark):
    draw = np.random.default_rng(2)
    data = pd.DataFrame({"g": draw.integers(0, 3, 400), "o": draw.permutation(400), "n": draw.integers(0, 9, 400)})
    data.loc[:250, "g"] = 1
    df = spark.createDataFrame(data).repartition(7)
    found = ranks.running_totals(df, "o", ["n"], ["g"]).toPandas().sort_values("o")
    data = data.sort_values("o")
    expected = data.groupby("g")["n"].cumsum() - data["n"]
    assert found["before_n"].tolist() == expected.tolist()
