import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from embgauge.functions import text, vectors


def test_cosine_of_a_zero_vector_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0], [1.0, 2.0, 3.0]), ([1.0, 2.0, 2.0], [2.0, 4.0, 4.0])], ["a", "b"])
    assert [r[0] for r in df.select(vectors.cosine("a", "b")).collect()] == [0.0, pytest.approx(1.0)]


def test_euclidean_and_elementwise(spark):
    df = spark.createDataFrame([([1.0, 5.0], [4.0, 1.0])], ["a", "b"])
    row = df.select(
        vectors.euclidean("a", "b").alias("d"), vectors.pair_features("a", "b").alias("f"), vectors.add("a", "b").alias("s")
    ).first()
    assert (row.d, row.f, row.s) == (5.0, [3.0, 4.0, 4.0, 5.0], [5.0, 6.0])


@pytest.mark.parametrize("bad", [[[1.0, 2.0], [1.0]], [[1.0, 2.0], None], [[1.0, 2.0], [None, 1.0]]])
def test_ragged_or_missing_vectors_fail(spark, bad):
    df = spark.createDataFrame([(v, [1.0, 1.0]) for v in bad], "a array<double>, b array<double>").coalesce(1)
    with pytest.raises(Exception, match="width|nulls"):
        df.select(vectors.cosine("a", "b")).collect()


def test_mean_and_sum_vectors(spark):
    x = np.random.default_rng(0).normal(size=(50, 5))
    row = frame(spark, x).agg(vectors.mean_vector("embedding").alias("m"), vectors.sum_vector("embedding").alias("s")).first()
    np.testing.assert_allclose(row.m, x.mean(axis=0))
    np.testing.assert_allclose(row.s, x.sum(axis=0))


def test_text_rules(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, " "), (3, "a")], "row_id int, text string")
    seen = {
        rule: [r[0] for r in df.orderBy("row_id").select(text.clean_text(F.col("text"), rule)).collect()]
        for rule in ("keep", "blank_to_space", "null_to_blank", "null_to_space")
    }
    assert seen == {
        "keep": [None, "", " ", "a"],
        "blank_to_space": [None, " ", " ", "a"],
        "null_to_blank": ["", "", " ", "a"],
        "null_to_space": [" ", "", " ", "a"],
    }
    with pytest.raises(ValueError):
        text.clean_text(F.col("text"), "other")
    with pytest.raises(ValueError):
        text.Profile.of("no such encoder")


def test_prompt_keeps_percent_signs_and_needs_one_slot(spark):
    df = spark.createDataFrame([("50% {x}",)], ["text"])
    assert df.select(text.decorate(F.col("text"), "<{text}>")).first()[0] == "<50% {x}>"
    with pytest.raises(ValueError):
        text.decorate(F.col("text"), "no slot")


def test_tokens_and_truncation(spark):
    df = spark.createDataFrame([(0, "  a\tb\n c "), (1, " "), (2, " ".join("w" * 70))], "row_id long, text string")
    tokens = text.token_table(df)
    assert [tuple(r) for r in tokens.where("row_id = 0").orderBy("token_pos").collect()] == [
        (0, 0, "a"), (0, 1, "b"), (0, 2, "c"),
    ]
    counts = {r.row_id: r["count"] for r in text.truncate_tokens(tokens).groupBy("row_id").count().collect()}
    assert counts == {0: 3, 2: 64}


def test_names():
    assert text.strip_side("stsb1") == "stsb" and text.strip_side("sts122") == "sts12"
    with pytest.raises(ValueError):
        text.strip_side("subj")
    assert text.whitened_name("zca_cor", "bert") == "whzca-cor-bert"
    assert text.method_label("pca") == "pca"
