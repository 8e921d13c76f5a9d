import numpy as np
import pytest
from pyspark.sql import functions as F

from embgauge.functions.text import Profile
from embgauge.operators import encode, pool
from embgauge.sources.embeddings import read_embeddings


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(0, "a b a"), (1, ""), (2, " \t"), (3, "über b"), (4, "x")]
    return spark.createDataFrame(rows, "row_id long, text string").repartition(2)


def lengths():
    class Lengths:
        def encode(self, batch):
            return np.array([[len(t), len(batch)] for t in batch], dtype=np.float32)

    return lambda: Lengths()


def test_encoder_gets_prepared_texts_in_batches(spark):
    df = spark.createDataFrame([(i, None if i == 0 else "ab") for i in range(10)], "row_id long, text string").coalesce(1)
    profile = Profile("lengths", "null_to_space", "<{text}>", batch_size=4)
    rows = encode.encode(df, lengths(), profile=profile).orderBy("row_id").collect()
    assert [r.embedding[0] for r in rows] == [3.0] + [4.0] * 9
    assert [r.embedding[1] for r in rows] == [4.0] * 8 + [2.0] * 2
    assert rows[0].text is None


def test_token_limit_applies_after_the_prompt(spark):
    df = spark.createDataFrame([(0, "a b c d e"), (1, "a  b")], "row_id long, text string")
    rows = encode.encode(df, lengths(), profile=Profile("short", template="> {text}", max_tokens=4)).orderBy("row_id")
    assert [r.embedding[0] for r in rows.collect()] == [len("> a b c"), len("> a  b")]


def test_text_without_a_rule_must_not_be_missing(spark):
    df = spark.createDataFrame([(0, None)], "row_id long, text string")
    with pytest.raises(Exception, match="no rule for missing text"):
        encode.encode(df, lengths(), profile=Profile.of("simcse")).collect()


def test_hashed_ngrams_by_sql_and_by_worker_agree(texts):
    by_sql = {r.row_id: r.embedding for r in encode.encode_hashed(texts, width=8, n=3).collect()}
    rows = encode.encode(texts, encode.hashed_ngrams(8, 3)).collect()
    assert set(by_sql) == {r.row_id for r in rows} == {0, 1, 2, 3, 4}
    for r in rows:
        np.testing.assert_allclose(by_sql[r.row_id], r.embedding, atol=1e-12)
    assert by_sql[1] == [0.0] * 8 and np.linalg.norm(by_sql[3]) == pytest.approx(1.0)


def test_hashed_ngrams_of_more_words_than_digests_are_looked_at_together(monkeypatch):
    text = "über b c a b\t\tc a"
    whole = encode.HashedNgrams(8, 3).encode([text, ""])
    monkeypatch.setattr(encode, "DIGEST_BYTES", 64)
    np.testing.assert_array_equal(encode.HashedNgrams(8, 3).encode([text, ""]), whole)


def test_a_bucket_of_a_text_is_one_sum(texts):
    plan = encode.encode_hashed(texts, n=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "sum(sign" in plan.replace("`", "")
    assert len(encode.encode_hashed(texts.unionByName(texts)).collect()) == 5


def test_word_vectors(spark):
    df = spark.createDataFrame([(i, "red blue green " * 3) for i in range(20)] + [(20, "")], "row_id long, text string")
    rows = encode.encode_word2vec(df, width=4).collect()
    assert len(rows) == 21 and all(len(r.embedding) == 4 for r in rows)


def test_sweep_writes_all_datasets_per_encoder(spark, texts, tmp_path):
    root = str(tmp_path / "store")
    base = texts.withColumns({"split": F.lit("train"), "side": F.lit(None).cast("int"), "label": F.lit(1)})
    both = base.withColumn("dataset", F.lit("d1")).unionByName(base.withColumn("dataset", F.lit("d2")))
    encode.encode_sweep(both, {Profile("h8"): encode.hashed_ngrams(8), Profile("h4"): encode.hashed_ngrams(4)}, root)
    assert read_embeddings(spark, root, "d2", "h4").select(F.size("embedding")).distinct().first()[0] == 4
    assert read_embeddings(spark, root, "d1", "h8").count() == 5


@pytest.fixture(scope="module")
def states(spark):
    """Hidden states [text][layer][token][3] of two texts with 4 and 1 tokens, four layers."""
    draw = np.random.default_rng(0)
    data = {0: draw.normal(size=(4, 4, 3)), 1: draw.normal(size=(4, 1, 3))}
    rows = [
        (t, layer, p, p != 2, [float(v) for v in h[layer, p]])
        for t, h in data.items() for layer in range(4) for p in range(h.shape[1])
    ]
    schema = "row_id long, layer int, token_pos int, attended boolean, embedding array<double>"
    return data, spark.createDataFrame(rows, schema).repartition(6)


def pooled(df):
    return {r.row_id: np.array(r.embedding) for r in df.collect()}


def test_pooling_strategies(states):
    data, tokens = states
    cases = [
        (pool.pool(tokens, "layer", 1), lambda h: h[1].mean(axis=0)),
        (pool.pool(tokens, "range", 2), lambda h: h[-2:].mean(axis=0).mean(axis=0)),
        (pool.pool(tokens, "pair", (0, 2)), lambda h: (h[0] + h[2]).mean(axis=0)),
        (pool.pool(tokens, "pair", (1, 1)), lambda h: 2 * h[1].mean(axis=0)),
        (pool.pool(tokens, "layer", 3, masked=True), lambda h: h[3][np.arange(len(h[3])) != 2].mean(axis=0)),
        (pool.last_token(tokens), lambda h: h[-1][-1]),
    ]
    for found, expected in cases:
        found = pooled(found)
        for text, h in data.items():
            np.testing.assert_allclose(found[text], expected(h), atol=1e-12)


def test_pooling_hashes_tokens_and_sorts_none(states):
    _, tokens = states
    found = [pool.mean_pool(tokens), pool.mean_pool(tokens, masked=True), pool.last_token(tokens, layers=4)]
    found += [pool.pool(tokens, s, p, layers=4) for s, p in (("layer", 1), ("range", 2), ("pair", (0, 2)))]
    for frame in found:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan
        assert not any(node in plan for node in ("ObjectHashAggregate", "SortAggregate", "Sort ["))


def test_pooling_of_vectors_of_two_widths_or_none(spark):
    schema = "row_id long, layer int, token_pos int, attended boolean, embedding array<float>"
    rows = spark.createDataFrame([(0, 0, 0, True, [1.0, 2.0]), (0, 0, 1, True, [1.0, 2.0, 3.0])], schema)
    for width in (2, 3):
        with pytest.raises(Exception, match="another width"):
            pool.mean_pool(rows, width=width).collect()
    with pytest.raises(Exception, match="another width"):
        pool.last_token(rows, width=2).collect()
    assert pool.last_token(rows, width=3).first().embedding == [1.0, 2.0, 3.0]
    nothing = rows.where("row_id > 0")
    assert pool.mean_pool(nothing).collect() == pool.last_token(nothing, layers=1).collect() == []
    missing = spark.createDataFrame([(0, 0, 0, True, None)], schema)
    assert pool.last_token(missing, width=2).first().embedding is None


@pytest.mark.parametrize("strategy, pooling", [("layer", (1, 2)), ("pair", 3), ("mean", 1), ("pair", (1, 2, 3))])
def test_unknown_pooling(states, strategy, pooling):
    with pytest.raises(ValueError, match="unknown pooling"):
        pool.pool(states[1], strategy, pooling)


def test_missing_layer_is_an_error(states):
    with pytest.raises(Exception, match="lacks one of the layers"):
        pool.pool(states[1], "pair", (0, 7)).collect()
