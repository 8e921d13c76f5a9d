import numpy as np
import pytest

import __spark_entry__ as entry
import check
import testbed
from embgauge.operators import whiten

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check.connection(SF)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    ours = check.canonical(frame.columns, [tuple(r) for r in frame.collect()])
    found = duck.sql(SQL[name])
    assert check.compare(ours, check.canonical(found.columns, found.fetchall())) == ""
    spark.catalog.clearCache()


def test_source_queries_read_every_document(spark, duck):
    ((n,),) = duck.sql("SELECT count(*) FROM documents").fetchall()
    for name in ("src_dataset_all", "contract_all"):
        assert entry.queries()[name](spark, SF).count() == n
    assert entry.queries()["src_union_splits_all"](spark, SF).agg({"n": "sum"}).first()[0] == n
    assert {"src_dataset_all", "src_union_splits_all", "contract_all"} <= set(SQL)


def test_cholesky_is_undone_as_in_the_reference(spark):
    rows = testbed.vectors(spark, SF).orderBy("row_id").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    covariance = np.cov(x.T)
    values, axes = np.linalg.eigh(covariance + whiten.REGULARIZATION * np.eye(x.shape[1]))
    w = np.linalg.cholesky((axes / values) @ axes.T).T
    back = (x - x.mean(axis=0)) @ w.T @ (covariance @ w.T).T + x.mean(axis=0)
    found = entry.queries()["dewhiten_cholesky"](spark, SF).orderBy("row_id", "dim").collect()
    assert {r.whitening for r in found} == {"cholesky"}
    np.testing.assert_allclose(np.array([r.value for r in found]).reshape(x.shape), back, atol=2e-6)


def test_entry(spark):
    assert entry.entry(spark).count() == 18
