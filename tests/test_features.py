import numpy as np
import pytest

from pyspark.sql import functions as F

from coterie.functions.tables import to_wide
from coterie.operators import features
from coterie.operators.features import pca, principal_axes

import helpers as h


def plain_scores(x, n):
    a = x - x.mean(0)
    axes = np.linalg.svd(a, full_matrices=False)[2][:n].T
    return a @ (axes * np.where(axes[np.abs(axes).argmax(0), np.arange(n)] >= 0, 1, -1))


def test_long_cells_to_wide_rows(spark):
    cells = [("b", "g2", 2.0), ("a", "g1", 1.0), ("a", "g3", None), ("c", "other", 5.0), ("a", "g2", float("nan"))]
    df = spark.createDataFrame(cells, "sample_id string, gene string, value double").repartition(3)
    wide, genes = to_wide(df)
    assert genes == ["g1", "g2", "g3", "other"]
    got = {r.sample_id: r.features for r in wide.collect()}
    assert got["b"] == [None, 2.0, None, None] and got["c"] == [None, None, None, 5.0]
    assert got["a"][0] == 1.0 and np.isnan(got["a"][1]) and got["a"][2:] == [None, None]
    chosen = {r.sample_id: r.features for r in to_wide(df, ["g3", "g1"])[0].collect()}
    assert chosen == {"a": [None, 1.0], "b": [None, None], "c": [None, None]}
    assert "pivot" not in wide._jdf.queryExecution().toString().lower()
    assert to_wide(df.limit(0))[0].count() == 0
    with pytest.raises(Exception, match="two cells"):
        to_wide(df.unionByName(df.limit(1)))[0].collect()


def test_many_genes(spark):
    df = spark.range(3).selectExpr("id AS sample_id", "explode(sequence(0, 20000)) AS gene").withColumn(
        "value", F.col("sample_id") + F.col("gene"))
    wide, genes = to_wide(df)
    row = wide.filter("sample_id = 2").first()
    assert len(genes) == 20_001 and row.features[:3] == [2.0, 3.0, 4.0] and row.features[-1] == 20_002.0


@pytest.mark.parametrize(("rows", "wide", "n"), [(80, 6, 3), (50, 120, 10), (40, 300, 39), (30, 5, 5)])
def test_pca_equals_singular_vectors(spark, rows, wide, n):
    """Fewer and more features than rows, a few components and all of them."""
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(rows, wide)) * rng.uniform(0.5, 4, wide) + 100
    got = np.array(h.vector(pca(h.to_samples(spark, x).repartition(5), n), "features").tolist())
    assert np.allclose(got, plain_scores(x, n), atol=1e-5)


def test_pca_without_gaps_between_components(spark):
    """Noise without structure: close eigenvalues need a wide basis, not a cap."""
    x = np.random.default_rng(1).normal(size=(300, 60))
    got = np.array(h.vector(pca(h.to_samples(spark, x), 20), "features").tolist())
    assert np.allclose(got.T @ got, np.diag(np.diag(got.T @ got)), atol=1e-5)
    want = plain_scores(x, 20)
    assert np.allclose(got, want, atol=1e-4)


def test_pca_of_flat_and_copied_rows(spark):
    flat = np.array(h.vector(pca(h.to_samples(spark, np.ones((10, 4))), 2), "features").tolist())
    assert np.allclose(flat, 0)
    x = h.with_copies(60)
    got = np.array(h.vector(pca(h.to_samples(spark, x), 2), "features").tolist())
    assert np.allclose(got, plain_scores(x, 2), atol=1e-6)
    assert np.allclose(got[1:20], got[0])


def test_products_are_added_up_in_parts(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(30, 11))
    monkeypatch.setattr(features, "SUMMED_FEATURES", 4)
    axes = principal_axes(h.to_samples(spark, x).repartition(3), x.mean(0), 11)
    assert np.allclose(axes.T @ axes, np.eye(11), atol=1e-9)
