"""Components of sparse rows against the eigenvectors of the whole covariance matrix."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from placelens.operators import components, zones
from placelens.operators.components import SparsePCA, principal_components


def table(spark, matrix, dense=False):
    make = (lambda r: Vectors.dense(r)) if dense else (lambda r: Vectors.sparse(len(r), [(int(j), float(r[j])) for j in np.flatnonzero(r)]))
    return spark.createDataFrame([(make(r),) for r in matrix], ["v"]).repartition(5)


def exact(matrix, k):
    centred = matrix - matrix.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / (len(matrix) - 1))
    return values[::-1][:k], vectors[:, ::-1][:, :k]


@pytest.mark.parametrize("dense", [False, True])
def test_variances_and_reconstruction(spark, dense):
    rng = np.random.default_rng(1)
    matrix = (rng.random((300, 60)) < 0.1) * rng.normal(1, 1, (300, 60))
    matrix[:, :3] += (rng.random((300, 1)) < 0.5) * [3.0, 2.0, 1.0]
    found, variances, mean = principal_components(table(spark, matrix, dense), 4)
    want, _ = exact(matrix, 4)
    assert np.allclose(mean, matrix.mean(axis=0))
    assert np.allclose(found.T @ found, np.eye(4), atol=1e-8)
    assert np.allclose(variances, want, rtol=1e-5)
    centred = matrix - mean
    error = ((centred - centred @ found @ found.T) ** 2).sum()
    assert error <= (1 + 1e-6) * ((centred**2).sum() - want.sum() * (len(matrix) - 1))


def test_more_columns_than_rows_and_empty_rows(spark):
    matrix = np.zeros((7, 3000))
    matrix[np.arange(6), np.arange(6) * 400] = 1 + np.arange(6)
    found, variances, _ = principal_components(table(spark, matrix), 3)
    assert found.shape == (3000, 3)
    assert np.allclose(variances, np.linalg.svd(matrix - matrix.mean(axis=0), compute_uv=False)[:3] ** 2 / 6, rtol=1e-6)
    few, _, _ = principal_components(table(spark, matrix[:, :400]), 900)
    assert few.shape == (400, 400)
    with pytest.raises(ValueError):
        principal_components(table(spark, matrix).limit(0), 2)


def test_model_in_a_pipeline_and_its_offset(spark):
    matrix = np.random.default_rng(2).normal(size=(40, 6))
    rows = table(spark, matrix)
    model = SparsePCA(k=2, inputCol="v", outputCol="out").fit(rows)
    scores = np.array([r[0] for r in model.transform(rows).select(vector_to_array("out")).collect()])
    assert np.allclose(scores.mean(axis=0), model.offset)
    assert np.allclose(np.sort(scores.var(axis=0, ddof=1)), np.sort(exact(matrix, 2)[0]), rtol=1e-6)


def test_zone_scores_are_centred_and_rows_stay_sparse(spark, monkeypatch):
    seen = []
    real = components.principal_components
    monkeypatch.setattr(components, "principal_components", lambda rows, k: seen.append(rows.first()[0]) or real(rows, k))
    rows = [(f"b{i}", f"Kind{i % 30}, Trade{i % 7}", 1.0, 2.0, 3.0, i, None) for i in range(210)]
    places = spark.createDataFrame(rows, "business_id string, categories string, latitude double, longitude double, stars double, review_count int, attributes string")
    scored = zones.cluster_features(places, missing_price=0).select(*zones.COMPONENTS).collect()
    assert np.allclose(np.array([list(r) for r in scored]).mean(axis=0), 0, atol=1e-9)
    assert len(seen[0].indices) == 2
