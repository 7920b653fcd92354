import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens.llm import knn_join
from placelens.llm.knn_join import top_inner_products


def brute(rows, every, top=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v in good if i % every == 0}):
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)
        out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:top])]
    return sorted(out)


def search(spark, rows, every):
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cell string")
    found = top_inner_products(vectors, F.col("id") % every == 0)
    assert found.columns == ["query_id", "rank", "id", "score"]
    return sorted(tuple(r) for r in found.collect())


def clusters(n, seed=1, width=6, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    return [(i, (centres[rng.integers(9)] * rng.uniform(0.5, 2) + rng.normal(size=width) * spread).tolist()) for i in range(n)]


@pytest.fixture
def small_pieces(monkeypatch):
    for name, value in {"GROUP_QUERIES": 7, "PIECE_ROWS": 40, "BLOCK_ROWS": 16, "BLOCK_SCORES": 64, "MAX_PIVOTS": 12}.items():
        monkeypatch.setattr(knn_join, name, value)


def test_many_groups_and_pieces(spark, small_pieces):
    rows = clusters(700)
    assert search(spark, rows, 10) == brute(rows, 10)


def test_odd_rows_ties_and_a_hot_vector(spark, small_pieces):
    rows = clusters(150) + [(1000 + i, [0.5] * 6) for i in range(200)] + [(0, [1.0, 2.0]), (10, [1e-9] * 6), (10, [1e-9] * 6), (10, [2.0] * 6), (20, [])]
    rows += [(30, None), (40, [1.0, None]), (50, [math.nan] * 6), (60, [math.inf] * 6), (None, [3.0] * 6), (1000, [0.5] * 6), (70, [9.0] * 6), (80, [-9.0] * 8)]
    assert search(spark, rows, 10) == brute(rows, 10)


def test_an_id_with_very_many_rows(spark, small_pieces):
    rows = clusters(90) + [(10, [0.1 * i] * 6) for i in range(80)] + [(20, [1.0] * 6)] * 30
    assert search(spark, rows, 10) == brute(rows, 10)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(4)
    for size in (1e3, 1e6):
        rows = [(i, (rng.integers(-3, 3, 4) + size * np.array([1, -1, 1, -1])).tolist()) for i in range(60)]
        assert search(spark, rows, 20) == brute(rows, 20)


def test_few_and_no_rows(spark):
    assert search(spark, [], 10) == []
    assert search(spark, [(0, [1.0])], 10) == []
    assert search(spark, [(1, [1.0])], 10) == []
    assert search(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])], 10) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]


def test_bounds_spare_far_cells(spark, monkeypatch):
    """Queries of one tight cluster do not get the rows of the others."""
    rng = np.random.default_rng(6)
    centres = 10 * np.eye(4)
    rows = [(i, (centres[i % 4] + rng.normal(size=4) * 0.01).tolist()) for i in range(2000)]
    sent = []
    whole = knn_join.deal_rows

    def watched(rows, plan):
        out = whole(rows, plan)
        sent.append(out.count())
        return out

    monkeypatch.setattr(knn_join, "deal_rows", watched)
    got = search(spark, rows, 400)
    assert got == brute(rows, 400)
    assert sent[0] < 1000
