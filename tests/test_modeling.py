import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from placelens.functions.columns import category_set
from placelens.operators import modeling, zones


def test_vocabularies_are_whole(spark):
    rows = [(f"b{i}", f"Kind{i % 150}, Trade{i % 151}") for i in range(302)]
    places = spark.createDataFrame(rows, "business_id string, categories string")
    vectors = modeling.category_text_vectors(places, dims=2)[0]
    # Every word is in two rows at least.
    assert vectors.first()["category_tf"].size >= 150 + 151

    rows = [(f"b{i}", f"Kind{i}, Trade{i}") for i in range(2100)]
    places = spark.createDataFrame(rows, "business_id string, categories string").withColumn("cats", category_set(F.col("categories")))
    ready = Pipeline(stages=modeling.assemble_stages([])).fit(places).transform(places)
    assert ready.first()["features"].size == 4200


def test_zone_categories_are_whole(spark, monkeypatch):
    sizes = []
    real = zones.CountVectorizer
    monkeypatch.setattr(zones, "CountVectorizer", lambda **k: sizes.append(k["vocabSize"]) or real(**k))
    places = spark.createDataFrame([(f"b{i}", f"Kind{i % 9}, Trade{i % 7}") for i in range(40)], "business_id string, categories string")
    assert len(zones.fit_components(places).stages[0].vocabulary) == 16
    assert sizes[0] > 10**9


def test_tiers_name_their_model(spark):
    random.seed(1)
    rows = [(f"b{i}", float(s), random.random() + s, ["a"], 1.0) for i, s in enumerate([2.0] * 40 + [3.5] * 40 + [5.0] * 10)]
    table = spark.createDataFrame(rows, "business_id string, stars double, x double, cats array<string>, weight double")
    out = modeling.tiered_regression(table, table, "stars", ["x"], rounds=2, min_tier_rows=28)
    seen = {(r["pred_tier"], r["tier_rows"], r["model_used"]) for r in out.collect()}
    assert seen == {(0.0, 40, "tier"), (1.0, 40, "tier"), (2.0, 10, "all")}
    own = modeling.tiered_regression(table, table, "stars", ["x"], rounds=2)
    assert {r["model_used"] for r in own.collect()} == {"tier"}
    with pytest.raises(ValueError, match="tier 2"):
        modeling.tiered_regression(table.where("stars < 5"), table, "stars", ["x"], rounds=2)
