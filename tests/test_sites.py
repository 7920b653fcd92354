"""The index of category keys against the full product of texts and keys."""

import random

import pytest
from pyspark.sql import functions as F

from placelens.functions.lexicons import CATEGORY_FALLBACKS
from placelens.operators import sites

KEYS = [
    "cat_pizza", "cat_fast_food", "cat_coffee_&_tea", "cat_bars", "cat_sports_bars", "cat_american_(new)", "cat_tex-mex", "cat_x", "cat_bb",
    "cat_pub", "cat_sushi_bars", "cat_Hot_Dogs", "cat_", "cat_crêperies", "cat_restaurants", "cat_bakeries", "cat_an", "cat_&", "cat__q_",
]
TEXTS = [
    "pizza", "Pizza please", "a fast-food place", "x", "bb", "b", "coffee", "tea & coffee", "bar", "barn", "crêpe", "crêperies", "the an", "an", "resta",
    "hot dogs, sushi", "sports-bar\nPub;tea", "  ", "&", "q", "_q_", "zzz", "american (new)", "(new)", "mex", "new york restaurants and bakeries", "piz", "pi", "p",
]


def _random_texts(n, seed):
    rng = random.Random(seed)
    pieces = [w for k in KEYS for w in (k[4:], k[4:8], k[5:9].replace("_", " "))] + ["or", "and", "the", ",", "&", "ab"]
    return ["".join(rng.choice(pieces) + rng.choice([" ", "", ", ", "-"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_index_finds_every_key_that_scores(spark):
    texts = sorted({t for t in TEXTS + _random_texts(400, 3)})
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, chunk string")
    keys = spark.createDataFrame([(k,) for k in KEYS], "cat_key string")
    every = chunks.crossJoin(keys).where(sites.score_category_match(F.col("chunk"), F.col("cat_key")) > 0).select("chunk_id", "cat_key")
    found = sites.candidate_keys(chunks, keys)
    assert every.count() > 500
    assert every.exceptAll(found).count() == 0
    assert found.count() < 0.5 * len(texts) * len(KEYS)


def test_scored_pairs_do_not_grow_with_unrelated_keys(spark):
    texts = spark.createDataFrame([("1", "pizza"), ("2", "hot dogs"), ("3", "sushi bar")], "chunk_id string, chunk string")
    sizes = []
    for n in (100, 10_000):
        keys = spark.range(n).select(F.concat(F.lit("cat_"), F.md5(F.col("id").cast("string"))).alias("cat_key"))
        sizes.append(sites.candidate_keys(texts, keys.unionByName(spark.createDataFrame([(k,) for k in KEYS], "cat_key string"))).count())
    assert sizes[0] == sizes[1] > 0


def _requests(spark, rows):
    return spark.createDataFrame(rows, "request_id int, city string, state string, text string")


def test_suggestions_and_fallbacks(spark):
    listed = CATEGORY_FALLBACKS[-1], CATEGORY_FALLBACKS[1]
    keys = spark.createDataFrame(
        [("a", "s", k) for k in ("cat_pizza", "cat_pizza_ovens", "cat_zoo", *listed)] + [("b", "s", f"cat_k{i}") for i in range(9)] + [(None, "s", "cat_pizza")],
        "city string, state string, cat_key string",
    )
    asked = _requests(spark, [(1, "a", "s", "pizza"), (2, "a", "s", "qqqq"), (3, "b", "s", "pizza"), (4, "c", "s", "pizza"), (5, "a", "s", "  "), (6, "a", "s", None), (7, None, "s", "pizza"), (8, "a", "s", "pizza")])
    got = {}
    for r in sites.suggest_categories(asked, keys, n=3).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append((r["rank"], r["cat_key"]))
    pizza = [(1, "cat_pizza"), (2, "cat_pizza_ovens")]
    assert got == {1: pizza, 8: pizza, 2: [(1, listed[1]), (2, listed[0])], 3: [(i + 1, f"cat_k{i}") for i in range(3)]}


@pytest.mark.parametrize("text, want", [("pizza", ["cat_pizza"]), ("zzzz", []), ("pizza, pub", ["cat_pizza", "cat_pub"]), ("PIZZA", ["cat_pizza"])])
def test_resolved_keys(spark, text, want):
    keys = spark.createDataFrame([("a", "s", k) for k in ("cat_pizza", "cat_pub", "cat_zoo")], "city string, state string, cat_key string")
    rows = sites.resolve_categories(_requests(spark, [(1, "a", "s", text)]), keys).collect()
    assert sorted(r["cat_key"] for r in rows) == want


def test_no_rows(spark):
    keys = spark.createDataFrame([], "city string, state string, cat_key string")
    for call in (sites.resolve_categories, sites.suggest_categories):
        assert call(_requests(spark, []), keys).count() == 0
        assert call(_requests(spark, [(1, "a", "s", "pizza")]), keys).count() == 0


def test_sites_are_rejected_with_a_reason(spark):
    ref = spark.createDataFrame([("big", "Tea, Bars")] * 10 + [("small", "Tea")] * 9, "slice string, categories string")
    asked = [(1, "big", "Tea"), (2, "big", "Tea, Pizza"), (3, "small", "Tea"), (4, "none", "Pizza"), (5, "big", None), (6, None, "Tea"), (7, "big", "")]
    rows = sites.check_sites(spark.createDataFrame(asked, "site_id int, slice string, categories string"), ref).collect()
    few = "too few reference places"
    got = {r["site_id"]: (r["reference_rows"], r["reject_reason"]) for r in rows}
    assert got == {1: (10, None), 2: (10, "unknown category"), 3: (9, few), 4: (0, few), 5: (10, None), 6: (0, few), 7: (10, None)}
    assert len(rows) == len(asked)
    assert all(r["reject_reason"] is None for r in sites.check_sites(spark.createDataFrame(asked[:1], "site_id int, slice string, categories string"), ref, 10).collect())
