"""Attribute, hour and category texts as they come in place tables."""

from pyspark.sql import functions as F

from placelens.functions.columns import bigrams, category_set, half_star, price_symbol, safe_double
from placelens.functions.dict_text import clean_value, days_open, hours_flags, parse_dict
from placelens.operators import cleaning, features, joins


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_parse_dict_cases(spark):
    parse = lambda t: one(spark, t, parse_dict(F.col("x")))
    assert parse("{'WiFi': \"u'free'\"}") in ({"WiFi": "u'free'"}, {"WiFi": "'free'"})
    assert parse("{'BusinessParking': \"{'garage': False, 'street': True}\"}") == {
        "BusinessParking": "{'garage': False, 'street': True}"
    }
    assert parse("{'GoodForKids': None, 'HasTV': True}") == {"GoodForKids": "None", "HasTV": "True"}
    assert parse(u"{u'Caters': u'yes'}") == {"Caters": "yes"}
    for bad in ("", None, "nan", "not a dict", "{broken"):
        assert parse(bad) == {}


def test_hours(spark):
    def flags(t):
        cols = hours_flags(F.col("x"))
        row = spark.createDataFrame([(t,)], "x string").select(*[c.alias(n) for n, c in cols.items()]).first()
        return tuple(row)

    assert flags("{}") == (0, 0, 0)
    assert flags("{'Friday': '18:0-2:0'}") == (0, 1, 0)
    assert flags("{'Saturday': '8:0-21:0', 'Monday': 'broken'}") == (1, 0, 1)
    assert flags("{'Monday': '8-'}") == (0, 0, 0)
    assert flags(None) == (0, 0, 0)
    days = lambda t: one(spark, t, days_open(F.col("x")))
    assert days("{'Monday': '0:0-0:0', 'Sunday': 'closed', 'Friday': '9:0-17:0'}") == 1.0
    assert days("{}") is None and days("broken") is None


def test_clean_value_and_price(spark):
    clean = lambda t: one(spark, t, clean_value(F.col("x")))
    assert [clean(t) for t in ("True", "false", " u'free' ", "'2'", "None", "007")] == ["1", "0", "free", "2", "None", "7"]
    symbol = lambda t: one(spark, t, price_symbol(F.col("x")))
    assert symbol("{'RestaurantsPriceRange2': '3'}") == "$$$"
    assert symbol('{"RestaurantsPriceRange2": 9}') == "$$$$"
    assert symbol(None) == "N/A"


def test_category_set_trims_and_sorts(spark):
    assert one(spark, " Pizza, Bars ,Pizza,,", category_set(F.col("x"))) == ["Bars", "Pizza"]
    assert one(spark, None, category_set(F.col("x"))) == []


def test_bigrams(spark):
    pairs = lambda t: one(spark, t, bigrams(F.split("x", " ")))
    assert pairs("a b c") == ["a b", "b c"] and pairs("a") == []


def test_half_star_rounds_ties_to_even(spark):
    rows = spark.createDataFrame([(1.25,), (1.75,), (0.2,), (9.0,), (None,)], "x double").select(half_star(F.col("x")))
    assert [r[0] for r in rows.collect()] == [1.0, 2.0, 1.0, 5.0, None]


def test_safe_double(spark):
    value = lambda t: one(spark, t, safe_double(F.col("x")))
    assert value("1.5") == 1.5 and value("abc") is None and value("NaN") is None and value(None) is None


def test_nested_attribute_drops_plain_parent_everywhere(spark):
    rows = [
        ("a", "{'BusinessParking': \"{'garage': True, 'valet': False}\", 'WiFi': \"u'free'\"}"),
        ("b", "{'BusinessParking': 'None', 'HasTV': 'True'}"),
    ]
    flat = features.flatten_attributes(spark.createDataFrame(rows, "business_id string, attributes string"))
    assert {tuple(r) for r in flat.collect()} == {
        ("a", "attr_businessparking_garage", "1"),
        ("a", "attr_businessparking_valet", "0"),
        ("a", "attr_wifi", "free"),
        ("b", "attr_hastv", "1"),
    }


def test_normalize_state(spark):
    state = lambda t: one(spark, t, cleaning.normalize_state(F.col("x")))
    assert state(" pa ") == "PA" and state("  ") is None and state(None) is None


def test_dedup_keeps_first_in_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert {tuple(r) for r in cleaning.dedup(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", 5, "z")}


def test_join_features_refuses_duplicate_keys(spark):
    import pytest

    left = spark.createDataFrame([("a", 1), ("a", 2)], "business_id string, x int")
    right = spark.createDataFrame([("a", 1)], "business_id string, y int")
    with pytest.raises(Exception, match="duplicate join key"):
        joins.join_features(left, right).collect()


def test_pivot_indicators(spark):
    long = spark.createDataFrame([("b1", "cat_tea", 1), ("b1", "cat_bar", 1), ("b2", "cat_tea", 1), ("b3", "cat_else", 1)], "business_id string, cat_key string, flag int")
    wide = features.pivot_indicators(long, "business_id", "cat_key", "flag", ["cat_bar", "cat_tea"])
    assert sorted(tuple(r) for r in wide.collect()) == [("b1", 1, 1), ("b2", 0, 1), ("b3", 0, 0)]


def test_attribute_values_are_not_broadcast(spark, tmp_path):
    """The estimate for opened attributes is that of a small file, whatever they unfold to."""
    rows = [(f"b{i % 6}", "{'HasTV': 'True', 'WiFi': \"u'free'\"}" if i % 3 else None) for i in range(8)] + [(None, "{'HasTV': 'True'}")]
    spark.createDataFrame(rows, "business_id string, attributes string").write.parquet(str(tmp_path / "places"))
    places = spark.read.parquet(str(tmp_path / "places"))
    flat = features.flatten_attributes(places)
    filled = features.fill_attributes(places, flat, ["attr_hastv", "attr_wifi"])
    dummies = features.categorical_dummies(places, flat, ["attr_wifi", "attr_none"])
    for df in (filled, dummies):
        joins = [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [business_id" in line]
        assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    plain = places.selectExpr("business_id", "explode(array('attr_hastv', 'attr_wifi')) AS attr_key").join(flat, ["business_id", "attr_key"], "left")
    expected = plain.selectExpr("business_id", "attr_key", "coalesce(value, '0')")
    assert sorted(map(str, filled.collect())) == sorted(map(str, expected.toDF(*filled.columns).collect()))
    assert {r["dummy"] for r in dummies.collect()} == {"attr_wifi_free", "attr_wifi_unknown"}
