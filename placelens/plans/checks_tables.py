"""Checked queries: sources, cleaning, joins and attribute features."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.functions.columns import category_set, price_tier, split_categories
from placelens.operators import cleaning, features, joins
from placelens.plans import views as v
from placelens.plans.registry import check, rounded
from placelens.plans.views import tfidf_sql, with_views
from placelens.session import shared_folder
from placelens.sources import readers, writers

# --- sources -----------------------------------------------------------------------------------------------

_MAP = """mapped AS (SELECT 'gm_' || substr(sha256(url), 1, 16) AS business_id, name, coalesce(address, '') AS address,
  trim(regexp_extract(address, ',\\s*([^,]+),\\s*([A-Z]{2})\\s+(\\d{5}(?:-\\d{4})?)\\s*$', 1)) AS city,
  trim(regexp_extract(address, ',\\s*([^,]+),\\s*([A-Z]{2})\\s+(\\d{5}(?:-\\d{4})?)\\s*$', 2)) AS state,
  coalesce(nullif(regexp_extract(address, ',\\s*([^,]+),\\s*([A-Z]{2})\\s+(\\d{5}(?:-\\d{4})?)\\s*$', 3), ''), zipcode) AS postal_code,
  try_cast(lat AS DOUBLE) AS latitude, try_cast(lon AS DOUBLE) AS longitude,
  least(greatest(coalesce(try_cast(rating AS DOUBLE), 0), 0), 5) AS stars,
  coalesce(try_cast(rating_count AS DOUBLE), 0)::BIGINT AS review_count,
  CASE WHEN try_cast(price_category AS DOUBLE) IS NULL THEN '{''DataSource'': ''GoogleMaps''}'
    ELSE '{''RestaurantsPriceRange2'': ''' || least(greatest(round_even(price_category::DOUBLE, 0)::INTEGER, 1), 4)
      || ''', ''DataSource'': ''GoogleMaps''}' END AS attributes, detail, url
 FROM map_export WHERE try_cast(lat AS DOUBLE) IS NOT NULL AND try_cast(lon AS DOUBLE) IS NOT NULL AND trim(name) <> '')"""


@check("sr3_scan_reviews_for", with_views("places reviews", """SELECT review_id, business_id, stars, length(text) AS n
 FROM reviews WHERE business_id IN (SELECT business_id FROM places WHERE is_open = 1)"""))
def scan_reviews(spark, sf):
    rows = readers.scan_reviews_for(v.places(spark, sf).where("is_open = 1"), v.reviews(spark, sf))
    return rows.select("review_id", "business_id", "stars", F.length("text").alias("n"))


@check("sr4_map_export_places", with_views("map_export", """SELECT business_id, name, address, city, state, postal_code,
 latitude, longitude, stars, review_count, attributes, detail, url FROM mapped""", _MAP))
def map_export(spark, sf):
    names = "business_id name address city state postal_code latitude longitude stars review_count attributes detail url"
    return readers.map_export_places(v.map_export(spark, sf)).select(*names.split())


@check("sr5_union_sources", with_views("places map_export", """SELECT business_id, name, city, state, stars, review_count,
 CASE WHEN detail IS NULL THEN 1 ELSE 0 END AS no_detail FROM (
 SELECT business_id, name, city, state, stars, review_count, NULL AS detail FROM places UNION ALL
 SELECT business_id, name, city, state, stars, review_count, detail FROM mapped)""", _MAP))
def union_sources(spark, sf):
    both = readers.union_sources(v.places(spark, sf), readers.map_export_places(v.map_export(spark, sf)))
    return both.select(
        "business_id", "name", "city", "state", "stars", "review_count", F.col("detail").isNull().cast("int").alias("no_detail")
    )


@check("sr8_merchant_master", with_views("places", """SELECT business_id, name, latitude, longitude, city, state, stars,
 review_count, is_open, categories FROM places"""))
def merchants(spark, sf):
    return writers.merchant_master(v.places(spark, sf))


@check("sr9_dataset_manifest")
def manifest(spark, sf):
    return writers.dataset_manifest(spark, {t: f"{sf}/{t}.parquet" for t in ("part", "lineitem", "documents")})


@check("sr1_read_places", with_views("places", """SELECT business_id, name, address, state, latitude, stars, review_count, is_open, attributes, categories FROM places"""))
def read_places(spark, sf):
    folder = shared_folder(spark, "places")
    writers.write_table(v.places(spark, sf), folder, fmt="csv")
    rows = readers.read_places(spark, folder, "csv")
    return rows.select("business_id", "name", "address", "state", "latitude", "stars", "review_count", "is_open", "attributes", "categories")


@check("sr2_read_reviews", with_views("reviews", "SELECT review_id, business_id, stars, md5(text) AS digest FROM reviews"))
def read_reviews(spark, sf):
    folder = shared_folder(spark, "reviews")
    v.reviews(spark, sf).write.json(folder)
    return readers.read_reviews(spark, folder).select("review_id", "business_id", "stars", F.md5("text").alias("digest"))


@check("sr2_read_users", """SELECT 'u' || c_custkey AS user_id, c_name AS name, c_custkey % 90 AS review_count, '2015-01-02' AS yelping_since,
 round((c_custkey % 41) / 10.0, 1)::DOUBLE AS average_stars FROM customer""")
def read_users(spark, sf):
    folder, k = shared_folder(spark, "users"), F.col("c_custkey")
    v.table(spark, sf, "customer").select(
        F.concat(F.lit("u"), k).alias("user_id"), F.col("c_name").alias("name"), (k % 90).alias("review_count"),
        F.lit("2015-01-02").alias("yelping_since"), F.round((k % 41) / 10.0, 1).alias("average_stars"), F.lit("x").alias("elite"),
    ).write.json(folder)
    return readers.read_users(spark, folder)


@check("sr2_read_checkins", "SELECT 'b' || (event_id % 200) AS business_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date FROM events")
def read_checkins(spark, sf):
    folder = shared_folder(spark, "checkins")
    rows = v.table(spark, sf, "events")
    rows.select(F.concat(F.lit("b"), F.col("event_id") % 200).alias("business_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date")).write.option(
        "header", "true").csv(folder)
    return readers.read_checkins(spark, folder, "csv")


@check("sr2_read_tips", """SELECT 'u' || (doc_id % 97) AS user_id, 'b' || (doc_id % 200) AS business_id, md5(text) AS digest, doc_id % 5 AS compliment_count
 FROM documents""")
def read_tips(spark, sf):
    folder, k = shared_folder(spark, "tips"), F.col("doc_id")
    v.table(spark, sf, "documents").select(
        F.concat(F.lit("u"), k % 97).alias("user_id"), F.concat(F.lit("b"), k % 200).alias("business_id"), "text",
        F.lit("2024-01-01").cast("timestamp").alias("date"), (k % 5).alias("compliment_count"),
    ).write.parquet(folder)
    return readers.read_tips(spark, folder, "parquet").select("user_id", "business_id", F.md5("text").alias("digest"), "compliment_count")


@check("sr8_write_merchants", with_views("places", """SELECT business_id, name, latitude, longitude, city, state, stars,
 review_count, is_open, categories FROM places"""))
def write_merchants(spark, sf):
    folder = shared_folder(spark, "merchants")
    writers.write_merchants(v.places(spark, sf), folder)
    return spark.read.parquet(folder)


@check("sr6_read_photo_manifest", with_views("photos", "SELECT photo_id, business_id FROM photos WHERE seq % 7 <> 0"))
def read_photos(spark, sf):
    folder = shared_folder(spark, "photos")
    row = F.to_json(F.struct("photo_id", "business_id"))
    broken = F.when(F.col("seq") % 7 == 0, F.lit("{broken")).otherwise(row)
    v.photos(spark, sf).select(broken.alias("line")).write.text(folder)
    return readers.read_photo_manifest(spark, folder).select("photo_id", "business_id")


@check("sr7_write_table", with_views("places", "SELECT business_id, state, stars FROM places"))
def write_table(spark, sf):
    folder = shared_folder(spark, "table")
    writers.write_table(v.places(spark, sf), folder, ["state"])
    return spark.read.parquet(folder).select("business_id", "state", "stars")


@check("sr10_save_and_load_index", "WITH " + tfidf_sql("documents", "doc_id", "text") + " SELECT term, round(idf, 6) AS idf FROM vocab")
def save_index(spark, sf):
    from placelens.operators.retrieval import fit_tfidf

    folder, config = shared_folder(spark, "index"), {"ngrams": 2}
    documents = v.table(spark, sf, "documents")
    if not writers.index_is_current(spark, folder, config):
        writers.save_index(fit_tfidf(documents, cut=True), documents.select("doc_id", "lang"), folder, config)
    if not writers.index_is_current(spark, folder, config):
        raise ValueError("the saved index does not match its configuration")
    return rounded(writers.load_index(spark, folder)[0].vocabulary)


# --- cleaning ----------------------------------------------------------------------------------------------


@check("cl1_drop_missing", with_views("places", """SELECT business_id FROM places WHERE address IS NOT NULL
 AND postal_code IS NOT NULL AND attributes IS NOT NULL AND categories IS NOT NULL"""))
def drop_missing(spark, sf):
    return cleaning.drop_missing(v.places(spark, sf), ["address", "postal_code", "attributes", "categories"]).select("business_id")


@check("cl2_filter_city", with_views("places", "SELECT business_id, city FROM places WHERE lower(city) = 'tampa'"))
def filter_city(spark, sf):
    return cleaning.filter_city(v.places(spark, sf), "TAMPA").select("business_id", "city")


@check("cl3_filter_categories", with_views("places", """SELECT business_id, categories FROM places
 WHERE lower(categories) LIKE '%gear%' OR lower(categories) LIKE '%promo%'"""))
def filter_categories(spark, sf):
    return cleaning.filter_categories(v.places(spark, sf), ["GEAR", "Promo"]).select("business_id", "categories")


@check("cl3_dining_slice", with_views("places", """SELECT count(*) AS n FROM places
 WHERE lower(categories) LIKE '%restaurant%' OR lower(categories) LIKE '%food%'"""))
def dining_slice(spark, sf):
    return cleaning.dining_slice(v.places(spark, sf)).agg(F.count("*").alias("n"))


@check("cl4_dedup", """SELECT l_partkey, l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (
 PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_extendedprice, l_shipdate) AS r FROM lineitem) WHERE r = 1""")
def dedup(spark, sf):
    rows = v.table(spark, sf, "lineitem")
    kept = cleaning.dedup(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_extendedprice", "l_shipdate"])
    return kept.select("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice")


@check("cl4_dedup_counts", """SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey,
 l_linenumber FROM lineitem)) AS rows_after FROM lineitem""")
def dedup_counts(spark, sf):
    return cleaning.dedup_counts(v.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@check("cl5_range_guard", with_views("map_export", """SELECT business_id, stars, review_count FROM mapped
 WHERE stars BETWEEN 1 AND 5 AND review_count >= 0""", _MAP))
def range_guard(spark, sf):
    rows = readers.map_export_places(v.map_export(spark, sf))
    return cleaning.range_guard(rows).select("business_id", "stars", "review_count")


@check("cl6_coerce_types", with_views("map_export", """SELECT url, try_cast(lat AS DOUBLE) AS lat,
 try_cast(rating AS DOUBLE) AS rating, coalesce(try_cast(rating AS DOUBLE)::INTEGER, 0) AS flag, 0 AS is_open FROM map_export"""))
def coerce_types(spark, sf):
    raw = v.map_export(spark, sf).select(
        F.col("URL").alias("url"), F.col("Lat").alias("lat"), F.col("Rating").alias("rating"), F.col("Rating").alias("flag")
    )
    return cleaning.coerce_types(raw, numeric=["lat", "rating"], flags=["flag", "is_open"])


@check("cl7_missing_profile", with_views("places", """SELECT column_name, n_missing, round(100.0 * n_missing / n, 6) AS pct_missing
 FROM (SELECT count(*)::DOUBLE AS n, unnest(['address', 'postal_code', 'attributes', 'hours', 'name']) AS column_name,
 unnest([count(*) - count(address), count(*) - count(postal_code), count(*) - count(attributes), count(*) - count(hours),
 count(*) - count(name)]) AS n_missing FROM places)"""))
def missing_profile(spark, sf):
    return rounded(cleaning.missing_profile(v.places(spark, sf).select("address", "postal_code", "attributes", "hours", "name")))


def _describe_sql(view: str, cols: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
 round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25,
 round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75 FROM {view}"""
        for c in cols
    ]
    return " UNION ALL ".join(parts)


@check("cl8_describe_numeric", with_views("places", _describe_sql("places", ["stars", "review_count", "is_open", "latitude"])))
def describe(spark, sf):
    return rounded(cleaning.describe_numeric(v.places(spark, sf), ["stars", "review_count", "is_open", "latitude"]))


@check("cl8_describe_prices", _describe_sql("lineitem", ["l_extendedprice", "l_quantity"]).replace(", 6)", ", 4)"))
def describe_prices(spark, sf):
    return rounded(cleaning.describe_numeric(v.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"]), 4)


@check("cl9_value_counts", with_views("places", "SELECT stars, count(*) AS n FROM places GROUP BY stars"))
def value_counts(spark, sf):
    return cleaning.value_counts(v.places(spark, sf), "stars")


@check("cl9_top_categories", with_views("places", "SELECT categories, count(*) AS n FROM places GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def top_values(spark, sf):
    return cleaning.value_counts(v.places(spark, sf), "categories", 5)


@check("cl10_available_states", with_views("places map_export", """SELECT state FROM (
 SELECT DISTINCT upper(trim(state)) AS state FROM (SELECT state FROM places UNION ALL SELECT state FROM mapped))
 WHERE state NOT IN ('', 'NAN') AND state IN (SELECT upper(trim(state)) FROM places WHERE is_open = 1)""", _MAP))
def states(spark, sf):
    places = v.places(spark, sf)
    second = readers.map_export_places(v.map_export(spark, sf))
    return cleaning.available_states([places, second], places.where("is_open = 1"))


@check("cl11_normalize_keys", with_views("map_export", """SELECT business_id, nullif(upper(trim(state)), '') AS state_norm,
 lower(trim(city)) AS city_norm, 'restaurants, food' AS categories_norm FROM mapped""", _MAP))
def normalize_keys(spark, sf):
    rows = cleaning.normalize_keys(readers.map_export_places(v.map_export(spark, sf)))
    return rows.select("business_id", "state_norm", "city_norm", "categories_norm")


@check("cl12_restrict_cities", with_views("places map_export", """SELECT business_id, city, state FROM (
 SELECT business_id, city, state FROM places UNION ALL SELECT business_id, city, state FROM mapped)
 WHERE (lower(trim(city)), upper(trim(state))) IN (('philadelphia','PA'), ('tampa','FL'), ('nashville','TN'), ('tucson','AZ'))""", _MAP))
def restrict_cities(spark, sf):
    both = readers.union_sources(v.places(spark, sf), readers.map_export_places(v.map_export(spark, sf)))
    return cleaning.restrict_cities(both).select("business_id", "city", "state")


@check("cl13_text_length_profile", with_views("reviews", """SELECT min(length(text)) AS min_len, max(length(text)) AS max_len,
 count(*) FILTER (trim(text) = '') AS n_blank, quantile_cont(length(text)::DOUBLE, 0.5) AS median_len FROM reviews"""))
def text_lengths(spark, sf):
    return cleaning.text_length_profile(v.reviews(spark, sf))


@check("cl14_category_frequency", with_views("places", """SELECT category, count(*) AS n FROM (
 SELECT trim(unnest(string_split(categories, ','))) AS category FROM places) GROUP BY 1"""))
def category_frequency(spark, sf):
    return cleaning.category_frequency(v.places(spark, sf))


@check("cl14_attribute_key_frequency", with_views("places", """SELECT attribute, count(*) AS n FROM (SELECT unnest(
 ['RestaurantsPriceRange2', 'GoodForKids', 'WiFi', 'HasTV', 'BusinessParking']) AS attribute, attributes FROM places)
 WHERE contains(attributes, '''' || attribute || ''':') GROUP BY 1"""))
def attribute_frequency(spark, sf):
    return cleaning.attribute_key_frequency(v.places(spark, sf))


@check("cl15_best_city_rows", with_views("places", """SELECT city, state, row_count FROM (SELECT *, row_number() OVER (
 PARTITION BY lower(city), state ORDER BY row_count DESC, city) AS r FROM spelled) WHERE r = 1 AND row_count > 0""",
 """spelled AS (SELECT CASE WHEN is_open = 1 THEN upper(city) ELSE city END AS city, state, count(*) AS row_count
 FROM places GROUP BY 1, 2)"""))
def best_cities(spark, sf):
    spelled = F.when(F.col("is_open") == 1, F.upper("city")).otherwise(F.col("city"))
    rows = v.places(spark, sf).groupBy(spelled.alias("city"), "state").agg(F.count("*").alias("row_count"))
    return cleaning.best_city_rows(rows)


# --- joins -------------------------------------------------------------------------------------------------


@check("jn1_keep_children", with_views("places actions", """SELECT event_id, business_id FROM actions
 WHERE business_id IN (SELECT business_id FROM places WHERE stars >= 3)"""))
def keep_children(spark, sf):
    return joins.keep_children(v.actions(spark, sf), v.places(spark, sf).where("stars >= 3")).select("event_id", "business_id")


@check("jn2_join_features", with_views("places reviews", """SELECT p.business_id, p.stars, r.n FROM places p JOIN (
 SELECT business_id, count(*) AS n FROM reviews GROUP BY 1) r USING (business_id)"""))
def join_features(spark, sf):
    counts = v.reviews(spark, sf).groupBy("business_id").agg(F.count("*").alias("n"))
    return joins.join_features(v.places(spark, sf), counts).select("business_id", "stars", "n")


@check("jn3_join_signals", with_views("places reviews", """SELECT p.business_id, round(coalesce(r.m, 0.0), 6) AS m
 FROM places p LEFT JOIN (SELECT business_id, avg(stars) AS m FROM reviews GROUP BY 1) r USING (business_id)"""))
def join_signals(spark, sf):
    means = v.reviews(spark, sf).groupBy("business_id").agg(F.avg("stars").alias("m"))
    return rounded(joins.join_signals(v.places(spark, sf).select("business_id"), means))


@check("jn4_text_fields", with_views("places", """SELECT business_id, coalesce(name, '') AS name, coalesce(categories, '')
 AS categories, coalesce(city, '') AS city, coalesce(state, '') AS state, coalesce(attributes, '') AS attributes FROM places"""))
def text_fields(spark, sf):
    return joins.text_fields(v.places(spark, sf))


@check("jn5_reconcile_keys", with_views("places reviews", """SELECT (SELECT count(DISTINCT business_id) FROM places) AS n_a,
 (SELECT count(DISTINCT business_id) FROM reviews) AS n_b,
 (SELECT count(*) FROM (SELECT business_id FROM reviews EXCEPT SELECT business_id FROM places)) AS b_without_a,
 (SELECT count(*) FROM (SELECT business_id FROM places EXCEPT SELECT business_id FROM reviews)) AS a_without_b"""))
def reconcile(spark, sf):
    return joins.reconcile_keys(v.places(spark, sf), v.reviews(spark, sf))


# --- features ----------------------------------------------------------------------------------------------

_ATTR = """attr AS (SELECT business_id, regexp_extract(attributes, '''RestaurantsPriceRange2'': ''([0-9])''', 1) AS price,
  regexp_extract(attributes, '''GoodForKids'': ''([A-Za-z]+)''', 1) AS kids, regexp_extract(attributes, 'u''(free|no)''', 1) AS wifi,
  regexp_extract(attributes, '''HasTV'': ''([A-Za-z]+)''', 1) AS tv, regexp_extract(attributes, '''garage'': ([A-Za-z]+)', 1) AS garage,
  regexp_extract(attributes, '''street'': ([A-Za-z]+)', 1) AS street FROM places WHERE attributes IS NOT NULL)"""
_FLAT = _ATTR + """, flat AS (
  SELECT business_id, 'attr_restaurantspricerange2' AS attr_key, price AS value FROM attr UNION ALL
  SELECT business_id, 'attr_goodforkids', CASE kids WHEN 'True' THEN '1' WHEN 'False' THEN '0' ELSE kids END FROM attr UNION ALL
  SELECT business_id, 'attr_wifi', wifi FROM attr UNION ALL
  SELECT business_id, 'attr_hastv', CASE tv WHEN 'True' THEN '1' ELSE '0' END FROM attr UNION ALL
  SELECT business_id, 'attr_businessparking_garage', CASE garage WHEN 'True' THEN '1' ELSE '0' END FROM attr UNION ALL
  SELECT business_id, 'attr_businessparking_street', CASE street WHEN 'True' THEN '1' ELSE '0' END FROM attr)"""


@check("fx1_parse_attributes", with_views("places", """SELECT business_id, 'RestaurantsPriceRange2' AS attribute, price AS value FROM attr
 UNION ALL SELECT business_id, 'GoodForKids', kids FROM attr UNION ALL SELECT business_id, 'HasTV', tv FROM attr
 UNION ALL SELECT business_id, 'WiFi', '''' || wifi || '''' FROM attr
 UNION ALL SELECT business_id, 'BusinessParking', '{''garage'': ' || garage || ', ''street'': ' || street || '}' FROM attr""", _ATTR))
def parse_attributes(spark, sf):
    return features.parse_attributes(v.places(spark, sf)).withColumn("value", F.regexp_replace("value", "^u'", "'"))


_HOURS = """SELECT business_id, CASE WHEN contains(hours, '8:0-22:0') THEN 1 ELSE {0} END AS time_is_open_morning,
 CASE WHEN contains(hours, '8:0-22:0') THEN 1 ELSE 0 END AS time_is_open_latenight,
 CASE WHEN contains(hours, 'Saturday') THEN 1 ELSE 0 END AS time_open_on_weekends FROM places"""


@check("fx2_hours_flags", with_views("places", _HOURS.format("CASE WHEN contains(hours, '0:0-0:0') THEN 1 ELSE 0 END")))
def hours(spark, sf):
    return features.hour_features(v.places(spark, sf))


@check("fx3_days_open", with_views("places", """SELECT business_id, CASE WHEN contains(hours, 'Saturday') THEN 2.0
 WHEN hours IS NOT NULL THEN 1.0 END::DOUBLE AS hours_days_open FROM places"""))
def days(spark, sf):
    return features.open_days(v.places(spark, sf))


@check("fx4_split_categories", with_views("places", """SELECT business_id, unnest(list_filter(list_transform(
 string_split(categories, ','), lambda x: trim(x)), lambda x: x <> '')) AS category FROM places"""))
def split(spark, sf):
    return v.places(spark, sf).select("business_id", F.explode(split_categories(F.col("categories"))).alias("category"))


@check("fx5_category_indicators", with_views("places", """SELECT DISTINCT business_id, 'cat_' || replace(lower(trim(c)), ' ', '_')
 AS cat_key, 1 AS flag FROM (SELECT business_id, unnest(string_split(categories, ',')) AS c FROM places)"""))
def indicators(spark, sf):
    return features.category_indicators(v.places(spark, sf))


@check("fx6_category_summary", with_views("places", """SELECT business_id, len(l) AS categories_count, l[1] AS category_primary,
 array_to_string(list_transform(l, lambda x: lower(x)), ' ') AS categories_text FROM (SELECT business_id,
 list_filter(list_transform(string_split(categories, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM places)"""))
def summary(spark, sf):
    return features.category_summary(v.places(spark, sf))


@check("fx7_clean_attr_value", with_views("places", """SELECT business_id, attr_key, value FROM flat
 WHERE attr_key NOT LIKE 'attr_businessparking%'""", _FLAT))
def clean_values(spark, sf):
    from placelens.functions.dict_text import clean_value, is_nested, snake_name

    rows = features.parse_attributes(v.places(spark, sf)).where(~is_nested(F.col("value")))
    key = snake_name(F.concat(F.lit("attr_"), F.col("attribute")))
    return rows.select("business_id", key.alias("attr_key"), clean_value(F.col("value")).alias("value"))


@check("fx8_flatten_attributes", with_views("places", "SELECT business_id, attr_key, value FROM flat", _FLAT))
def flatten(spark, sf):
    return features.flatten_attributes(v.places(spark, sf))


@check("fx8_fill_attributes", with_views("places", """SELECT p.business_id, k.attr_key, coalesce(f.value, '0') AS value
 FROM places p, (SELECT unnest(['attr_hastv', 'attr_wifi']) AS attr_key) k
 LEFT JOIN flat f ON f.business_id = p.business_id AND f.attr_key = k.attr_key""", _FLAT))
def fill(spark, sf):
    places = v.places(spark, sf)
    return features.fill_attributes(places, features.flatten_attributes(places), ["attr_hastv", "attr_wifi"])


@check("fx9_price_tier", with_views("places", """SELECT business_id, try_cast(price AS DOUBLE) AS price_tier,
 coalesce(try_cast(price AS INTEGER), 0) AS price_range, CASE WHEN price IS NULL THEN 'N/A' ELSE repeat('$', price::INTEGER) END
 AS price_symbol FROM places LEFT JOIN attr USING (business_id)""", _ATTR))
def prices(spark, sf):
    return features.price_columns(v.places(spark, sf))


@check("fx11_categorical_dummies", with_views("places", """SELECT business_id, 'attr_wifi_' || coalesce(wifi, 'unknown') AS dummy,
 1 AS flag FROM places LEFT JOIN attr USING (business_id)""", _ATTR))
def dummies(spark, sf):
    places = v.places(spark, sf)
    return features.categorical_dummies(places, features.flatten_attributes(places))


@check("fx12_coerce_binary", with_views("places", """SELECT business_id, attr_key, CASE WHEN value = '1' THEN 1 ELSE 0 END AS flag
 FROM flat WHERE attr_key IN ('attr_goodforkids', 'attr_hastv', 'attr_businessparking_garage', 'attr_businessparking_street')""", _FLAT))
def binary(spark, sf):
    flat = features.flatten_attributes(v.places(spark, sf))
    return features.coerce_binary(flat).select("business_id", "attr_key", "flag")


@check("fx13_drop_none_columns", with_views("places", "SELECT business_id, attr_key, value FROM flat WHERE attr_key <> 'attr_goodforkids'", _FLAT))
def drop_none(spark, sf):
    return features.drop_none_columns(features.flatten_attributes(v.places(spark, sf))).select("business_id", "attr_key", "value")


@check("fx14_attribute_features", with_views("places", """SELECT business_id, try_cast(price AS DOUBLE) AS attr_price_range,
 CASE kids WHEN 'True' THEN 1.0 WHEN 'False' THEN 0.0 END::DOUBLE AS attr_good_for_kids, NULL::DOUBLE AS attr_takeout,
 CASE wifi WHEN 'free' THEN 1.0 ELSE 0.0 END::DOUBLE AS attr_wifi_indicator FROM places LEFT JOIN attr USING (business_id)""", _ATTR))
def attribute_features(spark, sf):
    rows = features.attribute_features(v.places(spark, sf))
    return rows.select("business_id", "attr_price_range", "attr_good_for_kids", "attr_takeout", "attr_wifi_indicator")


@check("fx15_presence_flags", with_views("places", """SELECT business_id, CASE WHEN hours IS NOT NULL THEN 1 ELSE 0 END AS has_hours,
 CASE WHEN attributes IS NOT NULL THEN 1 ELSE 0 END AS has_attributes FROM places"""))
def presence(spark, sf):
    return features.presence_flags(v.places(spark, sf))


@check("fx16_top_n_grouping", with_views("places", """SELECT grp, count(*) AS n FROM (SELECT coalesce(t.name, 'Other') AS grp
 FROM places p LEFT JOIN (SELECT name, count(*) FROM places GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12) t USING (name)) GROUP BY 1"""))
def top_n(spark, sf):
    grouped = features.top_n_grouping(v.places(spark, sf), "name")
    return grouped.groupBy(F.col("name_grp").alias("grp")).agg(F.count("*").alias("n"))


def _gallery_sql() -> str:
    from placelens.functions.lexicons import FALLBACK_PHOTOS, PHOTO_URL

    head, tail = PHOTO_URL.split("%s")
    pics = "[" + ", ".join(f"'{p}'" for p in FALLBACK_PHOTOS) + "]"
    return with_views("places photos", f"""SELECT p.business_id, coalesce(g.urls, f.urls) AS photo_urls,
 string_split(coalesce(g.urls, f.urls), ' ')[1] AS photo_url FROM places p
 LEFT JOIN (SELECT business_id, string_agg('{head}' || photo_id || '{tail}', ' ' ORDER BY seq, photo_id) AS urls FROM (SELECT *,
   row_number() OVER (PARTITION BY business_id ORDER BY seq, photo_id) AS r FROM photos) WHERE r <= 8 GROUP BY 1) g USING (business_id)
 JOIN (SELECT business_id, string_agg({pics}[('0x' || substr(md5(business_id || '|' || j), 1, 8))::BIGINT % 5 + 1], ' ' ORDER BY j)
   AS urls FROM places, range(0, 4) t(j) GROUP BY 1) f USING (business_id)""")


@check("fx17_photo_gallery", _gallery_sql())
def gallery(spark, sf):
    rows = features.photo_gallery(v.places(spark, sf), v.photos(spark, sf))
    return rows.select("business_id", F.array_join("photo_urls", " ").alias("photo_urls"), "photo_url")
