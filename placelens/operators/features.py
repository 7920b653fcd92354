"""Features from categories, attributes and hours. Wide one-hot data stays in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions.columns import price_symbol, price_tier, split_categories
from placelens.functions.dict_text import (
    clean_value,
    days_open,
    hours_flags,
    is_nested,
    parse_dict,
    snake_name,
    tri_state,
)
from placelens.functions.frames import top_per_group
from placelens.functions.lexicons import (
    BINARY_ATTRIBUTES,
    BOOLEAN_FEATURES,
    DUMMY_ATTRIBUTES,
    FALLBACK_PHOTOS,
    PHOTO_URL,
)


def parse_attributes(places: DataFrame) -> DataFrame:
    """Long form (business_id, attribute, value) of the attribute dictionaries."""
    return places.select("business_id", F.explode(parse_dict(F.col("attributes"))).alias("attribute", "value"))


def hour_features(places: DataFrame) -> DataFrame:
    flags = hours_flags(F.col("hours"))
    return places.select("business_id", *[c.alias(n) for n, c in flags.items()])


def open_days(places: DataFrame) -> DataFrame:
    return places.select("business_id", days_open(F.col("hours")).alias("hours_days_open"))


def category_key(category: Column) -> Column:
    return F.concat(F.lit("cat_"), F.replace(F.lower(category), F.lit(" "), F.lit("_")))


def category_indicators(places: DataFrame) -> DataFrame:
    """Long one-hot table (business_id, cat_key, flag); categories that share a key share a row."""
    keys = F.transform(split_categories(F.col("categories"), keep_blank=True), category_key)
    return places.select("business_id", F.explode(F.array_distinct(keys)).alias("cat_key"), F.lit(1).alias("flag"))


def pivot_indicators(long: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Wide form for a list of columns the caller names; NULL becomes 0."""
    return long.groupBy(key).pivot(name, list(names)).agg(F.max(value)).na.fill(0)


def category_summary(places: DataFrame) -> DataFrame:
    parts = split_categories(F.col("categories"))
    return places.select(
        "business_id",
        F.size(parts).alias("categories_count"),
        F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("category_primary"),
        F.array_join(F.transform(parts, F.lower), " ").alias("categories_text"),
    )


def flatten_attributes(places: DataFrame) -> DataFrame:
    """Long attribute table with nested dictionaries opened.

    A nested entry gives attr_<key>_<sub> with 1 for true and 0 else. A plain entry gives 1 or 0 for
    true/false and else its text. A key that is nested in any place is dropped as a plain column everywhere.
    """
    rows = parse_attributes(places).withColumn("plain_key", snake_name(F.concat(F.lit("attr_"), F.col("attribute"))))
    nested = is_nested(F.col("value"))
    opened = F.transform(
        F.map_entries(parse_dict(F.col("value"))),
        lambda e: F.struct(
            snake_name(F.concat_ws("_", F.lit("attr"), F.col("attribute"), e["key"])).alias("attr_key"),
            F.when(clean_value(e["value"]) == "1", F.lit("1")).otherwise(F.lit("0")).alias("value"),
        ),
    )
    plain = F.array(F.struct(F.col("plain_key").alias("attr_key"), clean_value(F.col("value")).alias("value")))
    entries = rows.select("business_id", "plain_key", nested.alias("nested"), F.inline(F.when(nested, opened).otherwise(plain)))
    parents = rows.where(nested).select("plain_key").distinct().withColumn("is_parent", F.lit(True))
    marked = entries.join(parents, "plain_key", "left")
    return marked.where(F.col("nested") | F.col("is_parent").isNull()).select("business_id", "attr_key", "value")


def _with_values(grid: DataFrame, flat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (business_id, attr_key) with their values. Both sides grow with the places, but the size Spark estimates for
    opened dictionaries is that of the files they come from, so the join states that no side is broadcast."""
    wanted = flat.where(F.col("attr_key").isin(list(keys)))
    return grid.join(wanted.hint("merge"), ["business_id", "attr_key"], "left")


def fill_attributes(places: DataFrame, flat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per place and key; a value that is absent is '0'."""
    grid = places.select("business_id", F.explode(F.lit(list(keys))).alias("attr_key"))
    return _with_values(grid, flat, keys).withColumn(
        "value", F.coalesce("value", F.lit("0"))
    )


def categorical_dummies(
    places: DataFrame, flat: DataFrame, keys: Sequence[str] = tuple(DUMMY_ATTRIBUTES)
) -> DataFrame:
    """Long one-hot rows (business_id, dummy, flag) of categorical attributes; absent and '0' are 'unknown'."""
    used = flat.where(F.col("attr_key").isin(list(keys))).select("attr_key").distinct()
    grid = places.select("business_id", F.explode(F.lit(list(keys))).alias("attr_key")).join(
        used, "attr_key", "left_semi"
    )
    value = F.coalesce(F.when(F.col("value") != "0", F.col("value")), F.lit("unknown"))
    joined = _with_values(grid, flat, keys)
    return joined.select("business_id", F.concat_ws("_", "attr_key", value).alias("dummy"), F.lit(1).alias("flag"))


def binary_keys(flat: DataFrame, listed: Sequence[str] = tuple(BINARY_ATTRIBUTES)) -> DataFrame:
    """Keys read as yes/no: listed ones and those with no other value anywhere."""
    plain = F.col("value").isin("0", "1", "None", "True", "False")
    per_key = flat.groupBy("attr_key").agg(F.bool_and(plain).alias("all_plain"))
    return per_key.where(F.col("all_plain") | F.col("attr_key").isin(list(listed))).select("attr_key")


def coerce_binary(flat: DataFrame, listed: Sequence[str] = tuple(BINARY_ATTRIBUTES)) -> DataFrame:
    """Values of yes/no attributes as 0 or 1, unreadable ones 0."""
    as_number = F.when(F.col("value") == "True", 1.0).otherwise(F.col("value").try_cast("double"))
    return flat.join(binary_keys(flat, listed), "attr_key", "left_semi").select(
        "business_id", "attr_key", F.coalesce(as_number, F.lit(0.0)).cast("int").alias("flag")
    )


def drop_none_columns(flat: DataFrame) -> DataFrame:
    """Remove every attribute that holds the text 'None' for any place."""
    bad = flat.where(F.col("value") == "None").select("attr_key").distinct()
    return flat.join(bad, "attr_key", "left_anti")


def attribute_features(places: DataFrame) -> DataFrame:
    parsed = parse_dict(F.col("attributes"))
    wifi = F.lower(F.coalesce(F.try_element_at(parsed, F.lit("WiFi")), F.lit("none")))
    return places.select(
        "business_id",
        price_tier(F.col("attributes")).alias("attr_price_range"),
        *[tri_state(F.try_element_at(parsed, F.lit(key))).alias(name) for name, key in BOOLEAN_FEATURES.items()],
        F.when(wifi.contains("free"), 1.0).when(wifi.contains("no"), 0.0).alias("attr_wifi_indicator"),
    )


def price_columns(places: DataFrame) -> DataFrame:
    tier = price_tier(F.col("attributes"))
    return places.select(
        "business_id",
        tier.alias("price_tier"),
        F.coalesce(tier, F.lit(0.0)).cast("int").alias("price_range"),
        price_symbol(F.col("attributes")).alias("price_symbol"),
    )


def presence_flags(places: DataFrame) -> DataFrame:
    return places.select(
        "business_id",
        F.col("hours").isNotNull().cast("int").alias("has_hours"),
        F.col("attributes").isNotNull().cast("int").alias("has_attributes"),
    )


def top_n_grouping(df: DataFrame, col: str, n: int = 12, other: str = "Other") -> DataFrame:
    """Column <col>_grp: the n most frequent values, everything else ``other``."""
    top = (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count("*").alias("_n"))
        .orderBy(F.desc("_n"), F.asc(col))
        .limit(n)
        .withColumn("_top", F.col(col))
        .drop("_n")
    )
    # At most n rows by the limit above.
    return df.join(F.broadcast(top), col, "left").withColumn(f"{col}_grp", F.coalesce("_top", F.lit(other))).drop("_top")


def photo_gallery(places: DataFrame, photos: DataFrame, order: str = "seq", limit: int = 8) -> DataFrame:
    """First photos of each place as URLs in manifest order, or four fallback pictures picked by hash."""
    usable = photos.where((F.trim("photo_id") != "") & F.col("business_id").isNotNull())
    first = top_per_group(usable, ["business_id"], [F.asc(order), F.asc("photo_id")], limit, "pos")
    # At most ``limit`` rows per place are gathered.
    urls = first.groupBy("business_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", F.trim("photo_id").alias("photo_id")))),
            lambda s: F.format_string(PHOTO_URL, s["photo_id"]),
        ).alias("urls")
    )

    def fallback(j):
        digest = F.md5(F.concat(F.col("business_id"), F.lit("|"), j.cast("string")))
        pick = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(len(FALLBACK_PHOTOS)))
        return F.element_at(F.lit(FALLBACK_PHOTOS), (pick + 1).cast("int"))

    spare = F.transform(F.sequence(F.lit(0), F.lit(3)), fallback)
    joined = places.join(urls, "business_id", "left").withColumn("photo_urls", F.coalesce("urls", spare))
    return joined.drop("urls").withColumn("photo_url", F.col("photo_urls")[0])
