"""Row cleaning, profiling and key normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions.columns import contains_any, safe_double, split_categories
from placelens.functions.dict_text import parse_dict
from placelens.functions.frames import exact_quantiles, top_per_group
from placelens.functions.lexicons import INDEX_CITIES


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def filter_city(df: DataFrame, city: str | None) -> DataFrame:
    return df if not city else df.where(F.lower("city") == city.lower())


def filter_categories(df: DataFrame, keywords: Sequence[str], case_sensitive: bool = False) -> DataFrame:
    text = F.coalesce(F.col("categories"), F.lit(""))
    if case_sensitive:
        return df.where(contains_any(text, list(keywords)))
    return df.where(contains_any(F.lower(text), [k.lower() for k in keywords]))


def dining_slice(df: DataFrame) -> DataFrame:
    return filter_categories(df, ["restaurant", "food"])


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row per key in the given total order."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    return top_per_group(df, keys, cols, 1, "_row").drop("_row")


def dedup_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before and after de-duplication; NULL keys count as one value."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after")
    )


def range_guard(df: DataFrame) -> DataFrame:
    keep = F.col("stars").between(1, 5)
    if "review_count" in df.columns:
        keep = keep & (F.col("review_count") >= 0)
    return df.where(keep)


def coerce_types(
    df: DataFrame, numeric: Sequence[str] = (), dates: Sequence[str] = (), flags: Sequence[str] = ("is_open",)
) -> DataFrame:
    """Text to numbers and timestamps, unreadable values to NULL, absent or unreadable flags to 0."""
    changes = {c: safe_double(F.col(c)) for c in numeric if c in df.columns}
    changes |= {c: F.try_to_timestamp(F.col(c).cast("string")) for c in dates if c in df.columns}
    for c in flags:
        changes[c] = F.coalesce(safe_double(F.col(c)).cast("int"), F.lit(0)) if c in df.columns else F.lit(0)
    return df.withColumns(changes) if changes else df


def missing_profile(df: DataFrame) -> DataFrame:
    """NULL count and share per column in one pass over the table."""
    counts = df.agg(
        F.count("*").alias("rows_total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    long = counts.unpivot(["rows_total"], df.columns, "column_name", "n_missing")
    return long.select(
        "column_name",
        "n_missing",
        F.coalesce(F.try_divide(100.0 * F.col("n_missing"), F.col("rows_total")), F.lit(0.0)).alias("pct_missing"),
    )


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "v")
    moments = long.groupBy("column_name").agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    quartiles = exact_quantiles(long, ["column_name"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return moments.join(quartiles, "column_name", "left")


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    counts = (
        df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(col))
    )
    return counts if n is None else counts.limit(n)


def available_states(sources: Sequence[DataFrame], index: DataFrame | None = None) -> DataFrame:
    """Distinct cleaned states over all sources, cut to the states of the index."""

    def states(df: DataFrame) -> DataFrame:
        s = F.upper(F.trim("state"))
        return df.select(s.alias("state")).where((s != "") & (s != "NAN")).distinct()

    found = states(sources[0])
    for df in sources[1:]:
        found = found.union(states(df))
    found = found.distinct()
    if index is not None:
        found = found.intersect(states(index))
    return found.orderBy("state")


def normalize_state(c: Column) -> Column:
    s = F.upper(F.trim(c))
    return F.when(s != "", s)


def normalize_keys(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "state_norm": normalize_state(F.col("state")),
            "city_norm": F.lower(F.trim("city")),
            "categories_norm": F.lower(F.coalesce("categories", F.lit(""))),
        }
    )


def restrict_cities(df: DataFrame, allowed: Sequence[tuple[str, str]] = tuple(INDEX_CITIES)) -> DataFrame:
    """Keep places of the allow-listed (lowered city, upper state) pairs; the list is a fixed short literal."""
    pair = F.concat_ws("|", F.lower(F.trim("city")), F.upper(F.trim("state")))
    return df.where(pair.isin([f"{c}|{s}" for c, s in allowed]))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail early on an empty table."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def text_length_profile(reviews: DataFrame, col: str = "text") -> DataFrame:
    lengths = reviews.select(F.lit(1).alias("k"), F.length(col).alias("len"), F.trim(col).alias("t"))
    basics = lengths.groupBy("k").agg(
        F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.count_if(F.col("t") == "").alias("n_blank")
    )
    return basics.join(exact_quantiles(lengths, ["k"], "len", {"median_len": 0.5}), "k", "left").drop("k")


def category_frequency(places: DataFrame) -> DataFrame:
    return (
        places.select(F.explode(split_categories(F.col("categories"), keep_blank=True)).alias("category"))
        .groupBy("category")
        .agg(F.count("*").alias("n"))
    )


def attribute_key_frequency(places: DataFrame) -> DataFrame:
    return (
        places.select(F.explode(F.map_keys(parse_dict(F.col("attributes")))).alias("attribute"))
        .groupBy("attribute")
        .agg(F.count("*").alias("n"))
    )


def best_city_rows(cities: DataFrame, allowed: Sequence[tuple[str, str]] = tuple(INDEX_CITIES)) -> DataFrame:
    """Among spellings of one (city, state) keep the row with most places."""
    usable = restrict_cities(cities, allowed).where((F.trim("city") != "") & (F.col("row_count") > 0))
    keyed = usable.withColumns({"_c": F.lower(F.trim("city")), "_s": F.upper(F.trim("state"))})
    best = top_per_group(keyed, ["_c", "_s"], [F.desc("row_count"), F.asc("city")], 1, "_row")
    return best.drop("_c", "_s", "_row").orderBy(F.lower("state"), F.lower("city"))
