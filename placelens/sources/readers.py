"""Readers with fixed schemas, and the second place source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placelens import schemas
from placelens.functions.columns import safe_double
from placelens.functions.frames import conform


def _read(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    if fmt == "json":
        df = spark.read.schema(schema).json(path)
    elif fmt == "csv":
        # Quoted texts may span lines; columns are found by the header, so files may hold fewer or more.
        header = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
        df = conform(header, schema)
    elif fmt == "parquet":
        df = conform(spark.read.parquet(path), schema)
    else:
        raise ValueError(f"unknown format: {fmt}")
    return df


def read_places(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Places; attribute and hour objects of JSON lines arrive as their JSON text.

    A CSV file may hold line ends inside quotes, so it is read by one task; JSON lines and Parquet are split.
    """
    return _read(spark, path, fmt, schemas.PLACES)


def read_reviews(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, fmt, schemas.REVIEWS)


def read_users(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, fmt, schemas.USERS)


def read_checkins(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, fmt, schemas.CHECKINS)


def read_tips(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, fmt, schemas.TIPS)


def read_photo_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and malformed lines and rows without ids are skipped."""
    rows = spark.read.schema(schemas.PHOTOS).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("photo_id").isNotNull() & F.col("business_id").isNotNull()).where(
        (F.trim("photo_id") != "") & (F.trim("business_id") != "")
    )


def scan_reviews_for(places: DataFrame, reviews: DataFrame) -> DataFrame:
    """All reviews of the selected places."""
    return reviews.join(places.select("business_id").distinct(), "business_id", "left_semi")


def read_map_export(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    return map_export_places(conform(raw, schemas.MAP_EXPORT))


def map_export_places(raw: DataFrame) -> DataFrame:
    """Map-export rows in the place schema plus detail text and URL.

    Rows need coordinates and a name. The id is a hash of the URL, or of the row where there is none.
    """
    tail = r"(?i),\s*([^,]+),\s*([A-Z]{2})\s+(\d{5}(?:-\d{4})?)\s*$"
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    address = F.trim(text("Address"))
    part = lambda i: F.trim(F.regexp_extract(address, tail, i))
    url = F.trim(text("URL"))
    row_hash = F.substring(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])), 256), 1, 16)
    tier = F.least(F.greatest(F.bround(safe_double(F.col("Price Category")), 0).cast("int"), F.lit(1)), F.lit(4))
    priced = F.concat(F.lit("{'RestaurantsPriceRange2': '"), tier.cast("string"), F.lit("', 'DataSource': 'GoogleMaps'}"))
    df = raw.withColumns({"_lat": safe_double(F.col("Lat")), "_lon": safe_double(F.col("Lon"))})
    df = df.where(F.col("_lat").isNotNull() & F.col("_lon").isNotNull() & (F.trim(text("Name")) != ""))
    return df.select(
        F.when(url != "", F.concat(F.lit("gm_"), F.substring(F.sha2(url, 256), 1, 16)))
        .otherwise(F.concat(F.lit("gm_idx_"), row_hash))
        .alias("business_id"),
        F.col("Name").alias("name"),
        text("Address").alias("address"),
        part(1).alias("city"),
        F.upper(part(2)).alias("state"),
        F.coalesce(F.when(part(3) != "", part(3)), F.trim(text("ZipCode"))).alias("postal_code"),
        F.col("_lat").alias("latitude"),
        F.col("_lon").alias("longitude"),
        F.least(F.greatest(F.coalesce(safe_double(F.col("Rating")), F.lit(0.0)), F.lit(0.0)), F.lit(5.0)).alias("stars"),
        F.coalesce(safe_double(F.col("Rating Count")), F.lit(0.0)).cast("bigint").alias("review_count"),
        F.lit(1).alias("is_open"),
        F.when(safe_double(F.col("Price Category")).isNull(), F.lit("{'DataSource': 'GoogleMaps'}"))
        .otherwise(priced)
        .alias("attributes"),
        F.lit("Restaurants, Food").alias("categories"),
        F.lit("").alias("hours"),
        text("Detailed Ratings").alias("detail"),
        url.alias("url"),
    )


def union_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append a second source; columns only one side has become NULL on the other."""
    return a.unionByName(b, allowMissingColumns=True)
