"""Explicit schemas of the source tables."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(), "timestamp": T.TimestampType()}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind], True) for name, kind in columns.items()])


PLACES = _table(
    business_id="string", name="string", address="string", city="string", state="string", postal_code="string",
    latitude="double", longitude="double", stars="double", review_count="bigint", is_open="int",
    attributes="string", categories="string", hours="string",
)
REVIEWS = _table(
    review_id="string", user_id="string", business_id="string", stars="double", text="string", date="timestamp"
)
USERS = _table(user_id="string", name="string", review_count="bigint", yelping_since="string", average_stars="double")
CHECKINS = _table(business_id="string", date="string")
TIPS = _table(user_id="string", business_id="string", text="string", date="timestamp", compliment_count="bigint")
PHOTOS = _table(photo_id="string", business_id="string", caption="string", label="string")
MAP_EXPORT = _table(
    **{
        c: "string"
        for c in (
            "Name", "Address", "ZipCode", "Lat", "Lon", "Rating", "Rating Count", "Price Category", "URL",
            "Detailed Ratings",
        )
    }
)
MERCHANTS = [
    "business_id", "name", "latitude", "longitude", "city", "state", "stars", "review_count", "is_open", "categories",
]
