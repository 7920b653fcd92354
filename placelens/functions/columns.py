"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

# The size of a CountVectorizer that keeps every term; it counts the distinct terms and takes the smaller number.
WHOLE_VOCABULARY = 2**31 - 1


def safe_double(c: Column) -> Column:
    """Numeric value or NULL; text that is no number and NaN both become NULL."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2.0)
    half_dlon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2.0)
    a = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def half_star(c: Column) -> Column:
    """Nearest half star in 1..5, ties to even as NumPy rounds."""
    return clip(F.bround((c - 1.0) * 2.0, 0) / 2.0 + 1.0, 1.0, 5.0)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    return any_of([text.contains(n) for n in needles])


def latin_tokens(text: Column) -> Column:
    """Runs of a-z in the lowered text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Runs of letters and apostrophes, lowered."""
    return F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z']+"), F.lit(0)), F.lower
    )


def count_in(tokens: Column, lexicon: list[str] | tuple[str, ...]) -> Column:
    """How many tokens belong to the lexicon."""
    return F.size(F.filter(tokens, lambda t: t.isin(list(lexicon))))


def lexicon_share(tokens: Column, lexicon: list[str] | tuple[str, ...]) -> Column:
    n = F.size(tokens)
    return F.when(n == 0, F.lit(0.0)).otherwise(count_in(tokens, lexicon).cast("double") / n)


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs joined by one blank."""
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def split_categories(c: Column, keep_blank: bool = False) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p))
    return parts if keep_blank else F.filter(parts, lambda p: p != "")


def category_set(c: Column) -> Column:
    """Distinct categories in sorted order, so equal sets are equal arrays."""
    return F.array_sort(F.array_distinct(split_categories(c)))


def literal_map(table: dict) -> Column:
    """Map literal from a small fixed lookup table."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def price_tier(attributes: Column) -> Column:
    """Digit behind RestaurantsPriceRange2 in the attribute text."""
    text = F.coalesce(attributes, F.lit(""))
    return F.regexp_extract(text, r"RestaurantsPriceRange2['\"]?\s*:\s*['\"]?(\d)", 1).try_cast("double")


def price_symbol(attributes: Column) -> Column:
    tier = F.least(F.greatest(price_tier(attributes), F.lit(1.0)), F.lit(4.0)).cast("int")
    return F.when(price_tier(attributes).isNull(), F.lit("N/A")).otherwise(F.repeat(F.lit("$"), tier))


def trust_shrunk_stars(stars: Column, review_count: Column, ref_reviews: float = 150.0) -> Column:
    """Stars scaled to 0..1 and pulled to 0.5 where few reviews back them."""
    import math

    scaled = clip((stars - 1.0) / 4.0, 0.0, 1.0)
    trust = clip(
        F.log1p(F.greatest(review_count.cast("double"), F.lit(0.0))) / math.log1p(max(ref_reviews, 1.0)), 0.0, 1.0
    )
    return scaled * trust + 0.5 * (1.0 - trust)


def budget_tier(budget: Column) -> Column:
    b = F.lower(F.trim(budget))
    return F.when(b == "cheap", 1.0).when(b == "moderate", 2.0).when(b == "expensive", 4.0)


def price_match(tier: Column, budget: Column) -> Column:
    gap = clip(F.abs(tier - budget_tier(budget)), 0.0, 3.0)
    return F.coalesce(1.0 - gap / 3.0, F.lit(0.5))


def distance_score(distance_km: Column, radius_km: Column) -> Column:
    reach = F.when(radius_km > 0, radius_km).otherwise(F.lit(50.0))
    return F.coalesce(clip(1.0 - distance_km / (reach + 1e-9), 0.0, 1.0), F.lit(0.5))


def stable_bucket(key: Column, seed: int, buckets: int = 100) -> Column:
    """Bucket of a row that survives repartitioning and can be recomputed by any engine with md5."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
