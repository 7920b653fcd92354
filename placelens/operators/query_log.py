"""Annotation of a search log: constraints, intent and search text per request, all as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions.columns import literal_map
from placelens.functions.lexicons import (
    BUDGET_PATTERNS,
    BUDGET_TAIL_WORDS,
    CUISINE_LABELS,
    CUISINE_NEEDLES,
    INTENT_PATTERNS,
    KM_PER_MILE,
    LANDMARKS,
    QUERY_STOPWORDS,
    STATE_CODES,
)

_NEAR = r"\b(?:near|around|close to)\s+([a-z0-9][a-z0-9\s\-']+)(?:\s|$|,|\.)"
_IN = r"\bin\s+([a-z][a-z\s\-]+)(?:\s|$|,|\.)"
_WITHIN = r"within\s+(\d+(?:\.\d+)?)\s*(km|kilometers?|miles?|mi)\b"


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_query(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim_space(c)), r"\s+", " ")


def first_match(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Label of the first condition that holds."""
    out = F.lit(None).cast("string")
    for label, cond in reversed(list(pairs)):
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def cuisine_hint(q: Column) -> Column:
    return first_match([(needle, q.contains(needle)) for needle in CUISINE_NEEDLES])


def budget_hint(q: Column) -> Column:
    return first_match([(label, q.rlike(pattern)) for label, pattern in BUDGET_PATTERNS])


def radius_km(q: Column) -> Column:
    value = F.regexp_extract(q, _WITHIN, 1).try_cast("double")
    miles = F.regexp_extract(q, _WITHIN, 2).startswith("mi")
    nearby = q.contains("near") | q.contains("around") | q.contains("close to")
    stated = F.when(miles, value * KM_PER_MILE).otherwise(value)
    return F.when(value.isNotNull(), stated).when(nearby, F.lit(2.0))


def location_text(q: Column) -> Column:
    """Place named behind near/around/close to, else behind in, without trailing budget words."""
    found = F.coalesce(
        _blank_to_null(F.trim(F.regexp_extract(q, _NEAR, 1))), _blank_to_null(F.trim(F.regexp_extract(q, _IN, 1)))
    )
    words = "|".join(BUDGET_TAIL_WORDS)
    cut = F.trim(F.regexp_replace(found, rf"(?:(?:^|\s+)(?:{words}))+$", ""))
    return F.coalesce(_blank_to_null(cut), found)


def state_code(raw: Column, q: Column, location: Column) -> Column:
    codes = literal_map(STATE_CODES)
    valid = list(STATE_CODES.values())
    names = sorted(STATE_CODES, key=len, reverse=True)

    def code(text: Column, pattern: str) -> Column:
        c = F.upper(F.regexp_extract(text, pattern, 1))
        return F.when(c.isin(valid), c)

    # The longest name found anywhere wins, so names are tried by length once any of them occurs.
    full_name = F.coalesce(*[F.when(q.rlike(rf"\b{n}\b"), F.lit(STATE_CODES[n])) for n in names])
    named = F.when(q.rlike(rf"\b(?:{'|'.join(names)})\b"), full_name)
    tail = F.upper(F.element_at(F.split(F.lower(F.trim(location)), r"\s+"), -1))
    return F.coalesce(
        named,
        code(q, r"\bin\s+([a-z]{2})\b"),
        code(q, r",\s*([a-z]{2})\b"),
        code(q, r"\b([a-z]{2})\s+usa\b"),
        code(q, r"\b([a-z]{2})\s+state\b"),
        code(raw, r"\bin\s+([A-Z]{2})\b"),
        code(raw, r",\s*([A-Z]{2})\b"),
        F.try_element_at(codes, F.lower(F.trim(location))),
        F.when((F.length(tail) == 2) & tail.isin(valid), tail),
    )


def semantic_terms(raw: Column, cuisine: Column) -> Column:
    """Search words left after budget, distance and place phrases are removed."""
    q = F.lower(raw)
    q = F.regexp_replace(q, "|".join(p for _, p in BUDGET_PATTERNS), " ")
    q = F.regexp_replace(q, r"\bwithin\s+\d+(?:\.\d+)?\s*(km|kilometers?|miles?|mi)\b", " ")
    q = F.regexp_replace(q, r"\b(?:near|around|close to)\s+[a-z0-9][a-z0-9\s\-']+", " ")
    q = F.regexp_replace(q, r"\bin\s+[a-z][a-z\s\-]+", " ")
    tokens = F.regexp_extract_all(q, F.lit("[a-zA-Z']+"), F.lit(0))
    kept = F.array_distinct(F.filter(tokens, lambda t: (~t.isin(QUERY_STOPWORDS)) & (F.length(t) > 1)))
    spare = F.array(F.coalesce(cuisine, F.lit("restaurant")))
    return F.when(F.size(kept) > 0, kept).otherwise(spare)


def classify_intent(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.coalesce(first_match([(label, t.rlike(p)) for label, p in INTENT_PATTERNS]), F.lit("intent_default"))


def merge_cuisines(chosen: Column, cuisine: Column) -> Column:
    """Cuisines picked in the form followed by the one named in the text, without repeats."""
    named = F.try_element_at(literal_map(CUISINE_LABELS), cuisine)
    picked = F.coalesce(chosen, F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(picked, F.array(named))))


def compose_query_text(semantic: Column, extra: Column, cuisines: Column, raw: Column) -> Column:
    parts = F.concat(
        F.array(trim_space(semantic), trim_space(F.coalesce(extra, F.lit("")))),
        F.transform(F.coalesce(cuisines, F.array().cast("array<string>")), lambda c: F.trim(c)),
    )
    used = F.array_distinct(F.filter(parts, lambda p: p.isNotNull() & (p != "")))
    return F.coalesce(
        _blank_to_null(F.array_join(used, " ")),
        _blank_to_null(trim_space(F.coalesce(raw, F.lit("")))),
        F.lit("restaurants"),
    )


def geocode_landmarks(queries: DataFrame, gazetteer: Sequence[tuple[str, float, float]] = tuple(LANDMARKS)) -> DataFrame:
    """ref_lat/ref_lon of the first gazetteer entry that contains the location text or lies in it.

    The gazetteer is a short ordered list; a large one goes through ``geocode_table``.
    """
    key = normalize_query(F.col("location_text"))
    entries = F.lit(None)
    for name, lat, lon in reversed(list(gazetteer)):
        point = F.struct(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))
        entries = F.when(key.contains(name) | F.lit(name).contains(key), point).otherwise(entries)
    return (
        queries.withColumn("_p", entries)
        .withColumns({"ref_lat": F.col("_p.lat"), "ref_lon": F.col("_p.lon")})
        .drop("_p")
    )


def geocode_table(queries: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Fill missing points from a table (place_text, lat, lon) by the normalised user location.

    Of several points for one text the smallest (place_text, lat, lon) is used.
    """
    point = F.min(F.struct("place_text", "lat", "lon")).alias("_p")
    named = gazetteer.groupBy(normalize_query(F.col("place_text")).alias("_key")).agg(point)
    table = named.select("_key", F.col("_p.lat").alias("_lat"), F.col("_p.lon").alias("_lon"))
    keyed = queries.withColumn("_key", normalize_query(F.col("user_location")))
    missing = F.col("ref_lat").isNull() & F.col("ref_lon").isNull()
    return (
        keyed.join(table, "_key", "left")
        .withColumns(
            {
                "ref_lat": F.when(missing, F.col("_lat")).otherwise(F.col("ref_lat")),
                "ref_lon": F.when(missing, F.col("_lon")).otherwise(F.col("ref_lon")),
            }
        )
        .drop("_key", "_lat", "_lon")
    )


REQUEST_COLUMNS = ["text", "extra", "cuisines", "discover"]


def annotate(queries: DataFrame) -> DataFrame:
    """All constraints of a request log with columns text and, where present, extra, cuisines and discover.

    Logs repeat the same requests, so each distinct request is read once and the result is joined back.
    """
    asked = [c for c in REQUEST_COLUMNS if c in queries.columns]
    keyed = queries.withColumn("_request", F.sha2(F.to_json(F.struct(*asked)), 256))
    distinct = keyed.groupBy("_request").agg(*[F.any_value(c).alias(c) for c in asked])
    read = annotate_requests(distinct).drop(*asked)
    return keyed.join(read, "_request").drop("_request")


def annotate_requests(queries: DataFrame) -> DataFrame:
    """Constraints of every row as column expressions."""
    raw = trim_space(F.col("text"))
    have = set(queries.columns)
    opt = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    extra, chosen = opt("extra", "string"), opt("cuisines", "array<string>")
    discover = F.coalesce(opt("discover", "boolean"), F.lit(False))
    blank = F.coalesce(raw == "", F.lit(True)) | discover

    def unless_blank(c: Column) -> Column:
        return F.when(~blank, c)

    df = queries.withColumn("norm", F.when(blank, F.lit("")).otherwise(normalize_query(F.col("text"))))
    q = F.col("norm")
    df = df.withColumns({"cuisine": cuisine_hint(q), "location_text": location_text(q), "radius_km": radius_km(q)})
    constraint = normalize_query(F.concat_ws(" ", F.col("text"), extra))
    df = df.withColumns(
        {
            "budget": F.when(~discover, F.coalesce(budget_hint(q), budget_hint(constraint))),
            "state_code": unless_blank(state_code(raw, q, F.col("location_text"))),
            "terms": unless_blank(semantic_terms(raw, F.col("cuisine"))),
        }
    )
    df = df.withColumn("semantic_query", F.coalesce(F.array_join("terms", " "), F.lit("")))
    df = df.withColumn(
        "cuisine_filter", F.when(~discover, merge_cuisines(chosen, F.col("cuisine"))).otherwise(F.array().cast("array<string>"))
    )
    composed = compose_query_text(F.col("semantic_query"), extra, F.col("cuisine_filter"), F.col("text"))
    df = df.withColumn("query_text", F.when(discover, F.lit("restaurants")).otherwise(composed))
    df = df.withColumn("intent", classify_intent(F.col("query_text")))
    return geocode_landmarks(df)


def location_mismatch(state: Column, location: Column, browse_state: Column, browse_city: Column) -> Column:
    """1 where the text asks for another place than the one being browsed."""
    other_state = F.upper(F.trim(state)) != F.upper(F.trim(browse_state))
    city, loc = F.lower(F.trim(browse_city)), F.lower(F.trim(location))
    other_city = (city != "") & ~city.contains(loc) & ~loc.contains(city)
    return (F.coalesce(other_state, F.lit(False)) | F.coalesce(other_city, F.lit(False))).cast("int")


def query_profile(annotated: DataFrame) -> DataFrame:
    """Requests by intent, cuisine, budget and state."""
    return annotated.groupBy("intent", "cuisine", "budget", "state_code").agg(F.count("*").alias("n"))
