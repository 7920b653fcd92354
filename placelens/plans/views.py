"""Place, review, event and prediction views over the test tables, for Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.functions.frames import spread_scan
from placelens.functions.lexicons import INDEX_STOPWORDS

SLOTS = [
    ("Philadelphia", "PA", 39.8, -75.3),
    ("Tampa", "FL", 27.8, -82.6),
    ("Nashville", "TN", 36.0, -86.9),
    ("Tucson", "AZ", 32.1, -111.1),
]
TEMPLATES = [
    "cozy italian near times square",
    "fast cheap sushi within 3 miles",
    "quick lunch in Philadelphia moderate",
    "anniversary dinner, upscale steakhouse",
    "vegan in CA",
    "burger",
    "cheap near nyu",
    "korean within 1.5 km",
    "pizza in new orleans, la",
    "romantic thai",
    "",
    "restaurants",
]
ACTIONS = {"click": "detail_open", "purchase": "like", "error": "pass", "view": "refresh"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(index, values):
    return F.element_at(F.lit(list(values)), (index + 1).cast("int"))


def places(spark: SparkSession, sf: str) -> DataFrame:
    part = spread_scan(table(spark, sf, "part"))
    counts = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("review_count"))
    k = F.col("p_partkey")
    slot = k % 4
    yes = lambda cond: F.when(cond, F.lit("True")).otherwise(F.lit("False"))
    kids = F.when(F.col("p_size") % 3 == 0, "True").when(F.col("p_size") % 3 == 1, "False").otherwise("None")
    attributes = F.concat(
        F.lit("{'RestaurantsPriceRange2': '"), (1 + F.col("p_size") % 4).cast("string"),
        F.lit("', 'GoodForKids': '"), kids,
        F.lit("', 'WiFi': \"u'"), F.when(F.col("p_size") % 2 == 0, "free").otherwise("no"),
        F.lit("'\", 'HasTV': '"), yes(k % 7 == 0),
        F.lit("', 'BusinessParking': \"{'garage': "), yes(F.col("p_size") % 5 == 0),
        F.lit(", 'street': "), yes(k % 2 == 0), F.lit("}\"}"),
    )
    hours = F.when(k % 3 == 0, "{'Monday': '8:0-22:0', 'Saturday': '11:0-2:0'}").when(
        k % 3 == 1, "{'Monday': '11:0-20:0', 'Tuesday': '0:0-0:0'}"
    )
    base = part.select(
        "p_partkey",
        F.concat(F.lit("b"), k.cast("string")).alias("business_id"),
        F.col("p_name").alias("name"),
        F.when(k % 17 != 0, F.concat((100 + k % 900).cast("string"), F.lit(" Main Street"))).alias("address"),
        _pick(slot, [s[0] for s in SLOTS]).alias("city"),
        _pick(slot, [s[1] for s in SLOTS]).alias("state"),
        F.when(k % 19 != 0, (10000 + k % 90000).cast("string")).alias("postal_code"),
        (_pick(slot, [s[2] for s in SLOTS]) + ((k * 7919) % 3000).cast("double") / 10000.0).alias("latitude"),
        (_pick(slot, [s[3] for s in SLOTS]) + ((k * 104729) % 3000).cast("double") / 10000.0).alias("longitude"),
        (1.0 + ((k * 31) % 9).cast("double") / 2.0).alias("stars"),
        F.when(F.col("p_size") % 5 == 0, 0).otherwise(1).alias("is_open"),
        F.when(k % 23 != 0, attributes).alias("attributes"),
        F.concat(F.lit("Restaurants, "), F.split("p_name", " ")[1], F.lit(", "), F.lower("p_type")).alias("categories"),
        hours.alias("hours"),
    )
    return base.join(counts, base.p_partkey == counts.l_partkey, "left").select(
        *[c for c in base.columns if c != "p_partkey"], F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count")
    )


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    d = spread_scan(table(spark, sf, "documents"))
    return d.select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.concat(F.lit("b"), (F.col("doc_id") % 200).cast("string")).alias("business_id"),
        (1 + (F.col("doc_id") * 7) % 5).cast("double").alias("stars"),
        "text",
        F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60000000).alias("date"),
    )


def actions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.coalesce(
        *[F.when(F.col("event_type") == t, F.lit(a)) for t, a in ACTIONS.items()], F.lit("signup")
    )
    return e.select(
        "event_id",
        F.col("user_id").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        action.alias("action"),
        F.concat(F.lit("b"), (F.col("event_id") % 200).cast("string")).alias("business_id"),
        _pick(k % 3, ["intent_quick", "intent_romantic", "intent_default"]).alias("intent"),
        _pick(F.floor(k / 3) % 3, ["explorer", "reputation", "convenience"]).alias("arm"),
        F.concat(F.lit("q"), k.cast("string")).alias("query_text"),
    )


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    slot = F.col("event_id") % 4
    return e.select(
        F.col("event_id").alias("query_id"),
        F.col("user_id").alias("session_id"),
        _pick(F.col("event_id") % 12, TEMPLATES).alias("text"),
        _pick(slot, [s[1] for s in SLOTS]).alias("state"),
        _pick(slot, [s[0] for s in SLOTS]).alias("browse_city"),
    )


def photos(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey").distinct()
    return rows.select(
        F.concat(F.lit("ph"), F.col("l_orderkey").cast("string")).alias("photo_id"),
        F.concat(F.lit("b"), F.col("l_partkey").cast("string")).alias("business_id"),
        F.col("l_orderkey").alias("seq"),
    )


def map_export(spark: SparkSession, sf: str) -> DataFrame:
    """Second source: customers as rows of a map export, all fields as text."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    slot = k % 4
    text = lambda x: x.cast("string")
    return c.select(
        F.when(k % 29 == 0, "  ").otherwise(F.col("c_name")).alias("Name"),
        F.when(k % 13 == 0, F.lit("unknown")).otherwise(
            F.concat(text(k % 500), F.lit(" Oak Ave, "), _pick(slot, [s[0] for s in SLOTS]), F.lit(", "), _pick(slot, [s[1] for s in SLOTS]), F.lit(" "), text(10000 + k % 90000))
        ).alias("Address"),
        text(20000 + k % 70000).alias("ZipCode"),
        F.when(k % 11 == 0, "n/a").otherwise(text(20 + k % 50)).alias("Lat"),
        text(-70 - k % 40).alias("Lon"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(text(k % 8)).alias("Rating"),
        F.when(k % 5 == 0, "").otherwise(text(k % 1000)).alias("Rating Count"),
        F.when(k % 3 == 0, "").otherwise(F.concat(text(k % 7), F.lit(".5"))).alias("Price Category"),
        F.concat(F.lit("https://maps.example/"), text(k)).alias("URL"),
        F.when(k % 2 == 0, "{}").otherwise(F.concat(F.lit("segment "), F.col("c_mktsegment"))).alias("Detailed Ratings"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector of each class as query vectors."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return listed.select(F.col("label").alias("query_id"), F.transform("v", lambda s: s["x"]).alias("vec"))


def replay_log(spark: SparkSession, sf: str) -> DataFrame:
    a = actions(spark, sf)
    return a.select(
        F.col("event_id").alias("row_id"),
        "intent",
        F.col("arm").alias("historical_arm"),
        F.col("action").isin("detail_open", "like").cast("int").alias("reward"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    k = F.col("doc_id")
    return d.select(
        "doc_id",
        F.col("quality").alias("y"),
        (((k * 37) % 101).cast("double") / 100.0).alias("score"),
        (1.0 + ((k * 7) % 9).cast("double") / 2.0).alias("actual"),
        (1.0 + ((k * 11) % 41).cast("double") / 10.0).alias("predicted"),
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"),
        F.col("lang").alias("target"),
    )


# --- the same views in SQL -------------------------------------------------------------------------------


def _case(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CITY = _case("p_partkey % 4", [_q(s[0]) for s in SLOTS])
_STATE = _case("p_partkey % 4", [_q(s[1]) for s in SLOTS])
_LAT = _case("p_partkey % 4", [f"{s[2]}::DOUBLE" for s in SLOTS])
_LON = _case("p_partkey % 4", [f"{s[3]}::DOUBLE" for s in SLOTS])

SQL = {
    "places": f"""SELECT 'b' || p_partkey AS business_id, p_name AS name,
  CASE WHEN p_partkey % 17 <> 0 THEN (100 + p_partkey % 900) || ' Main Street' END AS address,
  {_CITY} AS city, {_STATE} AS state,
  CASE WHEN p_partkey % 19 <> 0 THEN (10000 + p_partkey % 90000)::VARCHAR END AS postal_code,
  {_LAT} + ((p_partkey * 7919) % 3000)::DOUBLE / 10000.0::DOUBLE AS latitude,
  {_LON} + ((p_partkey * 104729) % 3000)::DOUBLE / 10000.0::DOUBLE AS longitude,
  1.0::DOUBLE + ((p_partkey * 31) % 9)::DOUBLE / 2.0::DOUBLE AS stars,
  CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS is_open,
  CASE WHEN p_partkey % 23 <> 0 THEN '{{''RestaurantsPriceRange2'': ''' || (1 + p_size % 4) || ''', ''GoodForKids'': '''
    || CASE p_size % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' ELSE 'None' END || ''', ''WiFi'': "u'''
    || CASE WHEN p_size % 2 = 0 THEN 'free' ELSE 'no' END || '''", ''HasTV'': '''
    || CASE WHEN p_partkey % 7 = 0 THEN 'True' ELSE 'False' END || ''', ''BusinessParking'': "{{''garage'': '
    || CASE WHEN p_size % 5 = 0 THEN 'True' ELSE 'False' END || ', ''street'': '
    || CASE WHEN p_partkey % 2 = 0 THEN 'True' ELSE 'False' END || '}}"}}' END AS attributes,
  'Restaurants, ' || split_part(p_name, ' ', 2) || ', ' || lower(p_type) AS categories,
  CASE p_partkey % 3 WHEN 0 THEN '{{''Monday'': ''8:0-22:0'', ''Saturday'': ''11:0-2:0''}}'
    WHEN 1 THEN '{{''Monday'': ''11:0-20:0'', ''Tuesday'': ''0:0-0:0''}}' END AS hours,
  coalesce(lc.n, 0)::BIGINT AS review_count
 FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) lc ON lc.l_partkey = p_partkey""",
    "reviews": """SELECT doc_id::VARCHAR AS review_id, 'b' || (doc_id % 200) AS business_id,
  (1 + (doc_id * 7) % 5)::DOUBLE AS stars, text, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS date FROM documents""",
    "actions": """SELECT event_id, user_id AS session_id, ts,
  CASE event_type WHEN 'click' THEN 'detail_open' WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'pass'
    WHEN 'view' THEN 'refresh' ELSE 'signup' END AS action, 'b' || (event_id % 200) AS business_id,
  CASE k % 3 WHEN 0 THEN 'intent_quick' WHEN 1 THEN 'intent_romantic' ELSE 'intent_default' END AS intent,
  CASE (k // 3) % 3 WHEN 0 THEN 'explorer' WHEN 1 THEN 'reputation' ELSE 'convenience' END AS arm,
  'q' || k AS query_text
 FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS k FROM events)""",
    "query_log": f"""SELECT event_id AS query_id, user_id AS session_id,
  {_case("event_id % 12", [_q(t) for t in TEMPLATES])} AS text,
  {_case("event_id % 4", [_q(s[1]) for s in SLOTS])} AS state,
  {_case("event_id % 4", [_q(s[0]) for s in SLOTS])} AS browse_city FROM events""",
    "photos": """SELECT DISTINCT 'ph' || l_orderkey AS photo_id, 'b' || l_partkey AS business_id, l_orderkey AS seq
 FROM lineitem""",
    "map_export": f"""SELECT CASE WHEN c_custkey % 29 = 0 THEN '  ' ELSE c_name END AS name,
  CASE WHEN c_custkey % 13 = 0 THEN 'unknown' ELSE (c_custkey % 500) || ' Oak Ave, ' ||
    {_case("c_custkey % 4", [_q(s[0]) for s in SLOTS])} || ', ' || {_case("c_custkey % 4", [_q(s[1]) for s in SLOTS])}
    || ' ' || (10000 + c_custkey % 90000) END AS address,
  (20000 + c_custkey % 70000)::VARCHAR AS zipcode,
  CASE WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE (20 + c_custkey % 50)::VARCHAR END AS lat,
  (-70 - c_custkey % 40)::VARCHAR AS lon,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 8)::VARCHAR END AS rating,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE (c_custkey % 1000)::VARCHAR END AS rating_count,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE (c_custkey % 7) || '.5' END AS price_category,
  'https://maps.example/' || c_custkey AS url,
  CASE WHEN c_custkey % 2 = 0 THEN '{{}}' ELSE 'segment ' || c_mktsegment END AS detail FROM customer""",
    "replay_log": """SELECT event_id AS row_id, intent, arm AS historical_arm,
  CASE WHEN action IN ('detail_open', 'like') THEN 1 ELSE 0 END AS reward FROM actions""",
    "predictions": """SELECT d.doc_id, quality AS y, ((d.doc_id * 37) % 101)::DOUBLE / 100.0::DOUBLE AS score,
  1.0::DOUBLE + ((d.doc_id * 7) % 9)::DOUBLE / 2.0::DOUBLE AS actual,
  1.0::DOUBLE + ((d.doc_id * 11) % 41)::DOUBLE / 10.0::DOUBLE AS predicted, 'm' || (d.doc_id % 3) AS model, lang AS target
 FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "centroids": """SELECT label AS query_id, list(x ORDER BY i) AS vec FROM (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label""",
}
_NEEDS = {"replay_log": ["actions"]}


def with_views(names: str, body: str, extra: str = "") -> str:
    """``body`` preceded by the named views as common table expressions; ``extra`` adds more of them."""
    ordered: list[str] = []
    for n in names.split():
        for dep in (*_NEEDS.get(n, []), n):
            if dep not in ordered:
                ordered.append(dep)
    ctes = [f"{n} AS ({SQL[n]})" for n in ordered]
    if extra:
        ctes.append(extra)
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body if ctes else body


def sql_list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def tfidf_sql(source: str, key: str, text: str) -> str:
    """Common table expressions postings(doc_id, term, w) and vocab(term, idf)."""
    return f"""words AS (SELECT {key} AS doc_id, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
  lambda x: NOT list_contains({sql_list(INDEX_STOPWORDS)}, x)) AS w FROM {source}),
 terms AS (SELECT doc_id, unnest(w) AS term FROM words UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
 counts AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
 vocab AS MATERIALIZED (SELECT term, ln((n + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM counts, (SELECT count(*) AS n FROM {source})
  GROUP BY term, n),
 raw_w AS (SELECT doc_id, term, tf * idf AS r FROM counts JOIN vocab USING (term)),
 postings AS MATERIALIZED (SELECT doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM raw_w)"""
