"""Checked queries: radius joins, competition features, extents and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.functions.columns import haversine_km
from placelens.operators import modeling, spatial, vectors
from placelens.plans import views as v
from placelens.plans.registry import check, rounded
from placelens.plans.views import with_views
from placelens.session import cut


def _hav(a: str, b: str) -> str:
    return (
        f"2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude))"
        f" * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"
    )


@check("sp1_haversine", with_views("places", f"""SELECT p.business_id, round({_hav('p', 'q')}, 6) AS km
 FROM places p, (SELECT 36.1627::DOUBLE AS latitude, -86.7816::DOUBLE AS longitude) q"""))
def haversine(spark, sf):
    point = haversine_km(F.col("latitude"), F.col("longitude"), F.lit(36.1627), F.lit(-86.7816))
    return rounded(v.places(spark, sf).select("business_id", point.alias("km")))


_PAIRS = f"""pairs AS MATERIALIZED (SELECT a.business_id AS id, b.business_id AS ref_id, a.cats, b.cats AS ref_cats, b.stars, b.is_open,
  {_hav('a', 'b')} AS d, len(list_intersect(a.cats, b.cats)) > 0 AS same
  FROM TARGETS a JOIN REFS b ON abs(a.latitude - b.latitude) < 0.03 AND abs(a.longitude - b.longitude) < 0.05
  WHERE COND AND {_hav('a', 'b')} <= 3.0)"""
_CATS = """p AS (SELECT *, list_distinct(list_filter(list_transform(string_split(categories, ','), lambda x: trim(x)),
  lambda x: x <> '')) AS cats FROM places)"""


def _pairs(targets: str = "p", refs: str = "p", cond: str = "a.business_id <> b.business_id") -> str:
    return _PAIRS.replace("TARGETS", targets).replace("REFS", refs).replace("COND", cond)


@check("sp2_radius_join", with_views("places", "SELECT id AS target_id, ref_id, round(d, 6) AS distance_km FROM pairs",
 _CATS + ", " + _pairs()))
def radius_join(spark, sf):
    p = v.places(spark, sf).select("business_id", "latitude", "longitude")
    pairs = spatial.radius_join(
        p.withColumnRenamed("business_id", "target_id"), p.withColumnRenamed("business_id", "ref_id"), exclude_self=True, digits=6
    )
    return pairs.select("target_id", "ref_id", "distance_km")


def _stats(scope: str, label: str, refs: str = "p") -> str:
    hit = "" if scope == "all" else " AND same"
    cols = []
    for r in ("0.5", "1.0", "3.0"):
        t = r.replace(".", "_") + "km"
        cols += [
            f"count(*) FILTER (d <= {r}{hit}) AS count_{label}_{t}",
            f"round(coalesce(avg(pairs.stars) FILTER (d <= {r}{hit}), (SELECT avg(stars) FROM {refs})), 6) AS avg_rating_{label}_{t}",
            f"round(coalesce(avg(pairs.is_open) FILTER (d <= {r}{hit}), (SELECT avg(is_open) FROM {refs})), 6) AS survival_{label}_{t}",
        ]
    return ", ".join(cols)


def _per_target(cols: str, targets: str = "p", key: str = "business_id") -> str:
    return f"SELECT t.business_id AS {key}, {cols} FROM {targets} t LEFT JOIN pairs ON pairs.id = t.business_id GROUP BY 1"


@check("sp3_ring_stats", with_views("places", _per_target(_stats("all", "all")), _CATS + ", " + _pairs()))
def ring_stats(spark, sf):
    p = v.places(spark, sf)
    return rounded(spatial.ring_stats(p, p, exclude_self=True))


def _diversity(targets: str = "p", key: str = "business_id") -> str:
    cols = ", ".join(
        f"count(DISTINCT c) FILTER (d <= {r}) AS diversity_{r.replace('.', '_')}km" for r in ("0.5", "1.0", "3.0")
    )
    return f"""SELECT t.business_id AS {key}, {cols} FROM {targets} t LEFT JOIN (SELECT id, d, unnest(ref_cats) AS c FROM pairs) x
 ON x.id = t.business_id GROUP BY 1"""


@check("sp4_ring_diversity", with_views("places", _diversity(), _CATS + ", " + _pairs()))
def ring_diversity(spark, sf):
    p = v.places(spark, sf)
    return spatial.ring_diversity(p, p, exclude_self=True).select(
        "business_id", *[F.col(f"`diversity_{r}km`").alias(f"diversity_{r.replace('.', '_')}km") for r in ("0.5", "1.0", "3.0")]
    )


@check("sp5_same_category_stats", with_views("places", _per_target(_stats("same", "same_cat")), _CATS + ", " + _pairs()))
def same_category(spark, sf):
    p = v.places(spark, sf)
    return rounded(spatial.same_category_stats(p, p, exclude_self=True))


@check("sp6_nearest_same_category", with_views("places",
 _per_target("round(coalesce(min(d) FILTER (same), 3.0), 6) AS dist_nearest_same_cat", "p2"), _CATS
 + ", p2 AS (SELECT * REPLACE (list_filter(cats, lambda x: x <> 'Restaurants') AS cats) FROM p), " + _pairs("p2", "p2")))
def nearest(spark, sf):
    p = v.places(spark, sf).withColumn("categories", F.regexp_replace("categories", "^Restaurants, ", ""))
    return rounded(spatial.nearest_same_category(p, p, exclude_self=True))


_TOP5 = """best AS (SELECT t.business_id AS id, r.stars, r.is_open, row_number() OVER (PARTITION BY t.business_id ORDER BY
  len(list_intersect(t.cats, r.cats)) / sqrt(len(t.cats) * len(r.cats)) DESC, r.business_id) AS rn
  FROM p t JOIN p r ON t.business_id <> r.business_id)"""


@check("sp7_top5_similar_category", with_views("places", """SELECT id AS business_id, round(avg(stars), 6) AS avg_rating_top5_similar,
 round(avg(is_open), 6) AS survival_top5_similar FROM best WHERE rn <= 5 GROUP BY 1""", _CATS + ", " + _TOP5))
def top5(spark, sf):
    p = v.places(spark, sf)
    return rounded(spatial.top5_similar_category(p, p, exclude_self=True))


def _transforms_sql() -> str:
    cols = ["business_id"]
    for r in ("0_5km", "1_0km", "3_0km"):
        cols += [
            f"round(ln(1 + count_all_{r}), 5) AS log_count_all_{r}",
            f"round(ln(1 + count_same_cat_{r}), 5) AS log_count_same_cat_{r}",
            f"(count_all_{r} > 0)::INT::DOUBLE AS has_any_{r}",
            f"(count_same_cat_{r} > 0)::INT::DOUBLE AS has_same_cat_{r}",
            f"(count_all_{r} < 5)::INT::DOUBLE AS low_count_{r}",
            f"round(count_same_cat_{r} / (count_all_{r} + 1.0), 5) AS same_cat_ratio_{r}",
            f"round(avg_rating_all_{r} - gs, 5) + 0.0 AS rating_gap_global_{r}",
            f"round(survival_same_cat_{r} - go, 5) + 0.0 AS same_cat_survival_gap_global_{r}",
            f"round(avg_rating_same_cat_{r} - avg_rating_all_{r}, 5) + 0.0 AS same_cat_vs_local_rating_gap_{r}",
        ]
    raw = (_stats("all", "all") + ", " + _stats("same", "same_cat")).replace("round(coalesce", "(coalesce").replace(", 6)", ")")
    inner = _per_target(raw)
    return f"SELECT {', '.join(cols)} FROM ({inner}), (SELECT avg(stars) AS gs, avg(is_open) AS go FROM p)"


@check("sp8_spatial_transforms", with_views("places", _transforms_sql(), _CATS + ", " + _pairs()))
def transforms(spark, sf):
    p = v.places(spark, sf)
    wide = spatial.spatial_transforms(spatial.competition_features(p, p, exclude_self=True))
    keep = [
        "log_count_all", "log_count_same_cat", "has_any", "has_same_cat", "low_count", "same_cat_ratio", "rating_gap_global",
        "same_cat_survival_gap_global", "same_cat_vs_local_rating_gap",
    ]
    names = [f"{k}_{r}km" for r in ("0.5", "1.0", "3.0") for k in keep]
    return rounded(wide.select("business_id", *[F.col(f"`{n}`") for n in names]), 5)


_SPLIT = """, s AS (SELECT *, ('0x' || substr(md5(business_id || ':42'), 1, 8))::BIGINT % 10000 < 8000 AS train FROM p),
 tr AS (SELECT * FROM s WHERE train)"""
_SPLIT_PAIRS = ", " + _pairs("s", "tr")


@check("sp9_train_test_features", with_views("places", """SELECT t.business_id, CASE WHEN t.train THEN 'train' ELSE 'test' END AS split,
 count(d) AS count_all_3_0km, count(*) FILTER (same AND d <= 1.0) AS count_same_cat_1_0km,
 round(coalesce(avg(stars_) FILTER (d <= 0.5), (SELECT avg(stars) FROM tr)), 6) AS avg_rating_all_0_5km,
 round(ln(1 + coalesce(min(d) FILTER (same), 3.0)), 6) AS log_dist_nearest_same_cat
 FROM s t LEFT JOIN (SELECT id, d, same, stars AS stars_ FROM pairs) x ON x.id = t.business_id GROUP BY 1, 2""",
 _CATS + _SPLIT + _SPLIT_PAIRS))
def train_test(spark, sf):
    p = modeling.split_rows(v.places(spark, sf), {"train": 0.8, "test": 0.2})
    wide = spatial.train_test_features(p)
    names = ["count_all_3.0km", "count_same_cat_1.0km", "avg_rating_all_0.5km", "log_dist_nearest_same_cat"]
    return rounded(wide.select("business_id", "split", *[F.col(f"`{n}`") for n in names]))


def sites(spark, sf):
    """One candidate site per supplier, in and around the cities of the places."""
    s = v.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    slot = k % 4
    return s.select(
        F.concat(F.lit("s"), k.cast("string")).alias("site_id"),
        v._pick(slot, [c[0] for c in v.SLOTS]).alias("city"),
        v._pick(slot, [c[1] for c in v.SLOTS]).alias("state"),
        (v._pick(slot, [c[2] for c in v.SLOTS]) + ((k * 37) % 330).cast("double") / 1000.0).alias("latitude"),
        (v._pick(slot, [c[3] for c in v.SLOTS]) + ((k * 53) % 330).cast("double") / 1000.0).alias("longitude"),
        v._pick(k % 4, ["gear", "bolt, promo", "economy", "widget, small"]).alias("categories"),
    )


SITES_SQL = f"""sites AS (SELECT 's' || s_suppkey AS business_id, {v._case("s_suppkey % 4", [v._q(s[0]) for s in v.SLOTS])} AS city,
  {v._case("s_suppkey % 4", [v._q(s[1]) for s in v.SLOTS])} AS state,
  {v._case("s_suppkey % 4", [f"{s[2]}::DOUBLE" for s in v.SLOTS])} + ((s_suppkey * 37) % 330)::DOUBLE / 1000.0::DOUBLE AS latitude,
  {v._case("s_suppkey % 4", [f"{s[3]}::DOUBLE" for s in v.SLOTS])} + ((s_suppkey * 53) % 330)::DOUBLE / 1000.0::DOUBLE AS longitude,
  {v._case("s_suppkey % 4", ["['gear']", "['bolt', 'promo']", "['economy']", "['widget', 'small']"])} AS cats FROM supplier)"""


@check("sp10_score_sites_features", with_views("places", """SELECT t.business_id AS site_id, count(d) AS count_all_3_0km,
 count(*) FILTER (same) AS count_same_cat_3_0km, count(*) FILTER (d <= 1.0) AS count_all_1_0km,
 round(coalesce(avg(is_open) FILTER (same), (SELECT avg(is_open) FROM p)), 6) AS survival_same_cat_3_0km,
 round(coalesce(min(d) FILTER (same), 3.0), 6) AS dist_nearest_same_cat, round(any_value(top.s), 6) AS avg_rating_top5_similar
 FROM sites t LEFT JOIN pairs ON pairs.id = t.business_id JOIN (SELECT id, avg(stars) AS s FROM best WHERE rn <= 5 GROUP BY 1) top
 ON top.id = t.business_id GROUP BY 1""", _CATS + ", " + SITES_SQL + ", " + _pairs("sites", "p", "true") + """,
 best AS (SELECT t.business_id AS id, r.stars, row_number() OVER (PARTITION BY t.business_id ORDER BY
  len(list_intersect(t.cats, r.cats)) / sqrt(len(t.cats) * len(r.cats)) DESC, r.business_id) AS rn FROM sites t, p r)"""))
def site_features(spark, sf):
    wide = spatial.score_sites_features(sites(spark, sf), v.places(spark, sf))
    names = [
        "count_all_3.0km", "count_same_cat_3.0km", "count_all_1.0km", "survival_same_cat_3.0km", "dist_nearest_same_cat",
        "avg_rating_top5_similar",
    ]
    return rounded(wide.select("site_id", *[F.col(f"`{n}`") for n in names]))


@check("sp11_local_reference", with_views("places", """SELECT business_id, 'city' AS part FROM places WHERE lower(city) = 'tampa' AND state = 'FL'
 UNION ALL SELECT business_id, 'all' FROM places"""))
def local_reference(spark, sf):
    p = v.places(spark, sf)
    city = spatial.local_reference(p, " Tampa", "fl").select("business_id", F.lit("city").alias("part"))
    return city.unionByName(spatial.local_reference(p, None).select("business_id", F.lit("all").alias("part")))


@check("sp12_city_catalog", with_views("places", """SELECT city, state, count(*) AS row_count, round(avg(latitude), 6) AS center_lat,
 round(avg(longitude), 6) AS center_lon FROM places GROUP BY 1, 2 HAVING count(*) >= 10"""))
def city_catalog(spark, sf):
    return rounded(spatial.city_catalog(v.places(spark, sf)))


@check("sp13_coverage_bbox", with_views("places", """SELECT city, state, count(*) AS reference_count, count(latitude) AS geo_count,
 round(min(longitude), 6) AS min_lon, round(min(latitude), 6) AS min_lat, round(max(longitude), 6) AS max_lon,
 round(max(latitude), 6) AS max_lat, round(avg(longitude), 6) AS center_lon, round(avg(latitude), 6) AS center_lat
 FROM places GROUP BY 1, 2"""))
def coverage(spark, sf):
    return rounded(spatial.coverage_bbox(v.places(spark, sf)))


@check("sp14_convex_hull")
def hull(spark, sf):
    rings = spatial.convex_hull(v.places(spark, sf))
    return rounded(rings.select("city", "state", F.posexplode("ring").alias("pos", "p")).select("city", "state", "pos", "p.lon", "p.lat"))


CORNERS = [(-0.01, 0.02), (0.22, -0.01), (0.31, 0.18), (0.12, 0.29), (-0.01, 0.02)]


def _ring(city_lat: float, city_lon: float):
    return F.array(*[F.struct(F.lit(city_lon + x).alias("lon"), F.lit(city_lat + y).alias("lat")) for x, y in CORNERS])


def _edges_sql() -> str:
    rows = []
    for city, state, lat, lon in v.SLOTS:
        for (x1, y1), (x2, y2) in zip(CORNERS, CORNERS[1:]):
            rows.append(f"('{city}', {lon + x1!r}::DOUBLE, {lat + y1!r}::DOUBLE, {lon + x2!r}::DOUBLE, {lat + y2!r}::DOUBLE)")
    return "edges(city, x1, y1, x2, y2) AS (VALUES " + ", ".join(rows) + ")"


@check("sp15_point_in_polygon", with_views("places", """SELECT business_id, (count(*) FILTER ((y1 > latitude) <> (y2 > latitude)
 AND longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1) % 2)::INT AS inside FROM places JOIN edges USING (city) GROUP BY 1""",
 _edges_sql()))
def in_polygon(spark, sf):
    p = v.places(spark, sf)
    ring = F.lit(None)
    for city, _, lat, lon in v.SLOTS:
        ring = F.when(F.col("city") == city, _ring(lat, lon)).otherwise(ring)
    rings = p.select("city", "state").distinct().withColumn("ring", ring)
    return spatial.point_in_polygon(p, rings).select("business_id", "inside")


@check("sp14_hull_checks", with_views("places", """SELECT city, state, min(longitude) AS west, max(longitude) AS east, min(latitude) AS south,
 max(latitude) AS north, 1 AS closed, 1 AS corners_are_places, 0 AS left_turns_missing, 0 AS places_outside FROM places GROUP BY city, state"""))
def hull_checks(spark, sf):
    """A ring is the hull if it is closed, turns left at every corner, and no place lies to the right of an edge."""
    p = v.places(spark, sf).select("city", "state", F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    rings = cut(spatial.convex_hull(v.places(spark, sf)))
    edges = rings.select("city", "state", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("ring") - 1),
        lambda i: F.struct(F.element_at("ring", i).alias("a"), F.element_at("ring", i + 1).alias("b"), F.get("ring", F.pmod(i, F.size("ring") - 1) + 1).alias("c")),
    )).alias("e")).select("city", "state", "e.*")
    turn = lambda a, b, x, y: (b["lon"] - a["lon"]) * (y - a["lat"]) - (b["lat"] - a["lat"]) * (x - a["lon"])
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    turns = edges.groupBy("city", "state").agg(F.count_if(turn(a, b, c["lon"], c["lat"]) <= 0).cast("int").alias("left_turns_missing"))
    outside = p.join(edges, ["city", "state"]).groupBy("city", "state").agg(F.count_if(turn(a, b, F.col("x"), F.col("y")) < -1e-12).cast("int").alias("places_outside"))
    corners = edges.select("city", "state", "a").join(p.distinct(), ["city", "state"]).groupBy("city", "state", "a").agg(
        F.bool_or((F.col("x") == a["lon"]) & (F.col("y") == a["lat"])).alias("known")
    ).groupBy("city", "state").agg(F.bool_and("known").cast("int").alias("corners_are_places"))
    end = lambda f, part: f(F.transform("ring", lambda q: q[part]))
    shape = rings.select("city", "state", end(F.array_min, "lon").alias("west"), end(F.array_max, "lon").alias("east"), end(F.array_min, "lat").alias("south"),
                         end(F.array_max, "lat").alias("north"), (F.col("ring")[0] == F.element_at("ring", -1)).cast("int").alias("closed"))
    return shape.join(turns, ["city", "state"]).join(outside, ["city", "state"]).join(corners, ["city", "state"])


@check("sp16_geojson_features")
def geojson(spark, sf):
    p = v.places(spark, sf)
    return spatial.geojson_features(p, spatial.convex_hull(p))


@check("sp16_geojson_points", with_views("places", "SELECT city, state, longitude, latitude, 1 AS valid_hull FROM places"))
def geojson_points(spark, sf):
    """The coordinates read back from the GeoJSON texts: every place once."""
    shape = "struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>>"
    read = F.from_json("sample_points_geojson", shape)["geometry"]["coordinates"]
    rows = geojson(spark, sf).select("city", "state", "valid_hull", F.explode(read).alias("c"))
    return rows.select("city", "state", F.col("c")[0].alias("longitude"), F.col("c")[1].alias("latitude"), "valid_hull")


# --- vectors -----------------------------------------------------------------------------------------------

_COS = """round(list_inner_product(q.vec, e.v) / (sqrt(list_inner_product(q.vec, q.vec)) * sqrt(list_inner_product(e.v, e.v))), 6)"""
_VEC = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@check("kn1_radius_neighbors", with_views("centroids", """SELECT q.query_id, e.vec_id, round(list_distance(q.vec, e.v), 6) AS distance
 FROM centroids q, e WHERE list_distance(q.vec, e.v) <= 0.97""", _VEC))
def radius_vectors(spark, sf):
    return rounded(vectors.radius_neighbors(v.label_centroids(spark, sf), v.vectors(spark, sf), 0.97))


@check("kn2_cosine_top_k", with_views("centroids", f"""SELECT query_id, vec_id, similarity, rank FROM (SELECT q.query_id, e.vec_id,
 {_COS} AS similarity, row_number() OVER (PARTITION BY q.query_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM centroids q, e)
 WHERE rank <= 5""", _VEC))
def top_k_vectors(spark, sf):
    return rounded(vectors.cosine_top_k(v.label_centroids(spark, sf), v.vectors(spark, sf), 5))


@check("kn3_fit_norms", f"WITH {_VEC} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM e")
def norms(spark, sf):
    return rounded(vectors.fit_norms(v.vectors(spark, sf)).select("vec_id", "norm"))


@check("kn4_approx_neighbors")
def approx(spark, sf):
    return rounded(vectors.approx_neighbors(v.label_centroids(spark, sf), v.vectors(spark, sf), 0.97))


@check("kn4_recall", with_views("centroids", """SELECT count(*) AS pairs, 1 AS recall_reached FROM centroids q, e
 WHERE list_distance(q.vec, e.v) <= 0.97""", _VEC))
def approx_recall(spark, sf):
    """Whether the approximate search finds at least nine tenths of the exact pairs, and none besides them."""
    exact = radius_vectors(spark, sf).select("query_id", "vec_id", F.lit(1).alias("exact"))
    found = approx(spark, sf).select("query_id", "vec_id", F.lit(1).alias("found"))
    both = exact.join(found, ["query_id", "vec_id"], "full_outer")
    wrong = F.count_if(F.col("exact").isNull())
    hits = F.count_if(F.col("exact").isNotNull() & F.col("found").isNotNull())
    reached = (hits >= 0.9 * F.count("exact")) & (wrong == 0)
    return both.agg(F.count("exact").alias("pairs"), reached.cast("int").alias("recall_reached"))
