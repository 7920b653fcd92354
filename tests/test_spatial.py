"""Radius joins, competition features and hulls against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens.functions import frames
from placelens.operators import spatial, vectors


def km(a, b):
    (la, lo), (lb, ob) = a, b
    s = math.sin(math.radians(lb - la) / 2) ** 2
    s += math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(ob - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, s)))


def cloud(n, lat, lon, spread, seed):
    rng = random.Random(seed)
    wrap = lambda x: (x + 180) % 360 - 180
    return [(i, max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), wrap(lon + rng.uniform(-spread, spread))) for i in range(n)]


@pytest.mark.parametrize(
    "lat,lon,spread,radius",
    [(40, -75, 0.1, 3.0), (64, 10, 0.2, 3.0), (0, 180, 0.1, 3.0), (89.9, 0, 0.2, 8.0), (-89.95, 170, 5, 20.0), (0, 0, 80, 900.0)],
)
def test_radius_join_equals_brute_force(spark, lat, lon, spread, radius):
    pts = cloud(150, lat, lon, spread, 1)
    df = spark.createDataFrame(pts, "id long, latitude double, longitude double")
    pairs = spatial.radius_join(df.withColumnRenamed("id", "target_id"), df.withColumnRenamed("id", "ref_id"), radius)
    got = sorted((r["target_id"], r["ref_id"]) for r in pairs.collect())
    want = sorted((a[0], b[0]) for a in pts for b in pts if km(a[1:], b[1:]) <= radius)
    assert got == want


def test_radius_join_opens_shared_positions_last(spark, monkeypatch):
    """Rows that share positions come out as runs of one distance; lists and cells are split and lose no row."""
    rng = random.Random(4)
    spots = [(40 + 0.004 * i, -75.0 + 0.003 * (i % 3)) for i in range(9)]
    rows = [(i if i % 31 else None, *spots[rng.randrange(9)]) for i in range(300)] + [(900, None, 1.0), (901, 40.0, float("nan")), (5, *spots[0])]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double").repartition(4)
    near = [(a[0], b[0], round(km(a[1:], b[1:]), 6)) for a in rows for b in rows if None not in a[1:] + b[1:] and km(a[1:], b[1:]) <= 1.0]
    want = sorted(x for x in near if None not in x and x[0] != x[1])
    for spot_rows, cell_rows in ((1024, 10_000), (4, 7)):
        monkeypatch.setattr(spatial, "SPOT_ROWS", spot_rows)
        monkeypatch.setattr(spatial, "CELL_ROWS", cell_rows)
        pairs = spatial.radius_join(df.withColumnRenamed("id", "target_id"), df.withColumnRenamed("id", "ref_id"), 1.0, exclude_self=True, digits=6)
        assert pairs.columns == ["target_id", "latitude", "longitude", "ref_id", "ref_latitude", "ref_longitude", "distance_km"]
        got = [(r["target_id"], r["ref_id"], r["distance_km"]) for r in pairs.collect()]
        assert sorted(got) == want
        if spot_rows == 1024:
            assert sum(a[2] != b[2] for a, b in zip(got, got[1:])) < 81 < len(got) // 20


def test_salted_join_keeps_all_pairs_of_hot_keys(spark):
    probe = spark.createDataFrame([("h", i) for i in range(3)] + [("c", 9), ("x", 1)], "key string, p int")
    build = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1)], "key string, b int")
    got = sorted(tuple(r) for r in frames.salted_join(probe, build, "key", min_rows=5).select("key", "p", "b").collect())
    want = sorted(tuple(r) for r in probe.join(build, "key").select("key", "p", "b").collect())
    assert got == want and len(got) == 151


def brute_features(places, i):
    me = places[i]
    near = [(km(me[1:3], p[1:3]), p) for j, p in enumerate(places) if j != i]
    near = [(d, p) for d, p in near if d <= 3.0]
    out = {}
    for r in (0.5, 1.0, 3.0):
        hit = [p for d, p in near if d <= r]
        same = [p for p in hit if set(p[3]) & set(me[3])]
        out[f"count_all_{r}km"] = len(hit)
        out[f"count_same_cat_{r}km"] = len(same)
        out[f"diversity_{r}km"] = len({c for p in hit for c in p[3]})
        out[f"sum_{r}"] = sum(p[4] for p in hit)
    out["nearest"] = min([d for d, p in near if set(p[3]) & set(me[3])], default=3.0)
    return out


def test_features_with_copies_at_one_spot(spark):
    rng = random.Random(3)
    spots = [(40 + rng.uniform(0, 0.03), -75 + rng.uniform(0, 0.03)) for _ in range(12)]
    kinds = [["Pizza"], ["Pizza", "Bars"], ["Tea"], []]
    places = []
    for i in range(60):
        lat, lon = rng.choice(spots)
        places.append((f"b{i:02}", lat, lon, rng.choice(kinds), rng.randint(2, 10) / 2, rng.randint(0, 1)))
    rows = [(p[0], p[1], p[2], ",".join(p[3]), p[4], p[5]) for p in places]
    df = spark.createDataFrame(rows, "business_id string, latitude double, longitude double, categories string, stars double, is_open int")
    got = {r["business_id"]: r for r in spatial.competition_features(df, df, exclude_self=True).collect()}
    mean = sum(p[4] for p in places) / len(places)
    for i, p in enumerate(places):
        want, row = brute_features(places, i), got[p[0]]
        for r in (0.5, 1.0, 3.0):
            for name in (f"count_all_{r}km", f"count_same_cat_{r}km", f"diversity_{r}km"):
                assert row[name] == want[name], (p[0], name)
            n = want[f"count_all_{r}km"]
            assert row[f"avg_rating_all_{r}km"] == pytest.approx(want[f"sum_{r}"] / n if n else mean)
        assert row["dist_nearest_same_cat"] == pytest.approx(want["nearest"], abs=1e-9)


def test_lonely_site_gets_global_means(spark):
    ref = spark.createDataFrame([("a", 10.0, 10.0, "Tea", 4.0, 1), ("b", 10.001, 10.0, "Tea", 2.0, 0)],
                                "business_id string, latitude double, longitude double, categories string, stars double, is_open int")
    sites = spark.createDataFrame([("s", -50.0, 60.0, "Tea")], "site_id string, latitude double, longitude double, categories string")
    row = spatial.score_sites_features(sites, ref).first()
    assert row["count_all_3.0km"] == 0 and row["avg_rating_all_3.0km"] == 3.0 and row["dist_nearest_same_cat"] == 3.0
    assert row["avg_rating_top5_similar"] == 3.0


def test_hull_holds_all_points(spark):
    pts = cloud(400, 40, -75, 0.5, 5)
    rows = [("c", "S", la, lo) for _, la, lo in pts] + [("two", "S", 1.0, 1.0), ("two", "S", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "city string, state string, latitude double, longitude double")
    rings = {r["city"]: r["ring"] for r in spatial.convex_hull(df).collect()}
    assert rings["two"] is None
    ring = [(p["lon"], p["lat"]) for p in rings["c"]]
    assert ring[0] == ring[-1]
    for _, la, lo in pts:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            assert (bx - ax) * (la - ay) - (by - ay) * (lo - ax) >= -1e-9


def test_inside_ring(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]])
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (1.0, -0.1)], "longitude double, latitude double")
    got = [r[0] for r in df.select(spatial.inside_ring(F.col("longitude"), F.col("latitude"), square)).collect()]
    assert got == [True, False, False]
    none = F.lit(None).cast("array<struct<lon:double,lat:double>>")
    assert df.select(spatial.inside_ring(F.col("longitude"), F.col("latitude"), none)).first()[0] is False


def test_cosine_top_k_beyond_corpus_and_zero_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0])], "query_id long, vec array<double>")
    rows = {(r["query_id"], r["vec_id"]): r["similarity"] for r in vectors.cosine_top_k(queries, corpus, 99).collect()}
    assert rows[(7, 1)] == 1.0 and rows[(7, 2)] == 0.0 and rows[(7, 3)] == -1.0
    assert all(rows[(8, i)] == 0.0 for i in (1, 2, 3))


def test_blocks_do_not_change_the_neighbours(spark, monkeypatch):
    rng = random.Random(2)
    corpus = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(corpus, "vec_id long, embedding array<double>")
    queries = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    whole = {tuple(r)[:2] for r in vectors.cosine_top_k(queries, df, 3).select("query_id", "vec_id").collect()}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "CELL_ROWS", 11)
    assert whole == {tuple(r)[:2] for r in vectors.cosine_top_k(queries, df, 3).select("query_id", "vec_id").collect()}
    near = {tuple(r) for r in vectors.radius_neighbors(queries, df, 1.2).select("query_id", "vec_id").collect()}
    assert near == {(a, b) for a, x in corpus for b, y in corpus if math.dist(x, y) <= 1.2}


def test_far_cells_are_skipped_and_the_corpus_is_dealt_once(spark):
    rng = random.Random(5)
    rows = [(i, [100.0 * (i % 8) + rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    cells = vectors.index_cells(df.select("vec_id", F.col("embedding").alias("vec")))
    assert cells.rows.count() == 800 and cells.bounds.count.sum() == 800
    visits = vectors.cells_to_visit(queries, cells.bounds, lambda far: np.full(len(far), 3.0))
    assert vectors.skipped_share(queries, cells.bounds, visits) > 0.8
    near = {tuple(r) for r in vectors.radius_neighbors(queries, df, 3.0).select("query_id", "vec_id").collect()}
    assert near == {(a, b) for a, x in rows[:40] for b, y in rows if math.dist(x, y) <= 3.0}
    best = vectors.cosine_top_k(queries, df, 4)
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / math.hypot(*x) / math.hypot(*y)
    for q, x in rows[:40]:
        want = sorted((round(cos(x, y), 9) for _, y in rows), reverse=True)[:4]
        assert [round(r["similarity"], 9) for r in best.where(F.col("query_id") == q).orderBy("rank").collect()] == want


def _sets(n, seed=8):
    """Sets of three or four: one category that all hold, and rarer ones whose number grows with n."""
    rng = random.Random(seed)
    return sorted({("all", f"m{rng.randrange(n // 12)}", *{f"r{rng.randrange(n // 4)}" for _ in range(rng.randint(1, 2))}) for _ in range(n)})


def test_best_sets_against_all_pairs_and_pairs_compared(spark):
    compared = []
    for n in (300, 1200):
        sets = [(f"s{i:05d}", list(x), "a" if i % 10 else "b") for i, x in enumerate(_sets(n))]
        extra = [("s99998", [], "a"), ("s99999", ["lonely"], "b")]
        known = spark.createDataFrame(sets + extra, "ref_id string, ref_cats array<string>, slice string")
        queries = known.select("slice", F.col("ref_cats").alias("cats")).union(spark.createDataFrame([("a", ["new", "m1"])], "slice string, cats array<string>"))
        pairs = vectors.set_pairs(queries, known, 3)
        assert pairs.count() == pairs.select("slice", "cats", "ref_id").distinct().count()
        compared.append(pairs.count() / len(sets))
        if n == 300:
            rows = vectors.set_top_k(queries, known, 3).collect()
            got = {}
            for r in rows:
                got.setdefault((r["slice"], tuple(r["cats"])), []).append((-round(r["similarity"], 9), r["set_id"]))
            for (s, cats), found in got.items():
                scores = sorted((-round(len({*cats} & {*c}) / math.sqrt(len(cats) * len(c)), 9) if cats and c else 0.0, i) for i, c, t in sets + extra if t == s)
                assert sorted(found) == scores[:3]
            assert len(got) == queries.distinct().count()
    assert compared[1] < 2 * compared[0]


RING_SCHEMA = "business_id long, latitude double, longitude double, categories string, stars double, is_open int"


def _ring_places(points, seed):
    rng = random.Random(seed)
    return [(i, a, o, "Pizza", rng.choice([1.0, 2.5, 4.0, None]), rng.choice([0, 1, None])) for i, a, o in points]


@pytest.mark.parametrize("lat,lon,spread", [(40, -75, 0.05), (0, 180, 0.03), (79.99, 10, 0.1), (89.98, 0, 0.05), (-60, 30, 0.004)])
def test_ring_sums_equal_brute_force(spark, lat, lon, spread):
    places = _ring_places(cloud(260, lat, lon, spread, 4), 5)
    lat, lon = float(lat), float(lon)
    places += [(300, lat, lon, None, 3.0, 1), (301, lat, lon, "Bar", None, None), (302, None, lon, "Bar", 1.0, 1)]
    got = {r["business_id"]: r.asDict() for r in spatial.ring_stats(*[spark.createDataFrame(places, RING_SCHEMA)] * 2, exclude_self=True).collect()}
    usable = [p for p in places if p[1] is not None]
    assert set(got) == {p[0] for p in usable}
    mean = lambda xs: sum(xs) / len(xs)
    known = lambda rows, c: [p[c] for p in rows if p[c] is not None]
    for me in usable:
        for r in (0.5, 1.0, 3.0):
            near = [p for p in usable if p[0] != me[0] and km(me[1:3], p[1:3]) <= r]
            row = got[me[0]]
            assert row[f"count_all_{r}km"] == len(near)
            for c, name in ((4, "avg_rating"), (5, "survival")):
                want = mean(known(near, c) or known(places, c))
                assert row[f"{name}_all_{r}km"] == pytest.approx(want, abs=1e-9)


def test_pairs_of_ring_sums_with_most_places_in_one_cell(spark):
    """Four times the places in one cell of a town: pairs of cells stay, all pairs grow in step with the places."""
    pairs = []
    for n in (400, 1600):
        points = cloud(n, 40.0003, -75.0003, 0.0002, 6) + [(n + i, a, o) for i, a, o in cloud(100, 40, -75, 0.02, 7)]
        places = spark.createDataFrame(_ring_places(points, 8), RING_SCHEMA)
        _, steps = spatial.ring_steps(places, places)
        pairs.append([rows.count() for rows, _ in steps])
    # Pairs of cells stay; the places of the dense cell are looked at one by one only where a ring's border meets it.
    assert abs(pairs[0][0] - pairs[1][0]) <= 0.1 * pairs[0][0]
    assert sum(pairs[1]) < 0.05 * 1700 * 1700
    assert sum(pairs[1]) < 5 * sum(pairs[0])
