"""Radius joins, local competition features and extents of place tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions.columns import EARTH_RADIUS_KM, any_of, category_set, haversine_km, safe_double
from placelens.functions.frames import salted_join, top_per_group
from placelens.functions.grid import home_cell, nearby_cells
from placelens.operators.vectors import set_top_k
from placelens.session import cut

RADII = (0.5, 1.0, 3.0)
SPOT = ["slice", "latitude", "longitude"]
# Rows of one position that a radius join keeps in one list.
SPOT_ROWS = 1024
# Reference rows of a grid cell that meet their targets in one task.
CELL_ROWS = 10_000
MEASURES = ("n", "stars", "open", "n_stars", "n_open")
# Cells of ring sums: so many to the largest radius, none larger than this, and none beyond this latitude.
CELLS_PER_RADIUS = 32
MAX_CELL_KM = 10.0
CELL_LATITUDE = 80


def with_point(df: DataFrame) -> DataFrame:
    """Rows with usable coordinates, as doubles."""
    lat, lon = safe_double(F.col("latitude")), safe_double(F.col("longitude"))
    return df.withColumns({"latitude": lat, "longitude": lon}).where(
        F.col("latitude").between(-90, 90) & F.col("longitude").isNotNull()
    )


def _cell_pairs(targets: DataFrame, ref: DataFrame, radius_km: float, **salts) -> DataFrame:
    """Rows of both sides within the radius, by an equi-join on grid cells; cells of very many reference rows are salted."""
    left = with_point(targets).withColumn("cell", F.explode(nearby_cells("latitude", "longitude", radius_km)))
    right = (
        with_point(ref)
        .withColumn("cell", home_cell("latitude", "longitude", radius_km))
        .withColumnsRenamed({"latitude": "ref_latitude", "longitude": "ref_longitude"})
    )
    distance = haversine_km(F.col("latitude"), F.col("longitude"), F.col("ref_latitude"), F.col("ref_longitude"))
    pairs = salted_join(left, right, "cell", **salts).withColumn("distance_km", distance).where(F.col("distance_km") <= radius_km)
    return pairs.drop("cell")


def _spots(rows: DataFrame, name: str) -> DataFrame:
    """Rows gathered by position: latitude, longitude and ``name``, their other columns; at most about ``SPOT_ROWS`` in a list."""
    rows = with_point(rows)
    others = [F.col(f"`{c}`") for c in rows.columns if c not in SPOT[1:]]
    many = rows.groupBy(*SPOT[1:]).agg(F.count("*").alias("_n")).where(F.col("_n") > SPOT_ROWS)
    part = F.pmod(F.xxhash64(*others), F.coalesce(F.ceil(F.col("_n") / SPOT_ROWS), F.lit(1))).alias("_part")
    parts = rows.join(many, SPOT[1:], "left").select(*SPOT[1:], part, F.struct(*others).alias(name))
    return parts.groupBy(*SPOT[1:], "_part").agg(F.collect_list(name).alias(name)).drop("_part")


def radius_join(
    targets: DataFrame,
    ref: DataFrame,
    radius_km: float = 3.0,
    target_key: str = "target_id",
    ref_key: str = "ref_id",
    exclude_self: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """Pairs (target row, ref row, distance_km) with distance <= radius; with ``digits`` the distance is rounded.

    Both inputs carry latitude and longitude. Positions are joined, and rows at one position go with it as a list: the
    distance is found once for each pair of positions, and only the task that writes the pairs opens the lists. So the
    rows of a target and a distance follow each other in the same order, which Parquet stores in a small part of the
    bytes of scattered rows.
    """
    tasks = 4 * int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _cell_pairs(_spots(targets, "_targets"), _spots(ref, "_refs"), radius_km, min_rows=CELL_ROWS, rows=F.size("_refs"), parts=tasks)
    if digits is not None:
        pairs = pairs.withColumn("distance_km", F.round("distance_km", digits))
    opened = pairs.withColumn("_target", F.explode("_targets")).drop("_targets").withColumn("_ref", F.explode("_refs")).drop("_refs")
    at = lambda c, side, end: F.col(f"{end}{c}") if c in SPOT[1:] else F.col(f"{side}.`{c}`").alias(c)
    mine, theirs = [at(c, "_target", "") for c in targets.columns], [at(c, "_ref", "ref_") for c in ref.columns]
    pairs = opened.select(*mine, *theirs, "distance_km")
    if exclude_self:
        pairs = pairs.where(F.col(target_key) != F.col(ref_key))
    return pairs


def _slice(by: str | None) -> Column:
    return (F.col(by) if by else F.lit("")).alias("slice")


def reference_profiles(ref: DataFrame, by: str | None = None) -> DataFrame:
    """Places that share coordinates and category set, as one row with their count, sums and numbers of known values."""
    rows = with_point(ref).select(
        _slice(by), "latitude", "longitude", category_set(F.col("categories")).alias("cats"), "stars", "is_open"
    )
    return rows.groupBy("slice", "latitude", "longitude", "cats").agg(
        F.count("*").alias("n"),
        F.expr("coalesce(sum(double(stars)), 0D) AS stars"),
        F.expr("coalesce(sum(double(is_open)), 0D) AS open"),
        F.expr("count(double(stars)) AS n_stars"),
        F.expr("count(double(is_open)) AS n_open"),
    )


def _tag(r: float) -> str:
    return f"{float(r)}km"


def neighbour_totals(
    targets: DataFrame, ref: DataFrame, radii: Sequence[float] = RADII, by: str | None = None
) -> DataFrame:
    """Neighbour counts and sums per distinct (latitude, longitude, category set) of the targets.

    Work is done on distinct profiles, so copies at one spot cost one row. Neighbours are added up per category,
    which gives the diversity, then per profile. Pairs are aggregated in the join stage and never stored. Sums
    include the target's own spot; ``own_n`` tells how many reference rows share it.
    """
    key = ["slice", "latitude", "longitude", "cats"]
    profiles = with_point(targets).select(
        _slice(by), "latitude", "longitude", category_set(F.col("categories")).alias("cats")
    ).distinct()
    near = reference_profiles(ref, by).withColumnsRenamed({"cats": "ref_cats", "slice": "ref_slice"})
    pairs = _cell_pairs(profiles, near, max(radii)).where("slice = ref_slice")
    own = "latitude = ref_latitude AND longitude = ref_longitude AND cats = ref_cats"
    pairs = pairs.selectExpr(
        *key, "ref_cats", "distance_km", *MEASURES, "arrays_overlap(cats, ref_cats) AS same", f"{own} AS own"
    )
    sums = {
        f"{scope}_{m}_{_tag(r)}": f"if(distance_km <= {float(r)}D{' AND same' if scope == 'same' else ''}, {m}, 0)"
        for r in radii
        for scope in ("all", "same")
        for m in MEASURES
    }
    # The sums of a neighbour ride on its first category, so one pass over the pairs serves both.
    opened = pairs.select("*", F.posexplode_outer("ref_cats").alias("pos", "cat"))
    by_cat = opened.groupBy(*key, "cat").agg(
        *[F.expr(f"sum(if(pos IS NULL OR pos = 0, {v}, 0)) AS `{k}`") for k, v in sums.items()],
        F.expr("min(distance_km) AS d_any"),
        F.expr("min(if(own, NULL, distance_km)) AS d_other"),
        F.expr("min(if(same AND NOT own, distance_km, NULL)) AS d_same_other"),
        F.expr("max(if(own, n, NULL)) AS own_n"),
    )
    kinds = [
        F.expr(f"count_if(cat IS NOT NULL AND d_{d} <= {float(r)}D) AS `cats_{d}_{_tag(r)}`")
        for r in radii
        for d in ("any", "other")
    ]
    return by_cat.groupBy(*key).agg(
        *[F.expr(f"sum(`{k}`) AS `{k}`") for k in sums],
        *kinds,
        F.expr("min(d_same_other) AS d_same_other"),
        F.expr("coalesce(max(own_n), 0) AS own_n"),
    )


def with_global_means(df: DataFrame, ref: DataFrame, by: str | None = None) -> DataFrame:
    """Add mean stars and mean is_open of the whole reference set, or of the row's slice of it."""
    means = ref.groupBy(_slice(by)).agg(
        F.avg(F.col("stars").cast("double")).alias("global_stars"),
        F.avg(F.col("is_open").cast("double")).alias("global_open"),
    )
    if by:
        return df.join(means, "slice", "left")
    return df.withColumns({c: means.select(c).scalar() for c in ("global_stars", "global_open")})


def _target_rows(targets: DataFrame, key: str, exclude_self: bool, by: str | None) -> DataFrame:
    own = [F.expr("double(stars) AS own_stars"), F.expr("double(is_open) AS own_open")] if exclude_self else []
    return with_point(targets).select(key, _slice(by), "latitude", "longitude", category_set(F.col("categories")).alias("cats"), *own)


def _ring_columns(scope: str, r: float, exclude_self: bool) -> list[str]:
    """Count and means of one radius from its totals, less the row's own share; missing values enter no mean."""
    mine = {"n": "1", "stars": "coalesce(own_stars, 0)", "open": "coalesce(own_open, 0)", "n_stars": "int(own_stars IS NOT NULL)", "n_open": "int(own_open IS NOT NULL)"}

    def total(m: str) -> str:
        known = f"coalesce(`{scope}_{m}_{_tag(r)}`, 0)"
        if not exclude_self:
            return known
        return f"({known} - {mine[m] if scope == 'all' else f'if(size(cats) > 0, {mine[m]}, 0)'})"

    end = f"{'all' if scope == 'all' else 'same_cat'}_{_tag(r)}"
    means = [
        f"if({total(f'n_{m}')} > 0, {total(m)} / {total(f'n_{m}')}, global_{m}) AS `{label}_{end}`"
        for m, label in (("stars", "avg_rating"), ("open", "survival"))
    ]
    return [f"bigint({total('n')}) AS `count_{end}`", *means]


def competition_features(
    targets: DataFrame,
    ref: DataFrame,
    key: str = "business_id",
    radii: Sequence[float] = RADII,
    exclude_self: bool = False,
    by: str | None = None,
) -> DataFrame:
    """Per target and radius: count, mean stars, mean is_open, category diversity, the same over places sharing
    a category, and the distance to the nearest of those.

    With ``exclude_self`` the targets are rows of ``ref`` and each row's own share is taken back out. Where no
    neighbour is left the means are those of the whole reference set and the distance is the largest radius.
    With ``by`` only places of the target's own slice count, for neighbours and for those means.
    """
    rows = _target_rows(targets, key, exclude_self, by)
    totals = neighbour_totals(targets, ref, radii, by)
    joined = rows.join(totals, ["slice", "latitude", "longitude", "cats"], "left")
    joined = with_global_means(joined, ref, by)
    out = []
    for r in radii:
        t = _tag(r)
        out += _ring_columns("all", r, exclude_self) + _ring_columns("same", r, exclude_self)
        kinds = f"if(own_n >= 2, `cats_any_{t}`, `cats_other_{t}`)" if exclude_self else f"`cats_any_{t}`"
        out.append(f"coalesce({kinds}, 0) AS `diversity_{t}`")
    twins = 2 if exclude_self else 1
    nearest = f"""if(coalesce(own_n, 0) >= {twins} AND size(cats) > 0, 0D, coalesce(d_same_other, {float(max(radii))}D))"""
    return joined.selectExpr(key, *out, f"{nearest} AS dist_nearest_same_cat", "global_stars", "global_open")


def _pick(df: DataFrame, key: str, prefixes: Sequence[str]) -> DataFrame:
    names = [c for c in df.columns if any(c.startswith(p) for p in prefixes)]
    return df.select(key, *[F.col(f"`{c}`") for c in names])


def _cells(spots: DataFrame, cell_km: float) -> DataFrame:
    """Positions with ``node``, the small cell of their slice they lie in.

    Up to ``CELL_LATITUDE`` degrees cells are about as wide as they are high; beyond, every position is its own node.
    """
    polar = F.abs("latitude") > CELL_LATITUDE
    alone = [F.when(polar, F.col(c)).otherwise(0.0).alias(f"polar_{c}") for c in ("latitude", "longitude")]
    cell = home_cell("latitude", "longitude", cell_km).alias("cell")
    return spots.where(F.col("slice").isNotNull()).withColumn("node", F.struct("slice", cell, *alone))


def _node_table(spots: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """Middle, reach and totals of each node. No member is farther from the middle than the reach: half the height
    along a meridian and half the width along the widest parallel lead there."""
    lon = F.pmod(F.col("longitude") + 180.0, F.lit(360.0)) - 180.0
    box = spots.groupBy("node").agg(
        F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"),
        F.min(F.abs("latitude")).alias("inner"), *[F.sum(m).alias(m) for m in sums],
    )
    widest = "cos(radians(if(south < 0 AND north > 0, 0D, inner)))"
    reach = F.expr(f"{EARTH_RADIUS_KM}D * (radians(north - south) + {widest} * radians(east - west)) / 2")
    one = F.expr("south = north AND west = east")
    return box.select(
        "node", F.expr("(south + north) / 2 AS latitude"), F.expr("(west + east) / 2 AS longitude"),
        F.when(one, 0.0).otherwise(reach * (1 + 1e-6) + 1e-6).alias("reach"), *sums,
    )


def _settle(pairs: DataFrame, slack: Column, radii: Sequence[float]) -> DataFrame:
    """Which radii a pair is wholly inside of (``in_i``) and for which it has to be looked at closer (``open_i``)."""
    d = haversine_km(F.col("latitude"), F.col("longitude"), F.col("ref_latitude"), F.col("ref_longitude"))
    pairs = pairs.withColumns({"d": d, "slack": slack})
    inside = {f"in_{i}": F.col(f"open_{i}") & (F.col("d") + F.col("slack") <= float(r)) for i, r in enumerate(radii)}
    border = {f"open_{i}": F.col(f"open_{i}") & ~F.col(f"in_{i}") & (F.col("d") - F.col("slack") <= float(r)) for i, r in enumerate(radii)}
    return pairs.withColumns(inside).withColumns(border).drop("d", "slack")


def _inside_sums(pairs: DataFrame, keys: Sequence[str], radii: Sequence[float]) -> DataFrame:
    any_in = any_of([F.col(f"in_{i}") for i in range(len(radii))])
    return pairs.where(any_in).groupBy(*keys).agg(
        *[F.sum(F.when(F.col(f"in_{i}"), F.col(m)).otherwise(0)).alias(f"all_{m}_{_tag(r)}") for i, r in enumerate(radii) for m in MEASURES]
    )


def ring_steps(
    targets: DataFrame, ref: DataFrame, radii: Sequence[float] = RADII, by: str | None = None
) -> tuple[DataFrame, list[tuple[DataFrame, list[str]]]]:
    """Target positions, and the pairs that each step of ``ring_totals`` looks at with the keys they are added up by."""
    cell_km = min(max(radii) / CELLS_PER_RADIUS, MAX_CELL_KM)
    spots = cut(_cells(with_point(targets).select(_slice(by), *SPOT[1:]).distinct(), cell_km))
    places = reference_profiles(ref, by).groupBy(*SPOT).agg(*[F.sum(m).alias(m) for m in MEASURES])
    places = cut(_cells(places, cell_km))
    borders = [f"open_{i}" for i in range(len(radii))]
    undecided = any_of([F.col(c) for c in borders])
    nodes = _node_table(places, MEASURES).withColumnsRenamed({"node": "ref_node", "reach": "ref_reach"})
    # Reaches are below 1.25 cells.
    near = _cell_pairs(_node_table(spots), nodes, max(radii) + 2.5 * cell_km).where("node.slice = ref_node.slice")
    first = _settle(near.withColumns({c: F.lit(True) for c in borders}), F.col("reach") + F.col("ref_reach"), radii)
    rest = cut(first.where(undecided).select("node", "ref_node", "ref_latitude", "ref_longitude", "ref_reach", *MEASURES, *borders))
    second = _settle(salted_join(rest, spots, "node"), F.col("ref_reach"), radii)
    rest = second.where(undecided).select("ref_node", *SPOT, *borders)
    members = places.drop("slice").withColumnsRenamed({"node": "ref_node", "latitude": "ref_latitude", "longitude": "ref_longitude"})
    third = _settle(salted_join(rest, members, "ref_node"), F.lit(0.0), radii)
    return spots, [(first, ["node"]), (second, SPOT), (third, SPOT)]


def ring_totals(targets: DataFrame, ref: DataFrame, radii: Sequence[float] = RADII, by: str | None = None) -> DataFrame:
    """Counts and sums of the places within each radius of every distinct target position.

    Cells are small against the radius. A pair of cells that lies wholly inside a ring adds the total of one to
    all members of the other; pairs on a border are looked at target by target, and only cells on the border of
    a target's own ring point by point. A spot where most places lie costs one pair per cell.
    """
    spots, steps = ring_steps(targets, ref, radii, by)
    cells, *single = [_inside_sums(pairs, keys, radii) for pairs, keys in steps]
    rows = salted_join(cells, spots, "node").drop("node")
    for part in single:
        rows = rows.unionByName(part)
    return rows.groupBy(*SPOT).agg(*[F.sum(f"`{c}`").alias(c) for c in rows.columns if c not in SPOT])


def ring_stats(targets: DataFrame, ref: DataFrame, key: str = "business_id", exclude_self: bool = False) -> DataFrame:
    rows = _target_rows(targets, key, exclude_self, None).join(ring_totals(targets, ref), SPOT, "left")
    return with_global_means(rows, ref).selectExpr(key, *[c for r in RADII for c in _ring_columns("all", r, exclude_self)])


def ring_diversity(targets: DataFrame, ref: DataFrame, key: str = "business_id", exclude_self: bool = False) -> DataFrame:
    return _pick(competition_features(targets, ref, key, RADII, exclude_self), key, ["diversity_"])


def same_category_stats(targets: DataFrame, ref: DataFrame, key: str = "business_id", exclude_self: bool = False) -> DataFrame:
    full = competition_features(targets, ref, key, RADII, exclude_self)
    return _pick(full, key, ["count_same_cat_", "avg_rating_same_cat_", "survival_same_cat_"])


def nearest_same_category(targets: DataFrame, ref: DataFrame, key: str = "business_id", exclude_self: bool = False) -> DataFrame:
    return competition_features(targets, ref, key, RADII, exclude_self).select(key, "dist_nearest_same_cat")


def top5_similar_category(
    targets: DataFrame,
    ref: DataFrame,
    key: str = "business_id",
    exclude_self: bool = False,
    k: int = 5,
    by: str | None = None,
) -> DataFrame:
    """Mean stars and is_open of the k reference places most similar by category set, however far away.

    Similarity only depends on the category sets, so it is searched among distinct sets. The best k+1 places
    of a set lie in its k+1 best sets ordered by (similarity, smallest id), each giving at most k+1 places.
    """
    places = ref.select(
        F.col("business_id").alias("ref_id"),
        _slice(by),
        category_set(F.col("categories")).alias("ref_cats"),
        F.col("stars").cast("double").alias("stars"),
        F.col("is_open").cast("double").alias("is_open"),
    )
    heads = top_per_group(places, ["slice", "ref_cats"], [F.asc("ref_id")], k + 1, "pos")
    corpus = heads.where("pos = 1").select("slice", "ref_cats", "ref_id")
    rows = targets.select(key, _slice(by), category_set(F.col("categories")).alias("cats"))
    best_sets = set_top_k(rows.select("slice", "cats").distinct(), corpus, k + 1)
    candidates = best_sets.join(heads.drop("pos"), ["slice", "ref_cats"])
    order = [F.desc("similarity"), F.asc("ref_id")]
    best = top_per_group(candidates, ["slice", "cats"], order, k + 1, "pos")
    # At most k+1 rows per category set are gathered.
    listed = best.groupBy("slice", "cats").agg(
        F.array_sort(F.collect_list(F.struct("pos", "ref_id", "stars", "is_open"))).alias("best")
    )
    rows = rows.join(listed, ["slice", "cats"], "left")
    usable = F.filter("best", lambda b: b["ref_id"] != F.col(key)) if exclude_self else F.col("best")
    rows = with_global_means(rows.withColumn("best", F.slice(usable, 1, k)), ref, by)

    def mean(field: str, fallback: str) -> Column:
        values = F.filter(F.transform("best", lambda b: b[field]), lambda v: v.isNotNull())
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.col(fallback))

    return rows.select(
        key,
        mean("stars", "global_stars").alias("avg_rating_top5_similar"),
        mean("is_open", "global_open").alias("survival_top5_similar"),
    )


def spatial_transforms(df: DataFrame, radii: Sequence[float] = RADII) -> DataFrame:
    """Logs, flags, ratios and gaps derived from the competition features."""
    out = []
    for r in radii:
        t = _tag(r)
        n_all, n_same = f"`count_all_{t}`", f"`count_same_cat_{t}`"
        new = {
            "log_count_all": f"log1p(greatest({n_all}, 0))",
            "log_count_same_cat": f"log1p({n_same})",
            "has_any": f"double({n_all} > 0)",
            "has_same_cat": f"double({n_same} > 0)",
            "low_count": f"double({n_all} < 5)",
            "same_cat_ratio": f"{n_same} / ({n_all} + 1D)",
            "rating_gap_global": f"`avg_rating_all_{t}` - global_stars",
            "survival_gap_global": f"`survival_all_{t}` - global_open",
            "same_cat_rating_gap_global": f"`avg_rating_same_cat_{t}` - global_stars",
            "same_cat_survival_gap_global": f"`survival_same_cat_{t}` - global_open",
            "same_cat_vs_local_rating_gap": f"`avg_rating_same_cat_{t}` - `avg_rating_all_{t}`",
            "same_cat_vs_local_survival_gap": f"`survival_same_cat_{t}` - `survival_all_{t}`",
            "log_diversity": f"log1p(`diversity_{t}`)",
        }
        out += [f"{v} AS `{k}_{t}`" for k, v in new.items()]
    return df.selectExpr("*", *out, "log1p(dist_nearest_same_cat) AS log_dist_nearest_same_cat")


def all_features(
    targets: DataFrame,
    ref: DataFrame,
    key: str = "business_id",
    exclude_self: bool = False,
    by: str | None = None,
) -> DataFrame:
    """Competition features, category neighbours and transforms in one table."""
    local = competition_features(targets, ref, key, RADII, exclude_self, by)
    similar = top5_similar_category(targets, ref, key, exclude_self, by=by)
    wide = spatial_transforms(local.join(similar, key, "left"))
    numbers = [f.name for f in wide.schema.fields if f.name != key]
    return wide.select(key, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in numbers]).drop(
        "global_stars", "global_open"
    )


def train_test_features(df: DataFrame, split: str = "split") -> DataFrame:
    """Train rows measured against the other train rows, test rows against all train rows only."""
    train, test = df.where(F.col(split) == "train"), df.where(F.col(split) == "test")
    a = all_features(train, train, exclude_self=True).withColumn(split, F.lit("train"))
    b = all_features(test, train, exclude_self=False).withColumn(split, F.lit("test"))
    return a.unionByName(b)


def score_sites_features(sites: DataFrame, ref: DataFrame, by: str | None = None) -> DataFrame:
    """Features of a table of candidate sites (site_id, latitude, longitude, categories)."""
    return all_features(sites, ref, key="site_id", exclude_self=False, by=by)


def local_reference(ref: DataFrame, city: str | None, state: str | None = None) -> DataFrame:
    """Places of one city, or all places when no city is asked for."""
    if city and city.strip():
        local = ref.where(F.lower("city") == city.strip().lower())
        if state and state.strip():
            local = local.where(F.upper(F.trim("state")) == state.strip().upper())
        return local
    return ref


def city_catalog(ref: DataFrame, min_rows: int = 10) -> DataFrame:
    rows = ref.select(
        F.trim("city").alias("city"),
        F.coalesce(F.upper(F.trim("state")), F.lit("")).alias("state"),
        safe_double(F.col("latitude")).alias("lat"),
        safe_double(F.col("longitude")).alias("lon"),
        "business_id",
    ).where(F.col("city") != "")
    grouped = rows.groupBy(F.lower("city").alias("city_norm"), "state").agg(
        F.min_by("city", "business_id").alias("city"),
        F.count("*").alias("row_count"),
        F.avg("lat").alias("center_lat"),
        F.avg("lon").alias("center_lon"),
    )
    kept = grouped.where(
        (F.col("row_count") >= min_rows) & F.col("center_lat").isNotNull() & F.col("center_lon").isNotNull()
    )
    return kept.drop("city_norm").orderBy(F.desc("row_count"), F.lower("city"), "state")


def coverage_bbox(ref: DataFrame) -> DataFrame:
    lat, lon = safe_double(F.col("latitude")), safe_double(F.col("longitude"))
    both = lat.isNotNull() & lon.isNotNull()
    la, lo = F.when(both, lat), F.when(both, lon)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ref.groupBy("city", "state").agg(
        F.count("*").alias("reference_count"),
        F.count(la).alias("geo_count"),
        zero(F.min(lo)).alias("min_lon"),
        zero(F.min(la)).alias("min_lat"),
        zero(F.max(lo)).alias("max_lon"),
        zero(F.max(la)).alias("max_lat"),
        zero(F.avg(lo)).alias("center_lon"),
        zero(F.avg(la)).alias("center_lat"),
    )


def _ring(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Counter-clockwise hull of sorted distinct points, collinear points left out."""

    def chain(pts):
        kept: list[tuple[float, float]] = []
        for x, y in pts:
            while len(kept) > 1:
                (ax, ay), (bx, by) = kept[-2], kept[-1]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                kept.pop()
            kept.append((x, y))
        return kept

    if len(points) < 3:
        return points
    return chain(points)[:-1] + chain(points[::-1])[:-1]


def _hull_frame(pdf: pd.DataFrame, slices: Sequence[str]) -> Iterator[pd.DataFrame]:
    for values, group in pdf.groupby(list(slices), dropna=False):
        pts = sorted(set(zip(group["lon"], group["lat"])))
        yield pd.DataFrame(_ring(pts), columns=["lon", "lat"]).assign(**dict(zip(slices, values)))


def _partial_hulls(slices: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _hull_frame(pdf, slices):
                yield part[[*slices, "lon", "lat"]]

    return run


def convex_hull(ref: DataFrame, slices: Sequence[str] = ("city", "state"), rounds: int = 2) -> DataFrame:
    """Closed hull ring per slice as array<struct<lon,lat>>; NULL below three corners.

    The hull of a union is the hull of the hulls, so each Arrow batch first shrinks to its own corners; salted
    rounds shrink them further before the few corners of a slice meet in one group.
    """
    slices = list(slices)
    schema = ", ".join(f"{s} string" for s in slices) + ", lon double, lat double"
    points = with_point(ref).select(
        *[F.coalesce(F.col(s), F.lit("")).alias(s) for s in slices],
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
    )
    corners = points.mapInPandas(_partial_hulls(slices), schema)
    for step in range(rounds):
        salt = F.pmod(F.xxhash64("lon", "lat", F.lit(step)), F.lit(64 // (8**step)))

        def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.concat([p[[*slices, "lon", "lat"]] for p in _hull_frame(pdf[[*slices, "lon", "lat"]], slices)])

        corners = corners.withColumn("salt", salt).groupBy(*slices, "salt").applyInPandas(shrink, schema)

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {s: [pdf[s].iloc[0]] for s in slices}
        ring = _ring(sorted(set(zip(pdf["lon"], pdf["lat"]))))
        closed = [{"lon": x, "lat": y} for x, y in ring + ring[:1]] if len(ring) > 2 else None
        return pd.DataFrame({**head, "ring": [closed]})

    out = ", ".join(f"{s} string" for s in slices) + ", ring array<struct<lon:double,lat:double>>"
    return corners.groupBy(*slices).applyInPandas(close, out)


def inside_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test against a closed ring as one expression; NULL or short rings hold nothing."""
    edges = F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b")),
    )

    def crosses(e):
        a, b = e["a"], e["b"]
        rise = F.when(b["lat"] == a["lat"], F.lit(1e-18)).otherwise(b["lat"] - a["lat"])
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / rise + a["lon"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at)

    return F.coalesce(
        F.when(F.size(ring) >= 4, F.pmod(F.size(F.filter(edges, crosses)), F.lit(2)) == 1), F.lit(False)
    )


def point_in_polygon(points: DataFrame, rings: DataFrame, slices: Sequence[str] = ("city", "state")) -> DataFrame:
    joined = points.join(rings, list(slices), "left")
    flag = inside_ring(F.col("longitude"), F.col("latitude"), F.col("ring"))
    return joined.withColumn("inside", flag.cast("int")).drop("ring")


POINTS_PER_CHUNK = 1000


def point_chunks(ref: DataFrame, slices: Sequence[str]) -> DataFrame:
    """All places with a point, dealt by id into chunks of about ``POINTS_PER_CHUNK`` per slice."""
    points = with_point(ref)
    sizes = points.groupBy(*slices).agg(F.ceil(F.count("*") / POINTS_PER_CHUNK).cast("bigint").alias("_chunks"))
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in slices])
    dealt = points.alias("a").join(sizes.alias("b"), same).select("a.*", "_chunks")
    return dealt.withColumn("chunk", F.pmod(F.xxhash64("business_id", "longitude", "latitude"), F.col("_chunks"))).drop("_chunks")


def sample_points(ref: DataFrame, slices: Sequence[str] = ("city", "state"), max_points: int = 400) -> DataFrame:
    """Per slice a repeatable sample of at most ``max_points`` places, drawn by a hash of the id."""
    order = [F.asc(F.xxhash64("business_id")), F.asc("business_id")]
    return top_per_group(with_point(ref), list(slices), order, max_points, "draw")


def geojson_features(ref: DataFrame, hulls: DataFrame, slices: Sequence[str] = ("city", "state"), max_points: int | None = None) -> DataFrame:
    """GeoJSON texts per slice and chunk: the hull polygon, and the places as multi-points.

    All places are given, in chunks of bounded size; with ``max_points`` one chunk holds a sample of that size.
    """
    slices = list(slices)
    pair = lambda p: F.array(p["lon"], p["lat"])
    if max_points is None:
        points = point_chunks(ref, slices).withColumn("draw", F.col("business_id"))
    else:
        points = sample_points(ref, slices, max_points).withColumn("chunk", F.lit(0).cast("bigint"))
    # Hulls carry empty names where the place has none.
    points = points.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in slices})
    sample = points.groupBy(*slices, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("draw", F.col("longitude").alias("lon"), F.col("latitude").alias("lat")))).alias("dots")
    )

    def feature(kind: str, geometry: str, coordinates: Column) -> Column:
        return F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.lit(kind).alias("kind")).alias("properties"),
                F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            )
        )

    polygon = feature("reference_convex_hull", "Polygon", F.array(F.transform("ring", pair)))
    dots = feature("reference_sample", "MultiPoint", F.transform("dots", pair))
    joined = hulls.join(sample, slices, "left")
    return joined.select(
        *slices,
        F.coalesce("chunk", F.lit(0)).alias("chunk"),
        F.when(F.col("ring").isNotNull(), polygon).alias("hull_geojson"),
        F.when(F.col("dots").isNotNull(), dots).alias("sample_points_geojson"),
        F.col("ring").isNotNull().cast("int").alias("valid_hull"),
    )
