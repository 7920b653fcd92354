"""Checked queries: splits, scaling, models, evaluation, zones, category requests and site scoring."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from placelens.functions.columns import category_set
from placelens.functions.lexicons import CATEGORY_ALIASES, CATEGORY_FALLBACKS
from placelens.operators import components, evaluation, features, modeling, sites, spatial, text_signals, zones
from placelens.plans import views as v
from placelens.plans.checks_spatial import _CATS, _SPLIT, _SPLIT_PAIRS, SITES_SQL
from placelens.plans.checks_spatial import sites as site_table
from placelens.plans.checks_text import _LEX, ASPECTS, NEGATIVE, POSITIVE
from placelens.plans.registry import check, rounded
from placelens.plans.views import with_views
from placelens.session import cut

ROUNDS = 5


# --- preparation -------------------------------------------------------------------------------------------


@check("ml1_split_rows", with_views("places", """SELECT business_id, CASE WHEN h < 6000 THEN 'train' WHEN h < 8000 THEN 'val' ELSE 'test' END AS split
 FROM (SELECT business_id, ('0x' || substr(md5(business_id || ':42'), 1, 8))::BIGINT % 10000 AS h FROM places)"""))
def split(spark, sf):
    parts = modeling.split_rows(v.places(spark, sf), {"train": 0.6, "val": 0.2, "test": 0.2})
    return parts.select("business_id", "split")


@check("ml1_split_overlap", "SELECT 'x' AS business_id, 0::BIGINT AS parts WHERE false")
def overlap(spark, sf):
    return modeling.split_overlap(modeling.split_rows(v.reviews(spark, sf), {"train": 0.6, "val": 0.2, "test": 0.2}))


@check("ml2_impute_and_standardize", with_views("places", """SELECT business_id, split, round((coalesce(p, m) - a) / d, 6) AS price, round((review_count - a2) / d2, 6) AS review_count
 FROM x, (SELECT median(p) AS m FROM x WHERE split = 'train') , (SELECT avg(coalesce(p, (SELECT median(p) FROM x WHERE split = 'train'))) AS a,
 stddev_pop(coalesce(p, (SELECT median(p) FROM x WHERE split = 'train'))) AS d, avg(review_count) AS a2, stddev_pop(review_count) AS d2 FROM x WHERE split = 'train')""",
 """x AS (SELECT business_id, review_count, try_cast(regexp_extract(attributes, 'RestaurantsPriceRange2'': ''([0-9])', 1) AS DOUBLE) AS p,
 CASE WHEN ('0x' || substr(md5(business_id || ':42'), 1, 8))::BIGINT % 10000 < 8000 THEN 'train' ELSE 'test' END AS split FROM places)"""))
def scaling(spark, sf):
    places = v.places(spark, sf)
    rows = modeling.split_rows(places, {"train": 0.8, "test": 0.2}).join(features.price_columns(places), "business_id")
    rows = rows.select("business_id", "split", F.col("price_tier").alias("price"), F.col("review_count").cast("double").alias("review_count"))
    fitted = modeling.fit_scaling(rows.where("split = 'train'"), ["price", "review_count"])
    return rounded(modeling.standardize(rows, fitted))


@check("ml3_category_text_vectors")
def text_vectors(spark, sf):
    rows = modeling.category_text_vectors(v.places(spark, sf))[0]
    return rows.select("business_id", F.size(vector_to_array("category_vec")).alias("dims"))


@check("ml5_split_diagnostics", with_views("places", """SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS split, count(*) AS rows, round(avg(is_open), 6) AS survival_rate,
 round(avg(stars), 6) AS mean_stars, median(n) AS median_count_0_5km, round(median(near), 6) AS median_nearest FROM (SELECT t.business_id, t.train, any_value(t.is_open) AS is_open,
 any_value(t.stars) AS stars, count(*) FILTER (d <= 0.5) AS n, coalesce(min(d) FILTER (same), 3.0) AS near FROM s t LEFT JOIN (SELECT id, d, same FROM pairs) x
 ON x.id = t.business_id GROUP BY 1, 2) GROUP BY 1""", _CATS + _SPLIT + _SPLIT_PAIRS))
def diagnostics(spark, sf):
    places = modeling.split_rows(v.places(spark, sf), {"train": 0.8, "test": 0.2})
    train = places.where("split = 'train'")
    a = spatial.competition_features(train, train, exclude_self=True)
    b = spatial.competition_features(places.where("split = 'test'"), train)
    return rounded(modeling.split_diagnostics(a.unionByName(b).join(places.select("business_id", "split", "is_open", "stars"), "business_id")))


def training_table(spark, sf):
    """Wide model table of all places with split, cut once because every fit reads it again."""
    places = modeling.split_rows(v.places(spark, sf), {"train": 0.8, "test": 0.2})
    wide = spatial.train_test_features(places).drop("split")
    base = places.select(
        "business_id", "split", "city", "state", "categories", "latitude", "longitude", "stars", "is_open", "review_count",
        category_set(F.col("categories")).alias("cats"),
    )
    prices = features.price_columns(places).select("business_id", F.col("price_range").cast("double").alias("price_range"))
    joined = base.join(features.hour_features(places), "business_id").join(prices, "business_id").join(wide, "business_id")
    return cut(modeling.model_columns(joined))


def _parts(table):
    return table.where("split = 'train'"), table.where("split = 'test'")


@check("ml4_assemble_features", with_views("places", """SELECT business_id, state, latitude, stars, review_count::DOUBLE AS review_count,
 len(list_distinct(list_filter(list_transform(string_split(categories, ','), lambda c: trim(c)), lambda c: c <> ''))) + 1 AS flags FROM places"""))
def assemble(spark, sf):
    from pyspark.ml import Pipeline

    places = v.places(spark, sf)
    rows = places.withColumn("cats", category_set(F.col("categories")))
    stages = modeling.assemble_stages(["latitude", "stars", "review_count"], state=True)
    ready = Pipeline(stages=stages).fit(rows).transform(rows)
    x = vector_to_array("features")
    flags = F.aggregate(F.slice(x, F.lit(4), F.size(x)), F.lit(0.0), lambda a, c: a + c).cast("bigint")
    named = [x[i].alias(c) for i, c in enumerate(("latitude", "stars", "review_count"))]
    return ready.select("business_id", "state", *named, flags.alias("flags"))


@check("ml6_train_survival")
def survival(spark, sf):
    train, test = _parts(training_table(spark, sf))
    names = modeling.feature_families()
    models = modeling.train_survival(train, names["Base"] + names["LatLon"], ROUNDS)
    out = None
    for kind, model in models.items():
        rows = modeling.probability(model.transform(test)).select("business_id", F.lit(kind).alias("model"), "score", "is_open")
        out = rows if out is None else out.unionByName(rows)
    return out


@check("ml7_ablation_select")
def ablation(spark, sf):
    train, test = _parts(training_table(spark, sf))
    _, steps = modeling.ablation_select(train, test, rounds=ROUNDS)
    return spark.createDataFrame(steps, "family string, auc double, kept boolean")


@check("ml8_train_stars")
def stars(spark, sf):
    train, test = _parts(training_table(spark, sf))
    out = None
    for kind, model in modeling.train_stars(train, rounds=ROUNDS).items():
        rows = model.transform(test).select(F.lit(kind).alias("model"), F.col("stars").alias("actual"), F.col("prediction").alias("predicted"))
        out = rows if out is None else out.unionByName(rows)
    return evaluation.regression_metrics(out, ["model"])


def multi_target_table(spark, sf):
    places = modeling.split_rows(v.places(spark, sf), {"train": 0.6, "val": 0.2, "test": 0.2})
    reviews = v.reviews(spark, sf)
    targets = text_signals.weak_aspect_targets(reviews, places, 1, ASPECTS, POSITIVE, NEGATIVE)
    signals = text_signals.review_signals(reviews, places, **_LEX)
    base = places.select(
        "business_id", "split", "state", "latitude", "longitude", "review_count", "is_open", "stars",
        category_set(F.col("categories")).alias("cats"), text_signals.star_weights(F.col("stars")).alias("weight"),
    )
    joined = base.join(targets, "business_id").join(signals, "business_id", "left").join(features.attribute_features(places), "business_id")
    return cut(joined.na.fill(0))


MULTI_FEATURES = ["latitude", "longitude", "review_count", "is_open", "attr_price_range", *text_signals.REVIEW_SIGNALS]
TARGETS = ["stars", *[f"target_{a}" for a in ASPECTS]]


@check("ml9_train_multi_target")
def multi_target(spark, sf):
    table = multi_target_table(spark, sf)
    models = modeling.train_multi_target(table.where("split = 'train'"), TARGETS, MULTI_FEATURES, rounds=ROUNDS)
    rows = modeling.predict_multi_target(models, table.where("split = 'test'"), TARGETS)
    return evaluation.regression_metrics(rows, ["model", "target"])


@check("ml10_tiered_regression")
def tiered(spark, sf):
    table = multi_target_table(spark, sf)
    rows = modeling.tiered_regression(table.where("split = 'train'"), table.where("split = 'test'"), "stars", MULTI_FEATURES, rounds=ROUNDS, min_tier_rows=28)
    return rows.select("business_id", "stars", "predicted", "pred_tier", "true_tier", "tier_rows", "model_used")


# --- evaluation --------------------------------------------------------------------------------------------

_HALF = "least(greatest(round_even(({0} - 1) * 2, 0) / 2 + 1, 1), 5)::DOUBLE"


@check("ev1_auc", with_views("predictions", """SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auc
 FROM predictions p, predictions n WHERE p.y = 1 AND n.y = 0"""))
def auc(spark, sf):
    return rounded(evaluation.auc(v.predictions(spark, sf)))


@check("ev2_best_f1_threshold", with_views("predictions", """SELECT round(f1, 6) AS best_f1, threshold FROM (SELECT t / 100.0::DOUBLE AS threshold,
 2.0::DOUBLE * count(*) FILTER (y = 1 AND score >= t / 100.0::DOUBLE) / (count(*) FILTER (score >= t / 100.0::DOUBLE) + count(*) FILTER (y = 1)) AS f1
 FROM predictions, range(0, 101) r(t) GROUP BY t) ORDER BY f1 DESC, threshold LIMIT 1"""))
def best_f1(spark, sf):
    return rounded(evaluation.best_f1_threshold(v.predictions(spark, sf)))


@check("ev3_regression_metrics", with_views("predictions", """SELECT model, target, count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg(pow(actual - predicted, 2))), 6) AS rmse,
 round(1 - sum(pow(actual - predicted, 2)) / nullif(sum(pow(actual - m, 2)), 0), 6) AS r2 FROM (SELECT *, avg(actual) OVER (PARTITION BY model, target) AS m FROM predictions) GROUP BY 1, 2"""))
def metrics(spark, sf):
    return rounded(evaluation.regression_metrics(v.predictions(spark, sf), ["model", "target"]))


@check("ev3_macro_mae", with_views("predictions", """SELECT model, round(avg(mae), 6) AS macro_mae FROM (SELECT model, target, avg(abs(actual - predicted)) AS mae FROM predictions
 GROUP BY 1, 2) GROUP BY 1"""))
def macro(spark, sf):
    return rounded(evaluation.macro_mae(v.predictions(spark, sf)))


@check("ev4_mae_by_bucket", with_views("predictions", """SELECT CASE WHEN actual <= 2.5 THEN '<=2.5' WHEN actual <= 3.5 THEN '(2.5,3.5]' WHEN actual <= 4.5 THEN '(3.5,4.5]' ELSE '>4.5' END AS bucket,
 model, count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae FROM predictions GROUP BY 1, 2"""))
def by_bucket(spark, sf):
    return rounded(evaluation.mae_by_bucket(v.predictions(spark, sf)))


_REPORT = f"""h AS (SELECT {_HALF.format('actual')} AS t, {_HALF.format('predicted')} AS p FROM predictions),
 report AS (SELECT star, coalesce(tp / nullif(predicted, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall,
  coalesce(2.0::DOUBLE * tp / nullif(support + predicted, 0), 0)::DOUBLE AS f1, support FROM (SELECT 1 + i / 2.0::DOUBLE AS star,
  (SELECT count(*) FROM h WHERE t = 1 + i / 2.0::DOUBLE) AS support, (SELECT count(*) FROM h WHERE p = 1 + i / 2.0::DOUBLE) AS predicted,
  (SELECT count(*) FROM h WHERE t = 1 + i / 2.0::DOUBLE AND p = t) AS tp FROM range(0, 9) r(i)))"""


@check("ev5_half_star_report", with_views("predictions", """SELECT star, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report""", _REPORT))
def half_stars(spark, sf):
    return rounded(evaluation.half_star_report(v.predictions(spark, sf)))


@check("ev5_half_star_summary", with_views("predictions", """SELECT round((SELECT avg((t = p)::INT) FROM h), 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
 round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(avg(recall), 6) AS macro_recall, round(sum(recall * support) / sum(support), 6) AS weighted_recall,
 round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM report""", _REPORT))
def half_star_summary(spark, sf):
    return rounded(evaluation.half_star_summary(v.predictions(spark, sf)))


@check("ev5_confusion_matrix", with_views("predictions", "SELECT 1 + i / 2.0::DOUBLE AS true_star, " + ", ".join(
 f"(SELECT count(*) FROM h WHERE t = 1 + i / 2.0::DOUBLE AND p = {1 + j / 2}) AS pred_{str(1 + j / 2).replace('.', '_')}" for j in range(9))
 + " FROM range(0, 9) r(i)", _REPORT))
def matrix(spark, sf):
    return evaluation.confusion_matrix(v.predictions(spark, sf))


@check("ev6_high_star_report", with_views("predictions", """SELECT round(tp / p, 6) AS precision, round(tp / t, 6) AS recall, round(2.0::DOUBLE * tp / (p + t), 6) AS f1, round(t / n, 6) AS true_share,
 round(p / n, 6) AS pred_share FROM (SELECT count(*)::DOUBLE AS n, count(*) FILTER (t >= 4)::DOUBLE AS t, count(*) FILTER (p >= 4)::DOUBLE AS p,
 count(*) FILTER (t >= 4 AND p >= 4)::DOUBLE AS tp FROM h)""", _REPORT))
def high_stars(spark, sf):
    return rounded(evaluation.high_star_report(v.predictions(spark, sf)))


@check("ev7_star_accuracy", with_views("predictions", """SELECT round(avg((round_even(actual, 0) = least(greatest(round_even(predicted, 0), 1), 5))::INT), 6) AS acc_exact,
 round(avg((abs(actual - predicted) <= 0.5)::INT), 6) AS acc_within_half FROM predictions"""))
def star_accuracy(spark, sf):
    return rounded(evaluation.star_accuracy(v.predictions(spark, sf)))


@check("ev8_prediction_samples", with_views("places", """SELECT business_id, name, city, state, stars AS actual, round(1 + (review_count % 40) / 10.0::DOUBLE, 2) AS predicted,
 round(round(1 + (review_count % 40) / 10.0::DOUBLE, 2) - stars, 2) AS error FROM places ORDER BY business_id LIMIT 10"""))
def samples(spark, sf):
    places = v.places(spark, sf)
    made = places.select("business_id", F.col("stars").alias("actual"), (1.0 + (F.col("review_count") % 40) / 10.0).alias("predicted"))
    return evaluation.prediction_samples(made, places)


@check("ev8_feature_importance")
def importance(spark, sf):
    train, test = _parts(training_table(spark, sf))
    model = modeling.train_stars(train, rounds=ROUNDS, kinds=["forest"])["forest"]
    return modeling.feature_importance(model, test)


# --- zones -------------------------------------------------------------------------------------------------


def zone_features(spark, sf):
    """Places without a price form a tier of their own."""
    return zones.cluster_features(v.places(spark, sf), missing_price=0)


@check("cu1_cluster_features")
def cluster_features(spark, sf):
    return rounded(zone_features(spark, sf), 4)


@check("cu2_kmeans_zones")
def kmeans(spark, sf):
    rows = cut(zone_features(spark, sf))
    return zones.kmeans_zones(rows).select("business_id", "cluster")


@check("cu2_state_zones")
def state_zones(spark, sf):
    return zones.state_zones(v.places(spark, sf), "TN").select("business_id", "cluster")


@check("cu3_elbow_curve")
def elbow(spark, sf):
    return zones.elbow_curve(cut(zone_features(spark, sf)))


_CLUSTERED = "c AS (SELECT *, substr(business_id, 2)::BIGINT % 4 AS cluster FROM places)"


def clustered(spark, sf):
    return v.places(spark, sf).withColumn("cluster", F.substring("business_id", 2, 20).cast("bigint") % 4)


@check("cu4_cluster_summary", with_views("places", """SELECT cluster, round(avg(latitude), 6) AS latitude, round(avg(stars), 6) AS stars, round(avg(review_count), 6) AS review_count
 FROM c GROUP BY 1""", _CLUSTERED))
def summary(spark, sf):
    return rounded(zones.cluster_summary(clustered(spark, sf), ["latitude", "stars", "review_count"]))


@check("cu5_zone_insight", with_views("places", """SELECT arg_max(cluster, r) AS busiest, arg_max(cluster, s) AS saturated, arg_min(cluster, s) AS gap FROM (
 SELECT cluster, avg(review_count) AS r, avg(stars) AS s FROM c GROUP BY 1)""", _CLUSTERED))
def insight(spark, sf):
    return zones.zone_insight(zones.cluster_summary(clustered(spark, sf), ["stars", "review_count"]), "stars")


def _as_exact(rows, column, k):
    """Per component whether it holds as much of the variance as the exact one of the whole covariance matrix."""
    from pyspark.ml.feature import PCA

    rows = cut(rows.select(column))
    found = components.SparsePCA(k=k, inputCol=column, outputCol="found").fit(rows)
    shares = PCA(k=k, inputCol=column, outputCol="exact").fit(rows).explainedVariance.toArray()
    whole = components.column_sums(rows, found.pc.numRows)
    n = rows.count()
    total = (whole[:, 1].sum() - (whole[:, 0] ** 2).sum() / n) / (n - 1)
    same = [(i + 1, int(abs(found.variances[i] / total - shares[i]) <= 1e-6)) for i in range(k)]
    return rows.sparkSession.createDataFrame(same, "component int, as_exact int")


_EXACT = "SELECT unnest(range(1, 5))::INT AS component, 1 AS as_exact"


@check("ml3_component_variance", _EXACT)
def text_variance(spark, sf):
    return _as_exact(modeling.category_text_vectors(v.places(spark, sf), dims=4)[0], "category_tfidf", 4)


@check("cu1_component_variance", _EXACT)
def zone_variance(spark, sf):
    p = v.places(spark, sf).withColumn("cats", F.transform(category_set(F.col("categories")), F.lower))
    return _as_exact(zones.fit_components(p).stages[0].transform(p), "onehot", 4)


@check("cu1_zone_base", with_views("places", """SELECT business_id, latitude, longitude, stars, review_count, 0 AS mean_score
 FROM places"""))
def zone_base(spark, sf):
    """The columns that come from the table, and the mean of the first component, which is zero."""
    rows = cut(zone_features(spark, sf))
    mean = rows.agg(F.round(F.avg("pc1_score"), 6).cast("int").alias("mean_score"))
    return rows.select("business_id", *zones.BASE).crossJoin(F.broadcast(mean))


@check("cu2_zone_checks", with_views("places", """SELECT count(*) AS rows, 4 AS zones, 1 AS same_again, 1 AS at_their_means FROM places"""))
def zone_checks(spark, sf):
    """All places have a zone, a seed gives the same zones again, and no place is nearer to the mean of another zone."""
    rows = cut(zone_features(spark, sf))
    first, again = (cut(zones.kmeans_zones(rows, starts=3)) for _ in range(2))
    both = first.select("business_id", "cluster").join(again.select("business_id", F.col("cluster").alias("other")), "business_id")
    same = both.agg(F.count("*").alias("rows"), F.count_distinct("cluster").alias("zones"), F.bool_and(F.col("cluster") == F.col("other")).cast("int").alias("same_again"))
    scaled = zones.scaled_features(rows, zones.ZONE_FEATURES).select("business_id", vector_to_array("features").alias("x")).join(first.select("business_id", "cluster"), "business_id")
    width = len(zones.ZONE_FEATURES)
    means = scaled.groupBy("cluster").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("mean")).orderBy("cluster").collect()
    nearest = zones.nearest_centre(F.col("x"), np.array([r["mean"] for r in means]))
    still = scaled.agg((F.count_if(nearest != F.col("cluster")) <= F.count("*") / 1000).cast("int").alias("at_their_means"))
    return same.crossJoin(F.broadcast(still))


@check("cu3_elbow_checks", "SELECT unnest(range(2, 10))::INT AS k, 1 AS below_total")
def elbow_checks(spark, sf):
    """Costs lie below that of one cluster: rows x columns, as columns are standardised by the sample deviation."""
    rows = cut(zone_features(spark, sf))
    total = (rows.na.drop().count() - 1) * len(zones.ZONE_FEATURES)
    return zones.elbow_curve(rows).select("k", (F.col("inertia") < total).cast("int").alias("below_total"))


@check("cu6_component_labels")
def labels(spark, sf):
    return rounded(zones.component_labels(zones.fit_components(v.places(spark, sf)), spark), 4)


# --- category requests -------------------------------------------------------------------------------------


def category_requests(spark, sf):
    """One category request per part, worded in several ways."""
    part = v.table(spark, sf, "part")
    k = F.floor(F.col("p_partkey") / 4)
    noun, kind = F.split("p_name", " ")[1], F.lower("p_type")
    text = (
        F.when(k % 7 == 0, "xyzzy").when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.concat(noun, F.lit(", "), kind))
        .when(k % 4 == 2, F.concat(F.lit("The "), F.substring(noun, 1, 3))).otherwise(F.concat(kind, F.lit(" & "), noun, F.lit("s")))
    )
    slot = F.col("p_partkey") % 4
    return part.select(
        F.col("p_partkey").alias("request_id"), v._pick(slot, [s[0] for s in v.SLOTS]).alias("city"),
        v._pick(slot, [s[1] for s in v.SLOTS]).alias("state"), text.alias("text"),
    )


def _phrase_sql(q: str, p: str) -> str:
    words = f"list_filter(regexp_split_to_array({q}, '[^a-z0-9&]+'), lambda t: length(t) >= 2 AND t NOT IN ('or', 'and', 'the', 'a', 'an'))"
    label = f"list_filter(regexp_split_to_array({p}, '[^a-z0-9&]+'), lambda w: w <> '')"
    spaced = f"list_filter(string_split(replace({p}, '&', ' '), ' '), lambda w: w <> '')"
    hits = f"len(list_filter({words}, lambda t: len(list_filter({label}, lambda w: t = w OR (length(t) >= 4 AND contains(w, t)))) > 0))"
    stems = f"len(list_filter({words}, lambda t: length(t) >= 4 AND len(list_filter({spaced}, lambda w: contains(w, t) OR starts_with(w, substr(t, 1, 4)))) > 0)) > 0"
    every = f"len(list_filter({words}, lambda t: NOT contains({p}, t))) = 0"
    return f"""CASE WHEN {q} = {p} THEN 100.0 WHEN starts_with({p}, {q}) AND length({q}) >= 2 THEN 92.0 WHEN length({q}) >= 3 AND contains({p}, {q}) THEN 86.0
 WHEN length({q}) >= 2 AND (contains({p}, {q}) OR contains({q}, {p})) THEN 80.0 WHEN len({words}) = 0 THEN 0.0 WHEN {every} THEN 78.0
 WHEN {hits} > 0 THEN 45.0 + 25.0 * ({hits} / len({words})) WHEN {stems} THEN 35.0 ELSE 0.0 END::DOUBLE"""


def _alias_sql() -> str:
    rules = []
    for phrase, words in CATEGORY_ALIASES:
        hit = f"contains(ql, '{phrase}')" if " " in phrase else f"regexp_matches(ql, '(^|[^a-z0-9]){phrase}($|[^a-z0-9])')"
        to = " OR ".join(f"contains(label, '{w}') OR contains(bare, '{w}')" for w in words)
        rules.append(f"({hit} AND ({to}))")
    return f"CASE WHEN {' OR '.join(rules)} THEN 90.0 ELSE 0.0 END::DOUBLE"


_REQ = f"""asks AS (SELECT p_partkey AS request_id, {v._CITY} AS city, {v._STATE} AS state, CASE WHEN (p_partkey // 4) % 7 = 0 THEN 'xyzzy'
  WHEN (p_partkey // 4) % 4 = 0 THEN p_name WHEN (p_partkey // 4) % 4 = 1 THEN split_part(p_name, ' ', 2) || ', ' || lower(p_type)
  WHEN (p_partkey // 4) % 4 = 2 THEN 'The ' || substr(split_part(p_name, ' ', 2), 1, 3) ELSE lower(p_type) || ' & ' || split_part(p_name, ' ', 2) || 's' END AS text FROM part),
 keys AS (SELECT DISTINCT city, state, 'cat_' || replace(lower(c), ' ', '_') AS cat_key FROM (SELECT city, state, trim(unnest(string_split(categories, ','))) AS c FROM places)),
 texts AS (SELECT DISTINCT city, state, text FROM asks),
 chunks AS (SELECT DISTINCT city, state, text, unnest(list_distinct([text, trim(regexp_replace(replace(text, ',', ' '), '\\s+', ' ', 'g')),
  array_to_string(list_transform(string_split(text, ','), lambda x: trim(x)), ' ')] || list_transform(string_split(text, ','), lambda x: trim(x)))) AS chunk FROM texts),
 matched AS (SELECT *, lower(chunk) AS ql, lower(substr(cat_key, 5)) AS bare, replace(lower(substr(cat_key, 5)), '_', ' ') AS label FROM chunks JOIN keys USING (city, state)),
 rated AS MATERIALIZED (SELECT city, state, text, chunk, cat_key, greatest({_phrase_sql('ql', 'label')}, {_phrase_sql('ql', 'bare')}, {_alias_sql()}) AS score FROM matched)"""


@check("cr1_category_keys", with_views("places", "SELECT city, state, cat_key FROM keys", _REQ))
def keys(spark, sf):
    return sites.category_keys(v.places(spark, sf))


@check("cr2_score_category_match", with_views("places", """SELECT city, state, text, cat_key, round(max(score), 6) AS score FROM rated
 WHERE chunk = trim(regexp_replace(replace(text, ',', ' '), '\\s+', ' ', 'g')) GROUP BY ALL""", _REQ))
def category_match(spark, sf):
    rows = category_requests(spark, sf).select("city", "state", "text").distinct().join(sites.category_keys(v.places(spark, sf)), ["city", "state"])
    score = sites.score_category_match(sites._collapse(F.col("text")), F.col("cat_key"))
    return rounded(rows.select("city", "state", "text", "cat_key", score.alias("score")))


@check("cr3_resolve_categories", with_views("places", """SELECT a.request_id, c.cat_key FROM asks a JOIN (SELECT *, CASE WHEN first < 8 THEN 0
 WHEN (segments = 1 AND first >= 80 AND first - second >= 6) OR (first >= 88 AND first - second >= 12) OR strong = 0 THEN 1 ELSE least(strong, 3) END AS keep FROM (
 SELECT *, max(score) OVER w AS first, coalesce(max(CASE WHEN r = 2 THEN score END) OVER w, 0) AS second, count(*) FILTER (score >= 28) OVER w AS strong,
 len(string_split(text, ',')) AS segments FROM (SELECT *, row_number() OVER (PARTITION BY city, state, text ORDER BY score DESC, cat_key) AS r FROM (
 SELECT city, state, text, cat_key, max(score) AS score FROM rated GROUP BY ALL)) WINDOW w AS (PARTITION BY city, state, text))) c
 ON c.city = a.city AND c.text = a.text AND c.r <= c.keep""", _REQ))
def resolve(spark, sf):
    rows = sites.resolve_categories(category_requests(spark, sf), sites.category_keys(v.places(spark, sf)))
    return rows.select("request_id", "cat_key")


_FALL = "CASE cat_key " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(CATEGORY_FALLBACKS)) + " END"


@check("cr4_suggest_categories", with_views("places", f"""SELECT a.request_id, c.cat_key, c.r AS rank FROM asks a JOIN (SELECT *, min(tier) OVER (PARTITION BY city, state, text) AS best,
 row_number() OVER (PARTITION BY city, state, text ORDER BY tier, CASE WHEN tier = 1 THEN place ELSE 0 END, CASE WHEN tier = 0 THEN score ELSE 0 END DESC, cat_key) AS r FROM (
 SELECT *, {_FALL} AS place, CASE WHEN score >= 8 THEN 0 WHEN {_FALL} IS NOT NULL THEN 1 ELSE 2 END AS tier FROM rated
 WHERE chunk = trim(regexp_replace(replace(text, ',', ' '), '\\s+', ' ', 'g')))) c ON c.city = a.city AND c.text = a.text AND c.r <= 8 AND c.tier = c.best""", _REQ))
def suggest(spark, sf):
    rows = sites.suggest_categories(category_requests(spark, sf), sites.category_keys(v.places(spark, sf)))
    return rows.select("request_id", "cat_key", "rank")


# --- site scoring ------------------------------------------------------------------------------------------


@check("st1_check_sites", with_views("places", """SELECT s.business_id AS site_id, coalesce(n, 0) AS reference_rows, CASE WHEN coalesce(n, 0) < 10 THEN 'too few reference places'
 WHEN EXISTS (SELECT 1 FROM (SELECT unnest(s.cats) AS c) WHERE c NOT IN (SELECT u.c FROM used u WHERE u.city = s.city)) THEN 'unknown category' END AS reject_reason
 FROM sites s LEFT JOIN (SELECT city, count(*) AS n FROM places GROUP BY 1) r USING (city)""", SITES_SQL + """,
 used AS (SELECT DISTINCT city, trim(unnest(string_split(categories, ','))) AS c FROM places)"""))
def check_sites(spark, sf):
    slice_of = F.concat_ws("|", F.lower("city"), "state")
    ref = v.places(spark, sf).withColumn("slice", slice_of)
    rows = sites.check_sites(site_table(spark, sf).withColumn("slice", slice_of), ref)
    return rows.select("site_id", "reference_rows", "reject_reason")


@check("st1_score_sites")
def score_sites(spark, sf):
    table = training_table(spark, sf)
    train = table.where("split = 'train'")
    names = modeling.feature_families()
    survival_model = modeling.train_survival(train, names["Base"] + names["Distances"] + names["Counts"], ROUNDS, ["boosted_shallow"])["boosted_shallow"]
    star_model = modeling.train_stars(train, rounds=ROUNDS, kinds=["boosted"])["boosted"]
    return sites.score_sites(site_table(spark, sf), v.places(spark, sf), survival_model, star_model)


@check("st2_feature_aliases", with_views("places", "SELECT business_id, review_count AS local_restaurant_count, stars AS distance_to_nearest_same_category FROM places"))
def aliases(spark, sf):
    rows = v.places(spark, sf).select(
        "business_id", F.col("review_count").alias("count_all_3.0km"), F.col("stars").alias("dist_nearest_same_cat")
    )
    return sites.feature_aliases(rows).select("business_id", "local_restaurant_count", "distance_to_nearest_same_category")
