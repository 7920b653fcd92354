"""Splits, feature preparation and model training on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.functions.columns import WHOLE_VOCABULARY, bigrams, split_categories, stable_bucket
from placelens.functions.frames import exact_quantiles
from placelens.operators.components import SparsePCA
from placelens.operators.spatial import RADII



def split_rows(df: DataFrame, fractions: dict[str, float], seed: int = 42, key: str = "business_id") -> DataFrame:
    """Column ``split`` from a hash bucket of the key: all rows of a key share a part, on every run."""
    bucket = stable_bucket(F.col(key), seed, 10_000)
    out, edge = F.lit(list(fractions)[-1]), 0.0
    edges = []
    for name, share in fractions.items():
        edge += share
        edges.append((name, round(edge * 10_000)))
    for name, top in reversed(edges[:-1]):
        out = F.when(bucket < top, F.lit(name)).otherwise(out)
    return df.withColumn("split", out)


def split_overlap(df: DataFrame, key: str = "business_id") -> DataFrame:
    """Keys found in more than one part; empty for a sound split."""
    per = df.groupBy(key).agg(F.count_distinct("split").alias("parts"))
    return per.where(F.col("parts") > 1)


@dataclass(frozen=True)
class Scaling:
    """Per column: median, mean and population deviation after filling gaps with the median."""

    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]


def fit_scaling(train: DataFrame, cols: Sequence[str]) -> Scaling:
    """Statistics of the training rows; only three numbers per column reach the driver."""
    long = train.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "v")
    medians = {r["column_name"]: r["m"] for r in exact_quantiles(long, ["column_name"], "v", {"m": 0.5}).collect()}
    filled = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians.get(c, 0.0))) for c in cols]
    stats = train.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)],
        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)],
    ).first()
    return Scaling(
        {c: medians.get(c, 0.0) for c in cols},
        {c: stats[f"m{i}"] or 0.0 for i, c in enumerate(cols)},
        {c: stats[f"s{i}"] or 0.0 for i, c in enumerate(cols)},
    )


def impute_median(df: DataFrame, scaling: Scaling) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)) for c, m in scaling.medians.items()}
    )


def standardize(df: DataFrame, scaling: Scaling) -> DataFrame:
    """Median-filled columns with the training mean removed, in units of the training deviation."""
    filled = impute_median(df, scaling)
    return filled.withColumns(
        {c: (F.col(f"`{c}`") - scaling.means[c]) / (scaling.deviations[c] or 1.0) for c in scaling.medians}
    )


def category_text_stages(min_df: int = 2, dims: int = 24) -> tuple[list, str]:
    """TF-IDF of category words and word pairs reduced to a dense vector; input column category_terms."""
    counts = CountVectorizer(inputCol="category_terms", outputCol="category_tf", vocabSize=WHOLE_VOCABULARY, minDF=min_df)
    idf = IDF(inputCol="category_tf", outputCol="category_tfidf")
    pca = SparsePCA(k=dims, inputCol="category_tfidf", outputCol="category_vec")
    return [counts, idf, pca], "category_vec"


def with_category_terms(df: DataFrame) -> DataFrame:
    text = F.lower(F.array_join(split_categories(F.col("categories")), " "))
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return df.withColumn("category_terms", F.concat(words, bigrams(words)))


def category_text_vectors(train: DataFrame, others: Sequence[DataFrame] = (), dims: int = 24) -> list[DataFrame]:
    """Fit on the training rows and apply to them and to the other tables."""
    counts = CountVectorizer(inputCol="category_terms", outputCol="category_tf", vocabSize=WHOLE_VOCABULARY, minDF=2)
    prepared = with_category_terms(train)
    vocabulary = len(counts.fit(prepared).vocabulary)
    stages, _ = category_text_stages(dims=min(dims, vocabulary))
    model = Pipeline(stages=stages).fit(prepared)
    return [model.transform(with_category_terms(df)) for df in (train, *others)]


def model_name(feature: str) -> str:
    """Feature names hold dots, which column references of pyspark.ml do not take."""
    return feature.replace(".", "_")


def feature_families(radii: Sequence[float] = RADII) -> dict[str, list[str]]:
    tags = [f"{float(r)}km" for r in radii]
    each = lambda *names: [model_name(f"{n}_{t}") for n in names for t in tags]
    return {
        "Base": ["time_is_open_morning", "time_is_open_latenight", "time_open_on_weekends", "price_range"],
        "LatLon": ["latitude", "longitude"],
        "Distances": ["log_dist_nearest_same_cat", "dist_nearest_same_cat"],
        "Counts": each("log_count_all", "log_count_same_cat", "has_any", "has_same_cat", "low_count"),
        "Ratios": each("same_cat_ratio"),
        "Gap": each(
            "rating_gap_global", "survival_gap_global", "same_cat_rating_gap_global", "same_cat_survival_gap_global",
            "same_cat_vs_local_rating_gap", "same_cat_vs_local_survival_gap",
        ),
        "Diversity": each("diversity", "log_diversity"),
        "Semantic": ["avg_rating_top5_similar", "survival_top5_similar"],
    }


def model_columns(df: DataFrame) -> DataFrame:
    """Feature names without dots and numeric NULLs as 0."""
    plain = df.select(*[F.col(f"`{c}`").alias(model_name(c)) for c in df.columns])
    return plain.na.fill(0)


def assemble_stages(features: Sequence[str], categories: bool = True, state: bool = False, text_dims: int = 0) -> list:
    """Vector of numeric columns and, as asked, the category one-hot, state one-hot and category text parts."""
    stages, inputs = [], list(features)
    if categories:
        stages.append(CountVectorizer(inputCol="cats", outputCol="cats_vec", binary=True, vocabSize=WHOLE_VOCABULARY))
        inputs.append("cats_vec")
    if state:
        stages.append(StringIndexer(inputCol="state", outputCol="state_ix", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol="state_ix", outputCol="state_vec", handleInvalid="keep"))
        inputs.append("state_vec")
    if text_dims:
        text, name = category_text_stages(dims=text_dims)
        stages += text
        inputs.append(name)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2 n_class) in column ``weight``."""
    counts = train.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return train.join(counts, label).withColumn("weight", total / (2.0 * F.col("_n"))).drop("_n")


def split_diagnostics(df: DataFrame) -> DataFrame:
    """Rows, survival rate, mean stars and the median density and competitor distance per part."""
    base = df.groupBy("split").agg(
        F.count("*").alias("rows"), F.avg("is_open").alias("survival_rate"), F.avg("stars").alias("mean_stars")
    )
    density = exact_quantiles(
        df.select("split", F.col("`count_all_0.5km`").alias("v")), ["split"], "v", {"median_count_0_5km": 0.5}
    )
    nearest = exact_quantiles(
        df.select("split", F.col("dist_nearest_same_cat").alias("v")), ["split"], "v", {"median_nearest": 0.5}
    )
    return base.join(density, "split", "left").join(nearest, "split", "left")


def probability(df: DataFrame) -> DataFrame:
    return df.withColumn("score", vector_to_array("probability")[1])


def area_under_curve(scored: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction").evaluate(scored)


def survival_estimators(rounds: int = 20, label: str = "is_open") -> dict:
    gbt = dict(labelCol=label, featuresCol="features", maxIter=rounds, seed=42)
    return {
        "logistic": LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", maxIter=100),
        "boosted_shallow": GBTClassifier(maxDepth=3, **gbt),
        "boosted_default": GBTClassifier(maxDepth=5, **gbt),
    }


def train_survival(train: DataFrame, features: Sequence[str], rounds: int = 20, kinds: Sequence[str] = ("logistic", "boosted_shallow", "boosted_default")) -> dict[str, PipelineModel]:
    weighted = class_weights(train, "is_open")
    estimators = survival_estimators(rounds)
    return {k: Pipeline(stages=[*assemble_stages(features), estimators[k]]).fit(weighted) for k in kinds}


def ablation_select(
    train: DataFrame,
    test: DataFrame,
    families: Sequence[str] = ("Distances", "Counts", "Ratios", "Gap", "Diversity", "Semantic"),
    rounds: int = 20,
) -> tuple[list[str], list[tuple[str, float, bool]]]:
    """Add feature families one by one and keep those that raise the test AUC. Only AUCs reach the driver."""
    pool = feature_families()

    def score(features: list[str]) -> float:
        model = train_survival(train, features, rounds, ["boosted_shallow"])["boosted_shallow"]
        return area_under_curve(model.transform(test), "is_open")

    chosen = list(pool["Base"])
    best = score(chosen)
    steps = [("Base", best, True)]
    for family in families:
        value = score(chosen + pool[family])
        steps.append((family, value, value > best))
        if value > best:
            chosen, best = chosen + pool[family], value
    return chosen, steps


def star_estimators(rounds: int = 20, label: str = "stars") -> dict:
    common = dict(labelCol=label, featuresCol="features")
    return {
        "linear": LinearRegression(**common),
        "ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0, **common),
        "forest": RandomForestRegressor(numTrees=max(rounds, 1), maxDepth=10, seed=42, **common),
        "boosted": GBTRegressor(maxDepth=3, maxIter=rounds, seed=42, **common),
    }


def star_features() -> list[str]:
    f = feature_families()
    return f["Base"] + f["Counts"] + f["Distances"] + f["Gap"] + f["Semantic"]


def train_stars(train: DataFrame, features: Sequence[str] | None = None, rounds: int = 20, kinds: Sequence[str] = ("linear", "ridge", "forest", "boosted")) -> dict[str, PipelineModel]:
    estimators = star_estimators(rounds)
    stages = assemble_stages(features or star_features())
    return {k: Pipeline(stages=[*stages, estimators[k]]).fit(train) for k in kinds}


def train_multi_target(
    train: DataFrame, targets: Sequence[str], features: Sequence[str], weight: str = "weight", rounds: int = 20
) -> dict[str, dict]:
    """Per model kind one fitted model per target; the baseline is the training mean."""
    prep = Pipeline(stages=assemble_stages(features, categories=True)).fit(train)
    ready = prep.transform(train)
    means = train.agg(*[F.avg(t).alias(t) for t in targets]).first().asDict()
    out: dict[str, dict] = {"prep": prep, "baseline": means, "ridge": {}, "forest": {}, "boosted": {}}
    for t in targets:
        common = dict(labelCol=t, featuresCol="features", predictionCol=f"pred_{t}")
        out["ridge"][t] = LinearRegression(regParam=2.0, elasticNetParam=0.0, **common).fit(ready)
        out["forest"][t] = RandomForestRegressor(numTrees=rounds, maxDepth=10, minInstancesPerNode=4, seed=42, **common).fit(ready)
        out["boosted"][t] = GBTRegressor(lossType="absolute", maxDepth=5, maxIter=rounds, weightCol=weight, seed=42, **common).fit(ready)
    return out


def predict_multi_target(models: dict, df: DataFrame, targets: Sequence[str], key: str = "business_id") -> DataFrame:
    """Long predictions (key, model, target, actual, predicted)."""
    ready = models["prep"].transform(df)
    parts = []
    for kind in ("baseline", "ridge", "forest", "boosted"):
        scored = ready
        for t in targets:
            if kind == "baseline":
                scored = scored.withColumn(f"pred_{t}", F.lit(models["baseline"][t]))
            else:
                scored = models[kind][t].transform(scored)
        rows = F.array(
            *[
                F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("actual"), F.col(f"pred_{t}").alias("predicted"))
                for t in targets
            ]
        )
        parts.append(scored.select(key, F.lit(kind).alias("model"), F.inline(rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star_tier(stars):
    return F.when(stars <= 2.5, 0.0).when(stars <= 4.0, 1.0).otherwise(2.0)


def tiered_regression(
    train: DataFrame, test: DataFrame, target: str, features: Sequence[str], weight: str = "weight", rounds: int = 20,
    min_tier_rows: int | None = None,
) -> DataFrame:
    """Classify the star tier, then predict with the tier's own model.

    A tier without training rows is an error, unless ``min_tier_rows`` is given: tiers with fewer rows than that use
    the model of all rows.

    ``tier_rows`` is the number of training rows of the predicted tier, ``model_used`` is "tier" or "all".
    """
    prep = Pipeline(stages=assemble_stages(features)).fit(train)
    ready = prep.transform(train).withColumn("tier", star_tier(F.col("stars")))
    classifier = RandomForestClassifier(
        labelCol="tier", featuresCol="features", predictionCol="pred_tier", probabilityCol="tier_probability",
        rawPredictionCol="tier_raw", numTrees=rounds, maxDepth=5, weightCol=weight, seed=42,
    ).fit(ready)

    def regressor():
        return GBTRegressor(labelCol=target, featuresCol="features", predictionCol="predicted", lossType="absolute", maxDepth=5, maxIter=rounds, weightCol=weight, seed=42)

    counts = {r["tier"]: r["n"] for r in ready.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    fallback = regressor().fit(ready)
    scored = classifier.transform(prep.transform(test))
    out = None
    for tier in (0.0, 1.0, 2.0):
        enough = counts.get(tier, 0) >= (1 if min_tier_rows is None else min_tier_rows)
        if min_tier_rows is None and not enough:
            raise ValueError(f"no training rows in tier {tier:g}; give min_tier_rows to use the model of all rows")
        model = regressor().fit(ready.where(F.col("tier") == tier)) if enough else fallback
        part = model.transform(scored.where(F.col("pred_tier") == tier)).withColumns(
            {"tier_rows": F.lit(counts.get(tier, 0)).cast("bigint"), "model_used": F.lit("tier" if enough else "all")}
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("true_tier", star_tier(F.col("stars")))


def feature_importance(model: PipelineModel, df: DataFrame, features_col: str = "features") -> DataFrame:
    """Importance per feature of the last stage, largest first; names come from the vector's metadata."""
    spark = df.sparkSession
    attrs = model.transform(df).schema[features_col].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a.get("name", str(a["idx"])) for group in attrs.values() for a in group}
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(names.get(i, str(i)), float(w)) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
