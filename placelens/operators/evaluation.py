"""Evaluation of survival scores and star predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelens.functions.columns import clip, half_star
from placelens.functions.frames import with_running_totals


def auc(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """ROC AUC by ranks: equal scores share half a win. Works on counts per distinct score."""
    hist = df.groupBy(F.lit(1).alias("k"), F.col(score).cast("double").alias("s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg")
    )
    ranked = with_running_totals(hist.where(F.col("s").isNotNull()), ["k"], "s", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    return ranked.agg(F.try_divide(wins, F.max("total_pos").cast("double") * F.max("total_neg")).alias("auc"))


def best_f1_threshold(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Best F1 over the thresholds 0, 0.01 .. 1 with score >= threshold as positive; the first best wins."""
    value, y = F.col(score).cast("double"), F.col(label).cast("bigint")
    # Highest step whose threshold the score reaches; the guess may be off by one through rounding.
    guess = F.least(F.floor(value * 100.0), F.lit(99)).cast("int")
    step = (
        F.when(value >= (guess + 1) / F.lit(100.0), guess + 1)
        .when(value >= guess / F.lit(100.0), guess)
        .otherwise(guess - 1)
    )
    bins = df.groupBy(step.alias("step")).agg(F.sum(y).alias("tp"), F.count("*").alias("n"))
    positives = df.agg(F.sum(y).alias("p")).scalar()
    grid = df.sparkSession.range(101).select(F.col("id").cast("int").alias("step"))
    # At most 102 rows from here on.
    down = W.orderBy(F.desc("step"))
    curve = grid.join(bins, "step", "left").select(
        "step", F.coalesce(F.sum("tp").over(down), F.lit(0)).alias("tp"), F.coalesce(F.sum("n").over(down), F.lit(0)).alias("n")
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("n") + positives), F.lit(0.0))
    scored = curve.withColumn("f1", f1)
    best = scored.agg(F.max("f1").alias("best_f1"), F.max_by("step", F.struct("f1", -F.col("step"))).alias("step"))
    threshold = F.when(F.col("best_f1") > 0, F.col("step") / 100.0).otherwise(0.5)
    return best.select("best_f1", threshold.alias("threshold"))


def regression_metrics(df: DataFrame, groups: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE and R2 per group; the spread comes from one pass of sums around the mean."""
    err = F.col(actual) - F.col(predicted)
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1.0 - F.try_divide(F.avg(err * err), F.var_pop(actual))).alias("r2"),
    )


def macro_mae(df: DataFrame, target: str = "target", model: str = "model") -> DataFrame:
    """Mean of the per-target MAE for each model."""
    per = regression_metrics(df, [model, target])
    return per.groupBy(model).agg(F.avg("mae").alias("macro_mae"))


def star_bucket(stars: Column) -> Column:
    return (
        F.when(stars <= 2.5, "<=2.5").when(stars <= 3.5, "(2.5,3.5]").when(stars <= 4.5, "(3.5,4.5]").otherwise(">4.5")
    )


def mae_by_bucket(df: DataFrame, model: str = "model") -> DataFrame:
    return df.groupBy(star_bucket(F.col("actual")).alias("bucket"), model).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae")
    )


def confusion(df: DataFrame) -> DataFrame:
    """Counts per (true half star, predicted half star): at most 81 rows."""
    return df.groupBy(
        half_star(F.col("actual")).alias("true_star"), half_star(F.col("predicted")).alias("pred_star")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    grid = [1.0 + i / 2 for i in range(9)]
    rows = df.sparkSession.range(9).select((F.col("id") / 2.0 + 1.0).alias("true_star"))
    wide = confusion(df).groupBy("true_star").pivot("pred_star", grid).agg(F.sum("n"))
    named = wide.select("true_star", *[F.col(f"`{g}`").alias(f"pred_{str(g).replace('.', '_')}") for g in grid])
    return rows.join(named, "true_star", "left").na.fill(0)


def half_star_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support for each of the nine half stars."""
    cells = confusion(df)
    hit = F.col("true_star") == F.col("pred_star")
    sides = F.inline(
        F.array(
            F.struct(F.col("true_star").alias("star"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(hit, F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("pred_star").alias("star"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
        )
    )
    per = cells.select(sides).groupBy("star").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    grid = df.sparkSession.range(9).select((F.col("id") / 2.0 + 1.0).alias("star"))
    full = grid.join(per, "star", "left").na.fill(0, ["support", "predicted", "tp"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return full.select(
        "star",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2.0 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def half_star_summary(df: DataFrame) -> DataFrame:
    """Accuracy with macro and weighted averages over the nine half stars."""
    report = half_star_report(df)
    n = F.sum("support")
    parts = []
    for m in ("precision", "recall", "f1"):
        parts.append(F.avg(m).alias(f"macro_{m}"))
        parts.append(F.try_divide(F.sum(F.col(m) * F.col("support")), n).alias(f"weighted_{m}"))
    return report.agg(F.try_divide(F.sum(F.col("recall") * F.col("support")), n).alias("accuracy"), *parts)


def high_star_report(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of 'four stars or more', with both positive shares."""
    t, p = half_star(F.col("actual")) >= 4.0, half_star(F.col("predicted")) >= 4.0
    sums = df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.count_if(t).alias("t"), F.count_if(p).alias("p"), F.count_if(t & p).alias("tp")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(
        *groups,
        ratio(F.col("tp"), F.col("p")).alias("precision"),
        ratio(F.col("tp"), F.col("t")).alias("recall"),
        ratio(2.0 * F.col("tp"), F.col("t") + F.col("p")).alias("f1"),
        (F.col("t") / F.col("n")).alias("true_share"),
        (F.col("p") / F.col("n")).alias("pred_share"),
    )


def star_accuracy(df: DataFrame) -> DataFrame:
    """Share of equal whole stars (ties to even) and share within half a star."""
    whole = lambda c: F.bround(F.col(c), 0)
    predicted = clip(whole("predicted"), 1.0, 5.0)
    return df.agg(
        F.avg((whole("actual") == predicted).cast("double")).alias("acc_exact"),
        F.avg((F.abs(F.col("actual") - F.col("predicted")) <= 0.5).cast("double")).alias("acc_within_half"),
    )


def prediction_samples(df: DataFrame, places: DataFrame, n: int = 10) -> DataFrame:
    """Actual, predicted and error of a few places in id order."""
    rows = df.join(places.select("business_id", "name", "city", "state"), "business_id")
    shown = F.round("predicted", 2)
    return rows.orderBy("business_id").limit(n).select(
        "business_id", "name", "city", "state", "actual", shown.alias("predicted"), F.round(shown - F.col("actual"), 2).alias("error")
    )
