"""Signals, themes and weak aspect targets from review text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions.columns import (
    bigrams,
    clip,
    contains_any,
    count_in,
    latin_tokens,
    lexicon_share,
    safe_double,
    word_tokens,
)
from placelens.functions.frames import exact_quantiles, exploded_terms, top_per_group
from placelens.functions.lexicons import (
    ASPECT_KEYWORDS,
    COMPLAINT_PHRASES,
    HALF_STAR_WEIGHTS,
    HARSH_WORDS,
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    THEME_STOPWORDS,
)

REVIEW_SIGNALS = [
    "rev_neg_word_density", "rev_complaint_hit_rate", "rev_low_review_star_share", "rev_high_review_star_share",
    "rev_mean_sentiment", "rev_harsh_word_density", "rev_harsh_review_share", "rev_one_star_share",
    "rev_max_neg_density", "rev_neg_density_std",
]


def theme_words(text: Column, stopwords: Sequence[str] = tuple(THEME_STOPWORDS), min_len: int = 3) -> Column:
    """Tokens of a text without stop words and short ones."""
    return F.filter(word_tokens(text), lambda t: (~t.isin(list(stopwords))) & (F.length(t) >= min_len))


def theme_terms(text: Column, stopwords: Sequence[str] = tuple(THEME_STOPWORDS), min_len: int = 3) -> Column:
    """Kept tokens of a text and the bigrams formed from what is left."""
    kept = theme_words(text, stopwords, min_len)
    return F.concat(kept, bigrams(kept))


def extract_themes(
    texts: DataFrame, keys: Sequence[str], text: str = "text", k: int = 6,
    stopwords: Sequence[str] = tuple(THEME_STOPWORDS),
) -> DataFrame:
    """The k most frequent phrases per group with their rank: count descending, then phrase."""
    terms = exploded_terms(texts, keys, theme_words(F.col(text), stopwords), "phrase")
    counts = terms.groupBy(*keys, "phrase").agg(F.count("*").alias("n"))
    return top_per_group(counts, list(keys), [F.desc("n"), F.asc("phrase")], k)


def sentiment(text: Column, positive=tuple(POSITIVE_WORDS), negative=tuple(NEGATIVE_WORDS)) -> Column:
    return _sentiment(latin_tokens(text), positive, negative)


def _sentiment(tokens: Column, positive, negative) -> Column:
    p, n = count_in(tokens, positive), count_in(tokens, negative)
    return F.when(p + n == 0, F.lit(0.0)).otherwise((p - n) / (p + n + 1.0))


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """Trimmed ids, numeric stars, no NULL text; rows without id or stars are dropped."""
    return reviews.withColumns(
        {
            "business_id": F.trim(F.col("business_id")),
            "stars": safe_double(F.col("stars")),
            "text": F.coalesce("text", F.lit("")),
        }
    ).where(F.col("business_id").isNotNull() & F.col("stars").isNotNull())


def score_reviews(
    reviews: DataFrame,
    positive=tuple(POSITIVE_WORDS),
    negative=tuple(NEGATIVE_WORDS),
    harsh=tuple(HARSH_WORDS),
    complaints=tuple(COMPLAINT_PHRASES),
) -> DataFrame:
    """Per review: word densities, sentiment and complaint flags. The text is split once and then dropped."""
    tokens = reviews.withColumn("tokens", latin_tokens(F.col("text")))
    low = F.lower(F.col("text"))
    t = F.col("tokens")
    return tokens.select(
        *[c for c in reviews.columns if c != "text"],
        lexicon_share(t, negative).alias("neg_density"),
        lexicon_share(t, harsh).alias("harsh_density"),
        (count_in(t, harsh) > 0).cast("int").alias("harsh_any"),
        contains_any(low, list(complaints)).cast("int").alias("complaint"),
        _sentiment(t, positive, negative).alias("sentiment"),
    )


def review_signals(reviews: DataFrame, places: DataFrame, **lexicons) -> DataFrame:
    """Signals per place; places without reviews keep NULLs."""
    scored = score_reviews(clean_reviews(reviews).select("business_id", "stars", "text"), **lexicons)
    share = lambda cond: F.avg(cond.cast("double"))
    per_place = scored.groupBy("business_id").agg(
        F.avg("neg_density").alias("rev_neg_word_density"),
        F.avg("complaint").alias("rev_complaint_hit_rate"),
        share(F.col("stars") <= 2).alias("rev_low_review_star_share"),
        share(F.col("stars") >= 4).alias("rev_high_review_star_share"),
        F.avg("sentiment").alias("rev_mean_sentiment"),
        F.avg("harsh_density").alias("rev_harsh_word_density"),
        F.avg("harsh_any").alias("rev_harsh_review_share"),
        share(F.col("stars") <= 1).alias("rev_one_star_share"),
        F.max("neg_density").alias("rev_max_neg_density"),
        F.coalesce(F.stddev_samp("neg_density"), F.lit(0.0)).alias("rev_neg_density_std"),
    )
    return places.select(F.trim("business_id").alias("business_id")).join(per_place, "business_id", "left")


def aspect_hits(reviews: DataFrame, aspects: dict[str, Sequence[str]] = ASPECT_KEYWORDS) -> DataFrame:
    """Long rows (review_id, aspect) where any keyword of the aspect occurs in the lowered text."""
    low = F.lower(F.coalesce("text", F.lit("")))
    flags = F.array(*[F.when(contains_any(low, list(words)), F.lit(a)) for a, words in aspects.items()])
    return reviews.select("review_id", F.explode(F.array_compact(flags)).alias("aspect"))


def weak_aspect_targets(
    reviews: DataFrame,
    places: DataFrame,
    min_reviews: int = 1,
    aspects: dict[str, Sequence[str]] = ASPECT_KEYWORDS,
    positive=tuple(POSITIVE_WORDS),
    negative=tuple(NEGATIVE_WORDS),
) -> DataFrame:
    """Per place and aspect the number of hits and a target between 1 and 5.

    Enough hits: 0.7 mean stars + 0.3 mean sentiment on the star scale; else place stars, review mean or 3.
    """
    low = F.lower("text")
    rows = clean_reviews(reviews).select(
        "business_id",
        "stars",
        sentiment(F.col("text"), positive, negative).alias("sentiment"),
        *[contains_any(low, list(words)).alias(f"hit_{a}") for a, words in aspects.items()],
    )
    per_place = rows.groupBy("business_id").agg(
        F.avg("stars").alias("review_stars"),
        *[
            c
            for a in aspects
            for c in (
                F.count_if(F.col(f"hit_{a}")).alias(f"n_{a}"),
                F.avg(F.when(F.col(f"hit_{a}"), F.col("stars"))).alias(f"stars_{a}"),
                F.avg(F.when(F.col(f"hit_{a}"), F.col("sentiment"))).alias(f"sent_{a}"),
            )
        ],
    )
    joined = places.select(
        F.trim("business_id").alias("business_id"), safe_double(F.col("stars")).alias("place_stars")
    ).join(per_place, "business_id", "left")
    overall = F.coalesce("place_stars", "review_stars", F.lit(3.0))
    out = []
    for a in aspects:
        n = F.coalesce(F.col(f"n_{a}"), F.lit(0))
        mapped = clip(1.0 + 2.0 * (F.col(f"sent_{a}") + 1.0), 1.0, 5.0)
        blended = clip(0.7 * F.col(f"stars_{a}") + 0.3 * mapped, 1.0, 5.0)
        out += [
            n.alias(f"{a}_keyword_hits"),
            F.when(n >= min_reviews, blended).otherwise(overall).alias(f"target_{a}"),
        ]
    return joined.select("business_id", *out)


def target_correlations(places: DataFrame, targets: DataFrame, aspects=tuple(ASPECT_KEYWORDS)) -> DataFrame:
    """Pearson correlation of each aspect target with the stars."""
    joined = places.select("business_id", "stars").join(targets, "business_id")
    return joined.agg(*[F.corr(f"target_{a}", "stars").alias(f"corr_{a}_vs_overall") for a in aspects])


def neg_concentration(density: Column, review_count: Column) -> Column:
    return density / (F.log1p(F.greatest(review_count.cast("double"), F.lit(0.0))) + 1.0)


def star_weights(stars: Column) -> Column:
    """Sample weight of the half-star bin."""
    bin_no = clip(F.bround((stars - 1.0) * 2.0, 0), 0.0, 8.0).cast("int")
    return F.element_at(F.lit(HALF_STAR_WEIGHTS), bin_no + 1)


def extreme_weights(df: DataFrame, col: str = "stars") -> DataFrame:
    """Weight column that grows with the distance from the median; both medians are exact."""
    base = df.select(F.lit(1).alias("k"), F.col(col).cast("double").alias("v"))
    median = exact_quantiles(base, ["k"], "v", {"m": 0.5}).select("m").scalar()
    spread = base.select("k", F.abs(F.col("v") - median).alias("v"))
    scale = exact_quantiles(spread, ["k"], "v", {"m": 0.5}).select("m").scalar()
    return df.withColumn("weight", clip(1.0 + 1.6 * F.abs(F.col(col) - median) / (scale + 0.35), 0.6, 4.0))
