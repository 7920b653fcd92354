"""Category requests in free text and scoring of candidate sites."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions.columns import any_of, split_categories
from placelens.functions.frames import top_per_group
from placelens.functions.lexicons import CATEGORY_ALIASES, CATEGORY_FALLBACKS, FEATURE_ALIASES
from placelens.operators.features import category_key
from placelens.operators.modeling import model_columns
from placelens.operators.query_log import trim_space
from placelens.operators.spatial import convex_hull, inside_ring, score_sites_features

# Characters of an index entry; stems are as long.
GRAM = 4


def category_keys(places: DataFrame, slices: Sequence[str] = ("city", "state")) -> DataFrame:
    """Category keys in use per slice."""
    keys = F.explode(F.transform(split_categories(F.col("categories")), category_key)).alias("cat_key")
    return places.select(*slices, keys).distinct()


def _request_words(q: Column) -> Column:
    return F.filter(F.split(q, "[^a-z0-9&]+"), lambda t: (F.length(t) >= 2) & ~t.isin("or", "and", "the", "a", "an"))


def _phrase_score(q: Column, p: Column) -> Column:
    """How well a lowered phrase names a label: exact, prefix, substring, words, stems."""
    n = F.length(q)
    words = _request_words(q)
    label_words = F.filter(F.split(p, "[^a-z0-9&]+"), lambda w: w != "")
    spaced = F.filter(F.split(F.replace(p, F.lit("&"), F.lit(" ")), r"\s+"), lambda w: w != "")
    hits = F.size(
        F.filter(words, lambda t: F.exists(label_words, lambda w: (t == w) | ((F.length(t) >= 4) & w.contains(t))))
    )
    stems = F.exists(
        words, lambda t: (F.length(t) >= 4) & F.exists(spaced, lambda w: w.contains(t) | w.startswith(F.substring(t, 1, 4)))
    )
    total = F.size(words)
    return (
        F.when((q == "") | (p == ""), 0.0)
        .when(q == p, 100.0)
        .when(p.startswith(q) & (n >= 2), 92.0)
        .when((n >= 3) & p.contains(q), 86.0)
        .when((n >= 2) & (p.contains(q) | q.contains(p)), 80.0)
        .when(total == 0, 0.0)
        .when(F.forall(words, lambda t: p.contains(t)), 78.0)
        .when(hits > 0, 45.0 + 25.0 * (hits / total))
        .when(stems, 35.0)
        .otherwise(0.0)
    )


def _key_forms(key: Column) -> tuple[Column, Column]:
    """A key as a label with spaces and as it is written."""
    bare = F.lower(F.regexp_replace(key, "^cat_", ""))
    return F.replace(bare, F.lit("_"), F.lit(" ")), bare


def _alias_in_text(low: Column, phrase: str) -> Column:
    return low.contains(phrase) if " " in phrase else low.rlike(f"(?<![a-z0-9]){re.escape(phrase)}(?![a-z0-9])")


def _alias_in_key(label: Column, bare: Column, words: Sequence[str]) -> Column:
    return any_of([label.contains(w) | bare.contains(w) for w in words])


def score_category_match(text: Column, key: Column) -> Column:
    """Score of a request text against a category key, lifted to 90 by an alias phrase."""
    label, bare = _key_forms(key)
    low = F.lower(text)
    q = trim_space(low)
    scores = [_phrase_score(q, trim_space(label)), _phrase_score(q, trim_space(bare))]
    lifted = [_alias_in_text(low, phrase) & _alias_in_key(label, bare, words) for phrase, words in CATEGORY_ALIASES]
    return F.greatest(*scores, F.when(any_of(lifted), 90.0).otherwise(0.0))


def _grams(s: Column, n: int) -> Column:
    """All substrings of n characters."""
    at = F.sequence(F.lit(1), F.length(s) - n + 1)
    return F.when(F.length(s) >= n, F.transform(at, lambda i: s.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _entries(kind: str, grams: Column) -> Column:
    return F.transform(grams, lambda g: F.concat(F.lit(kind), g))


def _key_entries(key: Column) -> Column:
    """Index entries of a key: what it contains, how it begins, the aliases that stand for it."""
    label, bare = _key_forms(key)
    parts = []
    for p in (trim_space(label), trim_space(bare)):
        parts += [_entries("in:", _grams(p, n)) for n in range(2, GRAM + 1)]
        parts.append(F.when(p != "", F.array(F.concat(F.lit("head:"), F.substring(p, 1, GRAM)))).otherwise(F.array().cast("array<string>")))
    aliases = [F.when(_alias_in_key(label, bare, words), F.lit(f"alias:{i}")) for i, (_, words) in enumerate(CATEGORY_ALIASES)]
    return F.array_distinct(F.concat(*parts, F.array_compact(F.array(*aliases))))


def _text_entries(text: Column) -> Column:
    """Entries of which a key has to have one to score above 0.

    A key that contains the text or a word of it, or has a word with its stem, contains the first ``GRAM`` characters
    of the text or of that word. A key inside the text begins with one of its substrings. The rest are alias phrases.
    """
    low = F.lower(text)
    q = trim_space(low)
    begins = F.filter(F.concat(F.array(q), _request_words(q)), lambda t: F.length(t) >= 2)
    parts = [_entries("in:", F.transform(begins, lambda t: F.substring(t, 1, GRAM)))]
    parts += [_entries("head:", _grams(q, n)) for n in range(1, GRAM + 1)]
    aliases = [F.when(_alias_in_text(low, phrase), F.lit(f"alias:{i}")) for i, (phrase, _) in enumerate(CATEGORY_ALIASES)]
    return F.array_distinct(F.concat(*parts, F.array_compact(F.array(*aliases))))


def candidate_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs (chunk_id, cat_key) that share an index entry; all pairs with a score above 0 are among them.

    ``texts`` has (chunk_id, chunk), ``keys`` distinct values of cat_key. Entries travel with ids, not with texts.
    """
    index = keys.select("cat_key", F.explode(_key_entries(F.col("cat_key"))).alias("entry"))
    probes = texts.select("chunk_id", F.explode(_text_entries(F.col("chunk"))).alias("entry"))
    return probes.join(index, "entry").select("chunk_id", "cat_key").distinct()


def _scored(requests: DataFrame, keys: DataFrame, chunks: Column, slices: Sequence[str]) -> DataFrame:
    """Best score above 0 of each distinct (slice, text) with the keys of its slice.

    Each distinct chunk is looked up and scored once for all slices that ask for it.
    """
    slices = list(slices)
    used = keys.select(*slices, "cat_key").distinct()
    texts = requests.select(*slices, "text").distinct().where(trim_space(F.col("text")) != "")
    asked = texts.select(*slices, "text", F.explode(chunks).alias("chunk")).withColumn("chunk_id", F.sha2("chunk", 256))
    distinct = asked.select("chunk_id", "chunk").dropDuplicates(["chunk_id"])
    pairs = candidate_keys(distinct, used.select("cat_key").distinct()).join(distinct, "chunk_id")
    score = score_category_match(F.col("chunk"), F.col("cat_key"))
    hits = pairs.select("chunk_id", "cat_key", score.alias("score")).where(F.col("score") > 0)
    rows = asked.drop("chunk").join(hits, "chunk_id").join(used, [*slices, "cat_key"])
    return rows.groupBy(*slices, "text", "cat_key").agg(F.max("score").alias("score"))


def _collapse(text: Column) -> Column:
    return trim_space(F.regexp_replace(F.replace(text, F.lit(","), F.lit(" ")), r"\s+", " "))


def resolve_categories(
    requests: DataFrame, keys: DataFrame, slices: Sequence[str] = ("city", "state"), max_keys: int = 3
) -> DataFrame:
    """Category keys a request text stands for: one clear winner or up to ``max_keys`` strong ones."""
    slices = list(slices)
    raw = trim_space(F.col("text"))
    parts = F.filter(F.transform(F.split(raw, "[,;\n]+"), trim_space), lambda p: p != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(raw))
    chunks = F.array_distinct(F.concat(F.array(raw, F.array_join(parts, " "), _collapse(raw)), parts))
    scored = _scored(requests, keys, F.filter(chunks, lambda c: c != ""), slices)
    k = max(max_keys, 2)
    ranked = top_per_group(scored, [*slices, "text"], [F.desc("score"), F.asc("cat_key")], k)
    # At most ``k`` rows per text are gathered.
    best = ranked.groupBy(*slices, "text").agg(
        F.array_sort(F.collect_list(F.struct("rank", "cat_key", "score"))).alias("top")
    )
    first = F.col("top")[0]["score"]
    gap = first - F.coalesce(F.get("top", F.lit(1))["score"], F.lit(0.0))
    alone = ((F.size(parts) == 1) & (first >= 80) & (gap >= 6)) | ((first >= 88) & (gap >= 12))
    strong = F.slice(F.filter("top", lambda t: t["score"] >= 28), 1, max_keys)
    chosen = (
        F.when(first < 8, F.slice("top", 1, 0))
        .when(alone | (F.size(strong) == 0), F.slice("top", 1, 1))
        .otherwise(strong)
    )
    resolved = best.select(*slices, "text", F.inline(chosen))
    return requests.join(resolved, [*slices, "text"])


def suggest_categories(
    requests: DataFrame, keys: DataFrame, slices: Sequence[str] = ("city", "state"), n: int = 8
) -> DataFrame:
    """The n best keys scoring 8 or more; else listed fallbacks in use; else the first keys by name."""
    slices = list(slices)
    scored = _scored(requests, keys, F.array(_collapse(trim_space(F.col("text")))), slices)
    hits = scored.where(F.col("score") >= 8)
    order = [F.desc("score"), F.asc("cat_key")]
    best = top_per_group(hits, [*slices, "text"], order, n).select(*slices, "text", "rank", "cat_key")
    place = F.coalesce(F.nullif(F.array_position(F.lit(CATEGORY_FALLBACKS), F.col("cat_key")), F.lit(0)), F.lit(999))
    used = keys.select(*slices, "cat_key").distinct().withColumn("place", place)
    spare = top_per_group(used, slices, [F.asc("place"), F.asc("cat_key")], n)
    # A slice with a listed fallback in use offers nothing else; its first row is one then.
    listed = spare.where((F.col("rank") == 1) & (F.col("place") < 999)).select(*slices, F.lit(True).alias("listed"))
    spare = spare.join(listed, slices, "left").where(F.col("listed").isNull() | (F.col("place") < 999))
    texts = requests.select(*slices, "text").distinct().where(trim_space(F.col("text")) != "")
    missed = texts.join(best.select(*slices, "text"), [*slices, "text"], "left_anti")
    kept = best.unionByName(missed.join(spare, slices).select(*slices, "text", "rank", "cat_key"))
    return requests.join(kept, [*slices, "text"])


def feature_aliases(df: DataFrame) -> DataFrame:
    """Add former feature names next to the columns that carry them now."""
    add = {old: F.col(f"`{new}`") for old, new in FEATURE_ALIASES.items() if new in df.columns and old not in df.columns}
    return df.withColumns(add)


def check_sites(sites: DataFrame, ref: DataFrame, min_rows: int = 10) -> DataFrame:
    """Reference size of each site's slice and the reason a site cannot be scored."""
    sizes = ref.groupBy("slice").agg(F.count("*").alias("reference_rows"))
    known = ref.select("slice", F.explode(split_categories(F.col("categories"))).alias("category")).distinct()
    asked = sites.select("site_id", "slice", F.explode_outer(split_categories(F.col("categories"))).alias("category"))
    unknown = (
        asked.where(F.col("category").isNotNull())
        .join(known, ["slice", "category"], "left_anti")
        .groupBy("site_id")
        .agg(F.count("*").alias("unknown"))
    )
    joined = sites.join(sizes, "slice", "left").join(unknown, "site_id", "left")
    n = F.coalesce("reference_rows", F.lit(0))
    reason = F.when(n < min_rows, "too few reference places").when(F.col("unknown") > 0, "unknown category")
    return joined.withColumns({"reference_rows": n, "reject_reason": reason}).drop("unknown")


def score_sites(sites: DataFrame, ref: DataFrame, survival: PipelineModel, stars: PipelineModel, min_rows: int = 10) -> DataFrame:
    """Survival probability and stars of candidate sites (site_id, city, state, latitude, longitude, categories).

    Only places of the site's own city count as reference. Model inputs a site does not carry are 0. Sites
    that fail a check come back with a reason and no scores; fewer than ``min_rows`` reference places are one.
    """
    slice_of = F.concat_ws("|", F.lower(F.trim("city")), F.upper(F.trim("state")))
    sites, ref = sites.withColumn("slice", slice_of), ref.withColumn("slice", slice_of)
    checked = check_sites(sites, ref, min_rows)
    good = checked.where(F.col("reject_reason").isNull())
    rings = convex_hull(ref, ["slice"])
    features = score_sites_features(good.drop("reference_rows"), ref, by="slice")
    base = good.select(
        "site_id", "latitude", "longitude", F.array_distinct(split_categories(F.col("categories"))).alias("cats"),
        *[F.lit(0.0).alias(c) for c in ("time_is_open_morning", "time_is_open_latenight", "time_open_on_weekends", "price_range")],
    )
    inputs = model_columns(base.join(features, "site_id"))
    surv = survival.transform(inputs).select("site_id", vector_to_array("probability")[1].alias("survival_probability"))
    star = stars.transform(inputs).select("site_id", F.col("prediction").alias("predicted_stars"))
    metrics = features.select(
        "site_id", F.col("`count_all_3.0km`").alias("count_all_3km"), "survival_top5_similar", "dist_nearest_same_cat"
    )
    placed = checked.join(rings, "slice", "left").withColumn(
        "inside_hull", inside_ring(F.col("longitude"), F.col("latitude"), F.col("ring")).cast("int")
    )
    scored = placed.select("site_id", "reference_rows", "reject_reason", "inside_hull")
    for part in (surv, star, metrics):
        scored = scored.join(part, "site_id", "left")
    return scored
