"""Text index, candidate filters and multi-factor ranking for a table of requests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelens.functions.columns import (
    bigrams,
    distance_score,
    haversine_km,
    price_match,
    price_symbol,
    price_tier,
    safe_double,
    trust_shrunk_stars,
)
from placelens.functions.frames import salted_join, top_per_group
from placelens.functions.lexicons import CUISINE_KEYWORDS, INDEX_STOPWORDS, THEME_STOPWORDS, WEIGHT_NAMES
from placelens.operators import term_blocks
from placelens.operators.text_signals import extract_themes
from placelens.session import cut as checkpointed
from placelens.session import stored

# Bytes of text whose terms one task counts.
TEXT_BLOCK = 8 << 20
# Blocks whose terms one task counts, if they all went there.
BLOCKS_PER_PART = 4

RESULT_COLUMNS = [
    "business_id", "name", "address", "city", "state", "categories", "stars", "review_count", "similarity",
    "final_score", "latitude", "longitude", "distance_km", "price_tier", "price_match",
]


def select_candidates_global(places: DataFrame, n: int) -> DataFrame:
    return places.orderBy(F.desc("review_count"), F.asc("business_id")).limit(n)


def select_candidates_by_state(places: DataFrame, n: int) -> DataFrame:
    """Most reviewed places with the budget shared over the states, at least 50 for each."""
    state = F.upper(F.trim("state"))
    states = places.agg(F.count_distinct(F.coalesce(state, F.lit(""))).alias("states")).scalar()
    share = F.greatest(F.lit(50), F.floor(F.lit(n) / F.greatest(states, F.lit(1))))
    # No state is given more than max(50, n) rows, so this cut runs before the shuffle.
    order = [F.desc("review_count"), F.asc("business_id")]
    ranked = top_per_group(places.withColumn("_s", F.coalesce(state, F.lit(""))), ["_s"], order, max(50, n), "_r")
    return ranked.where(F.col("_r") <= share).drop("_s", "_r").orderBy(*order).limit(n)


def sentiment_reviews(reviews: DataFrame) -> DataFrame:
    """All positive (stars >= 4) and negative (stars <= 2) reviews with text."""
    stars = safe_double(F.col("stars"))
    polarity = F.when(stars >= 4, "positive").when(stars <= 2, "negative")
    return reviews.withColumn("polarity", polarity).where(
        F.col("polarity").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")
    )


def sample_sentiment_reviews(
    reviews: DataFrame, max_reviews: int, order: Sequence[str] = ("date", "review_id"), places: DataFrame | None = None
) -> DataFrame:
    """First positive and negative texts of each place, half of the budget each. No other operator needs the sample."""
    rows = sentiment_reviews(reviews)
    if places is not None:
        rows = rows.join(places.select("business_id"), "business_id", "left_semi")
    positive = max(1, max_reviews // 2)
    negative = max(1, max_reviews - positive)
    ranked = top_per_group(rows, ["business_id", "polarity"], [F.asc(o) for o in order], max(positive, negative), "pos")
    limit = F.when(F.col("polarity") == "positive", positive).otherwise(negative)
    return ranked.where(F.col("pos") <= limit)


def synthetic_snippets(places: DataFrame) -> DataFrame:
    """Positive pseudo-review of second-source places from name, address, categories and detail text."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    detail = F.when(~F.col("detail").isin("", "{}", "nan"), F.col("detail"))
    rows = places.where(F.col("business_id").startswith("gm_")).select(
        "business_id",
        F.lit("positive").alias("polarity"),
        F.concat_ws(" ", text("name"), text("address"), text("categories"), detail).alias("text"),
    )
    return rows.where(F.trim("text") != "")


def build_profiles(
    places: DataFrame, texts: DataFrame, themes: int = 6, stopwords: Sequence[str] = tuple(THEME_STOPWORDS)
) -> DataFrame:
    """One profile text per place from its fields and the themes of its positive and negative texts."""
    top = extract_themes(texts, ["business_id", "polarity"], k=themes, stopwords=stopwords)

    def phrases(kind: str) -> Column:
        rows = F.collect_list(F.when(F.col("polarity") == kind, F.struct("rank", "phrase")))
        return F.array_join(F.transform(F.array_sort(rows), lambda s: s["phrase"]), ", ").alias(kind)

    # At most 2 x ``themes`` phrases per place are gathered.
    per_place = top.groupBy("business_id").agg(phrases("positive"), phrases("negative"))
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    filled = lambda c: F.when(clean(c) != "", clean(c))
    blank = F.lit("")
    profile = F.concat(
        F.lit("Restaurant: "), F.coalesce(filled("name"), F.lit("This restaurant")),
        F.lit(". Category: "), clean("categories"),
        F.lit(". City: "), F.concat_ws(", ", filled("city"), filled("state")),
        F.lit(". Price: "), price_symbol(F.col("attributes")),
        F.lit(". Positive themes: "), F.coalesce("positive", blank),
        F.lit(". Negative themes: "), F.coalesce("negative", blank), F.lit("."),
    )
    return places.join(per_place, "business_id", "left").select("business_id", profile.alias("profile"))


@dataclass(frozen=True)
class TextIndex:
    """Term weights as tables: postings (doc_id, term, w) and vocabulary (term, idf); ``files`` fits the size of the postings."""

    postings: DataFrame
    vocabulary: DataFrame
    files: int | None = None


def index_words(text: Column, stopwords: Sequence[str]) -> Column:
    """Words of two or more characters without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda t: ~t.isin(list(stopwords))) if stopwords else words


def index_terms(text: Column, stopwords: Sequence[str], ngrams: int = 2) -> Column:
    """Words of two or more characters without stop words, and the pairs of neighbours among them."""
    kept = index_words(text, stopwords)
    return F.concat(kept, bigrams(kept)) if ngrams > 1 else kept


def _block_words(docs: DataFrame, blocks: int, stopwords: Sequence[str]) -> DataFrame:
    """Rows (block, doc_id, words). A block is one task; rows that share an id are in one block."""
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    spread = docs.select("doc_id", "text", block).repartitionById(blocks, "block")
    return spread.select("block", "doc_id", index_words(F.col("text"), stopwords).alias("words"))


def _block_counts(docs: DataFrame, blocks: int, stopwords: Sequence[str], ngrams: int) -> DataFrame:
    """Counts (doc_id, term, tf), block by block."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _block_words(docs, blocks, stopwords).groupBy("block")
    return rows.applyInArrow(lambda t: term_blocks.counted(t, ngrams), f"doc_id {kind}, term string, tf bigint")


def fit_tfidf(
    docs: DataFrame,
    max_features: int | None = None,
    stopwords: Sequence[str] = tuple(INDEX_STOPWORDS),
    ngrams: int = 2,
    min_df: int = 1,
    cut: bool = False,
) -> TextIndex:
    """TF-IDF over (doc_id, text): smoothed idf, unit-length rows. ``max_features`` keeps the most counted terms.

    Documents are dealt by id into blocks of about ``TEXT_BLOCK`` bytes, however many that takes, and their counts
    stay there. A block sends its distinct terms to the tasks that count them over all blocks (``term_blocks``) and
    gets the frequencies back. All rows of one id are in one block and so in one task. With ``cut`` the frequencies are
    kept as a table, for plans that read both tables.
    """
    n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(cores, -(-size // TEXT_BLOCK))
    parts = max(cores, -(-size // (TEXT_BLOCK * BLOCKS_PER_PART)))
    words = _block_words(docs, blocks, stopwords)
    sent = words.groupBy("block").applyInArrow(
        lambda t: term_blocks.sent_terms(t, ngrams, parts), "block int, part int, terms binary, n binary, tf binary"
    )

    def merged(vocabulary: bool, found: bool, last: tuple[int, str] | None = None) -> DataFrame:
        schema = "block int, part int, found binary, term string, df bigint, total bigint"
        return sent.groupBy("part").applyInArrow(lambda t: term_blocks.merged_terms(t, vocabulary, found, last), schema)

    last = None
    if max_features is not None:
        order = [F.desc("total"), F.asc("term")]
        most = merged(True, False).where(F.col("df") >= min_df).orderBy(*order).limit(max_features)
        last = most.agg(F.max(F.struct((-F.col("total")).alias("t"), "term")).alias("last")).select("last.*").first()
        last = (-last["t"], last["term"]) if last["t"] is not None else (n_docs + 1 << 32, "")
    both = stored(merged(True, True, last), "term-frequencies") if cut else None
    frequent = (both if cut else merged(True, False, last)).where(F.col("block").isNull() & (F.col("df") >= max(min_df, 1)))
    found = (both if cut else merged(False, True, last)).where(F.col("block").isNotNull()).select("block", "part", "found")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Both sides lie by block, so no text moves for it.
    postings = words.groupBy("block").cogroup(found.repartitionById(blocks, "block").groupBy("block")).applyInArrow(
        lambda left, right: term_blocks.weighted(left, right, ngrams, parts, n_docs, min_df), f"doc_id {kind}, term string, w double"
    )
    idf = (F.ln((F.lit(n_docs) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")
    return TextIndex(postings, frequent.select("term", idf), parts)


def doc_norms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def query_weights(
    texts: DataFrame, vocabulary: DataFrame, stopwords: Sequence[str] = tuple(INDEX_STOPWORDS), ngrams: int = 2
) -> DataFrame:
    """Unit-length term weights (query_text, term, wq) of distinct query texts; unseen terms are ignored."""
    distinct = texts.select("query_text").distinct()
    terms = distinct.select(
        "query_text", F.explode(index_terms(F.col("query_text"), stopwords, ngrams)).alias("term")
    )
    raw = (
        terms.groupBy("query_text", "term")
        .agg(F.count("*").alias("tf"))
        .join(vocabulary, "term")
        .select("query_text", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    )
    norms = raw.groupBy("query_text").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "query_text").select("query_text", "term", (F.col("raw") / F.col("norm")).alias("wq"))


def cosine_scores(
    texts: DataFrame, index: TextIndex, stopwords: Sequence[str] = tuple(INDEX_STOPWORDS), ngrams: int = 2
) -> DataFrame:
    """Similarity of every (distinct query text, document) that share a term; other pairs score 0.

    An equi-join on the term; postings of very frequent terms are salted.
    """
    weights = query_weights(texts, index.vocabulary, stopwords, ngrams)
    q_norms = weights.groupBy("query_text").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("q_norm"))
    dots = (
        salted_join(weights, index.postings, "term")
        .groupBy("query_text", "doc_id")
        .agg(F.sum(F.col("wq") * F.col("w")).alias("dot"))
    )
    # Index rows have unit length.
    return dots.join(q_norms, "query_text").select(
        "query_text", "doc_id", (F.col("dot") / (F.col("q_norm") + 1e-9)).alias("similarity")
    )


def cosine_in_states(
    asked: DataFrame, index: TextIndex, meta: DataFrame, stopwords: Sequence[str] = tuple(INDEX_STOPWORDS), ngrams: int = 2
) -> DataFrame:
    """``cosine_scores`` of each distinct (query_text, state) with the places of that state only.

    Every document takes the state of its place along, so the join is on state and term: a text asked in one state
    meets none of the postings of the others, and a term that is frequent everywhere is one key per state.
    """
    weights = query_weights(asked, index.vocabulary, stopwords, ngrams)
    q_norms = weights.groupBy("query_text").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("q_norm"))
    where = asked.select("query_text", F.upper(F.trim("state")).alias("state_norm")).distinct()
    known = meta.select(F.col("business_id").alias("doc_id"), "state_norm").where(F.col("state_norm").isNotNull())
    # Only terms that are asked for travel with a state.
    wanted = index.postings.join(weights.select("term").distinct(), "term", "left_semi")
    key = F.concat_ws("\n", "state_norm", "term").alias("state_term")
    postings = wanted.join(known, "doc_id").select("doc_id", "w", key)
    texts = weights.join(where, "query_text").select("query_text", "state_norm", "wq", key)
    dots = salted_join(texts, postings, "state_term").groupBy("query_text", "state_norm", "doc_id").agg(F.sum(F.col("wq") * F.col("w")).alias("dot"))
    return dots.join(q_norms, "query_text").select(
        "query_text", "state_norm", "doc_id", (F.col("dot") / (F.col("q_norm") + 1e-9)).alias("similarity")
    )


SIGNATURE = [
    "query_text", "state", "city", "cuisine_filter", "budget", "ref_lat", "ref_lon", "radius_km", *WEIGHT_NAMES,
]


def with_signature(queries: DataFrame) -> DataFrame:
    """Tag each request with a digest of all that its ranking depends on."""
    return queries.withColumn("sig", F.sha2(F.to_json(F.struct(*SIGNATURE)), 256))


def place_meta(places: DataFrame) -> DataFrame:
    """Columns the ranking needs, normalised."""
    return places.select(
        "business_id", "name", "address", "city", "state", "categories", "stars", "review_count",
        safe_double(F.col("latitude")).alias("latitude"),
        safe_double(F.col("longitude")).alias("longitude"),
        price_tier(F.col("attributes")).alias("price_tier"),
        F.upper(F.trim("state")).alias("state_norm"),
        F.lower(F.trim("city")).alias("city_norm"),
        F.lower(F.coalesce("categories", F.lit(""))).alias("categories_norm"),
    )


def align_meta(index_ids: DataFrame, meta: DataFrame) -> DataFrame:
    """Meta rows of the indexed ids with absent normalised columns filled from the raw ones."""
    joined = index_ids.select("business_id").join(meta, "business_id", "left")
    raw = {
        "state_norm": F.upper(F.trim(F.coalesce("state", F.lit("")))),
        "city_norm": F.lower(F.trim(F.coalesce("city", F.lit("")))),
        "categories_norm": F.lower(F.coalesce("categories", F.lit(""))),
    }
    filled = {n: F.coalesce(F.col(n), c) if n in meta.columns else c for n, c in raw.items()}
    return joined.withColumns(filled)


def candidate_pairs(requests: DataFrame, meta: DataFrame, all_states: bool = False) -> DataFrame:
    """Places of the asked state and city per request signature, with cuisine match and distance.

    ``all_states`` also serves requests for the state 'all'; every place then appears under a second key.
    """
    asked = requests.withColumn("_state", F.upper(F.trim("state"))).drop("state").withColumnRenamed("city", "_city")
    keyed = meta.withColumn("_state", F.col("state_norm"))
    if all_states:
        keyed = meta.withColumn("_state", F.explode(F.array(F.col("state_norm"), F.lit("ALL"))))
    pairs = salted_join(asked, keyed, "_state", min_rows=1_000_000)
    city = F.lower(F.trim("_city"))
    pairs = pairs.where(F.coalesce((city == "") | (city == "all") | (city == F.col("city_norm")), F.lit(True)))
    keywords = F.flatten(
        F.filter(
            F.transform("cuisine_filter", lambda c: F.try_element_at(literal_arrays(CUISINE_KEYWORDS), c)),
            lambda k: k.isNotNull(),
        )
    )
    match = F.coalesce(F.exists(keywords, lambda k: F.col("categories_norm").contains(k)), F.lit(False))
    distance = haversine_km(F.col("ref_lat"), F.col("ref_lon"), F.col("latitude"), F.col("longitude"))
    return pairs.withColumns({"cuisine_match": match, "distance_km": distance}).drop("_state", "_city")


def literal_arrays(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])


def _in_reach() -> Column:
    hard = F.col("ref_lat").isNotNull() & F.col("ref_lon").isNotNull() & (F.col("radius_km") > 0)
    return F.when(F.coalesce(hard, F.lit(False)), F.coalesce(F.col("distance_km") <= F.col("radius_km"), F.lit(False))).otherwise(True)


def _relaxed() -> Column:
    """No cuisine asked for, or none of the places matches it."""
    return (F.coalesce(F.size("cuisine_filter"), F.lit(0)) <= 0) | ~F.col("any_match")


def filter_candidates(requests: DataFrame, meta: DataFrame, all_states: bool = False) -> DataFrame:
    """Candidates per signature after all filters; the cuisine filter gives way where it would leave nothing."""
    pairs = candidate_pairs(requests, meta, all_states)
    matched = pairs.groupBy("sig").agg(F.bool_or("cuisine_match").alias("any_match"))
    kept = pairs.join(matched, "sig").where(_in_reach() & (_relaxed() | F.col("cuisine_match")))
    return kept.drop("any_match", "cuisine_match")


def score_candidates(
    requests: DataFrame, meta: DataFrame, sims: DataFrame, ref_reviews: float = 150.0, all_states: bool = False
) -> DataFrame:
    """Filtered candidates with their five-factor score.

    Similarity and popularity are scaled by their range over the filtered set of the signature. One aggregate
    finds the ranges for the matched and for the whole set together with the relaxation flag, so a set is
    never held in one task.
    """
    sim = sims.select("query_text", F.col("doc_id").alias("business_id"), "similarity")
    pairs = (
        candidate_pairs(requests, meta, all_states)
        .join(sim, ["query_text", "business_id"], "left")
        .withColumns(
            {
                "similarity": F.coalesce("similarity", F.lit(0.0)),
                "pop": F.log1p(F.greatest(F.col("review_count").cast("double"), F.lit(0.0))),
            }
        )
    )
    reach = _in_reach()
    both = reach & F.col("cuisine_match")
    ranges = []
    for c in ("similarity", "pop"):
        for name, fn in (("lo", F.min), ("hi", F.max)):
            ranges += [fn(F.when(reach, F.col(c))).alias(f"{c}_{name}_any"), fn(F.when(both, F.col(c))).alias(f"{c}_{name}_match")]
    stats = pairs.groupBy("sig").agg(F.bool_or("cuisine_match").alias("any_match"), *ranges)
    kept = pairs.join(stats, "sig").where(reach & (_relaxed() | F.col("cuisine_match")))

    def scaled(c: str) -> Column:
        pick = lambda end: F.when(_relaxed(), F.col(f"{c}_{end}_any")).otherwise(F.col(f"{c}_{end}_match"))
        return (F.col(c) - pick("lo")) / (pick("hi") - pick("lo") + 1e-9)

    match = price_match(F.col("price_tier"), F.col("budget"))
    near = distance_score(F.col("distance_km"), F.col("radius_km"))
    trust = trust_shrunk_stars(F.col("stars"), F.col("review_count"), ref_reviews)
    score = (
        F.col("w_semantic") * scaled("similarity")
        + F.col("w_rating") * trust
        + F.col("w_price") * match
        + F.col("w_distance") * near
        + F.col("w_popularity") * scaled("pop")
    )
    return kept.select("sig", "*", match.alias("price_match"), score.alias("final_score")).select(
        "sig", *RESULT_COLUMNS
    )


def top_k_per_query(scored: DataFrame, top_k: int = 10, pool_k: int | None = 45) -> DataFrame:
    """Pool of max(top_k, pool_k) rows per signature, best first."""
    size = max(top_k, pool_k or 0, 1)
    return top_per_group(scored, ["sig"], [F.desc("final_score"), F.asc("business_id")], size)


# What the ranking of a request depends on besides its text.
FRAME = [c for c in SIGNATURE if c != "query_text"]


def _frame_candidates(frames: DataFrame, meta: DataFrame, ref_reviews: float) -> DataFrame:
    """Filtered places of each request frame with the part of the score that no text changes, and the set's size."""
    facts = meta.select(
        "business_id", "state_norm", "city_norm", "categories_norm", "latitude", "longitude", "stars", "review_count", "price_tier"
    )
    match = price_match(F.col("price_tier"), F.col("budget"))
    near = distance_score(F.col("distance_km"), F.col("radius_km"))
    trust = trust_shrunk_stars(F.col("stars"), F.col("review_count"), ref_reviews)
    fixed = F.col("w_rating") * trust + F.col("w_price") * match + F.col("w_distance") * near
    pairs = candidate_pairs(frames, facts).select(
        "frame", "business_id", "distance_km", "w_popularity", "cuisine_match", _in_reach().alias("reach"),
        (F.coalesce(F.size("cuisine_filter"), F.lit(0)) > 0).alias("filtered"),
        F.log1p(F.greatest(F.col("review_count").cast("double"), F.lit(0.0))).alias("pop"),
        match.alias("price_match"), fixed.alias("fixed"),
    )
    pairs = checkpointed(pairs)
    both = F.col("reach") & F.col("cuisine_match")
    stats = pairs.groupBy("frame").agg(
        (F.any_value("filtered") & F.bool_or("cuisine_match")).alias("strict"),
        *[
            c
            for name, rows in (("any", F.col("reach")), ("match", both))
            for c in (
                F.min(F.when(rows, F.col("pop"))).alias(f"lo_{name}"),
                F.max(F.when(rows, F.col("pop"))).alias(f"hi_{name}"),
                F.count_if(rows).alias(f"n_{name}"),
            )
        ],
    )
    pick = lambda name: F.when(F.col("strict"), F.col(f"{name}_match")).otherwise(F.col(f"{name}_any"))
    bounds = stats.select("frame", "strict", pick("lo").alias("lo"), pick("hi").alias("hi"), pick("n").alias("n_set"))
    kept = pairs.join(bounds, "frame").where(F.col("reach") & (~F.col("strict") | F.col("cuisine_match")))
    scaled = (F.col("pop") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)
    base = F.col("fixed") + F.col("w_popularity") * scaled
    return kept.select("frame", "business_id", "distance_km", "price_match", "n_set", base.alias("base"))


def rank_candidates(requests: DataFrame, meta: DataFrame, sims: DataFrame, size: int, ref_reviews: float = 150.0) -> DataFrame:
    """The ``size`` best candidates per signature, as ``score_candidates`` and a cut would give them.

    Requests that differ only in their text share a frame, and the places of a frame are filtered and scored once.
    A text changes the score only of places it shares a term with; the others keep the frame's order, so the
    frame's own first ``size`` rows are all of them that can be among the best. This needs weights of 0 or more.
    Names and addresses are joined to the ranked rows only.
    """
    asked = requests.withColumn("frame", F.sha2(F.to_json(F.struct(*FRAME)), 256))
    places = _frame_candidates(asked.select("frame", *FRAME).distinct(), meta, ref_reviews)
    keyed = asked.select("sig", "frame", "query_text", "state", "w_semantic")
    # A place is in one state, so the text and the place settle the similarity.
    shared = ["query_text", "state_norm"] if "state_norm" in sims.columns else ["query_text"]
    hits = keyed.withColumn("state_norm", F.upper(F.trim("state"))).join(
        sims.select(*shared, F.col("doc_id").alias("business_id"), "similarity"), shared
    ).drop("state", "state_norm")
    touched = checkpointed(hits.drop("query_text").join(places, ["frame", "business_id"]))
    first = top_per_group(places, ["frame"], [F.desc("base"), F.asc("business_id")], size, "_r").drop("_r")
    others = (
        keyed.drop("query_text", "state").join(first, "frame")
        .join(touched.select("sig", "business_id"), ["sig", "business_id"], "left_anti")
        .withColumn("similarity", F.lit(0.0))
    )
    ends = touched.groupBy("sig").agg(
        F.min("similarity").alias("low"), F.max("similarity").alias("hi"), F.count("*").alias("n_touched")
    )
    lo = F.when(F.col("n_touched") < F.col("n_set"), F.lit(0.0)).otherwise(F.col("low"))
    scaled = (F.col("similarity") - lo) / (F.col("hi") - lo + 1e-9)
    rows = touched.unionByName(others).join(ends, "sig", "left")
    final = F.col("w_semantic") * F.coalesce(scaled, F.lit(0.0)) + F.col("base")
    rows = rows.select("sig", "business_id", "similarity", "distance_km", "price_match", final.alias("final_score"))
    best = top_per_group(rows, ["sig"], [F.desc("final_score"), F.asc("business_id")], size)
    shown = [c for c in RESULT_COLUMNS if c not in ("similarity", "final_score", "distance_km", "price_match")]
    return best.join(meta.select(*shown), "business_id").select("sig", *RESULT_COLUMNS, "rank")


def keyword_match_mvp(
    queries: DataFrame, places: DataFrame, min_stars: float = 3, max_price: int | None = 4, top_k: int = 5
) -> DataFrame:
    """Open places ranked per keyword query by bag-of-words cosine over their categories, then stars.

    ``queries`` has query_id and text. Places that share no word score 0 and only fill up the list; as they do
    not depend on the query, the few best of them are found once.
    """
    stop = ["food", "restaurants"]
    open_places = places.where(F.col("is_open") == 1).withColumn("price_range", price_tier(F.col("attributes")))
    if max_price is not None and max_price < 4:
        eligible = open_places.where((F.col("stars") >= min_stars) & (F.col("price_range") <= max_price))
    else:
        eligible = open_places.where(F.col("stars") >= min_stars)

    def words(c: Column) -> Column:
        found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
        return F.filter(found, lambda t: ~t.isin(stop))

    known = open_places.select(F.explode(words(F.col("categories"))).alias("term")).distinct()
    bags = (
        eligible.select("business_id", F.explode(words(F.col("categories"))).alias("term"))
        .groupBy("business_id", "term")
        .agg(F.count("*").alias("tf"))
    )
    norm = lambda df, key: df.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    per_text = queries.select("text").distinct().select("text", F.explode(words(F.col("text"))).alias("term"))
    asked = per_text.groupBy("text", "term").agg(F.count("*").alias("tf")).join(known, "term", "left_semi")
    dots = (
        salted_join(asked.withColumnRenamed("tf", "q"), bags, "term")
        .groupBy("text", "business_id")
        .agg(F.sum(F.col("q") * F.col("tf")).alias("dot"))
    )
    scored = (
        dots.join(norm(bags, "business_id").withColumnRenamed("norm", "d_norm"), "business_id")
        .join(norm(asked, "text").withColumnRenamed("norm", "q_norm"), "text")
        .withColumn("match_score", F.col("dot") / (F.col("d_norm") * F.col("q_norm")))
        .join(eligible.select("business_id", "stars"), "business_id")
    )
    order = [F.desc("match_score"), F.desc("stars"), F.asc("business_id")]
    hits = top_per_group(scored, ["text"], order, top_k).select("text", "business_id", "match_score", "stars")
    # Spare rows: the best ``top_k`` places by stars that do not share a word with the text. At most
    # top_k places per text can be hits among the first 2 x top_k, so those rows are enough.
    rest = eligible.select("business_id", "stars").orderBy(F.desc("stars"), F.asc("business_id")).limit(2 * top_k)
    listed = rest.agg(F.collect_list(F.struct("business_id", "stars"))).scalar()
    spare = (
        queries.select("text").distinct()
        .select("text", F.inline(listed))
        .join(hits.select("text", "business_id"), ["text", "business_id"], "left_anti")
        .withColumn("match_score", F.lit(0.0))
    )
    best = top_per_group(hits.unionByName(spare.select(hits.columns)), ["text"], order, top_k)
    details = eligible.select("business_id", "name", "price_range", "categories")
    return queries.select("query_id", "text").join(best, "text").join(details, "business_id").drop("text")
