"""Checked queries: review signals, query-log annotation and the text index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.functions.columns import latin_tokens, lexicon_share
from placelens.functions.lexicons import (
    BUDGET_PATTERNS,
    BUDGET_TAIL_WORDS,
    CUISINE_LABELS,
    CUISINE_NEEDLES,
    HALF_STAR_WEIGHTS,
    INDEX_STOPWORDS,
    LANDMARKS,
    QUERY_STOPWORDS,
    STATE_CODES,
    THEME_STOPWORDS,
)
from placelens.operators import query_log, retrieval, text_signals
from placelens.plans import views as v
from placelens.plans.checks_tables import _MAP as MAPPED
from placelens.plans.registry import check, rounded
from placelens.plans.views import sql_list as _list
from placelens.plans.views import tfidf_sql, with_views
from placelens.session import cut, shared_folder
from placelens.sources import writers

# The test texts are invented prose, so the signals are driven with frequent tokens and letter groups of it.
POSITIVE = ["the", "that", "with", "from"]
NEGATIVE = ["and", "was", "this", "are"]
HARSH = ["are", "for"]
COMPLAINTS = ["ther the", "hat was", "on and"]
ASPECTS = {"food": ["eron"], "service": ["thou", "blees"], "atmosphere": ["esthe"], "value": ["zzz"]}


def _like(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _n_in(words) -> str:
    return f"len(list_filter(w, lambda x: list_contains({_list(words)}, x)))"


_SIGNALS = f"""tok AS (SELECT review_id, business_id, stars, lower(text) AS low, regexp_extract_all(lower(text), '[a-z]+') AS w FROM reviews),
 sig AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0 ELSE {_n_in(NEGATIVE)}::DOUBLE / len(w) END AS neg,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE {_n_in(HARSH)}::DOUBLE / len(w) END AS harsh, ({_n_in(HARSH)} > 0)::INT AS harsh_any,
  {_like('low', COMPLAINTS)}::INT AS complaint,
  ({_n_in(POSITIVE)} - {_n_in(NEGATIVE)}) / ({_n_in(POSITIVE)} + {_n_in(NEGATIVE)} + 1.0) AS sentiment FROM tok)"""
_LEX = dict(positive=POSITIVE, negative=NEGATIVE, harsh=HARSH, complaints=COMPLAINTS)


@check("tx1_tokenize", with_views("reviews", """SELECT review_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct,
 coalesce(w[1], '') AS first FROM (SELECT review_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM reviews)"""))
def tokenize(spark, sf):
    t = latin_tokens(F.col("text"))
    return v.reviews(spark, sf).select(
        "review_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"),
        F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first"),
    )


_THEME_TERMS = f"""kept AS (SELECT KEYS, list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z'']+'), lambda x: lower(x)),
  lambda x: NOT list_contains({_list(THEME_STOPWORDS)}, x) AND length(x) >= 3) AS w FROM SOURCE),
 phrases AS (SELECT KEYS, unnest(w) AS phrase FROM kept UNION ALL
  SELECT KEYS, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM kept)"""


def _themes(keys: str, source: str) -> str:
    return _THEME_TERMS.replace("KEYS", keys).replace("SOURCE", source)


@check("tx2_extract_themes", with_views("reviews", """SELECT business_id, phrase, n, rank FROM (SELECT *, row_number() OVER (
 PARTITION BY business_id ORDER BY n DESC, phrase) AS rank FROM (SELECT business_id, phrase, count(*) AS n FROM phrases GROUP BY 1, 2))
 WHERE rank <= 6""", _themes("business_id", "reviews")))
def themes(spark, sf):
    return text_signals.extract_themes(v.reviews(spark, sf), ["business_id"])


@check("tx3_lexicon_density", with_views("reviews", """SELECT review_id, round(neg, 6) AS neg, round(harsh, 6) AS harsh FROM sig""", _SIGNALS))
def density(spark, sf):
    t = latin_tokens(F.col("text"))
    rows = v.reviews(spark, sf).select("review_id", lexicon_share(t, NEGATIVE).alias("neg"), lexicon_share(t, HARSH).alias("harsh"))
    return rounded(rows)


@check("tx4_harsh_and_complaints", with_views("reviews", "SELECT review_id, harsh_any, complaint FROM sig", _SIGNALS))
def complaints(spark, sf):
    return text_signals.score_reviews(v.reviews(spark, sf), **_LEX).select("review_id", "harsh_any", "complaint")


@check("tx5_sentiment", with_views("reviews", "SELECT review_id, round(sentiment, 6) AS sentiment FROM sig", _SIGNALS))
def sentiment(spark, sf):
    score = text_signals.sentiment(F.col("text"), POSITIVE, NEGATIVE)
    return rounded(v.reviews(spark, sf).select("review_id", score.alias("sentiment")))


@check("tx6_review_signals", with_views("places reviews", """SELECT p.business_id, round(avg(neg), 6) AS rev_neg_word_density,
 round(avg(complaint), 6) AS rev_complaint_hit_rate, round(avg((s.stars <= 2)::INT), 6) AS rev_low_review_star_share,
 round(avg((s.stars >= 4)::INT), 6) AS rev_high_review_star_share, round(avg(sentiment), 6) AS rev_mean_sentiment,
 round(avg(harsh), 6) AS rev_harsh_word_density, round(avg(harsh_any), 6) AS rev_harsh_review_share,
 round(avg((s.stars <= 1)::INT), 6) AS rev_one_star_share, round(max(neg), 6) AS rev_max_neg_density,
 CASE WHEN count(neg) > 0 THEN round(coalesce(stddev_samp(neg), 0), 6) END AS rev_neg_density_std
 FROM places p LEFT JOIN sig s USING (business_id) GROUP BY 1""", _SIGNALS))
def signals(spark, sf):
    return rounded(text_signals.review_signals(v.reviews(spark, sf), v.places(spark, sf), **_LEX))


@check("tx7_aspect_hits", with_views("reviews", " UNION ALL ".join(
 f"SELECT review_id, '{a}' AS aspect FROM reviews WHERE {_like('lower(text)', w)}" for a, w in ASPECTS.items())))
def aspects(spark, sf):
    return text_signals.aspect_hits(v.reviews(spark, sf), ASPECTS)


def _targets_sql() -> str:
    cols = []
    for a, words in ASPECTS.items():
        hit = _like("low", words)
        blend = f"""least(greatest(0.7::DOUBLE * avg(s.stars) FILTER ({hit}) + 0.3::DOUBLE * least(greatest(
 1 + 2 * (avg(sentiment) FILTER ({hit}) + 1), 1), 5), 1), 5)"""
        cols.append(f"count(*) FILTER ({hit}) AS {a}_keyword_hits")
        cols.append(f"round(CASE WHEN count(*) FILTER ({hit}) >= 1 THEN {blend} ELSE any_value(p.stars) END, 6) AS target_{a}")
    return f"SELECT p.business_id, {', '.join(cols)} FROM places p LEFT JOIN sig s USING (business_id) GROUP BY 1"


@check("tx8_weak_aspect_targets", with_views("places reviews", _targets_sql(), _SIGNALS))
def targets(spark, sf):
    rows = text_signals.weak_aspect_targets(v.reviews(spark, sf), v.places(spark, sf), 1, ASPECTS, POSITIVE, NEGATIVE)
    return rounded(rows)


@check("tx9_target_correlations", with_views("places reviews", "SELECT " + ", ".join(
 f"round(corr(t.target_{a}, p.stars), 6) AS corr_{a}_vs_overall" for a in ASPECTS)
 + f" FROM places p JOIN ({_targets_sql()}) t USING (business_id)", _SIGNALS))
def correlations(spark, sf):
    places = v.places(spark, sf)
    rows = text_signals.weak_aspect_targets(v.reviews(spark, sf), places, 1, ASPECTS, POSITIVE, NEGATIVE)
    return rounded(text_signals.target_correlations(places, rows))


@check("tx10_neg_concentration", with_views("places reviews", """SELECT p.business_id, round(coalesce(avg(neg), 0)
 / (ln(1 + greatest(any_value(p.review_count), 0)) + 1), 6) AS feat_neg_concentration FROM places p LEFT JOIN sig s USING (business_id)
 GROUP BY 1""", _SIGNALS))
def concentration(spark, sf):
    places = v.places(spark, sf)
    rows = text_signals.review_signals(v.reviews(spark, sf), places, **_LEX).join(places.select("business_id", "review_count"), "business_id")
    density = F.coalesce("rev_neg_word_density", F.lit(0.0))
    return rounded(rows.select("business_id", text_signals.neg_concentration(density, F.col("review_count")).alias("feat_neg_concentration")))


@check("tx11_star_weights", with_views("predictions", f"""SELECT doc_id, ([{', '.join(map(str, HALF_STAR_WEIGHTS))}]::DOUBLE[])[
 (least(greatest(round_even((predicted - 1) * 2, 0), 0), 8))::INT + 1] AS weight FROM predictions"""))
def star_weights(spark, sf):
    return v.predictions(spark, sf).select("doc_id", text_signals.star_weights(F.col("predicted")).alias("weight"))


@check("tx12_extreme_weights", with_views("places", """SELECT business_id, round(least(greatest(1 + 1.6::DOUBLE * abs(stars - m) / (s + 0.35::DOUBLE),
 0.6), 4.0), 6) AS weight FROM places, (SELECT median(stars) AS m FROM places), (SELECT median(abs(stars - (SELECT median(stars) FROM places))) AS s FROM places)"""))
def extreme_weights(spark, sf):
    return rounded(text_signals.extreme_weights(v.places(spark, sf)).select("business_id", "weight"))


# --- query log ---------------------------------------------------------------------------------------------

_NORM = "n AS (SELECT *, trim(text) AS raw, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS q FROM query_log)"
_CUISINE = "CASE " + " ".join(f"WHEN contains(q, '{c}') THEN '{c}'" for c in CUISINE_NEEDLES) + " END"
_BUDGET = "CASE " + " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{b}'" for b, p in BUDGET_PATTERNS) + " END"
_WITHIN = "'within\\s+(\\d+(?:\\.\\d+)?)\\s*(km|kilometers?|miles?|mi)\\b'"
_RADIUS = f"""CASE WHEN regexp_matches(q, {_WITHIN}) THEN regexp_extract(q, {_WITHIN}, 1)::DOUBLE
 * CASE WHEN starts_with(regexp_extract(q, {_WITHIN}, 2), 'mi') THEN 1.60934::DOUBLE ELSE 1.0::DOUBLE END
 WHEN contains(q, 'near') OR contains(q, 'around') OR contains(q, 'close to') THEN 2.0::DOUBLE END"""
_LOC0 = """coalesce(nullif(trim(regexp_extract(q, '\\b(?:near|around|close to)\\s+([a-z0-9][a-z0-9\\s\\-'']+)(?:\\s|$|,|\\.)', 1)), ''),
 nullif(trim(regexp_extract(q, '\\bin\\s+([a-z][a-z\\s\\-]+)(?:\\s|$|,|\\.)', 1)), ''))"""
_LOC = f"""coalesce(nullif(trim(regexp_replace({_LOC0}, '(?:(?:^|\\s+)(?:{'|'.join(BUDGET_TAIL_WORDS)}))+$', '')), ''), {_LOC0})"""
_CODES = _list(STATE_CODES.values())
_NAMES = sorted(STATE_CODES, key=len, reverse=True)
_STATE = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(q, '\\b{n}\\b') THEN '{STATE_CODES[n]}'" for n in _NAMES)
    + " "
    + " ".join(
        f"WHEN list_contains({_CODES}, upper(regexp_extract({src}, '{p}', 1))) THEN upper(regexp_extract({src}, '{p}', 1))"
        for src, p in [("q", "\\bin\\s+([a-z]{2})\\b"), ("q", ",\\s*([a-z]{2})\\b"), ("q", "\\b([a-z]{2})\\s+usa\\b"),
                       ("q", "\\b([a-z]{2})\\s+state\\b"), ("raw", "\\bin\\s+([A-Z]{2})\\b"), ("raw", ",\\s*([A-Z]{2})\\b")]
    )
    + f" WHEN list_contains({_CODES}, upper(string_split(loc, ' ')[-1])) THEN upper(string_split(loc, ' ')[-1]) END"
)
_BUDGET_ALL = "|".join(p for _, p in BUDGET_PATTERNS)
_TERMS = f"""list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '{_BUDGET_ALL}', ' ', 'g'),
 '\\bwithin\\s+\\d+(?:\\.\\d+)?\\s*(km|kilometers?|miles?|mi)\\b', ' ', 'g'), '\\b(?:near|around|close to)\\s+[a-z0-9][a-z0-9\\s\\-'']+', ' ', 'g'),
 '\\bin\\s+[a-z][a-z\\s\\-]+', ' ', 'g'), '[a-zA-Z'']+'), lambda t: NOT list_contains({_list(QUERY_STOPWORDS)}, t) AND length(t) > 1)"""
_LABEL = "CASE cuisine " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in CUISINE_LABELS.items()) + " END"
_INTENT = """CASE WHEN regexp_matches(query_text, '\\bfast\\b|\\bquick\\b|\\bcheap\\b|\\bgrab[\\s-]?and[\\s-]?go\\b') THEN 'intent_quick'
 WHEN regexp_matches(query_text, '\\bdate\\b|\\bromantic\\b|\\bcozy\\b|\\banniversary\\b') THEN 'intent_romantic' ELSE 'intent_default' END"""


def _geo(axis: int) -> str:
    out = "CASE "
    for entry in LANDMARKS:
        out += f"WHEN contains(loc, '{entry[0]}') OR contains('{entry[0]}', loc) THEN {entry[axis]}::DOUBLE "
    return out + "END"


# Word order with first occurrences only.
_DEDUP = "list_filter(t, lambda x, i: list_position(t, x) = i)"
ANNOTATED = _NORM + f""", texts AS (SELECT DISTINCT raw, q FROM n), a1 AS (SELECT *, {_CUISINE} AS cuisine, {_BUDGET} AS budget, {_RADIUS} AS radius_km,
  {_LOC} AS loc, {_TERMS} AS t FROM texts),
 a2 AS (SELECT *, CASE WHEN raw = '' THEN NULL ELSE {_STATE} END AS state_code, CASE WHEN raw = '' THEN '' WHEN len(t) = 0
  THEN coalesce(cuisine, 'restaurant') ELSE array_to_string({_DEDUP}, ' ') END AS semantic_query,
  {_LABEL} AS label, {_geo(1)} AS ref_lat, {_geo(2)} AS ref_lon FROM a1),
 a3 AS (SELECT *, CASE WHEN semantic_query = '' THEN 'restaurants' WHEN label IS NOT NULL AND label <> semantic_query
  THEN semantic_query || ' ' || label ELSE semantic_query END AS query_text FROM a2),
 annotated AS (SELECT n.query_id, n.session_id, n.text, n.state, n.browse_city, a.cuisine, a.budget, a.radius_km, a.loc AS location_text,
  a.state_code, a.semantic_query, a.label, a.ref_lat, a.ref_lon, a.query_text, {_INTENT} AS intent FROM n JOIN a3 a ON a.raw = n.raw)"""


def annotated(spark, sf):
    return query_log.annotate(v.query_log(spark, sf))


def _log_check(name: str, cols: str):
    names = [c.strip() for c in cols.split(",")]

    @check(name, with_views("query_log", f"SELECT query_id, {', '.join(_round(c) for c in names)} FROM annotated", ANNOTATED))
    def run(spark, sf):
        return rounded(annotated(spark, sf).select("query_id", *names))

    return run


def _round(c: str) -> str:
    return f"round({c}, 6) AS {c}" if c in ("radius_km", "ref_lat", "ref_lon") else c


@check("ql1_normalize_query", with_views("query_log", "SELECT query_id, q AS norm FROM n", _NORM))
def normalize(spark, sf):
    return annotated(spark, sf).select("query_id", "norm")


_log_check("ql2_cuisine_hint", "cuisine")
_log_check("ql3_budget_hint", "budget")
_log_check("ql4_radius_km", "radius_km")
_log_check("ql5_location_text", "location_text")
_log_check("ql6_geocode_landmarks", "ref_lat, ref_lon")
_log_check("ql7_state_code", "state_code")
_log_check("ql8_semantic_terms", "semantic_query")
_log_check("ql9_classify_intent", "intent")
_log_check("ql11_compose_query_text", "query_text")


@check("ql6_geocode_table", with_views("query_log", """SELECT query_id, round(coalesce(ref_lat, g.lat), 6) AS ref_lat,
 round(coalesce(ref_lon, g.lon), 6) AS ref_lon FROM annotated LEFT JOIN (VALUES ('tampa', 27.8, -82.6), ('tucson', 32.1, -111.1)) g(c, lat, lon)
 ON lower(browse_city) = g.c""", ANNOTATED))
def geocode_table(spark, sf):
    log = annotated(spark, sf).withColumn("user_location", F.col("browse_city"))
    cities = v.places(spark, sf).select("city").distinct().where(F.col("city").isin("Tampa", "Tucson"))
    at = lambda i: F.when(F.col("city") == "Tampa", v.SLOTS[1][i]).otherwise(v.SLOTS[3][i])
    gazetteer = cities.select(F.concat(F.lit(" "), F.col("city")).alias("place_text"), at(2).alias("lat"), at(3).alias("lon"))
    return rounded(query_log.geocode_table(log, gazetteer).select("query_id", "ref_lat", "ref_lon"))


@check("ql10_merge_cuisines", with_views("query_log", """SELECT query_id, CASE WHEN label IS NULL OR label IN ('Thai', 'Sushi')
 THEN 'Thai|Sushi' ELSE 'Thai|Sushi|' || label END AS cuisines FROM annotated""", ANNOTATED))
def cuisines(spark, sf):
    log = v.query_log(spark, sf).withColumn("cuisines", F.array(F.lit("Thai"), F.lit("Sushi"), F.lit("Thai")))
    return query_log.annotate(log).select("query_id", F.array_join("cuisine_filter", "|").alias("cuisines"))


@check("ql12_location_mismatch", with_views("query_log", """SELECT query_id, (coalesce(state_code <> state, false) OR coalesce(
 NOT contains(lower(browse_city), location_text) AND NOT contains(location_text, lower(browse_city)), false))::INT AS mismatch
 FROM annotated""", ANNOTATED))
def mismatch(spark, sf):
    flag = query_log.location_mismatch(F.col("state_code"), F.col("location_text"), F.col("state"), F.col("browse_city"))
    return annotated(spark, sf).select("query_id", flag.alias("mismatch"))


@check("ql13_query_profile", with_views("query_log", """SELECT intent, cuisine, budget, state_code, count(*) AS n FROM annotated
 GROUP BY ALL""", ANNOTATED))
def profile(spark, sf):
    return query_log.query_profile(annotated(spark, sf))


# --- text index --------------------------------------------------------------------------------------------


@check("rt1_select_candidates_global", with_views("places", """SELECT business_id, review_count FROM places ORDER BY review_count DESC,
 business_id LIMIT 50"""))
def candidates_global(spark, sf):
    return retrieval.select_candidates_global(v.places(spark, sf), 50).select("business_id", "review_count")


@check("rt2_select_candidates_by_state", with_views("places", """SELECT business_id, state FROM (SELECT *, row_number() OVER (PARTITION BY state
 ORDER BY review_count DESC, business_id) AS r FROM places) WHERE r <= 50 ORDER BY review_count DESC, business_id LIMIT 150"""))
def candidates_by_state(spark, sf):
    return retrieval.select_candidates_by_state(v.places(spark, sf), 150).select("business_id", "state")


POLAR = """polar AS (SELECT * FROM (SELECT *, CASE WHEN stars >= 4 THEN 'positive' WHEN stars <= 2 THEN 'negative' END AS polarity FROM reviews)
  WHERE polarity IS NOT NULL AND trim(text) <> '')"""
SAMPLED = POLAR + """, sampled AS (SELECT *, row_number() OVER (PARTITION BY business_id, polarity ORDER BY date, review_id) AS pos FROM polar
  QUALIFY pos <= CASE polarity WHEN 'positive' THEN 1 ELSE 2 END)"""


@check("rt3_sample_sentiment_reviews", with_views("reviews", "SELECT review_id, polarity, pos FROM sampled", SAMPLED))
def sampled(spark, sf):
    return retrieval.sample_sentiment_reviews(v.reviews(spark, sf), 3).select("review_id", "polarity", "pos")


PROFILES = POLAR + ", " + _themes("business_id, polarity", "polar") + """,
 top AS (SELECT business_id, polarity, string_agg(phrase, ', ' ORDER BY n DESC, phrase) AS phrases FROM (SELECT *, row_number() OVER (
  PARTITION BY business_id, polarity ORDER BY n DESC, phrase) AS r FROM (SELECT business_id, polarity, phrase, count(*) AS n FROM phrases
  GROUP BY ALL)) WHERE r <= 6 GROUP BY 1, 2),
 profiles AS (SELECT p.business_id, 'Restaurant: ' || name || '. Category: ' || categories || '. City: ' || city || ', ' || state
  || '. Price: ' || CASE WHEN attributes IS NULL THEN 'N/A' ELSE repeat('$', regexp_extract(attributes, 'PriceRange2'': ''([0-9])', 1)::INT) END
  || '. Positive themes: ' || coalesce(a.phrases, '') || '. Negative themes: ' || coalesce(b.phrases, '') || '.' AS profile
  FROM places p LEFT JOIN top a ON a.business_id = p.business_id AND a.polarity = 'positive'
  LEFT JOIN top b ON b.business_id = p.business_id AND b.polarity = 'negative')"""


def profiles(spark, sf):
    texts = retrieval.sentiment_reviews(v.reviews(spark, sf))
    return retrieval.build_profiles(v.places(spark, sf), texts)


@check("rt4_build_profiles", with_views("places reviews", "SELECT business_id, profile FROM profiles", PROFILES))
def build_profiles(spark, sf):
    return profiles(spark, sf)


@check("rt5_synthetic_snippets", with_views("map_export", """SELECT business_id, 'positive' AS polarity, concat_ws(' ', nullif(name, ''),
 nullif(address, ''), 'Restaurants, Food', CASE WHEN detail NOT IN ('', '{}', 'nan') THEN detail END) AS text FROM mapped""",
 MAPPED))
def snippets(spark, sf):
    from placelens.sources import readers

    return retrieval.synthetic_snippets(readers.map_export_places(v.map_export(spark, sf)))


@check("rt6_fit_tfidf", "WITH " + tfidf_sql("documents", "doc_id", "text") + " SELECT doc_id, term, round(w, 6) AS w FROM postings")
def tfidf(spark, sf):
    index = retrieval.fit_tfidf(v.table(spark, sf, "documents"))
    return rounded(index.postings)


@check("rt6_vocabulary", "WITH " + tfidf_sql("documents", "doc_id", "text") + " SELECT term, round(idf, 6) AS idf FROM vocab")
def vocabulary(spark, sf):
    return rounded(retrieval.fit_tfidf(v.table(spark, sf, "documents")).vocabulary)


@check("rt7_doc_norms", "WITH " + tfidf_sql("documents", "doc_id", "text")
 + " SELECT doc_id, round(sqrt(sum(w * w)), 6) AS norm FROM postings GROUP BY 1")
def doc_norms(spark, sf):
    return rounded(retrieval.doc_norms(retrieval.fit_tfidf(v.table(spark, sf, "documents")).postings))


COSINE = f"""qwords AS (SELECT query_text, list_filter(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
  lambda x: NOT list_contains({_list(INDEX_STOPWORDS)}, x)) AS w FROM (SELECT DISTINCT query_text FROM annotated)),
 qterms AS (SELECT query_text, unnest(w) AS term FROM qwords UNION ALL
  SELECT query_text, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM qwords),
 qraw AS (SELECT query_text, term, count(*) * any_value(idf) AS r FROM qterms JOIN vocab USING (term) GROUP BY 1, 2),
 qw AS (SELECT query_text, term, r / sqrt(sum(r * r) OVER (PARTITION BY query_text)) AS w FROM qraw),
 sims AS MATERIALIZED (SELECT query_text, doc_id, sum(qw.w * p.w) / (1 + 1e-9) AS similarity FROM qw JOIN postings p USING (term) GROUP BY 1, 2)"""
INDEXED = PROFILES + ", " + tfidf_sql("profiles", "business_id", "profile")


_SHELVES: dict[str, str] = {}


def place_index(spark, sf) -> retrieval.TextIndex:
    """Index over the place profiles, built once per state of the tables and then loaded.

    Its configuration names the files it was built from with their sizes and times, so a changed table gets a new
    version of the index.
    """
    files = [spark.read.format("binaryFile").load(f"{sf}/{t}.parquet").select("path", "length", "modificationTime") for t in ("part", "lineitem", "documents")]
    seen = reduce(DataFrame.unionByName, files)
    mark = seen.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("digest")).first()
    config = {"kind": "place profiles", **mark.asDict()}
    session = spark.sparkContext.applicationId
    shelf = _SHELVES.setdefault(session, shared_folder(spark, "place-index"))
    if not writers.index_is_current(spark, shelf, config):
        # The profiles are sized, indexed and listed; without the cut each would read all review text again.
        docs = cut(profiles(spark, sf).select(F.col("business_id").alias("doc_id"), F.col("profile").alias("text")))
        writers.save_index(retrieval.fit_tfidf(docs, cut=True), docs.select("doc_id"), shelf, config)
    return writers.load_index(spark, shelf, config)[0]


@check("rt8_cosine_scores", with_views("places reviews query_log", "SELECT query_text, doc_id, round(similarity, 6) AS similarity FROM sims",
 INDEXED + ", " + ANNOTATED + ", " + COSINE))
def cosine(spark, sf):
    return rounded(retrieval.cosine_scores(annotated(spark, sf), place_index(spark, sf)))
