"""Checked queries: candidate filters, ranking, search, re-ranking and the feedback policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.functions.columns import budget_tier, distance_score, haversine_km, price_match, price_tier, trust_shrunk_stars
from placelens.functions.lexicons import ARM_WEIGHTS, ARMS, CUISINE_KEYWORDS, MANUAL_WEIGHTS, WEIGHT_NAMES
from placelens.operators import policy, rerank, retrieval
from placelens.plans import search as plan
from placelens.plans import views as v
from placelens.plans.checks_spatial import _hav
from placelens.plans.checks_text import ANNOTATED, COSINE, INDEXED, annotated, place_index
from placelens.plans.registry import check, rounded
from placelens.plans.views import with_views
from placelens.session import cut, shared_folder
from placelens.streaming.policy_stream import QStateStream

# --- policy state in SQL -----------------------------------------------------------------------------------

REWARDS = """rewards AS MATERIALIZED (SELECT *, CASE action WHEN 'detail_open' THEN 1.0 WHEN 'like' THEN 1.0 WHEN 'pass' THEN -0.5
  WHEN 'refresh' THEN -0.1 END::DOUBLE AS reward FROM actions WHERE action IN ('detail_open', 'like', 'pass', 'refresh'))"""
_FOLD = "list_reduce(list_prepend(0.0::DOUBLE, {0}), lambda q, r: q + 0.15::DOUBLE * (r - q))"
_ARM_NO = "CASE {0} WHEN 'explorer' THEN 1 WHEN 'reputation' THEN 2 ELSE 3 END"
STATE = REWARDS + f""", q AS (SELECT intent, arm, {_FOLD.format("list(reward ORDER BY ts, event_id)")} AS q_value, count(*) AS pull_count
  FROM rewards GROUP BY 1, 2),
 grid AS (SELECT intent, arm FROM (VALUES ('intent_quick'), ('intent_romantic'), ('intent_default')) a(intent),
  (VALUES ('explorer'), ('reputation'), ('convenience')) b(arm)),
 qstate AS (SELECT g.intent, g.arm, coalesce(q_value, 0.0) AS q_value, coalesce(pull_count, 0) AS pull_count,
  (sum(coalesce(pull_count, 0)) OVER (PARTITION BY g.intent))::BIGINT AS total_interactions FROM grid g LEFT JOIN q USING (intent, arm)),
 chosen AS (SELECT intent, arm FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY (pull_count > 0)::INT,
  CASE WHEN pull_count > 0 THEN q_value + 0.5::DOUBLE * sqrt(ln(greatest(1, total_interactions)) / pull_count) ELSE 0 END DESC,
  {_ARM_NO.format("arm")}) AS r FROM qstate) WHERE r = 1)"""


def events(spark, sf):
    return policy.reward_events(v.actions(spark, sf))


def state(spark, sf):
    return policy.q_state(events(spark, sf))


# --- ranking -----------------------------------------------------------------------------------------------

_KEYWORDS = " UNION ALL ".join(f"SELECT '{k}' AS label, unnest({w!r}) AS kw" for k, w in CUISINE_KEYWORDS.items())


def _requests_sql(weights: str = "policy") -> str:
    cols = []
    for i, name in enumerate(WEIGHT_NAMES):
        if weights == "policy":
            presets = " ".join(f"WHEN '{a}' THEN {w[i]}::DOUBLE" for a, w in ARM_WEIGHTS.items())
            cols.append(f"CASE c.arm {presets} ELSE {MANUAL_WEIGHTS[i]}::DOUBLE END AS {name}")
        else:
            cols.append(f"{MANUAL_WEIGHTS[i]}::DOUBLE AS {name}")
    return f"""requests AS MATERIALIZED (SELECT a.*, c.arm, {', '.join(cols)} FROM annotated a LEFT JOIN chosen c USING (intent)),
 sigs AS MATERIALIZED (SELECT row_number() OVER () AS sig, * FROM (SELECT DISTINCT query_text, state, label, budget, ref_lat, ref_lon, radius_km,
  {', '.join(WEIGHT_NAMES)} FROM requests)),
 kw AS ({_KEYWORDS}),
 pairs AS MATERIALIZED (SELECT s.*, p.business_id, p.name, p.city, p.stars, p.review_count, p.categories,
  try_cast(regexp_extract(p.attributes, 'RestaurantsPriceRange2'': ''([0-9])', 1) AS DOUBLE) AS price_tier,
  EXISTS (SELECT 1 FROM kw WHERE kw.label = s.label AND contains(lower(p.categories), kw.kw)) AS hit,
  CASE WHEN s.ref_lat IS NOT NULL THEN {_hav('p', 's2')} END AS distance_km, coalesce(m.similarity, 0) AS similarity, ln(1 + greatest(p.review_count, 0)) AS pop
  FROM sigs s JOIN places p ON p.state = s.state JOIN (SELECT sig, ref_lat AS latitude, ref_lon AS longitude FROM sigs) s2 ON s2.sig = s.sig
  LEFT JOIN sims m ON m.query_text = s.query_text AND m.doc_id = p.business_id),
 flagged AS (SELECT *, bool_or(hit) OVER (PARTITION BY sig) AS any_hit FROM pairs),
 survivors AS (SELECT * FROM flagged WHERE (label IS NULL OR NOT any_hit OR hit)
  AND (ref_lat IS NULL OR radius_km IS NULL OR distance_km <= radius_km)),
 scored AS MATERIALIZED (SELECT *,
  CASE WHEN budget IS NULL OR price_tier IS NULL THEN 0.5 ELSE 1 - least(abs(price_tier
   - CASE budget WHEN 'cheap' THEN 1 WHEN 'moderate' THEN 2 ELSE 4 END), 3) / 3 END AS price_match,
  least(greatest((stars - 1) / 4, 0), 1) * least(ln(1 + review_count) / ln(151), 1)
   + 0.5::DOUBLE * (1 - least(ln(1 + review_count) / ln(151), 1)) AS trust,
  CASE WHEN ref_lat IS NULL THEN 0.5 ELSE least(greatest(1 - distance_km / (coalesce(radius_km, 50) + 1e-9), 0), 1) END AS near,
  (similarity - min(similarity) OVER w) / (max(similarity) OVER w - min(similarity) OVER w + 1e-9) AS sim_n,
  (pop - min(pop) OVER w) / (max(pop) OVER w - min(pop) OVER w + 1e-9) AS pop_n FROM survivors WINDOW w AS (PARTITION BY sig)),
 finals AS MATERIALIZED (SELECT *, w_semantic * sim_n + w_rating * trust + w_price * price_match + w_distance * near + w_popularity * pop_n AS final_score
  FROM scored),
 ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY round(final_score, 9) DESC, business_id) AS rank FROM finals)"""


RANKED = INDEXED + ", " + ANNOTATED + ", " + COSINE + ", " + STATE + ", " + _requests_sql()
_ALL = "places reviews query_log actions"


def requests(spark, sf):
    return plan.plan_requests(v.query_log(spark, sf), state(spark, sf))


def meta(spark, sf):
    return retrieval.place_meta(v.places(spark, sf))


def asked(spark, sf):
    return requests(spark, sf).select("sig", *retrieval.SIGNATURE).distinct()


@check("rt9_filter_candidates", with_views(_ALL, "SELECT query_text, state, business_id, round(distance_km, 6) AS distance_km FROM survivors", RANKED))
def filtered(spark, sf):
    rows = retrieval.filter_candidates(asked(spark, sf), meta(spark, sf))
    return rounded(rows.select("query_text", "state", "business_id", "distance_km"))


@check("rt10_score_candidates", with_views(_ALL, """SELECT query_text, state, business_id, round(similarity, 6) AS similarity,
 round(price_match, 6) AS price_match, round(final_score, 6) AS final_score FROM finals""", RANKED))
def scored(spark, sf):
    a = asked(spark, sf)
    rows = retrieval.score_candidates(a, meta(spark, sf), retrieval.cosine_scores(a, place_index(spark, sf)))
    named = rows.join(a.select("sig", "query_text"), "sig")
    return rounded(named.select("query_text", "state", "business_id", "similarity", "price_match", "final_score"))


@check("rt10a_trust_shrink", with_views("places", """SELECT business_id, round(least(greatest((stars - 1) / 4, 0), 1) * t + 0.5::DOUBLE * (1 - t), 6)
 AS trust FROM (SELECT *, least(ln(1 + review_count) / ln(151), 1) AS t FROM places)"""))
def trust(spark, sf):
    return rounded(v.places(spark, sf).select("business_id", trust_shrunk_stars(F.col("stars"), F.col("review_count")).alias("trust")))


@check("rt10b_price_match", with_views("places", """SELECT business_id, b AS budget, round(CASE WHEN attributes IS NULL THEN 0.5 ELSE
 1 - least(abs(regexp_extract(attributes, 'RestaurantsPriceRange2'': ''([0-9])', 1)::DOUBLE - t), 3) / 3 END, 6) AS score FROM places,
 (VALUES ('cheap', 1), ('moderate', 2), ('expensive', 4)) x(b, t)"""))
def price(spark, sf):
    rows = v.places(spark, sf).select("business_id", "attributes", F.explode(F.lit(["cheap", "moderate", "expensive"])).alias("budget"))
    return rounded(rows.where(budget_tier(F.col("budget")) > 0).select(
        "business_id", "budget", price_match(price_tier(F.col("attributes")), F.col("budget")).alias("score")
    ))


@check("rt10c_distance_score", with_views("places", f"""SELECT business_id, round(least(greatest(1 - {_hav('p', 'q')} / (2.0 + 1e-9), 0), 1), 6) AS near,
 round(least(greatest(1 - {_hav('p', 'q')} / (50.0 + 1e-9), 0), 1), 6) AS far
 FROM places p, (SELECT 39.9526::DOUBLE AS latitude, -75.1652::DOUBLE AS longitude) q"""))
def distance(spark, sf):
    km = haversine_km(F.lit(39.9526), F.lit(-75.1652), F.col("latitude"), F.col("longitude"))
    none = F.lit(None).cast("double")
    return rounded(v.places(spark, sf).select(
        "business_id", distance_score(km, F.lit(2.0)).alias("near"), distance_score(km, none).alias("far")
    ))


@check("rt11_top_k_per_query", with_views(_ALL, "SELECT query_text, state, business_id, rank, round(final_score, 6) AS final_score FROM ranked WHERE rank <= 45", RANKED))
def top_k(spark, sf):
    r = requests(spark, sf)
    pools = plan.rank_pools(r, place_index(spark, sf), meta(spark, sf))
    return rounded(pools.join(r.select("sig", "query_text").distinct(), "sig").select("query_text", "state", "business_id", "rank", "final_score"))


_MVP = """bags AS (SELECT business_id, stars, term, count(*) AS tf FROM (SELECT business_id, stars, unnest(list_filter(regexp_extract_all(
  lower(categories), '[\\p{L}\\p{N}_]{2,}'), lambda x: x NOT IN ('food', 'restaurants'))) AS term FROM places WHERE is_open = 1 AND stars >= 3
  AND regexp_extract(attributes, 'RestaurantsPriceRange2'': ''([0-9])', 1) IN ('1', '2', '3')) GROUP BY ALL),
 asks AS (SELECT DISTINCT p_name AS text, unnest(string_split(p_name, ' ')) AS term FROM part),
 known AS (SELECT * FROM asks WHERE term IN (SELECT unnest(regexp_extract_all(lower(categories), '[\\p{L}\\p{N}_]{2,}')) FROM places WHERE is_open = 1)),
 cands AS (SELECT a.text, b.business_id, any_value(b.stars) AS stars, (SELECT sqrt(sum(tf * tf)) FROM bags n WHERE n.business_id = b.business_id) AS dn,
  (SELECT sqrt(count(*)) FROM known k WHERE k.text = a.text) AS qn,
  sum(CASE WHEN a.term = b.term THEN b.tf ELSE 0 END) AS dot FROM asks a, bags b GROUP BY 1, 2),
 mvp AS (SELECT text, business_id, CASE WHEN dot = 0 THEN 0.0 ELSE dot / (dn * qn) END AS match_score, stars,
  row_number() OVER (PARTITION BY text ORDER BY round(CASE WHEN dot = 0 THEN 0.0 ELSE dot / (dn * qn) END, 9) DESC, stars DESC, business_id) AS rank FROM cands)"""


@check("rt12_keyword_match_mvp", with_views("places", """SELECT p_partkey AS query_id, business_id, rank, round(match_score, 6) AS match_score, stars
 FROM part JOIN mvp ON mvp.text = p_name WHERE rank <= 5""", _MVP))
def keyword_match(spark, sf):
    asks = v.table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    rows = retrieval.keyword_match_mvp(asks, v.places(spark, sf), min_stars=3, max_price=3, top_k=5)
    return rounded(rows.select("query_id", "business_id", "rank", "match_score", "stars"))


@check("rt13_search", with_views(_ALL, f"""SELECT r.query_id, k.business_id, k.rank, round(k.final_score, 6) AS final_score, round(k.similarity, 6) AS similarity,
 r.intent, r.arm FROM requests r JOIN ranked k ON {' AND '.join(f'r.{c} IS NOT DISTINCT FROM k.{c}' for c in
 ('query_text', 'state', 'label', 'budget', 'ref_lat', 'ref_lon', 'radius_km', *WEIGHT_NAMES))} WHERE k.rank <= 10""", RANKED))
def search(spark, sf):
    rows = plan.search(v.query_log(spark, sf), place_index(spark, sf), meta(spark, sf), state(spark, sf))
    return rounded(rows.select("query_id", "business_id", "rank", "final_score", "similarity", "intent", "arm"))


@check("rt13_search_meta", with_views(_ALL, f"""SELECT r.query_id, count(*) FILTER (k.rank <= 45) AS pool_rows,
 count(*) FILTER (k.rank <= 10 AND k.similarity > 0) AS semantic_match_count, 0 AS reranked FROM requests r JOIN ranked k
 ON {' AND '.join(f'r.{c} IS NOT DISTINCT FROM k.{c}' for c in
 ('query_text', 'state', 'label', 'budget', 'ref_lat', 'ref_lon', 'radius_km', *WEIGHT_NAMES))} GROUP BY 1""", RANKED))
def search_meta(spark, sf):
    index, m, log, s = place_index(spark, sf), meta(spark, sf), v.query_log(spark, sf), state(spark, sf)
    pools = cut(plan.rank_pools(plan.plan_requests(log, s), index, m))
    return plan.search_meta(plan.search(log, index, m, s, pools=pools), pools)


def form_requests(spark, sf):
    """The log as it comes from the request form: filters, extra words, own sizes and weights, some of it unusable."""
    k = F.col("query_id")
    weights = {n: F.when(k % 5 == 0, F.lit(0.3 * (i + 1))) for i, n in enumerate(WEIGHT_NAMES)}
    return v.query_log(spark, sf).withColumns({
        "state": F.when(k % 50 == 7, " ").when(k % 50 == 8, "all").otherwise(F.col("state")),
        "city": F.when(k % 3 == 0, F.upper("browse_city")),
        "extra": F.when(k % 4 == 1, "cheap patio"),
        "cuisines": F.when(k % 6 == 2, F.array(F.lit("Sushi"), F.lit("Mexican"))),
        "discover": k % 10 == 3,
        "user_location": F.when(k % 2 == 0, F.concat(F.lit(" "), F.upper("browse_city"))),
        "top_k": F.when(k % 7 == 0, (k % 20 + 1).cast("int")).when(k % 50 == 9, 0),
        "pool_k": F.when(k % 11 == 0, 20),
        "rl_user_overrode": k % 5 == 0,
        **weights,
    })


def city_points(spark, sf):
    """Gazetteer of the cities: the mean position of their places."""
    return v.places(spark, sf).groupBy(F.col("city").alias("place_text")).agg(
        F.round(F.avg("latitude"), 4).alias("lat"), F.round(F.avg("longitude"), 4).alias("lon")
    )


@check("rt13_search_form")
def search_form(spark, sf):
    rows = plan.search(
        form_requests(spark, sf), place_index(spark, sf), meta(spark, sf), state(spark, sf), gazetteer=city_points(spark, sf)
    )
    return rounded(rows.select("query_id", "business_id", "rank", "final_score", "similarity", "distance_km", "intent", "arm"))


@check("rt13_rejected_requests", with_views("query_log", """SELECT query_id, CASE WHEN query_id % 50 IN (7, 8) THEN 'no state'
 ELSE 'top_k outside 1 to 100' END AS reject_reason FROM query_log WHERE query_id % 50 IN (7, 8) OR (query_id % 50 = 9 AND query_id % 7 <> 0)"""))
def rejected(spark, sf):
    return plan.rejected_requests(form_requests(spark, sf))


@check("sr11_align_meta", with_views("places", """SELECT business_id, upper(state) AS state_norm, lower(city) AS city_norm,
 lower(categories) AS categories_norm FROM places WHERE is_open = 1"""))
def align(spark, sf):
    p = v.places(spark, sf)
    rows = retrieval.align_meta(p.where("is_open = 1"), p)
    return rows.select("business_id", "state_norm", "city_norm", "categories_norm")


# --- re-ranking --------------------------------------------------------------------------------------------

_PREFS = """acts AS (SELECT session_id, business_id, ts, event_id, CASE action WHEN 'like' THEN 'like' WHEN 'pass' THEN 'dislike' END AS kind FROM actions
  WHERE action IN ('like', 'pass')),
 runs AS (SELECT *, row_number() OVER (PARTITION BY session_id, business_id ORDER BY ts DESC, event_id DESC) AS back,
  first_value(kind) OVER (PARTITION BY session_id, business_id ORDER BY ts DESC, event_id DESC) AS last_kind FROM acts),
 tails AS (SELECT *, min(CASE WHEN kind <> last_kind THEN back END) OVER (PARTITION BY session_id, business_id) AS stop FROM runs),
 prefs AS (SELECT session_id, business_id, any_value(last_kind) AS preference, count(*) AS run, min(event_id) AS first_event FROM tails
  WHERE stop IS NULL OR back < stop GROUP BY 1, 2)"""


@check("rr1_preference_state", with_views("actions", "SELECT session_id, business_id, preference, first_event FROM prefs", _PREFS))
def preferences(spark, sf):
    rows = rerank.preference_state(v.actions(spark, sf))
    return rows.select("session_id", "business_id", "preference", F.col("since.event_id").alias("first_event"))


@check("rr1_preference_state_toggle", with_views("actions", "SELECT session_id, business_id, preference FROM prefs WHERE run % 2 = 1", _PREFS))
def toggles(spark, sf):
    return rerank.preference_state_toggle(v.actions(spark, sf))


@check("rr2_parse_preferences", with_views("actions", """SELECT event_id, CASE WHEN trim(business_id) = '' THEN 0 ELSE 1 END AS n_liked,
 0 AS n_disliked, CASE WHEN event_id % 2 = 0 THEN 3.5 END::DOUBLE AS min_rating FROM actions"""))
def parse_preferences(spark, sf):
    a = v.actions(spark, sf)
    raw = F.concat(
        F.lit('{"liked_business_ids": ["'), F.col("business_id"), F.lit('", " "], "disliked_business_ids": null, "min_rating": '),
        F.when(F.col("event_id") % 2 == 0, "3.5").otherwise("null"), F.lit("}"),
    )
    rows = rerank.parse_preferences(a.select("event_id", raw.alias("raw")))
    return rows.select("event_id", F.size("liked_business_ids").alias("n_liked"), F.size("disliked_business_ids").alias("n_disliked"), "min_rating")


_POOLS = RANKED + ", " + _PREFS + """, combos AS MATERIALIZED (SELECT DISTINCT r.session_id, k.sig FROM requests r JOIN sigs k
  ON r.query_text = k.query_text AND r.state = k.state AND r.budget IS NOT DISTINCT FROM k.budget),
 pool AS MATERIALIZED (SELECT c.session_id, k.* FROM combos c JOIN ranked k USING (sig) WHERE k.rank <= 45),
 docsim AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, sum(a.w * b.w) / (1 + 1e-9) AS s FROM postings a JOIN postings b USING (term)
  WHERE a.doc_id IN (SELECT business_id FROM pool) AND b.doc_id IN (SELECT business_id FROM prefs) GROUP BY 1, 2),
 counted AS (SELECT session_id, preference, count(*) AS n FROM prefs GROUP BY 1, 2),
 sums AS (SELECT p.sig, p.session_id, p.business_id, f.preference, sum(coalesce(d.s, 0)) AS s FROM pool p JOIN prefs f USING (session_id)
  LEFT JOIN docsim d ON d.x = p.business_id AND d.y = f.business_id GROUP BY ALL),
 avgs AS (SELECT p.sig, p.session_id, p.business_id, p.final_score, l.n AS nl, d.n AS nd, sl.s / l.n AS al, sd.s / d.n AS ad
  FROM pool p LEFT JOIN counted l ON l.session_id = p.session_id AND l.preference = 'like'
  LEFT JOIN counted d ON d.session_id = p.session_id AND d.preference = 'dislike'
  LEFT JOIN sums sl ON sl.sig = p.sig AND sl.session_id = p.session_id AND sl.business_id = p.business_id AND sl.preference = 'like'
  LEFT JOIN sums sd ON sd.sig = p.sig AND sd.session_id = p.session_id AND sd.business_id = p.business_id AND sd.preference = 'dislike'),
 reranked AS (SELECT *, CASE WHEN nl IS NULL THEN 0 WHEN max(al) OVER w - min(al) OVER w < 1e-12 THEN 0.5 ELSE
   (al - min(al) OVER w) / (max(al) OVER w - min(al) OVER w) END AS liked,
  CASE WHEN nd IS NULL THEN 0 WHEN max(ad) OVER w - min(ad) OVER w < 1e-12 THEN 0.5 ELSE
   (ad - min(ad) OVER w) / (max(ad) OVER w - min(ad) OVER w) END AS disliked,
  CASE WHEN max(final_score) OVER w - min(final_score) OVER w < 1e-12 THEN 0.5 ELSE
   (final_score - min(final_score) OVER w) / (max(final_score) OVER w - min(final_score) OVER w) END AS base
  FROM avgs WINDOW w AS (PARTITION BY sig, session_id))"""


def _pool(spark, sf, index):
    r = requests(spark, sf)
    pools = cut(plan.rank_pools(r, index, meta(spark, sf)))
    key = F.concat_ws("|", "sig", F.col("session_id").cast("string"))
    combos = r.select("sig", "session_id").distinct().withColumn("query_id", key)
    wishes = rerank.preference_state(v.actions(spark, sf)).select("session_id", "business_id", "preference")
    names = r.select("sig", "query_text").distinct()
    return combos.join(pools.drop("rank"), "sig").join(names, "sig"), wishes


@check("rr3_avg_similarity_to", with_views(_ALL, """SELECT s.query_text, s.state, a.session_id, a.business_id, round(coalesce(al, 0), 6) AS avg_similarity
 FROM avgs a JOIN sigs s USING (sig)""", _POOLS))
def avg_similarity(spark, sf):
    index = place_index(spark, sf)
    pool, wishes = _pool(spark, sf, index)
    liked = wishes.where("preference = 'like'").select("session_id", F.col("business_id").alias("chosen_id"))
    sims = rerank.avg_similarity_to(pool, liked, index.postings, "session_id")
    rows = pool.join(sims, ["session_id", "business_id"], "left").na.fill(0.0, ["avg_similarity"])
    return rounded(rows.select("query_text", "state", "session_id", "business_id", "avg_similarity"))


@check("rr4_preference_score", with_views("places", f"""SELECT business_id, round((CASE WHEN stars >= 3.5 THEN 1 ELSE 0 END
 + CASE WHEN d <= 15 THEN 1 ELSE greatest(0, 1 - (d - 15) / (15 + 1e-9)) END + CASE WHEN contains(lower(categories), 'gear') THEN 0 ELSE 1 END
 + CASE WHEN contains(lower(categories), 'promo') THEN 1 ELSE 0.5::DOUBLE END) / 4, 6) AS score FROM (SELECT *, {_hav('p', 'q')} AS d
 FROM places p, (SELECT 39.9526::DOUBLE AS latitude, -75.1652::DOUBLE AS longitude) q)""".replace("SELECT *, 2 *", "SELECT p.*, 2 *")))
def preference_score(spark, sf):
    km = haversine_km(F.lit(39.9526), F.lit(-75.1652), F.col("latitude"), F.col("longitude"))
    score = rerank.preference_score(
        F.col("stars"), km, F.col("categories"), F.lit(3.5), F.lit(15.0), F.array(F.lit("Gear")), F.array(F.lit("Promo "))
    )
    return rounded(v.places(spark, sf).select("business_id", score.alias("score")))


@check("rr5_rerank_pool", with_views(_ALL, """SELECT s.query_text, s.state, r.session_id, r.business_id, round(liked, 5) AS v2_sim_liked,
 round(disliked, 5) AS v2_sim_disliked, 0.5::DOUBLE AS v2_pref_match,
 round(base + 0.35::DOUBLE * liked - 0.25::DOUBLE * disliked + 0.1::DOUBLE, 5) AS v2_score FROM reranked r JOIN sigs s USING (sig)""", _POOLS))
def rerank_pool(spark, sf):
    index = place_index(spark, sf)
    pool, wishes = _pool(spark, sf, index)
    rows = rerank.rerank_pool(pool, wishes, index.postings, owner="session_id")
    return rounded(rows.select(
        "query_text", "state", "session_id", "business_id", "v2_sim_liked", "v2_sim_disliked", "v2_pref_match", "v2_score"
    ), 5)


@check("rr5_search_with_preferences")
def search_with_preferences(spark, sf):
    prefs = rerank.preference_state(v.actions(spark, sf))
    rows = plan.search(
        v.query_log(spark, sf), place_index(spark, sf), meta(spark, sf), state(spark, sf), prefs, v.photos(spark, sf)
    )
    return rows.select("query_id", "business_id", "rank", "v2_score", "photo_url", "reranked")


# --- policy ------------------------------------------------------------------------------------------------


@check("bd1_reward_events", with_views("actions", "SELECT event_id, intent, arm, reward FROM rewards", REWARDS))
def rewards(spark, sf):
    return events(spark, sf).select("event_id", "intent", "arm", "reward")


_OVERRIDES = """marked AS (SELECT event_id, session_id, ts, event_id // 500 AS round, CASE WHEN action = 'refresh' THEN 'slider_override' ELSE action END AS action
  FROM actions)"""


@check("bd2_dedupe_overrides", with_views("actions", """SELECT event_id, action FROM marked WHERE action <> 'slider_override' UNION ALL
 SELECT event_id, action FROM (SELECT *, row_number() OVER (PARTITION BY session_id, round ORDER BY ts, event_id) AS r FROM marked
 WHERE action = 'slider_override') WHERE r = 1""", _OVERRIDES))
def overrides(spark, sf):
    a = v.actions(spark, sf)
    named = F.when(F.col("action") == "refresh", "slider_override").otherwise(F.col("action"))
    rows = a.withColumns({"round": F.floor(F.col("event_id") / 500), "action": named})
    return policy.dedupe_overrides(rows).select("event_id", "action")


@check("bd3_q_state", with_views("actions", "SELECT intent, arm, round(q_value, 6) AS q_value, pull_count, total_interactions FROM qstate", STATE))
def q_state(spark, sf):
    return rounded(state(spark, sf))


@check("bd4_q_state_stream", with_views("actions", "SELECT intent, arm, round(q_value, 6) AS q_value, pull_count, total_interactions FROM qstate", STATE))
def q_state_stream(spark, sf):
    folder = shared_folder(spark, "feedback")
    rows = events(spark, sf).select("event_id", "ts", "intent", "arm", "reward")
    rows.write.parquet(f"{folder}/events")
    stream = QStateStream(f"{folder}/out")
    query = stream.start(spark.readStream.schema(rows.schema).parquet(f"{folder}/events"), f"{folder}/progress")
    query.awaitTermination()
    return rounded(stream.state(spark, query.lastProgress["batchId"]))


@check("bd5_feedback_log", with_views("actions", f"""SELECT event_id, intent, arm, reward, query_text, round({_FOLD.format(
 "list(reward) OVER (PARTITION BY intent, arm ORDER BY ts, event_id)")}, 4) AS new_q_value FROM rewards""", REWARDS))
def feedback_log(spark, sf):
    rows = policy.feedback_log(events(spark, sf))
    return rows.select("event_id", "intent", "arm", "reward", "query_text", "new_q_value")


@check("bd6_ucb_select", with_views("actions", "SELECT intent, arm FROM chosen", STATE))
def ucb(spark, sf):
    return policy.ucb_select(state(spark, sf))


@check("bd7_apply_policy", with_views("query_log actions", """SELECT a.query_id, c.arm, CASE WHEN a.query_id % 3 = 0 THEN 0.85 ELSE
 CASE c.arm WHEN 'explorer' THEN 1.35 WHEN 'reputation' THEN 0.75 ELSE 0.7 END END::DOUBLE AS w_semantic,
 CASE WHEN a.query_id % 3 = 0 THEN 0 ELSE 1 END AS rl_applied FROM annotated a JOIN chosen c USING (intent)""".replace(
 "c.arm, CASE WHEN a.query_id", "CASE WHEN a.query_id % 3 <> 0 THEN c.arm END AS arm, CASE WHEN a.query_id", 1), ANNOTATED + ", " + STATE))
def apply_policy(spark, sf):
    log = annotated(spark, sf).withColumn("rl_user_overrode", F.col("query_id") % 3 == 0)
    rows = policy.apply_policy(log, policy.ucb_select(state(spark, sf)))
    return rows.select("query_id", "arm", "w_semantic", F.col("rl_applied").cast("int").alias("rl_applied"))


def _replay_sql() -> str:
    arms = {a: i + 1 for i, a in enumerate(ARMS)}
    score = lambda i: f"q{i} + 0.5::DOUBLE * sqrt(ln(greatest(1, n1 + n2 + n3)) / n{i})"
    pick = f"""CASE WHEN n1 = 0 THEN 1 WHEN n2 = 0 THEN 2 WHEN n3 = 0 THEN 3
   WHEN {score(1)} >= {score(2)} AND {score(1)} >= {score(3)} THEN 1 WHEN {score(2)} >= {score(3)} THEN 2 ELSE 3 END"""
    number = "CASE l.historical_arm " + " ".join(f"WHEN '{a}' THEN {i}" for a, i in arms.items()) + " END"
    step = ", ".join(
        [f"CASE WHEN hit AND pick = {i} THEN q{i} + 0.15::DOUBLE * (reward - q{i}) ELSE q{i} END AS q{i}" for i in (1, 2, 3)]
        + [f"CASE WHEN hit AND pick = {i} THEN n{i} + 1 ELSE n{i} END AS n{i}" for i in (1, 2, 3)]
    )
    return f"""numbered AS MATERIALIZED (SELECT l.*, {number} AS arm_no, row_number() OVER (PARTITION BY intent ORDER BY row_id) AS i FROM replay_log l),
 walk AS (SELECT DISTINCT intent, 0::BIGINT AS i, 0::BIGINT AS row_id, 0 AS reward, false AS hit, 0 AS pick, 0.0::DOUBLE AS q1, 0.0::DOUBLE AS q2, 0.0::DOUBLE AS q3,
   0 AS n1, 0 AS n2, 0 AS n3 FROM replay_log
  UNION ALL SELECT intent, i, row_id, reward, hit, pick, {step} FROM (SELECT w.intent, n.i, n.row_id, n.reward, ({pick}) AS pick, ({pick}) = n.arm_no AS hit,
   q1, q2, q3, n1, n2, n3 FROM walk w JOIN numbered n ON n.intent = w.intent AND n.i = w.i + 1)),
 hits AS MATERIALIZED (SELECT intent, row_id, reward, pick, CASE pick WHEN 1 THEN q1 WHEN 2 THEN q2 ELSE q3 END AS q_value FROM walk WHERE hit)"""


@check("bd8_replay_evaluate", with_views("replay_log", """SELECT 'default' AS setting, count(*) AS matches, sum(reward)::DOUBLE AS cumulative_reward,
 round(avg(reward), 6) AS cumulative_ctr, round((SELECT avg(reward) FROM (SELECT reward FROM hits ORDER BY row_id DESC LIMIT 100)), 6) AS windowed_ctr
 FROM hits""", _replay_sql()))
def replay(spark, sf):
    return rounded(policy.replay_evaluate(v.replay_log(spark, sf)))


@check("bd8_replay_state")
def replay_state(spark, sf):
    options = v.replay_log(spark, sf).select("intent").distinct().select(
        F.col("intent").alias("setting"), F.lit(0.5).alias("c"), F.lit(0.15).alias("alpha")
    )
    return rounded(policy.replay_state(v.replay_log(spark, sf), options))


@check("bd9_policy_bounds", with_views("replay_log", """SELECT round(sum(r * n) / sum(n), 6) AS random_ctr, round(sum(b * n) / sum(n), 6) AS optimal_ctr
 FROM (SELECT intent, avg(rate) AS r, max(rate) AS b, sum(n) AS n FROM (SELECT intent, historical_arm, avg(reward) AS rate, count(*) AS n
 FROM replay_log GROUP BY 1, 2) GROUP BY 1)"""))
def bounds(spark, sf):
    return rounded(policy.policy_bounds(v.replay_log(spark, sf)))


@check("bd10_best_arm_per_intent", with_views("actions", """SELECT intent, arm AS best_arm, round(q_value, 6) AS q_value FROM (SELECT *, row_number() OVER (
 PARTITION BY intent ORDER BY q_value DESC) AS r FROM qstate) WHERE r = 1""", STATE))
def best_arm(spark, sf):
    return rounded(policy.best_arm_per_intent(state(spark, sf)))
