"""Index and ranking plans, and results against plain Python."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from placelens.functions import frames
from placelens.operators import modeling, retrieval, spatial, text_signals
from placelens.plans import checks_search, checks_text
from placelens.plans import search as plan
from placelens.plans import views as v
from placelens.sources import writers

SF = "/root/testdata/sf0.001"
DOCS = [(1, "spicy thai noodles noodles"), (2, "thai curry"), (3, "pizza oven pizza"), (4, "")]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tfidf_equals_plain_python(spark):
    index = retrieval.fit_tfidf(spark.createDataFrame(DOCS, "doc_id int, text string"), stopwords=[])
    counts = {}
    for i, text in DOCS:
        words = text.split()
        counts[i] = collections.Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = collections.Counter(t for c in counts.values() for t in c)
    got = {(r["doc_id"], r["term"]): r["w"] for r in index.postings.collect()}
    for i, c in counts.items():
        raw = {t: n * (math.log(5 / (df[t] + 1)) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        for t, x in raw.items():
            assert got[(i, t)] == pytest.approx(x / norm)


def test_index_blocks_follow_the_text_and_keep_ids_whole(spark, monkeypatch):
    """Tasks hold a bounded amount of text; rows that share an id, or have none, are one document, kept or not."""
    rows = [(i % 40 if i % 50 else None, f"w{i % 7} w{i % 3} und w{i % 11}") for i in range(120)] + [(3, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    plain = retrieval.fit_tfidf(docs, stopwords=["und"])
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", 100)
    many, kept = retrieval.fit_tfidf(docs, stopwords=["und"]), retrieval.fit_tfidf(docs, stopwords=["und"], cut=True)
    assert many.postings.rdd.getNumPartitions() == -(-sum(len(t or "") for _, t in rows) // 100)
    whole = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    texts = collections.defaultdict(collections.Counter)
    for i, t in rows:
        words = [w for w in (t or "").split() if w != "und"]
        texts[i].update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = collections.Counter(t for c in texts.values() for t in c)
    idf = {t: math.log((len(rows) + 1) / (n + 1)) + 1 for t, n in df.items()}
    norm = {i: math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for i, c in texts.items()}
    expected = sorted((str(i), t, round(n * idf[t] / norm[i], 9)) for i, c in texts.items() for t, n in c.items())
    for index in (plain, many, kept):
        assert whole(index.postings) == expected
        assert whole(index.vocabulary) == sorted((t, round(x, 9)) for t, x in idf.items())
    capped = [retrieval.fit_tfidf(docs, max_features=5, stopwords=["und"], cut=c) for c in (False, True)]
    assert whole(capped[0].postings) == whole(capped[1].postings) and len(whole(capped[0].vocabulary)) == 5
    rare = [retrieval.fit_tfidf(docs, min_df=9, stopwords=["und"], cut=c).vocabulary.count() for c in (False, True)]
    assert rare == [sum(n >= 9 for n in df.values())] * 2


def test_terms_leave_a_block_packed(spark, monkeypatch, tmp_path):
    """No row of an exchange is a term or a posting; the saved index is whole and each of its files sorted by term."""
    rows = [(f"d{i % 90}" if i % 45 else None, " ".join(f"w{(i * k) % 53} x{k}" for k in range(i % 13))) for i in range(180)] + [("e", None), ("f", " ")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", 1000)
    monkeypatch.setattr(writers, "PACKED_ROWS", 50)
    index = retrieval.fit_tfidf(docs, stopwords=[], cut=True)
    for plan in (physical(index.postings), physical(retrieval.fit_tfidf(docs, stopwords=[]).vocabulary)):
        keys = [line for line in plan.splitlines() if "Exchange" in line and ("term" in line or "doc_id" in line)]
        assert not [line for line in keys if "partitioning(term" in line or "Window" in line] and "SortMergeJoin" not in plan
    writers.save_index(index, docs.select("doc_id"), str(tmp_path / "i"), {"a": 1})
    saved = writers.load_index(spark, str(tmp_path / "i"))[0]
    whole = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    assert whole(saved.postings) == whole(index.postings) == whole(retrieval.fit_tfidf(docs, stopwords=[]).postings)
    assert whole(saved.vocabulary) == whole(index.vocabulary) and len(whole(index.vocabulary)) > 100
    files = saved.postings.groupBy(F.input_file_name().alias("f")).agg(F.collect_list("term").alias("t")).collect()
    assert len(files) > 1 and all(r["t"] == sorted(r["t"]) for r in files)
    none = retrieval.fit_tfidf(docs, stopwords=[], max_features=0)
    assert none.postings.count() == none.vocabulary.count() == 0


def test_vocabulary_cap_takes_most_frequent_then_alphabetical(spark):
    index = retrieval.fit_tfidf(spark.createDataFrame(DOCS, "doc_id int, text string"), max_features=4, stopwords=[])
    assert {r["term"] for r in index.vocabulary.collect()} == {"noodles", "pizza", "thai", "curry"}


def test_cosine_is_bounded_and_one_for_itself(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    index = retrieval.fit_tfidf(docs, stopwords=[])
    asked = docs.select(F.col("text").alias("query_text"))
    rows = retrieval.cosine_scores(asked, index, stopwords=[]).collect()
    assert all(0 < r["similarity"] <= 1.0 + 1e-9 for r in rows)
    own = {r["doc_id"]: r["similarity"] for r in rows if r["query_text"] == dict(DOCS)[r["doc_id"]]}
    assert all(x == pytest.approx(1.0, abs=1e-6) for x in own.values()) and set(own) == {1, 2, 3}


def test_plans_have_no_pairwise_joins(spark):
    places = v.places(spark, SF)
    plans = [
        spatial.radius_join(places.withColumnRenamed("business_id", "target_id"), places.withColumnRenamed("business_id", "ref_id")),
        spatial.competition_features(places, places, exclude_self=True),
        retrieval.cosine_scores(checks_text.annotated(spark, SF), checks_text.place_index(spark, SF)),
    ]
    for df in plans:
        text = physical(df)
        assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    rows = frames.top_per_group(v.places(spark, SF), ["state"], [F.desc("review_count"), F.asc("business_id")], 3)
    assert "WindowGroupLimit" in physical(rows)


def test_large_top_k_is_cut_in_parts(spark, monkeypatch):
    rows = v.places(spark, SF).select("state", "business_id", "review_count")
    order = [F.desc("review_count"), F.asc("business_id")]
    want = frames.top_per_group(rows, ["state"], order, 7).collect()
    monkeypatch.setattr(frames, "EARLY_CUT", 5)
    assert sorted(map(tuple, frames.top_per_group(rows, ["state"], order, 7).collect())) == sorted(map(tuple, want))


def test_only_needed_columns_are_read(spark):
    text = physical(text_signals.review_signals(v.reviews(spark, SF), v.places(spark, SF)))
    assert "lang" not in text.split("documents.parquet")[1].split("ReadSchema")[1][:120]


def test_cuisine_filter_gives_way_when_it_leaves_nothing(spark):
    places = spark.createDataFrame(
        [("a", "A", "PA", "c", "Sushi Bars", 4.0, 10), ("b", "B", "PA", "c", "Pizza", 4.0, 5), ("c", "C", "FL", "d", "Pizza", 4.0, 5)],
        "business_id string, name string, state string, city string, categories string, stars double, review_count long",
    ).withColumns({"address": F.lit(""), "latitude": F.lit(1.0), "longitude": F.lit(1.0), "attributes": F.lit("{}")})
    asked = spark.createDataFrame([(1, "sushi", "PA"), (2, "sushi", "FL"), (3, "", "fl"), (4, "x", "ALL")], "query_id int, text string, state string")
    requests = plan.plan_requests(asked.withColumn("session_id", F.lit(1)), None)
    kept = retrieval.filter_candidates(requests.select("sig", *retrieval.SIGNATURE).distinct(), retrieval.place_meta(places))
    got = requests.join(kept.select("sig", "business_id"), "sig").groupBy("query_id").agg(F.sort_array(F.collect_list("business_id")).alias("ids"))
    assert {r["query_id"]: r["ids"] for r in got.collect()} == {1: ["a"], 2: ["c"], 3: ["c"]}


def test_radius_filter_drops_places_without_position(spark):
    places = spark.createDataFrame([("a", 40.7295, -73.9965), ("b", 41.7, -73.9), ("c", None, None)], "business_id string, latitude double, longitude double")
    fixed = {n: F.lit("x") for n in ("name", "city", "address", "categories", "attributes")}
    places = places.withColumns({**fixed, "state": F.lit("NY"), "stars": F.lit(4.0), "review_count": F.lit(3)})
    asked = spark.createDataFrame([(1, "cheap near nyu", "NY", 1)], "query_id int, text string, state string, session_id int")
    requests = plan.plan_requests(asked, None)
    kept = retrieval.filter_candidates(requests.select("sig", *retrieval.SIGNATURE).distinct(), retrieval.place_meta(places))
    assert [r["business_id"] for r in kept.collect()] == ["a"]


def test_search_reranks_only_sessions_with_preferences(spark):
    index, meta = checks_text.place_index(spark, SF), checks_search.meta(spark, SF)
    wish = spark.createDataFrame([(1, "b3", "like")], "session_id long, business_id string, preference string")
    rows = plan.search(v.query_log(spark, SF).withColumn("top_k", F.lit(5)), index, meta, None, wish)
    assert rows.agg(F.max("rank")).first()[0] == 5
    seen = {(r["session_id"], r["reranked"]) for r in rows.select("session_id", "reranked").distinct().collect()}
    assert (1, 1) in seen and all(flag == (1 if s == 1 else 0) for s, flag in seen)


def test_ranking_by_frames_equals_the_scored_candidates(spark):
    index, meta = checks_text.place_index(spark, SF), checks_search.meta(spark, SF)
    log = checks_search.form_requests(spark, SF)
    requests = plan.plan_requests(log, checks_search.state(spark, SF), checks_search.city_points(spark, SF))
    sizes = requests.groupBy("sig").agg(F.max("pool_size").alias("size"))
    asked = requests.select("sig", *retrieval.SIGNATURE).distinct()
    scored = retrieval.score_candidates(asked, meta, retrieval.cosine_scores(asked, index))
    want = frames.top_per_group(scored, ["sig"], [F.desc(F.round("final_score", 9)), F.asc("business_id")], 500)
    want = want.join(sizes, "sig").where("rank <= size")
    got = plan.rank_pools(requests, index, meta)

    def rows(df, score):
        cols = [c for c in retrieval.RESULT_COLUMNS if c not in ("final_score", "business_id")]
        picked = df.select("sig", "rank", *([F.round("final_score", 6)] if score else ["business_id", *cols])).collect()
        return sorted(map(tuple, picked), key=repr)

    assert rows(got, True) == rows(want, True) and len(rows(got, True)) > 1000
    assert len(set(rows(got, False)) ^ set(rows(want, False))) <= 0.001 * len(rows(want, False))
    counts = got.groupBy("sig").count().join(sizes, "sig")
    assert counts.where("count > size").count() == 0


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    xs = [float(x) for x in rng.integers(0, 50, 500)] + [7.0] * 400
    ys = [float(x) for x in rng.normal(size=333)]
    df = spark.createDataFrame([("x", x) for x in xs] + [("y", y) for y in ys] + [("x", None)], "k string, v double")
    probs = {"a": 0.1, "m": 0.5, "z": 0.93}
    got = {r["k"]: r for r in frames.exact_quantiles(df, ["k"], "v", probs).collect()}
    for k, values in (("x", xs), ("y", ys)):
        for n, p in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(values, p))


def test_running_totals(spark):
    df = spark.createDataFrame([("a", float(i % 97), i) for i in range(97)], "k string, x double, n long")
    for r in frames.with_running_totals(df, ["k"], "x", ["n"], rows_per_segment=9).collect():
        assert r["before_n"] == sum(i for i in range(97) if i < r["x"]) and r["total_n"] == sum(range(97))


def test_split_is_stable_and_disjoint(spark):
    df = v.places(spark, SF).select("business_id")
    a = modeling.split_rows(df, {"train": 0.6, "val": 0.2, "test": 0.2})
    b = modeling.split_rows(df.repartition(5), {"train": 0.6, "val": 0.2, "test": 0.2})
    assert a.exceptAll(b).count() == 0 and modeling.split_overlap(a.union(b)).count() == 0


def test_texts_are_split_once_for_words_and_pairs(spark):
    """The pairs name the words several times; each name would split the text again. Null and short texts stay whole."""
    docs = spark.createDataFrame([(1, "Spicy noodles, spicy noodles"), (1, "noodles"), (2, None), (None, "it")], "doc_id int, text string")
    themes = text_signals.extract_themes(docs, ["doc_id"])
    counts = retrieval._block_counts(docs, 2, ["und"], 2)
    for df in (themes, counts):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert {tuple(r) for r in themes.collect()} == {(1, "noodles", 3, 1), (1, "spicy", 2, 2), (1, "spicy noodles", 2, 3), (1, "noodles spicy", 1, 4)}
    single = retrieval._block_counts(docs, 2, ["und"], 1)
    assert {(r["doc_id"], r["term"], r["tf"]) for r in single.collect()} == {(1, "spicy", 2), (1, "noodles", 3), (None, "it", 1)}
