"""Rewards, arm values, arm choice, replay and the stream."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from placelens.functions.lexicons import ARMS, INTENTS
from placelens.operators import policy, query_log
from placelens.session import shared_folder
from placelens.streaming.policy_stream import QStateStream, feedback_log_sink

EVENTS = "event_id long, ts timestamp, intent string, arm string, reward double, query_text string"


def make_events(n, seed=1):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    return [
        (i, start + datetime.timedelta(seconds=i // 3), rng.choice(INTENTS), rng.choice(ARMS), rng.choice([1.0, -0.5, -0.1]), f"q{i}")
        for i in range(n)
    ]


def loop(events):
    q, log = {}, {}
    for i, _, intent, arm, r, _ in events:
        old, n = q.get((intent, arm), (0.0, 0))
        q[(intent, arm)] = (old + 0.15 * (r - old), n + 1)
        log[i] = q[(intent, arm)][0]
    return q, log


def test_one_reward(spark):
    one = spark.createDataFrame([make_events(1)[0][:2] + ("intent_quick", "explorer", 1.0, "")], EVENTS)
    rows = {(r["intent"], r["arm"]): r for r in policy.q_state(one).collect()}
    assert len(rows) == 9
    assert rows[("intent_quick", "explorer")]["q_value"] == pytest.approx(0.15)
    assert rows[("intent_quick", "reputation")]["total_interactions"] == 1
    assert rows[("intent_romantic", "explorer")]["total_interactions"] == 0


def test_ranges_equal_the_plain_loop(spark):
    events = make_events(3000)
    df = spark.createDataFrame(events, EVENTS)
    q, log = loop(events)
    for r in policy.q_state(df).collect():
        want = q.get((r["intent"], r["arm"]), (0.0, 0))
        assert r["q_value"] == pytest.approx(want[0], abs=1e-12) and r["pull_count"] == want[1]
    got = {r["event_id"]: r["new_q_value"] for r in policy.feedback_log(df).collect()}
    assert set(got) == set(log)
    assert all(abs(got[i] - log[i]) <= 0.5001e-4 for i in log)


def state(spark, rows):
    schema = "intent string, arm string, q_value double, pull_count long, total_interactions long"
    return spark.createDataFrame(rows, schema)


def choose(spark, q, n):
    total = sum(n)
    rows = [("intent_quick", a, x, k, total) for a, x, k in zip(ARMS, q, n)]
    return policy.ucb_select(state(spark, rows)).first()["arm"]


def test_ucb(spark):
    assert choose(spark, [0.0] * 3, [0, 0, 0]) == "explorer"
    assert choose(spark, [9.0, 0.0, 0.0], [1, 0, 0]) == "reputation"
    assert choose(spark, [9.0, 9.0, 0.0], [1, 1, 0]) == "convenience"
    assert choose(spark, [0.1, 0.8, 0.2], [3, 3, 3]) == "reputation"
    assert choose(spark, [0.5, 0.5, 0.5], [3, 3, 3]) == "explorer"


def test_unknown_arm_is_rejected_and_blank_intent_is_default(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, " ", "explorer", 1.0, ""), (2, t, "intent_quick", "nope", 1.0, "")], EVENTS)
    rows = {(r["intent"], r["arm"]): r["pull_count"] for r in policy.q_state(df).collect()}
    assert rows[("intent_default", "explorer")] == 1 and sum(rows.values()) == 1
    assert policy.unknown_arms(df).count() == 1


def test_intents(spark):
    texts = {
        "quick cheap lunch": "intent_quick", "grab and go": "intent_quick", "romantic date night": "intent_romantic",
        "breakfast": "intent_default", "": "intent_default", None: "intent_default", "cozy fast food": "intent_quick",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["i"] for r in df.select("t", query_log.classify_intent(F.col("t")).alias("i")).collect()}
    assert got == texts


def test_stream_in_batches_equals_batch_and_counts_late_events(spark):
    events = make_events(600, seed=4)
    folder = shared_folder(spark, "stream")
    for part in range(3):
        spark.createDataFrame(events[part * 200 : part * 200 + 200], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    late = (9999, datetime.datetime(2023, 1, 1), "intent_quick", "explorer", 1.0, "late")
    spark.createDataFrame([late], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    job = QStateStream(f"{folder}/out", late_seconds=60)
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = job.start(source, f"{folder}/progress")
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    q, _ = loop(events)
    for r in job.state(spark, last).collect():
        want = q.get((r["intent"], r["arm"]), (0.0, 0))
        assert r["q_value"] == pytest.approx(want[0], abs=1e-12) and r["pull_count"] == want[1]
    assert job.late_events(spark, last).first()["late_events"] == 1
    # A batch that runs again leaves the same state.
    job.fold_batch(spark.createDataFrame([late], EVENTS), last)
    assert job.late_events(spark, last).first()["late_events"] == 1


def test_feedback_log_keeps_every_row_once_across_restarts(spark):
    """Each start takes the files that came since the last one; rows of earlier runs are not written again."""
    folder = shared_folder(spark, "log")
    rows = make_events(90) + [(90, None, None, None, None, None)]

    def arrive(part):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events")

    def run():
        events = spark.readStream.schema(EVENTS).parquet(f"{folder}/events")
        query = feedback_log_sink(events, f"{folder}/out", f"{folder}/progress")
        assert query.awaitTermination(120)

    key = lambda r: r[0]
    seen = []
    for part in (rows[:50], rows[50:], []):
        if part:
            arrive(part)
        seen += part
        run()
        got = [tuple(r) for r in spark.read.schema(EVENTS).parquet(f"{folder}/out").collect()]
        assert sorted(got, key=key) == sorted(seen, key=key)


def test_replay_settings_run_side_by_side(spark):
    rng = random.Random(9)
    log = [(i, rng.choice(INTENTS), rng.choice(ARMS), rng.randint(0, 1)) for i in range(900)]
    df = spark.createDataFrame(log, "row_id long, intent string, historical_arm string, reward int")
    alone = policy.replay_evaluate(df).first()
    options = spark.createDataFrame([("a", 0.5, 0.15), ("b", 2.0, 0.3)], "setting string, c double, alpha double")
    both = {r["setting"]: r for r in policy.replay_evaluate(df, options).collect()}
    assert both["a"]["matches"] == alone["matches"] and both["a"]["windowed_ctr"] == alone["windowed_ctr"]
    assert set(both) == {"a", "b"}


def test_manual_weights_where_overridden(spark):
    q = spark.createDataFrame([(1, "intent_quick", True, 0.3), (2, "intent_quick", False, 0.3)], "query_id int, intent string, rl_user_overrode boolean, w_price double")
    chosen = spark.createDataFrame([("intent_quick", "convenience")], "intent string, arm string")
    rows = {r["query_id"]: r for r in policy.apply_policy(q, chosen).collect()}
    assert rows[1]["arm"] is None and rows[1]["w_price"] == 0.3 and rows[1]["w_semantic"] == 0.85
    assert rows[2]["arm"] == "convenience" and rows[2]["w_distance"] == 1.45
    off = policy.apply_policy(q, None).first()
    assert off["arm"] is None and "Manual weights" in off["strategy_label"]
