"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_ONLY optionally a comma list of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from placelens.plans import load_registry  # noqa: E402
from placelens.session import build_session  # noqa: E402

HEADLINE = [
    "cl4_dedup",
    "cl8_describe_prices",
    "fx8_flatten_attributes",
    "fx17_photo_gallery",
    "tx2_extract_themes",
    "tx6_review_signals",
    "tx8_weak_aspect_targets",
    "sp2_radius_join",
    "sp3_ring_stats",
    "sp7_top5_similar_category",
    "kn1_radius_neighbors",
    "kn2_cosine_top_k",
    "ql13_query_profile",
    "rt6_fit_tfidf",
    "rt11_top_k_per_query",
    "rt13_search",
    "rr1_preference_state",
    "rr5_rerank_pool",
    "bd3_q_state",
    "bd5_feedback_log",
    "bd8_replay_evaluate",
    "ev1_auc",
    "cr3_resolve_categories",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = build_session(
        "placelens-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            # Small tables still use every local core.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_registry()[0]
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    # One small query first, so that starting the JVM and the Python workers is not charged to the first name.
    queries["cl9_value_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
