"""Feedback rewards, arm values per intent, arm choice and replay of a historical log."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelens.functions.columns import literal_map
from placelens.functions.frames import ordered_segments, range_count, top_per_group
from placelens.functions.lexicons import (
    ACTION_REWARDS,
    ALPHA,
    ARM_WEIGHTS,
    ARMS,
    INTENTS,
    MANUAL_WEIGHTS,
    UCB_C,
    WEIGHT_NAMES,
)

GROUP = ["intent", "arm"]


def arm_order(arm: Column) -> Column:
    return F.array_position(F.lit(ARMS), arm)


def clean_intent(intent: Column) -> Column:
    t = F.trim(F.coalesce(intent, F.lit("")))
    return F.when(t == "", F.lit("intent_default")).otherwise(t)


def reward_events(actions: DataFrame) -> DataFrame:
    """Actions that carry a reward, with the arm and intent of the round they answer."""
    reward = F.try_element_at(literal_map(ACTION_REWARDS), F.trim("action"))
    return actions.withColumn("reward", reward).where(
        F.col("reward").isNotNull() & F.col("intent").isNotNull() & F.col("arm").isNotNull()
    )


def dedupe_overrides(events: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """At most one slider_override per (session, round); the other rows are not shuffled."""
    is_override = F.coalesce(F.col("action") == "slider_override", F.lit(False))
    first = top_per_group(events.where(is_override), ["session_id", "round"], [F.asc(o) for o in order], 1, "_r")
    return events.where(~is_override).unionByName(first.drop("_r"))


def known_arms(events: DataFrame) -> DataFrame:
    return events.where(F.col("arm").isin(ARMS))


def unknown_arms(events: DataFrame) -> DataFrame:
    """Events the fold rejects."""
    return events.where(~F.col("arm").isin(ARMS))


def segment_values(segmented: DataFrame, order: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """Value each (segment, intent, arm) reaches from 0, and its event count.

    The update q + alpha (r - q) over n events maps q to (1 - alpha)^n q + value, so ranges of the event order
    can be folded apart and chained afterwards.
    """
    window = W.partitionBy("segment", *GROUP).orderBy(*[F.desc(o) for o in order])
    weight = F.lit(alpha) * F.pow(F.lit(1.0 - alpha), F.col("age"))
    aged = segmented.withColumn("age", F.row_number().over(window) - 1)
    return aged.groupBy("segment", *GROUP).agg(
        F.count("*").alias("n"), F.sum(F.col("reward") * weight).alias("value")
    )


def chain_segments(values: DataFrame, alpha: float = ALPHA, before: DataFrame | None = None) -> DataFrame:
    """Chain the few segment rows of each (intent, arm) to q_value and pull_count.

    ``before`` is an earlier state (intent, arm, q_value, pull_count) the events follow on.
    """
    later = W.partitionBy(*GROUP).orderBy(F.desc("segment")).rowsBetween(W.unboundedPreceding, -1)
    decay = F.pow(F.lit(1.0 - alpha), F.coalesce(F.sum("n").over(later), F.lit(0)))
    chained = (
        values.withColumn("part", F.col("value") * decay)
        .groupBy(*GROUP)
        .agg(F.sum("part").alias("fresh"), F.sum("n").alias("pulls"))
    )
    if before is None:
        return chained.select(*GROUP, F.col("fresh").alias("q_value"), F.col("pulls").alias("pull_count"))
    joined = before.join(chained, GROUP, "full_outer")
    pulls = F.coalesce("pulls", F.lit(0))
    old = F.coalesce("q_value", F.lit(0.0)) * F.pow(F.lit(1.0 - alpha), pulls)
    return joined.select(
        *GROUP,
        (old + F.coalesce("fresh", F.lit(0.0))).alias("q_value"),
        (F.coalesce("pull_count", F.lit(0)) + pulls).cast("bigint").alias("pull_count"),
    )


def state_grid(spark: SparkSession) -> DataFrame:
    """Every default intent with every arm."""
    return spark.range(1).select(F.explode(F.lit(INTENTS)).alias("intent")).select(
        "intent", F.explode(F.lit(ARMS)).alias("arm")
    )


def complete_state(state: DataFrame) -> DataFrame:
    """All arms of the default and seen intents, zeros where nothing was pulled, with the total per intent."""
    seen = state.select("intent").distinct().select("intent", F.explode(F.lit(ARMS)).alias("arm"))
    grid = state_grid(state.sparkSession).union(seen).distinct()
    full = grid.join(state, GROUP, "left").select(
        *GROUP,
        F.coalesce("q_value", F.lit(0.0)).alias("q_value"),
        F.coalesce("pull_count", F.lit(0)).cast("bigint").alias("pull_count"),
    )
    # Three rows per intent.
    return full.withColumn("total_interactions", F.sum("pull_count").over(W.partitionBy("intent")))


def fold_events(events: DataFrame, order: Sequence[str] = ("ts", "event_id"), alpha: float = ALPHA) -> DataFrame:
    """q_value and pull_count per (intent, arm) from events in the given total order.

    Nine groups hold all events, so the order is cut into ranges first and each range is folded on its own.
    """
    rows = known_arms(events).select(clean_intent(F.col("intent")).alias("intent"), "arm", "reward", *order)
    ranged = rows.repartitionByRange(range_count(rows), *order).withColumn("segment", F.spark_partition_id())
    return chain_segments(segment_values(ranged, order, alpha), alpha)


def q_state(events: DataFrame, order: Sequence[str] = ("ts", "event_id"), alpha: float = ALPHA) -> DataFrame:
    return complete_state(fold_events(events, order, alpha))


def feedback_log(events: DataFrame, order: Sequence[str] = ("ts", "event_id"), alpha: float = ALPHA) -> DataFrame:
    """Every event with the arm's value right after it, rounded to 4 digits.

    Ranges of the event order are folded to find the value each range starts from, then every range is run
    through on its own.
    """
    order = list(order)
    rows = known_arms(events).withColumn("intent", clean_intent(F.col("intent")))
    segmented = ordered_segments(rows.select("intent", "arm", "reward", "query_text", *order), order)
    values = segment_values(segmented, order, alpha)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """Value an arm has at the start of each range; three numbers per range."""
        pdf = pdf.sort_values("segment")
        q, starts = 0.0, []
        for n, value in zip(pdf["n"], pdf["value"]):
            starts.append(q)
            q = q * (1.0 - alpha) ** int(n) + value
        return pdf[[*GROUP, "segment"]].assign(start=starts)

    starts = values.groupBy(*GROUP).applyInPandas(chain, "intent string, arm string, segment int, start double")
    joined = segmented.join(starts, [*GROUP, "segment"])
    kept = [*GROUP, "reward", "query_text", *order]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.select(*kept).schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rewards = pd.concat([pdf["start"].head(1), pdf["reward"]])
        q = rewards.ewm(alpha=alpha, adjust=False).mean().iloc[1:]
        return pdf[kept].assign(new_q_value=q.round(4).to_numpy())

    return joined.groupBy(*GROUP, "segment").applyInPandas(run, schema + ", new_q_value double")


def ucb_scores(state: DataFrame, c: float = UCB_C) -> DataFrame:
    total = F.greatest(F.lit(1), F.col("total_interactions")).cast("double")
    bonus = F.lit(c) * F.sqrt(F.ln(total) / F.greatest(F.lit(1), F.col("pull_count")))
    return state.withColumn("score", F.col("q_value") + bonus)


def ucb_select(state: DataFrame, c: float = UCB_C) -> DataFrame:
    """Arm per intent: the first arm never pulled, else the best score, ties by arm order."""
    rank = F.struct(
        (F.col("pull_count") == 0).alias("untried"),
        F.when(F.col("pull_count") > 0, F.col("score")).alias("score"),
        (-arm_order(F.col("arm"))).alias("first"),
    )
    return ucb_scores(state, c).groupBy("intent").agg(F.max_by("arm", rank).alias("arm"))


def best_arm_per_intent(state: DataFrame) -> DataFrame:
    rank = F.struct("q_value", (-arm_order(F.col("arm"))).alias("first"))
    return state.groupBy("intent").agg(F.max_by("arm", rank).alias("best_arm"), F.max("q_value").alias("q_value"))


def strategy_label(arm: Column, intent: Column) -> Column:
    return (
        F.when(arm == "convenience", "Detected intent: Quick Meal. Prioritizing: Convenience.")
        .when(arm == "reputation", "Detected intent: Special Occasion. Prioritizing: Reputation.")
        .when(arm == "explorer", "Detected intent: Discovery. Prioritizing: Explorer picks.")
        .when(intent == "intent_quick", "Detected intent: Quick Meal. Manual weights active.")
        .when(intent == "intent_romantic", "Detected intent: Romantic Dining. Manual weights active.")
        .otherwise("Detected intent: General Search. Manual weights active.")
    )


def apply_policy(queries: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Attach arm, five weights and label; manual weights where the request turned the policy off or overrode it.

    Requests may carry rl_enabled, rl_user_overrode and their own weight columns.
    """
    have = set(queries.columns)
    flag = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    manual = [F.coalesce(F.col(n), F.lit(v)) if n in have else F.lit(v) for n, v in zip(WEIGHT_NAMES, MANUAL_WEIGHTS)]
    out = queries.drop("arm")
    if chosen is None:
        out = out.withColumn("arm", F.lit(None).cast("string"))
    else:
        # One row per intent.
        out = out.join(chosen.select("intent", F.col("arm").alias("arm")), "intent", "left")
    use = flag("rl_enabled", True) & ~flag("rl_user_overrode", False)
    out = out.withColumn("arm", F.when(use, F.col("arm")))
    weights = {}
    for i, (name, own) in enumerate(zip(WEIGHT_NAMES, manual)):
        preset = F.try_element_at(literal_map({a: w[i] for a, w in ARM_WEIGHTS.items()}), F.col("arm"))
        weights[name] = F.coalesce(preset, own)
    weights["rl_applied"] = F.col("arm").isNotNull()
    weights["strategy_label"] = strategy_label(F.col("arm"), F.col("intent"))
    return out.withColumns(weights)


def _choose(state: dict, c: float) -> str:
    for arm in ARMS:
        if state["n"][arm] == 0:
            return arm
    log_total = math.log(max(1, sum(state["n"].values())))
    return max(ARMS, key=lambda a: state["q"][a] + c * math.sqrt(log_total / state["n"][a]))


def replay_matches(log: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Rows of the log on which the policy picks the historical arm, with the value after the update.

    What the policy does for one intent depends only on that intent's earlier rows and on its settings
    (setting, c, alpha), so these run side by side. Rows arrive sorted and stream through in Arrow batches;
    only three arm values are held. The order within one intent cannot be split.
    """
    if settings is None:
        rows = log.withColumns({"setting": F.lit("default"), "c": F.lit(UCB_C), "alpha": F.lit(ALPHA)})
    else:
        listed = settings.select("setting", "c", "alpha")
        options = listed.agg(F.collect_list(F.struct("setting", "c", "alpha"))).scalar()
        rows = log.select("*", F.inline(options))
    cols = ["setting", "intent", "row_id", "historical_arm", "reward", "c", "alpha"]
    spread = rows.select(*cols).repartition("setting", "intent").sortWithinPartitions("setting", "intent", "row_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for pdf in batches:
            out = []
            for setting, intent, row_id, arm, reward, c, alpha in pdf.itertuples(index=False):
                if (setting, intent) != key:
                    key = (setting, intent)
                    state = {"q": dict.fromkeys(ARMS, 0.0), "n": dict.fromkeys(ARMS, 0)}
                if _choose(state, c) == arm:
                    state["q"][arm] += alpha * (reward - state["q"][arm])
                    state["n"][arm] += 1
                    out.append((setting, intent, row_id, arm, float(reward), state["q"][arm]))
            yield pd.DataFrame(out, columns=["setting", "intent", "row_id", "arm", "reward", "q_value"])

    id_type = log.schema["row_id"].dataType.simpleString()
    schema = f"setting string, intent string, row_id {id_type}, arm string, reward double, q_value double"
    return spread.mapInPandas(run, schema)


def replay_evaluate(log: DataFrame, settings: DataFrame | None = None, window: int = 100) -> DataFrame:
    """Matches, cumulative reward and click rate per setting, and the rate over its last matched rows."""
    matched = replay_matches(log, settings)
    totals = matched.groupBy("setting").agg(
        F.count("*").alias("matches"), F.sum("reward").alias("cumulative_reward"), F.avg("reward").alias("cumulative_ctr")
    )
    last = top_per_group(matched, ["setting"], [F.desc("row_id")], window, "_r")
    return totals.join(last.groupBy("setting").agg(F.avg("reward").alias("windowed_ctr")), "setting")


def replay_state(log: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Final arm values of a replay per setting."""
    matched = replay_matches(log, settings)
    return matched.groupBy("setting", *GROUP).agg(
        F.max_by("q_value", "row_id").alias("q_value"), F.count("*").alias("pull_count")
    )


def policy_bounds(log: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Expected reward of a random and of the best policy, weighted by the intents' shares of the log.

    Reward rates come from ``rates`` (intent, arm, rate) or are estimated from the log.
    """
    per_arm = log.groupBy("intent", F.col("historical_arm").alias("arm")).agg(
        F.count("*").alias("n"), F.avg("reward").alias("rate")
    )
    shares = per_arm.groupBy("intent").agg(F.sum("n").alias("n"))
    source = per_arm.select("intent", "arm", "rate") if rates is None else rates
    by_intent = source.groupBy("intent").agg(F.avg("rate").alias("random"), F.max("rate").alias("best"))
    joined = shares.join(by_intent, "intent")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return joined.agg(mean("random").alias("random_ctr"), mean("best").alias("optimal_ctr"))
