"""Chat formatting after cumulative-snapshot collapse, with DataFrame functions only.

A log often holds every state of a growing conversation. A conversation whose turns are the first turns of a
longer one is dropped; of equal conversations the smallest id stays. What stays is rendered as ChatML.

Turns are ordered by (turn, role, text), nulls last, and two conversations agree in a turn if role and text do,
null being a value of its own; turn numbers only order. Null roles and texts render as empty. A null conv_id is an
id like any other. Rows that repeat another row are turns of their own. Extra columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelens.llm.registry import query, table
from placelens.llm.tables import written

RANGE_ROWS = 100_000
BOUND_CHARS = 64
SEGMENT_TURNS = 64


def _hash_columns(*values: Column) -> list[Column]:
    """Two 60-bit numbers of the MD5 of the values; null differs from every text."""
    md5 = F.md5(F.to_json(F.struct(*[F.coalesce(F.concat(F.lit("v"), v.cast("string")), F.lit("n")).alias(f"c{i}") for i, v in enumerate(values)])))
    return [F.conv(F.substring(md5, 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(2)]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, role, text, p1, p2): position of each turn and the hash of all turns up to it.

    The hash of a prefix is the exclusive-or of the hashes of (position, role, text), so it can be summed in
    parts: rows are range-partitioned in their order, counted and folded inside a range, and the few totals per
    (conversation, range) are chained. A conversation that holds most rows is spread over many ranges.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    for i, h in enumerate(_hash_columns(F.col("role"), F.col("text"))):
        rows = rows.withColumn(f"t{i + 1}", h)
    order = [F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text")]
    # The bounds of the ranges are sampled, so they know texts by their beginning only; inside a range whole texts rank.
    bounds = [*order[:2], F.asc_nulls_last(F.substring("text", 1, BOUND_CHARS))]
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = rows.repartitionByRange(ranges, F.asc_nulls_last("conv_id"), *bounds)
    ranged = written(ranged.withColumn("range", F.spark_partition_id()), "chat-ranges")
    inside = W.partitionBy("conv_id", "range").orderBy(*order)
    sizes = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))
    placed = ranged.withColumn("local", F.row_number().over(inside)).join(bases, here)
    placed = placed.withColumn("nth", F.col("base") + F.col("local")).drop("c", "r", "base", "local", "turn")
    for i, h in enumerate(_hash_columns(F.col("nth"), F.col("t1"), F.col("t2"))):
        placed = placed.withColumn(f"h{i + 1}", h)
    upto = W.partitionBy("conv_id", "range").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    folded = written(placed.withColumn("x1", F.bit_xor("h1").over(upto)).withColumn("x2", F.bit_xor("h2").over(upto)).drop("h1", "h2", "t1", "t2"), "chat-folds")
    ends = folded.groupBy("conv_id", "range").agg(F.max(F.struct("nth", "x1", "x2")).alias("end"))
    carried = ends.select(
        F.col("conv_id").alias("c"),
        F.col("range").alias("r"),
        F.coalesce(F.bit_xor("end.x1").over(earlier), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("end.x2").over(earlier), F.lit(0)).alias("b2"),
    )
    joined = folded.join(carried, here)
    return joined.select(
        "conv_id", "nth", "role", "text", F.col("x1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("b2")).alias("p2")
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of a longer one, one of each set of equals."""
    whole = turns.groupBy("conv_id").agg(F.max(F.struct("nth", "p1", "p2")).alias("last")).select("conv_id", "last.*")
    unique = whole.groupBy("nth", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    ends = whole.select(F.col("conv_id").alias("c"), F.col("nth").alias("n_turns"))
    inner = turns.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).where(F.col("nth") < F.col("n_turns"))
    prefixes = inner.select("nth", "p1", "p2").distinct()
    return unique.join(prefixes, ["nth", "p1", "p2"], "left_anti").select("conv_id", F.col("nth").alias("n_turns"))


def render(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, first_turn, rendered): ChatML of 64 turns at a time.

    The segments of a conversation in order are its whole text; a segment is bounded, a conversation is not.
    """
    picked = chosen.select(F.col("conv_id").alias("c"), "n_turns")
    mine = turns.join(picked, F.col("conv_id").eqNullSafe(F.col("c")))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(F.lit("<|im_start|>"), blank("role"), F.lit("\n"), blank("text"), F.lit("<|im_end|>\n"))
    lines = mine.select("conv_id", "n_turns", "nth", F.floor((F.col("nth") - 1) / SEGMENT_TURNS).alias("segment"), line.alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("nth", "line")))
    grouped = lines.groupBy("conv_id", "n_turns", "segment").agg(F.min("nth").alias("first_turn"), parts.alias("parts"))
    return grouped.select("conv_id", "segment", "n_turns", "first_turn", F.array_join(F.transform("parts", lambda p: p["line"]), "").alias("rendered"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    turns = written(numbered_turns(conversations), "chat-turns")
    return render(turns, maximal_conversations(turns))


SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    md5(coalesce('v' || role, 'n') || chr(1) || coalesce('v' || text, 'n')) AS h,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text) AS nth
  FROM conversations),
p AS (SELECT conv_id, nth, md5(string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY nth)) AS h FROM t),
whole AS (SELECT conv_id, max(nth) AS n_turns, arg_max(h, nth) AS h FROM p GROUP BY conv_id),
kept AS (
  SELECT min(conv_id) AS conv_id, n_turns FROM whole
  WHERE NOT EXISTS (SELECT 1 FROM p JOIN whole w USING (conv_id) WHERE p.nth = whole.n_turns AND p.h = whole.h AND p.nth < w.n_turns)
  GROUP BY n_turns, h)
SELECT conv_id, (nth - 1) // {SEGMENT_TURNS} AS segment, n_turns, min(nth) AS first_turn,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY nth) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY ALL
"""


@query("op2_chat_snapshots", SQL)
def op2(spark, folder):
    return collapse_and_render(table(spark, folder, "conversations"))
