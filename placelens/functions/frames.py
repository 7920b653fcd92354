"""Small DataFrame helpers that keep global and hot-key work distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelens.functions.columns import bigrams
from placelens.session import cut

# Spark's default for spark.sql.window.group.limit.threshold.
EARLY_CUT = 1000
PARTS = 64


def conform(df: DataFrame, schema) -> DataFrame:
    """Project to ``schema``; absent columns and unreadable values become typed NULLs."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def spread_scan(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than there are cores; anything larger stays as it was read.

    For tables whose rows are costly to process, such as long texts in one small file.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def exploded_terms(df: DataFrame, keys: Sequence[str], words: Column, name: str, ngrams: int = 2) -> DataFrame:
    """One row per word of the array ``words`` and, with ``ngrams`` above 1, per pair of neighbours in it.

    The words are a column of their own first: inside the explode, each of the places where the pairs name them
    would split the text again.
    """
    kept = df.select(*keys, words.alias("_words"))
    terms = F.concat("_words", bigrams(F.col("_words"))) if ngrams > 1 else F.col("_words")
    return kept.select(*keys, F.explode(terms).alias(name))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. The rank filter lets Spark cut each group to k rows before the shuffle.

    Spark does so up to ``EARLY_CUT`` rows; for a larger k the groups are first cut in salted parts.
    """
    if k > EARLY_CUT:
        part = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)))
        window = W.partitionBy(*keys, "_part").orderBy(*order)
        df = part.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_part", "_rank")
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def hot_keys(df: DataFrame, key: str, min_rows: int = 100_000, rows: Column | None = None) -> DataFrame:
    """Keys with more than ``min_rows`` rows in ``df`` and the number of salts each gets, one per ``min_rows`` rows.

    ``rows`` is the number of rows that a row stands for, such as the length of a list; one if it is left out.
    """
    total = F.count("*") if rows is None else F.sum(rows)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(total.alias("rows"))
    return counts.where(F.col("rows") > min_rows).select(key, F.ceil(F.col("rows") / float(min_rows)).alias("salts"))


def salted_join(
    probe: DataFrame, build: DataFrame, key: str, min_rows: int = 100_000, rows: Column | None = None, parts: int | None = None
) -> DataFrame:
    """Inner equi-join on ``key`` that splits the build rows of hot keys and repeats their probe rows.

    The salt counts are joined like any table, so every hot key is split however many there are; Spark broadcasts
    them where their measured size allows it. Adaptive skew handling splits the probe side. ``rows`` is that of
    ``hot_keys``. ``parts`` states the number of tasks, for joins that make far more rows than they read: by the bytes
    read alone Spark would leave them to a few tasks.
    """
    hot = hot_keys(build, key, min_rows, rows)
    salts = F.coalesce("salts", F.lit(1).cast("bigint"))
    spread = build.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(*build.columns), salts))
    repeated = probe.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    sides = [repeated.drop("salts"), spread.drop("salts")]
    if parts is not None:
        sides = [side.repartition(parts, key, "salt") for side in sides]
    return sides[0].join(sides[1], [key, "salt"]).drop("salt")


def with_running_totals(
    hist: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], rows_per_segment: int = 1_000_000
) -> DataFrame:
    """Add, per key, the total of each measure and its sum over all smaller values.

    ``hist`` has one row per (keys, value). Its rows are cut into ranges of (keys, value) of a stated size; sums
    run inside a range and the range totals are chained, so no task sees a whole key.
    """
    keys = list(keys)
    sliced = ordered_segments(hist, [*keys, value], rows_per_segment)
    totals = sliced.groupBy(*keys, "segment").agg(*[F.sum(m).alias(f"segment_{m}") for m in measures])
    ordered = W.partitionBy(*keys).orderBy("segment")
    whole = W.partitionBy(*keys)
    chained = totals.select(
        *keys,
        "segment",
        *[
            c
            for m in measures
            for c in (
                (F.sum(f"segment_{m}").over(ordered) - F.col(f"segment_{m}")).alias(f"base_{m}"),
                F.sum(f"segment_{m}").over(whole).alias(f"total_{m}"),
            )
        ],
    )
    inside = W.partitionBy(*keys, "segment").orderBy(value)
    run = sliced.withColumns({f"run_{m}": F.sum(m).over(inside) - F.col(m) for m in measures})
    return run.join(chained, [*keys, "segment"]).select(
        *hist.columns,
        *[(F.col(f"base_{m}") + F.col(f"run_{m}")).alias(f"before_{m}") for m in measures],
        *[F.col(f"total_{m}") for m in measures],
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per key without gathering a key's values in one task."""
    keys = list(keys)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = with_running_totals(hist, keys, value, ["n"])
    first, last = F.col("before_n"), F.col("before_n") + F.col("n") - 1

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position <= last), F.col(value).cast("double")))

    parts = []
    for name, p in probs.items():
        spot = (F.col("total_n") - 1) * F.lit(float(p))
        parts += [
            at(F.floor(spot)).alias(f"{name}_lo"),
            at(F.ceil(spot)).alias(f"{name}_hi"),
            F.max(spot - F.floor(spot)).alias(f"{name}_w"),
        ]
    found = ranked.groupBy(*keys).agg(*parts)
    return found.select(
        *keys,
        *[
            (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_w")).alias(n)
            for n in probs
        ],
    )


def range_count(df: DataFrame, rows_per_segment: int = 1_000_000) -> int:
    """Number of ranges that keeps a range near ``rows_per_segment`` rows, at least one per shuffle partition."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_segment))


def ordered_segments(df: DataFrame, order: Sequence[str], rows_per_segment: int = 1_000_000) -> DataFrame:
    """Range-partition by a total order and number the ranges in column ``segment``.

    The number of ranges follows a count of the table. The result is a reliable checkpoint: the ranges come from
    sampling, and the segment of a row must not change when a lost task is run again. The rows are cut before as
    well, because counting, sampling and ranging each read them.
    """
    rows = cut(df)
    ranged = rows.repartitionByRange(range_count(rows, rows_per_segment), *order)
    return cut(ranged.withColumn("segment", F.spark_partition_id()))
