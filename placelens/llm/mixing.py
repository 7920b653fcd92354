"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target T and size S is wanted T / S times: the whole part is certain, the fraction is
a copy probability. Pairs of documents trade probability, counted in words, at random until one of the two is
certain, so the words of a block stay what they were; the one fraction left per block goes up a reduction tree.

Null text has size 0, so no words are taken from it. Null sources form a source of their own, last in order. Repeated rows
are rounded each by itself. Extra columns pass through. An empty table gives an empty result. The random numbers
follow from the seed and the rows, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelens.llm.quality_rules import WORD_BREAK
from placelens.llm.registry import fresh, query, table
from placelens.llm.tables import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK = 2048
FAN_IN = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, WORD_BREAK), lambda w: w != "")), F.lit(0)).cast("bigint")


def water_fill(sources: DataFrame, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): ``share`` of all sizes by weight, at most ``limit`` x size each.

    In the order of limit / weight the full sources come first, so one pass of running sums finds the level.
    """
    cap = F.col("source_size") * F.lit(float(limit))
    rows = sources.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    order = W.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("full", (F.col("budget") - before) * F.lit(1.0) >= F.col("ratio") * rest)
    used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    level = (F.col("budget") - used) / open_weight
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return rows.withColumn("target", target).drop("cap", "ratio", "budget", "full")


def source_targets(docs: DataFrame, source: str, size: str) -> DataFrame:
    """(source, source_size, n_docs, weight, target), one row per source; weights repeat in code point order."""
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size).alias("source_size"), F.count_if(F.col(size) > 0).alias("n_docs"))
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    return water_fill(ranked.withColumn("weight", weight))


def pivotal(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round probabilities to 0 or 1 by pairwise transfers of words; at most one stays open (its position, or -1).

    A transfer keeps the sum of size x probability, and the direction is drawn so that no probability changes in
    expectation.
    """
    p, last = p.copy(), -1
    draws = rng.random(len(p))
    for j in range(len(p)):
        if last < 0:
            last = j
            continue
        i = last
        up = min((1 - p[i]) * sizes[i], p[j] * sizes[j])
        down = min(p[i] * sizes[i], (1 - p[j]) * sizes[j])
        if draws[j] * (up + down) < down:
            move, full = up, (1 - p[i]) * sizes[i] <= p[j] * sizes[j]
            hit = (i, 1.0) if full else (j, 0.0)
        else:
            move, full = -down, p[i] * sizes[i] <= (1 - p[j]) * sizes[j]
            hit = (i, 0.0) if full else (j, 1.0)
        p[i] += move / sizes[i]
        p[j] -= move / sizes[j]
        p[hit[0]] = hit[1]
        last = j if hit[0] == i else i
        if not 1e-12 < p[last] < 1 - 1e-12:
            p[last] = round(p[last])
            last = -1
    return p, last


def _round_blocks(rows: DataFrame, level: int, seed: int, final: bool) -> DataFrame:
    def step(group: pa.Table) -> pa.Table:
        values = {c: group.column(c).to_numpy() for c in ("shuffle", "size", "p", "rank", "block")}
        order = np.lexsort((values["size"], values["shuffle"]))
        rng = np.random.default_rng([seed, level, int(values["rank"][0]), int(values["block"][0])])
        p, last = pivotal(values["size"][order].astype(float), values["p"][order], rng)
        if last >= 0 and final:
            p[last], last = float(rng.random() < p[last]), -1
        group = group.take(pa.array(order))
        for name, column in (("p", pa.array(p)), ("open", pa.array(np.arange(len(p)) == last))):
            group = group.set_column(group.schema.get_field_index(name), name, column)
        return group

    return rows.groupBy("rank", "block").applyInArrow(step, rows.schema)


def decide_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """One row (key, source, size, source_size, target, copies) per input row; texts do not move.

    Blocks hold about 2,048 documents of one source and the tree joins 256 residuals at a time, so a source that
    holds most rows is many tasks; the number of levels follows from the largest source.
    """
    units = written(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size")), "mix-units")
    targets = written(source_targets(units, "source", "size"), "mix-targets")
    blocks = max(1, -(-(targets.agg(F.max("n_docs")).first()[0] or 0) // BLOCK))
    wanted = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    per_source = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK))
    rows = units.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("wanted", wanted).withColumn("base", F.floor(F.col("wanted") + 1e-9))
    rows = rows.withColumn("p", F.greatest(F.lit(0.0), F.col("wanted") - F.col("base")))
    rows = rows.withColumn("shuffle", F.xxhash64(F.lit(seed), "key", "size")).select(
        "key",
        "source",
        "size",
        "source_size",
        "target",
        "base",
        "p",
        "shuffle",
        F.col("rank").cast("bigint").alias("rank"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "key"), per_source).cast("bigint").alias("block"),
        F.lit(False).alias("open"),
    )
    rounded = (F.col("size") > 0) & (F.col("p") > 1e-9)
    done = [rows.where(~rounded).withColumn("p", F.lit(0.0))]
    todo, level = rows.where(rounded), 0
    while True:
        out = written(_round_blocks(todo, level, seed, blocks == 1), "mix-level")
        done.append(out.where(~F.col("open")))
        if blocks == 1:
            break
        todo = out.where("open").withColumn("block", F.floor(F.col("block") / FAN_IN))
        blocks, level = -(-blocks // FAN_IN), level + 1
    whole = reduce(DataFrame.unionByName, done)
    return whole.select("key", "source", "size", "source_size", "target", (F.col("base") + F.round("p")).cast("bigint").alias("copies"))


def take_copies(docs: DataFrame, decisions: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows as often as the mix takes them, own columns only; rows with equal key, source and size share their decisions in turn."""
    size, nth, times = (fresh(docs, n) for n in ("_size", "_nth", "_times"))
    sized = docs.withColumn(size, word_count(F.col(f"`{text}`")))
    mine = [f"`{key}`", f"`{source}`", size]
    sized = sized.withColumn(nth, F.row_number().over(W.partitionBy(*mine).orderBy(F.xxhash64(F.col(f"`{text}`")))))
    turn = F.row_number().over(W.partitionBy("key", "source", "size").orderBy(F.desc("copies")))
    names = {c: fresh(sized, f"_d_{c}") for c in ("key", "source", "size", "turn")}
    d = decisions.withColumn("turn", turn).where(F.col("copies") > 0)
    d = d.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("copies").alias(times))
    on = F.col(nth) == F.col(names["turn"])
    for a, b in zip(mine, ("key", "source", "size")):
        on = on & F.col(a).eqNullSafe(F.col(names[b]))
    taken = sized.join(d, on)
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return taken.select(*columns, again.alias(fresh(taken, "_again"))).select(*columns)


@query("op5_pivotal_mix")
def op5(spark, folder):
    mixed = decide_copies(table(spark, folder, "documents"))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
