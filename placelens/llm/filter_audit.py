"""Filter interaction audit: what each filter removes, at each step of every order in which the filters can run.

Documents become counts per part and set of failed filters. The counts of a part are one tensor with an axis of length
two (pass, fail) for each filter, and a step of an order is a choice of pass, fail or all along each axis, so every
figure of every order is one contraction of that small tensor. No order is run over the documents.

Null text counts as empty and null parts as the empty string. A document is good or toxic if any of its label rows
says so. Rows that repeat a document count as often as they occur and are no copies of each other. Null ids come
last: a row without id is a copy if any row with an id has its text. Extra columns are not read. A part without
documents does not exist, so an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelens.llm.quality_rules import WORD_BREAK, let
from placelens.llm.registry import query, table

MEASURES = ("docs", "good", "toxic")
COPY = "E"
_NULL_SPREAD = 1 << 20


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D; each is true where the text fails it."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    sizes = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": let(sizes, lambda s: s["n"] < 100),
        "B": let(sizes, lambda s: 100 * s["distinct"].cast("bigint") < 80 * s["n"].cast("bigint")),
        "C": 100 * capitals.cast("bigint") > 10 * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def _code(failures: Mapping[str, Column]) -> Column:
    """Failed filters as one number, the first filter in the highest bit."""
    total = F.lit(0)
    for name in failures:
        total = total * 2 + failures[name].cast("int")
    return total


def judged_documents(docs: DataFrame, failures, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, text_hash, failed, copies): one short row per distinct document row, whatever the length of its text."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("text_hash"),
        _code(failures(whole)).alias("failed"),
    )
    return rows.groupBy("id", "part", "text_hash", "failed").agg(F.count("*").alias("copies"))


def with_labels(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add 0/1 ``good`` and ``toxic``. Rows without id match no label; they are dealt out by their text hash."""
    flag = lambda c: F.max(F.coalesce((F.col(f"`{c}`") == 1).cast("int"), F.lit(0)))
    marks = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("id"))
    marks = marks.agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).withColumn("spread", F.lit(0))
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("text_hash"), F.lit(_NULL_SPREAD))).otherwise(0)
    joined = rows.withColumn("spread", spread.cast("int")).join(marks, ["id", "spread"], "left").drop("spread")
    return joined.fillna(0, ["good", "toxic"])


def contingency(rows: DataFrame) -> DataFrame:
    """(part, failed, docs, good, toxic), the copy filter added as lowest bit of ``failed``.

    All documents of a text fail the same text filters, so a text is one row per part before its smallest id is
    looked for: a text with very many copies is as many rows as there are parts.
    """
    n = {"docs": F.col("copies"), "good": F.col("copies") * F.col("good"), "toxic": F.col("copies") * F.col("toxic")}
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *[c.alias(m) for m, c in n.items()])))
    texts = rows.groupBy("text_hash", "part", "failed").agg(*[F.sum(c).alias(m) for m, c in n.items()], first.alias("first"))
    least = F.min("first.id").over(W.partitionBy("text_hash"))
    texts = texts.withColumn("least", least)

    def original(m: str) -> Column:
        return F.when(F.col("least").isNull(), F.col(m)).when(F.col("first.id") == F.col("least"), F.col(f"first.{m}")).otherwise(0)

    kept = F.struct((F.col("failed") * 2).alias("failed"), *[original(m).alias(m) for m in MEASURES])
    copies = F.struct((F.col("failed") * 2 + 1).alias("failed"), *[(F.col(m) - original(m)).alias(m) for m in MEASURES])
    sides = texts.select("part", F.inline(F.array(kept, copies)))
    return sides.groupBy("part", "failed").agg(*[F.sum(m).alias(m) for m in MEASURES])


def all_steps(filters: Sequence[str]) -> list[tuple[str, int]]:
    """(order, position of the step in it), orders as strings of filter letters."""
    return [("".join(o), i) for o in permutations(filters) for i in range(len(filters))]


PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def contractions(tensor: np.ndarray, filters: Sequence[str]) -> dict[str, np.ndarray]:
    """Figures of every step. ``tensor`` is measures x 2 x 2 ..., one axis of (pass, fail) per filter."""
    steps = all_steps(filters)
    axes = "abcdefghijklmnopqrst"[: len(filters)]

    def contract(choose) -> np.ndarray:
        picks = [np.array([choose(order.index(f), i) for order, i in steps]) for f in filters]
        spec = f"z{axes}," + ",".join(f"y{a}" for a in axes) + "->zy"
        return np.einsum(spec, tensor, *picks)

    kept = contract(lambda at, i: PASS if at <= i else ALL)
    removed = contract(lambda at, i: PASS if at < i else FAIL if at == i else ALL)
    failing = contract(lambda at, i: FAIL if at == i else ALL)
    alone = contract(lambda at, i: FAIL if at == i else PASS)
    names = np.array([order[i] for order, i in steps])
    shapley = np.zeros(len(steps), np.int64)
    for f in filters:
        shapley[names == f] = removed[0, names == f].sum()
    return {
        "kept": kept[0],
        "removed": removed[0],
        "redundant": failing[0] - removed[0],
        "unique_fails": alone[0],
        "good_lost": removed[1],
        "toxic_lost": removed[2],
        "shapley": shapley,
    }


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """One row per part, order and step. A part travels as its counts, two to the power of the filters at most."""
    steps = all_steps(filters)
    cells = F.collect_list(F.struct("failed", *MEASURES))
    parts = counts.groupBy("part").agg(cells.alias("cells"))

    def run(batches):
        orders, at = [o for o, _ in steps], [i + 1 for _, i in steps]
        for batch in batches:
            for part, found in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                flat = np.zeros((len(MEASURES), 2 ** len(filters)), np.int64)
                for cell in found:
                    flat[:, cell["failed"]] += [cell[m] for m in MEASURES]
                figures = contractions(flat.reshape(len(MEASURES), *[2] * len(filters)), filters)
                columns = [pa.array([part] * len(steps)), pa.array(orders), pa.array(at, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(figures[f]) for f in FIGURES]], ["part", "filter_order", "step", *FIGURES])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} bigint" for f in FIGURES))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = with_labels(judged_documents(docs, text_failures), labels)
    return audit(contingency(rows), "ABCD" + COPY)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT part, w.doc_id, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
              100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
              coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT '' AS s UNION ALL SELECT s || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(s, x)),
s AS (SELECT s AS filter_order, step, ascii(substr(s, step, 1)) - 64 AS own,
             list_transform(range(1, step), lambda i: ascii(substr(s, i::INT, 1)) - 64) AS earlier
      FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE len(s) = 5),
x AS (SELECT filter_order, step, own, part, docs, good, toxic, fails[own] AS failed,
             len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda i: i)) = 1 AS single
      FROM s, c),
r AS (SELECT part, filter_order, step, own,
             sum(CASE WHEN NOT failed AND NOT gone THEN docs ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN failed AND NOT gone THEN docs ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN failed AND gone THEN docs ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN failed AND single THEN docs ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN failed AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN failed AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""


@query("op13_filter_audit", SQL)
def op13(spark, folder):
    return audit_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
