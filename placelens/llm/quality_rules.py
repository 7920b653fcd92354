"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Null text counts as empty. Empty texts have no words and fail the word count. Repeated rows are judged alike,
each row by itself. Extra columns pass through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.llm.registry import fresh, query, table

# Word breaks, symbols and frequent words of the four languages.
WHITE = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the and of to in is that for with are was this"
    " der die das und ist von den mit nicht ein eine zu"
    " le la les de des et que en un une pour par"
    " el los las y del para con se por su al lo"
).split()
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """low <= metric <= high, or with ``per`` low % <= metric / per <= high %. A ratio over 0 passes."""

    name: str
    metric: str
    per: str | None = None
    low: int | None = None
    high: int | None = None

    def passes(self, column) -> Column:
        value, unit = column(self.metric), F.lit(1)
        if self.per:
            value, unit = value * 100, column(self.per)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= unit * self.low)
        if self.high is not None:
            ok = ok & (value <= unit * self.high)
        return ok


BASE_RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("repeated_words", "n_repeat_words", "n_words", high=50),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=2000),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("capitals", "n_capitals", "word_chars", high=40),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambda functions use it many times."""
    return F.transform(F.array(value), body)[0]


def repeated_window_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the array, the first occurrence included.

    Windows are sorted by hash, so equal ones are neighbours; the positions of repeated windows are sorted again
    and each adds the words that the one before it has not covered. n log n in the length of the text.
    """

    def windows(w: Column) -> Column:
        at = lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("p"))
        return F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), at))

    def positions(s: Column) -> Column:
        same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"))
        return F.aggregate(p, start, step, lambda a: a["n"])

    counted = let(words, lambda w: let(windows(w), lambda s: let(positions(s), covered)))
    return F.when(F.size(words) >= WINDOW, counted).otherwise(F.lit(0).cast("bigint"))


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def metric_columns(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    clean = lambda w: F.btrim(F.lower(w), F.lit(".,;:!?"))
    found = {
        "n_words": F.size(words),
        "word_chars": without(text, WHITE),
        "n_symbols": F.length(text) - without(text, SYMBOLS),
        "n_capitals": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_stop_words": F.size(F.filter(words, lambda w: clean(w).isin(STOP_WORDS))),
        "n_repeat_words": repeated_window_words(words),
    }
    return {k: v.cast("bigint") for k, v in found.items()}


METRICS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES, text: str = "text", verdict: str | None = None) -> DataFrame:
    """Input rows with one struct column (``verdict``): metrics, ``failed`` rule names, ``base_failed``, ``kept``."""
    verdict = verdict or fresh(docs, "quality")
    t, w, ls = (fresh(docs, f"_{n}") for n in ("whole", "words", "lines"))
    names = {m: fresh(docs, f"_m_{m}") for m in METRICS}
    every = docs.columns
    keep = [F.col(f"`{c}`") for c in every]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = docs.select(
        *keep,
        whole.alias(t),
        F.filter(F.split(whole, WORD_BREAK), lambda x: x != "").alias(w),
        F.filter(F.split(whole, "\n"), lambda x: F.translate(x, WHITE, "") != "").alias(ls),
    )
    measured = metric_columns(F.col(t), F.col(w), F.col(ls))
    values = split.select(*keep, *[c.alias(names[m]) for m, c in measured.items()])
    column = lambda m: F.col(names[m])
    names_of_failed = lambda rs: [F.when(~r.passes(column), F.lit(r.name)) for r in rs]
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | ~r.passes(column)
    kept = ~base_failed
    for r in rules:
        kept = kept & r.passes(column)
    return values.select(
        *keep,
        F.struct(
            *[column(m).alias(m) for m in METRICS],
            F.array_compact(F.array(*names_of_failed([*base, *rules]))).alias("failed"),
            base_failed.alias("base_failed"),
            kept.alias("kept"),
        ).alias(verdict),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows that pass every rule, with their own columns."""
    verdict = fresh(docs, "quality")
    return quality_rules(docs, verdict=verdict).where(F.col(f"{verdict}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
MEASURE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {{docs}}),
w AS (
  SELECT doc_id, t,
    [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM d),
each AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
wins AS (
  SELECT doc_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM wins WHERE z IS NOT NULL),
reps AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals,
    len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len([x FOR x IN ws IF trim(lower(x), '.,;:!?') IN ({_STOP_SQL})]) AS n_stop_words,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN reps ON w.doc_id = reps.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * word_chars BETWEEN 200 * n_words AND 2000 * n_words AND 100 * n_symbols <= 10 * n_words
    AND 100 * n_capitals <= 40 * word_chars AND 100 * n_dup_lines <= 50 * n_lines
    AND 100 * n_stop_words >= 2 * n_words AS fine
  FROM m)
""".replace("{{", "{").replace("}}", "}")

SQL = MEASURE_SQL.replace("{docs}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept
FROM judged
"""


@query("op8_quality_rules", SQL)
def op8(spark, folder):
    judged = quality_rules(table(spark, folder, "documents").select("doc_id", "text"), verdict="q")
    wanted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"q.{c}") for c in wanted])
