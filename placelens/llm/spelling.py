"""Spelling variants: every word, its near words and the far more frequent word it is a variant of.

Two words are near if one inserted, deleted or replaced code point makes one the other. Letters are hashed to a few
symbols, so that a word has a small reduced form; the one-edit neighbourhoods of all reduced words are generated in
full and joined with the reduced vocabulary, and what meets there is verified on the original strings. A pair of words
of unlike length is generated by deletion from the longer one, which is insertion into the shorter one, and a replaced
symbol is generated from the smaller one, so that every pair is made from one side only.

Null text has no words. A null id counts as the empty string. Repeated rows count as often as they occur. Words of any
length are taken whole; long ones are worked on letter by letter in bounded slices. Extra columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.llm.registry import query, table
from placelens.llm.tables import written
from placelens.llm.textbytes import mix, slices

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS = 7
LEAST_COUNT = 2
TYPO_EVERY = 31
RATIO = 10
#: A larger alphabet makes larger neighbourhoods and fewer pairs to verify.
SYMBOLS = 8
SLICE_LETTERS = 1 << 19


def lower_a_to_z(word: Column) -> Column:
    """Only A-Z in lower case. ASCII words, which are most, take the fast way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def typed_word(key: Column, run: Column) -> Column:
    """The lower-cased run, without one code point where the hash of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(TYPO_EVERY)) == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words with enough code points and occurrences. Runs too short for a word are not matched."""
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", lower_a_to_z(F.col("run")).alias("run")).select(typed_word(F.col("id"), F.col("run")).alias("word"))
    counts = rows.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


class Reducer:
    """Reduced forms as polynomial hashes modulo 2^64, so that each neighbour follows from the sums of its word.

    Unlike reduced words with one hash only make a pair more to verify; none can be missed.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, symbols: int = SYMBOLS):
        self.symbols = symbols
        self.inverse = np.uint64(pow(self.BASE, -1, 2**64))

    def load(self, words: pa.Array) -> None:
        letters = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8)
        self.lengths = np.asarray(pc.utf8_length(words)).astype(np.int64)
        ends = np.cumsum(self.lengths)
        self.first = ends - self.lengths
        self.owner = np.repeat(np.arange(len(words)), self.lengths)
        self.at = np.arange(len(letters)) - self.first[self.owner]
        self.s = (letters % self.symbols).astype(np.uint64) + np.uint64(1)
        powers = np.full(max(1, int(self.lengths.max(initial=0))), self.BASE, np.uint64)
        powers[0] = 1
        self.power = np.cumprod(powers)[self.at]
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.s * self.power)])
        self.before = running[:-1] - running[self.first][self.owner]
        self.total = running[ends] - running[self.first]

    def _finish(self, sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mix(sums ^ mix(lengths.astype(np.uint64))).view(np.int64)

    def keys(self) -> np.ndarray:
        return self._finish(self.total, self.lengths)

    def neighbours(self):
        """(word, key of a reduced neighbour), the word itself included; each neighbour of a word once."""
        yield np.arange(len(self.total)), self.keys()
        # Of equal symbols in a row only the first is deleted: the others leave the same word.
        new = np.ones(len(self.s), bool)
        new[1:] = (self.s[1:] != self.s[:-1]) | (self.at[1:] == 0)
        owner = self.owner[new]
        after = self.total[owner] - self.before[new] - (self.s * self.power)[new]
        yield owner, self._finish(self.before[new] + after * self.inverse, self.lengths[owner] - 1)
        for c in range(2, self.symbols + 1):
            lower = self.s < np.uint64(c)
            owner = self.owner[lower]
            sums = self.total[owner] + (np.uint64(c) - self.s[lower]) * self.power[lower]
            yield owner, self._finish(sums, self.lengths[owner])


def _word_slices(batches, column: str = "word"):
    for batch in batches:
        sizes = np.asarray(pc.utf8_length(batch.column(column))).astype(np.int64)
        for a, b in slices(np.concatenate([[0], np.cumsum(sizes)]), SLICE_LETTERS):
            yield batch.slice(a, b - a)


def reduced_vocabulary(words: DataFrame) -> DataFrame:
    """(word, n, key): the hash of the reduced word beside each word."""

    def run(batches):
        tool = Reducer()
        for rows in _word_slices(batches):
            tool.load(rows.column("word"))
            yield pa.RecordBatch.from_arrays([rows.column("word"), rows.column("n"), pa.array(tool.keys())], ["word", "n", "key"])

    return words.mapInArrow(run, "word string, n bigint, key bigint")


def reduced_neighbours(words: DataFrame) -> DataFrame:
    """(key, near_key) of one word per reduced word: all reduced words one edit away, whether they occur or not."""

    def run(batches):
        tool = Reducer()
        for rows in _word_slices(batches):
            tool.load(rows.column("word"))
            keys = tool.keys()
            for owner, near in tool.neighbours():
                yield pa.RecordBatch.from_arrays([pa.array(keys[owner]), pa.array(near)], ["key", "near_key"])

    return words.groupBy("key").agg(F.min("word").alias("word")).select("word").mapInArrow(run, "key bigint, near_key bigint")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), each pair of near words in both directions. ``words`` comes from reduced_vocabulary."""
    known = words.select(F.col("key").alias("near_key")).distinct()
    pairs = reduced_neighbours(words).join(known, "near_key")
    right = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("key").alias("near_key"))
    met = pairs.join(words, "key").join(right, "near_key")
    # Words of one reduced form meet twice.
    met = met.where((F.col("key") != F.col("near_key")) | (F.col("word") < F.col("near")))
    met = met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")
    sides = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return met.select(F.inline(sides))


def follow(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root) of all words with a form. Every round doubles how far a pointer reaches."""
    reach, at = 1, written(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while reach < hops:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        at, reach = written(step, "spelling-roots"), reach * 2
    return at


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    Each form is at least ten times as frequent as its word, so the logarithm of the largest count bounds the chains.
    """
    words = written(reduced_vocabulary(vocabulary(docs, key, text)), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.select("word", "n").join(near, "word", "left")
    far_more = -F.col("best.order") >= RATIO * F.col("n")
    rows = written(
        rows.select(
            "word",
            F.when(far_more, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(far_more, -F.col("best.order")).alias("form_n"),
        ),
        "spelling-near",
    )
    most = words.agg(F.max("n")).first()[0] or LEAST_COUNT
    roots = follow(rows.where("form IS NOT NULL"), math.ceil(math.log(most / LEAST_COUNT, RATIO)) + 1)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
keyed AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS k, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hex AS (SELECT *, hex(encode(k)) AS x FROM keyed),
bytes AS (SELECT run, c, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT) AS b FROM hex),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
             lambda h, y: xor(h // 256, t[(xor(h % 256, y) + 1)::INT])), 4294967295) AS h FROM bytes, tab),
typed AS (SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word
          FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
dels AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
         FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
pairs AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM dels a JOIN dels b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM dels a JOIN words b ON a.d = b.word
          UNION SELECT b.word, a.word, a.n FROM dels a JOIN words b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN most END AS form_n,
                 CASE WHEN most >= 10 * w.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.near_n = most) END AS form
          FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (SELECT word, word AS root FROM forms
         UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""


@query("op12_spelling_variants", SQL)
def op12(spark, folder):
    return spelling_variants(table(spark, folder, "documents"))
