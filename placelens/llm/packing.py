"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Only the histogram of piece lengths decides how sequences are filled, and it has at most ``capacity`` entries
whatever the size of the corpus. Best-two-fit runs on the histogram: a bin is filled greedily with the longest
lengths that fit, then its shortest document makes room for two unpacked ones that leave less space. A finished
bin is a pattern of lengths that is used as often as the counts allow, and pieces find their pattern by their rank
among pieces of equal length.

Null text counts as empty and gives one piece with the end token. Repeated rows are packed each by itself. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelens.llm.registry import query, table
from placelens.llm.tables import written
from placelens.llm.textbytes import slices, text_bytes

CAPACITY = 4096
END = 1
CACHE_WORDS = 250_000
MARKS = ".,!?;:"
RANK_BLOCK = 200_000


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes, each word tokenised once.

    The tokenizer's own rules never join characters across ASCII white space, so the ids of a text are those of its
    words in a row. A word of letters, with or without sentence marks after it, is lower-cased and goes to the
    merges directly; all others take the tokenizer's whole way. Words are kept until ``CACHE_WORDS`` are known.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _any(self, words: list[str]) -> dict[str, bytes]:
        """Ids of any words by the tokenizer's own rules."""
        if not words:
            return {}
        found = self.whole.encode(words, is_pretokenized=True, add_special_tokens=False)
        data = np.array(found.ids, "<u4").tobytes()
        cuts = (4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words) + 1))).tolist()
        return {w: data[a:b] for w, a, b in zip(words, cuts, cuts[1:])}

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words of letters; the last token of each is marked as a word's end."""
        if not words:
            return {}
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        if len(cuts) != len(words) + 1:
            return self._any(words)
        data = ids.tobytes()
        return {w: data[a:b] for w, a, b in zip(words, cuts, cuts[1:])}

    def _resolve(self, words: list[str]) -> dict[str, bytes]:
        joined = "\n".join(words)
        low = joined.lower()
        if "\u03a3" in joined or not (is_normalized("NFC", joined) and is_normalized("NFC", low)):
            simple = [w.isascii() for w in words]
            odd = [w for w, ok in zip(words, simple) if not ok]
            words = [w for w, ok in zip(words, simple) if ok]
            return self._any(odd) | (self._resolve(words) if words else {})
        parts, lows = self.parts, low.split("\n")
        cores = [w.rstrip(MARKS) for w in lows]
        fits = [c.isalpha() for c in cores]
        tails = [w[len(c) :] if len(c) < len(w) else "" for w, c in zip(lows, cores)]
        found = self._letters(list({c for c, ok in zip(cores, fits) if ok and c not in parts}))
        found |= self._any([t for t in set(tails) if t and t not in parts])
        found[""] = b""
        if len(parts) + len(found) <= CACHE_WORDS:
            parts.update(found)
            found = parts
        out = {
            w: (found[c] if c in found else parts[c]) + (found[t] if t in found else parts[t])
            for w, c, t, ok in zip(words, cores, tails, fits)
            if ok
        }
        out |= self._any([w for w, ok in zip(words, fits) if not ok])
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        split, words = [_split(t) for t in texts], self.words
        missing = set().union(*split).difference(words)
        new = self._resolve(list(missing)) if missing else {}
        if len(words) + len(new) <= CACHE_WORDS:
            words.update(new)
            return [b"".join([words[w] for w in s]) for s in split]
        return [b"".join([words[w] if w in words else new[w] for w in s]) for s in split]


def _split(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every text and its end token, cut every ``capacity`` ids."""
    kind = docs.schema[key].dataType
    source = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches):
        encode = WordEncoder(tokenizer)
        tail, step = np.array([end], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            at, out = [], {"piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            offsets = text_bytes(batch.column("text"))[1]
            encoded = (ids for a, b in slices(offsets) for ids in encode(batch.column("text").slice(a, b - a).to_pylist()))
            for i, ids in enumerate(encoded):
                ids += tail
                for n, start in enumerate(range(0, len(ids), step)):
                    part = ids[start : start + step]
                    at.append(i)
                    out["piece"].append(n)
                    out["start"].append(start // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["ids"].append(part)
            columns = [batch.column(key).take(pa.array(at, pa.int64())), pa.array(out["piece"], pa.int32())]
            columns += [pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return source.mapInArrow(run, schema)


class _Stock:
    """Counts per length, and the longest length in stock up to any bound."""

    def __init__(self, counts: np.ndarray):
        self.n = counts
        self.index = np.arange(len(counts))
        self.refresh()

    def refresh(self) -> None:
        self.upto = np.maximum.accumulate(np.where(self.n > 0, self.index, 0))

    def add(self, length: int, by: int) -> None:
        before = self.n[length]
        self.n[length] += by
        if (before > 0) != (self.n[length] > 0):
            self.refresh()


def _fill(stock: _Stock, capacity: int) -> tuple[Counter, int]:
    """One bin: the longest length, then always the longest that fits. Takes it out of the stock."""
    used, gap = Counter(), capacity
    while gap and (length := int(stock.upto[gap])):
        times = int(min(stock.n[length], gap // length))
        used[length] += times
        gap -= times * length
        stock.add(length, -times)
    return used, gap


def _two_for_one(stock: _Stock, used: Counter, gap: int) -> int:
    """Swap the shortest document of a bin for two unpacked ones that fit closer, as long as that gains; the new gap."""
    while gap and sum(used.values()) > 1:
        short = min(used)
        room = gap + short
        first = np.flatnonzero(stock.n[: room + 1] > 0)
        if not len(first):
            break
        second = stock.upto[np.minimum(first, room - first)]
        # Two of the same length need two in stock; otherwise the next shorter one is the partner.
        alone = (second == first) & (stock.n[first] < 2)
        second = np.where(alone, stock.upto[np.maximum(first - 1, 0)], second)
        total = np.where(second > 0, first + second, 0)
        best = int(np.argmax(total))
        if total[best] <= short:
            break
        a, b = int(first[best]), int(second[best])
        for length, by in ((short, -1), (a, 1), (b, 1)):
            used[length] += by
            stock.add(length, -by)
        used += Counter()
        gap = room - a - b
    return gap


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(bins, {length: documents per bin}) that use up the counts.

    Every pattern leaves fewer documents of some length than it needs, so there are at most a few per length.
    """
    stock = _Stock(np.bincount(list(counts), weights=list(counts.values()), minlength=capacity + 1).astype(np.int64) if counts else np.zeros(capacity + 1, np.int64))
    found = []
    while stock.upto[capacity]:
        used, gap = _fill(stock, capacity)
        _two_for_one(stock, used, gap)
        used = {k: v for k, v in used.items() if v}
        more = min(int(stock.n[k]) // v for k, v in used.items())
        for k, v in used.items():
            stock.add(k, -more * v)
        found.append((1 + more, used))
    return found


def pattern_rows(found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, documents per bin, first sequence, offset in the bin) of every pattern entry."""
    rows, next_rank, sequence = [], Counter(), 0
    for bins, used in found:
        offset = 0
        for length in sorted(used, reverse=True):
            first = next_rank[length]
            next_rank[length] += bins * used[length]
            rows.append((length, first, next_rank[length], used[length], sequence, offset))
            offset += length * used[length]
        sequence += bins
    return rows


def pack(parts: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add (sequence_id, offset) to rows with a ``length`` of at most ``capacity``; sequences have no gaps.

    ``order`` names columns that tell rows apart; rows equal in all of them are interchangeable. Ranks within a
    length are counted in blocks of rows, so one length may hold most rows. The pattern table is broadcast: it has
    a few entries per possible length, whatever the number of rows.
    """
    spark = parts.sparkSession
    total = parts.agg(F.count("*")).first()[0]
    blocks = max(1, -(-total // RANK_BLOCK))
    rows = parts.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    per_block = written(rows.groupBy("length", "_block").agg(F.count("*").alias("_n")), "pack-lengths")
    counts = dict(per_block.groupBy("length").agg(F.sum("_n")).collect())
    entries = pattern_rows(patterns({int(k): int(v) for k, v in counts.items()}, capacity))
    plan = spark.createDataFrame(entries, "_l bigint, _first bigint, _end bigint, _each bigint, _seq bigint, _off bigint")
    upto = W.partitionBy("length").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = per_block.select("length", "_block", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    local = F.row_number().over(W.partitionBy("length", "_block").orderBy(*order))
    ranked = rows.withColumn("_local", local).join(bases, ["length", "_block"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_local") - 1)
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    nth = F.col("_rank") - F.col("_first")
    return placed.select(
        *parts.columns,
        (F.col("_seq") + F.floor(nth / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_off") + F.pmod(nth, F.col("_each")) * F.col("length")).cast("bigint").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) with the token bytes of every sequence; needs pieces made with ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of all documents with their place; token ids stay in the tasks that made them."""
    return pack(written(pieces(docs, tokenizer, with_ids=False), "pack-pieces"), ["doc_id", "piece", "ids_crc32"])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_best_two_fit")
def op7(spark, folder):
    return pack_documents(table(spark, folder, "documents"), tokenizer_path())
