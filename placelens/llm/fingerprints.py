"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each shingle is hashed once; the upper bits choose one of ``BINS`` bins, which keeps its smallest hash. An empty
bin takes over the value of the first filled bin in an order of its own, the same for all documents. Two low bits
per bin are stored, and the chance agreement of such bits is taken out of the estimated likeness.

Null text counts as empty. A text without words has the empty fingerprint, which is like another empty one (1.0)
and unlike any other (0.0). Texts of fewer than five words have one shingle of all their words. Repeated rows get
equal fingerprints. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelens.llm.registry import query, table
from placelens.llm.textbytes import Hasher, find_words, shingles, slices, text_bytes
from placelens.session import shared_folder

BINS = 512
BITS = 2
WORDS = 5
PROBES = 48
PART_BYTES = 16 << 20
EMPTY = np.uint64(2**64 - 1)


def probe_order(bins: int = BINS) -> np.ndarray:
    """For every bin, the order in which it asks the other bins for a value."""
    return np.argsort(np.random.default_rng(71).random((bins, bins)), axis=1).astype(np.int64)


def densify(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row that has any value from the first filled bin in their own order."""
    out = values.copy()
    filled = values != EMPTY
    row, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for t in range(PROBES):
        if not len(row):
            return out
        asked = order[bin_, t]
        hit = filled[row, asked]
        out[row[hit], bin_[hit]] = values[row[hit], asked[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    # Rows with few values: rank the filled bins directly. The result is the same as further probing.
    rank = np.argsort(order, axis=1)
    for r in np.unique(row):
        own, there = bin_[row == r], np.flatnonzero(filled[r])
        best = there[np.argmin(rank[np.ix_(own, there)], axis=1)]
        out[r, own] = values[r, best]
    return out


class Fingerprinter:
    """Packed fingerprints of texts; one object per task."""

    def __init__(self, bins: int = BINS, words: int = WORDS):
        self.bins, self.words = bins, words
        self.hasher, self.order = Hasher(), probe_order(bins)

    def packed(self, column: pa.Array) -> np.ndarray:
        """One row of bytes per text, and whether it has any word (last byte)."""
        data, offsets = text_bytes(column)
        n = len(offsets) - 1
        starts, ends, rows = find_words(data, offsets)
        hashes = self.hasher.ranges(self.hasher.sums(data), starts, ends)
        grams, owner = shingles(hashes, rows, n, self.words)
        shift = np.uint64(64 - int(np.log2(self.bins)))
        values = np.full(n * self.bins, EMPTY)
        np.minimum.at(values, owner * self.bins + (grams >> shift).astype(np.int64), grams & ((np.uint64(1) << shift) - np.uint64(1)))
        values = densify(values.reshape(n, self.bins), self.order)
        low = (values & np.uint64(2**BITS - 1)).astype(np.uint8)
        per_byte = 8 // BITS
        bytes_ = np.zeros((n, self.bins // per_byte + 1), np.uint8)
        for i in range(per_byte):
            bytes_[:, :-1] |= low[:, i::per_byte] << np.uint8(BITS * i)
        bytes_[:, -1] = np.bincount(owner, minlength=n) > 0
        return bytes_


def as_text(packed: np.ndarray) -> list[str]:
    return [base64.b64encode(row[:-1].tobytes()).decode() if row[-1] else "" for row in packed]


def from_text(fingerprint: str, bins: int = BINS) -> np.ndarray:
    body = base64.b64decode(fingerprint) if fingerprint else bytes(bins * BITS // 8)
    return np.frombuffer(body + (b"\x01" if fingerprint else b"\x00"), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed rows, corrected for bits that agree by chance."""
    differ = a[:, :-1] ^ b[:, :-1]
    mask, per_byte = np.uint8(2**BITS - 1), 8 // BITS
    same = sum(((differ >> np.uint8(BITS * i)) & mask) == 0 for i in range(per_byte)).sum(axis=1) / (per_byte * differ.shape[1])
    chance = 2.0**-BITS
    found = np.clip((same - chance) / (1 - chance), 0.0, 1.0)
    return np.where((a[:, -1] > 0) & (b[:, -1] > 0), found, np.where(a[:, -1] == b[:, -1], 1.0, 0.0))


def fingerprint_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row."""

    def run(batches):
        tool = Fingerprinter()
        for batch in batches:
            offsets = text_bytes(batch.column(text))[1]
            for a, b in slices(offsets):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(as_text(tool.packed(rows.column(text))))], [key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


_RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_pairs(tool: Fingerprinter, own: list[str], following: list[str]) -> list[pa.Array]:
    """The result columns of documents and the ones that follow them."""
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(own, following)]
    a, b, c = (tool.packed(pa.array(x, pa.string())) for x in (own, edited, following))
    return [
        pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(as_text(a)),
        pa.array(as_text(b)),
        pa.array(likeness(a, b)),
        pa.array(likeness(a, c)),
    ]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, and compare with the next document by ascending doc_id.

    Null ids come last and equal ids are ordered by text. Rows are range-partitioned by id and walked in order; the
    first and last row of each range are kept beside the results, and one small join closes the seams. The walk is
    written to the shared folder, so both parts read the same ranges.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    order = [F.asc_nulls_last("doc_id"), F.asc("text")]
    # Text is no sort key of the ranges: rows of one id are few, and long texts would weigh on the sampling.
    ranged = rows.repartitionByRange(max(1, -(-total // PART_BYTES)), order[0]).sortWithinPartitions(*order)
    names = [c.split()[0] for c in _RESULT.split(", ")]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def walk(batches):
        tool, part, previous = Fingerprinter(), TaskContext.get().partitionId(), None

        def special(row, label):
            blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([row.column("doc_id"), *blank, row.column("text"), pa.array([label]), pa.array([part], pa.int32())], [*out])

        out = ["doc_id", *names, "text", "kind", "part"]
        for batch in batches:
            if not batch.num_rows:
                continue
            if previous is None:
                yield special(batch.slice(0, 1), "first")
            for a, b in slices(text_bytes(batch.column("text"))[1]):
                here = batch.slice(a, b - a)
                if previous is not None:
                    here = pa.Table.from_batches([previous, here]).combine_chunks().to_batches()[0]
                previous = here.slice(here.num_rows - 1, 1)
                n = here.num_rows - 1
                if not n:
                    continue
                texts = here.column("text").to_pylist()
                columns = compare_pairs(tool, texts[:-1], texts[1:])
                yield pa.RecordBatch.from_arrays([here.column("doc_id").slice(0, n), *columns, pa.nulls(n, pa.string()), pa.array(["row"] * n), pa.array([part] * n, pa.int32())], out)
        if previous is not None:
            yield special(previous, "last")

    folder = shared_folder(spark, "fingerprints")
    walked = ranged.mapInArrow(walk, f"doc_id {kind}, {_RESULT}, text string, kind string, part int")
    walked.write.option("compression", "zstd").parquet(folder)
    done = spark.read.parquet(folder)
    firsts = done.where("kind = 'first'").select("part", F.col("text").alias("following"))
    # One row per range, without texts: the range after each, and the first after the last.
    chain = firsts.select("part").withColumn("next", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())))
    seams = done.where("kind = 'last'").select("doc_id", "text", "part").join(chain, "part")
    seams = seams.select("doc_id", "text", "next").join(firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")

    def close(batches):
        tool = Fingerprinter()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                columns = compare_pairs(tool, row.column("text").to_pylist(), row.column("following").to_pylist())
                yield pa.RecordBatch.from_arrays([row.column("doc_id"), *columns], ["doc_id", *names])

    closed = seams.mapInArrow(close, f"doc_id {kind}, {_RESULT}")
    return done.where("kind = 'row'").select("doc_id", *names).unionByName(closed)


@query("op4_one_permutation_minhash")
def op4(spark, folder):
    return fingerprint_edits(table(spark, folder, "documents"))
