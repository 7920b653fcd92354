"""Repeated passages through a sparse enhanced suffix array and its common-prefix interval tree.

Suffixes are taken at anchors: in every window of ``length - GRAM + 1`` byte positions the one with the smallest
hash of the next ``GRAM`` bytes. Two equal strings of ``length`` bytes have the same anchor at the same place, so
repeats meet at anchors although only one position in 26 is looked at.

Suffixes of one anchor string are sorted by what follows; the common prefixes of neighbours give the interval tree,
which is scanned with a stack. An interval is a set of occurrences that share a right part; inside it the
occurrences are sorted by what stands before them, and a second scan tests where their left extensions differ. Each
interval of the second scan is a maximal repeat with all its occurrences: it can be extended neither way.
Occurrences in the same surroundings (a whole window on either side) count as one suffix, their copies are covered
as a whole.

Null text counts as empty. Texts below ``length`` bytes keep everything. Rows that repeat an id are one document
(rows with the same text keep the same bytes; rows with other text are not told apart); rows without an id are one
document, the last. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.llm.packed import bucket_count, pack, runs, text_size, unpack
from placelens.llm.registry import query, table
from placelens.llm.tables import written
from placelens.llm.textbytes import Hasher, batch_slices, mix, text_bytes

LENGTH = 100
GRAM = 50
REACH = LENGTH - GRAM
KEY_BUCKET_BYTES = 4 << 20
DOC_BUCKET_BYTES = 4 << 20
WIDE = 256
PIECE_BYTES = 1 << 20
LAST = np.int64(2**63 - 1)
POSITION_BITS = np.uint64(22)


def row_ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def find_anchors(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions with the smallest hash in any window of REACH + 1 positions that lies inside a text.

    ``grams[i]`` is the hash of the GRAM bytes from i; a text is [start, end). Of equal hashes the first counts.
    """
    n, window = len(grams), REACH + 1
    if n < window:
        return np.empty(0, np.int64)
    low = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
    least = (grams & ~low) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= window:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < window:
        rest = window - size
        least = np.minimum(least[: len(least) - rest], least[rest:])
    inside = np.zeros(len(least) + 1, np.int32)
    fits = ends - starts >= LENGTH
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - LENGTH + 1, -1)
    chosen = (least[np.cumsum(inside[:-1]) > 0] & low).astype(np.int64)
    return chosen[np.diff(chosen, prepend=-1) != 0]


def anchors_of(batch: pa.RecordBatch, hasher: Hasher):
    """(ids, positions, anchor hashes, hashes of the surroundings) of a batch, slice by slice.

    Long texts go through in overlapping pieces, each with the windows that start in it.
    """
    for rows, data, offsets in batch_slices(batch):
        ids = row_ids(rows.column("doc_id"))
        sums = hasher.sums(data)
        starts, ends = offsets[:-1], offsets[1:]
        pieces = []
        for a in range(0, max(1, len(data)), PIECE_BYTES):
            b = min(len(data), a + PIECE_BYTES + LENGTH - 1)
            if b - a < LENGTH:
                continue
            at = np.arange(a, b - GRAM + 1)
            near = slice(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left"))
            grams = hasher.ranges(sums, at, at + GRAM)
            pieces.append(find_anchors(grams, np.clip(starts[near], a, b) - a, np.clip(ends[near], a, b) - a) + a)
        place = np.unique(np.concatenate(pieces)) if pieces else np.empty(0, np.int64)
        if not len(place):
            continue
        row = np.searchsorted(offsets, place, "right") - 1
        left, right = np.maximum(starts[row], place - REACH), np.minimum(ends[row], place + LENGTH)
        around = hasher.ranges(sums, left, right)
        around = mix(around ^ ((place - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        yield ids[row], place - starts[row], hasher.ranges(sums, place, place + GRAM), around


def _send(parts: list, n: int, names: list[str]) -> pa.RecordBatch:
    rows = [p for p in parts if p is not None]
    columns = []
    for name in names:
        kind = pa.int32() if name == "bucket" else pa.binary()
        columns.append(pa.chunked_array([p.column(name) if name in p.schema.names else pa.nulls(p.num_rows, kind) for p in rows], kind).combine_chunks() if rows else pa.array([], kind))
    return pa.RecordBatch.from_arrays(columns, names)


def _doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _by_class(keys: np.ndarray, around: np.ndarray, ids: np.ndarray, places: np.ndarray):
    """Order by (key, surroundings, id, place), which rows lead their class, which stand elsewhere than their leader."""
    order = np.lexsort((places, ids, around, keys))
    first, ends = runs(keys[order], around[order]) if len(order) else (np.empty(0, np.int64),) * 2
    leads = np.zeros(len(order), bool)
    leads[first] = True
    leader = order[np.repeat(first, ends - first)]
    return order, leads, (ids[order] != ids[leader]) | (places[order] != places[leader])


ANCHOR_COLUMNS = ["bucket", "keys", "around", "ids", "places", "wide", "copy_ids", "copy_places", "wide_ids", "wide_places"]
FOUND_COLUMNS = ["bucket", "copy_ids", "copy_places", "edge_ids", "edge_places", "edge_keys", "wide_ids", "wide_places"]


def repeated_anchors(docs: DataFrame, key_buckets: int, doc_buckets: int) -> DataFrame:
    """Per bucket of documents, packed: copies (a class leader stands earlier), edges (leaders of one anchor string
    with several classes) and wide (anchors of a string with very many classes).

    A task keeps one leader per class, so copies are one entry per task at the exchange. A string that has over
    ``WIDE`` classes in one task is marked wide; its occurrences go another way, so that no task gathers them.
    """

    def scan(batches):
        hasher = Hasher()
        for batch in batches:
            found = list(anchors_of(batch, hasher))
            if not found:
                continue
            ids, places, keys, around = (np.concatenate(x) for x in zip(*found))
            order, leads, elsewhere = _by_class(keys, around, ids, places)
            copies = order[elsewhere]
            heads = order[leads]
            first, ends = runs(keys[heads])
            wide = np.repeat(ends - first > WIDE, ends - first)
            mark = heads[first[ends - first > WIDE]]
            out, sent = heads[wide], np.append(heads[~wide], mark)
            flags = np.append(np.zeros(len(heads) - len(out), np.uint8), np.ones(len(mark), np.uint8))
            bucket = (keys[sent] % np.uint64(key_buckets)).astype(np.int64)
            spread = lambda at: (mix(ids[at].astype(np.uint64)) % np.uint64(key_buckets)).astype(np.int64)  # noqa: E731, B023
            yield _send(
                [
                    pack(bucket, {"keys": keys[sent], "around": around[sent], "ids": ids[sent], "places": places[sent].astype(np.uint32), "wide": flags}, ["ids"]),
                    pack(spread(copies), {"copy_ids": ids[copies], "copy_places": places[copies].astype(np.uint32)}, ["copy_ids"]),
                    pack(spread(out), {"wide_ids": ids[out], "wide_places": places[out].astype(np.uint32)}, ["wide_ids"]),
                ],
                key_buckets,
                ANCHOR_COLUMNS,
            )

    def settle(group: pa.Table) -> pa.Table:
        keys, around = unpack(group, "keys", np.uint64), unpack(group, "around", np.uint64)
        ids, places, flags = unpack(group, "ids"), unpack(group, "places", np.uint32), unpack(group, "wide", np.uint8)
        copy_ids, copy_places = unpack(group, "copy_ids"), unpack(group, "copy_places", np.uint32)
        wide_ids, wide_places = unpack(group, "wide_ids"), unpack(group, "wide_places", np.uint32)
        by_key = np.argsort(keys, kind="stable")
        first, ends = runs(keys[by_key]) if len(keys) else (np.empty(0, np.int64),) * 2
        again = by_key[np.repeat(ends - first > 1, ends - first)]
        alone = by_key[np.repeat(ends - first == 1, ends - first)]
        lone_wide = alone[flags[alone] > 0]
        k, c, d, p, w = (x[again] for x in (keys, around, ids, places, flags))
        order, leads, elsewhere = _by_class(k, c, d, p)
        first, ends = runs(k[order]) if len(k) else (np.empty(0, np.int64),) * 2
        length = ends - first
        classes = np.add.reduceat(leads, first) if len(first) else np.empty(0, np.int64)
        is_wide = np.repeat((np.add.reduceat(w[order], first) > 0) if len(first) else np.empty(0, bool), length)
        several = np.repeat(classes > 1, length)
        more = order[elsewhere]
        edge, out = order[leads & several & ~is_wide], order[leads & is_wide]
        copy_ids, copy_places = np.append(copy_ids, d[more]), np.append(copy_places, p[more])
        wide_ids = np.concatenate((wide_ids, d[out], ids[lone_wide]))
        wide_places = np.concatenate((wide_places, p[out], places[lone_wide]))
        sent = _send(
            [
                pack(_doc_bucket(copy_ids, doc_buckets), {"copy_ids": copy_ids, "copy_places": copy_places.astype(np.uint32)}, ["copy_ids"]),
                pack(_doc_bucket(d[edge], doc_buckets), {"edge_ids": d[edge], "edge_places": p[edge], "edge_keys": k[edge]}, ["edge_ids"]),
                pack(_doc_bucket(wide_ids, doc_buckets), {"wide_ids": wide_ids, "wide_places": wide_places.astype(np.uint32)}, ["wide_ids"]),
            ],
            doc_buckets,
            FOUND_COLUMNS,
        )
        return pa.Table.from_batches([sent])

    sent = docs.mapInArrow(scan, _schema(ANCHOR_COLUMNS))
    return sent.groupBy("bucket").applyInArrow(settle, _schema(FOUND_COLUMNS))


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {'int' if n == 'bucket' else 'binary'}" for n in names)


CONTEXT_COLUMNS = ["bucket", "keys", "ids", "places", "lefts", "rights", "windows", "window_ids", "window_places", "late_ids", "late_places"]


class TextBucket:
    """The texts of a bucket by id: bytes end to end, and where each id is."""

    def __init__(self, texts: pa.Table):
        batch = texts.combine_chunks().to_batches() if texts.num_rows else []
        ids = row_ids(batch[0].column("doc_id")) if batch else np.empty(0, np.int64)
        self.data, self.offsets = text_bytes(batch[0].column("text")) if batch else (np.empty(0, np.uint8), np.zeros(1, np.int64))
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]

    def rows(self, ids: np.ndarray) -> np.ndarray:
        return self.order[np.searchsorted(self.ids, ids)]


def contexts(texts: DataFrame, found: DataFrame, key_buckets: int) -> DataFrame:
    """Surroundings of the edges, and hashes of all strings of full length around wide anchors, by anchor string."""

    def step(texts: pa.Table, found: pa.Table) -> pa.Table:
        bucket = TextBucket(texts)
        ids, places, keys = unpack(found, "edge_ids"), unpack(found, "edge_places", np.uint32).astype(np.int64), unpack(found, "edge_keys", np.uint64)
        row = bucket.rows(ids) if len(ids) else np.empty(0, np.int64)
        start, end = bucket.offsets[row], bucket.offsets[row + 1]
        at = start + places
        n_left, n_right = np.minimum(REACH, at - start).astype(np.uint8), np.minimum(LENGTH, end - at).astype(np.uint8)
        padded = np.concatenate((np.zeros(REACH, np.uint8), bucket.data, np.zeros(LENGTH, np.uint8)))
        lefts = padded[(at + REACH - 1)[:, None] - np.arange(REACH)]
        rights = padded[(at + REACH)[:, None] + np.arange(LENGTH)]
        lefts[np.arange(REACH) >= n_left[:, None]] = 0
        rights[np.arange(LENGTH) >= n_right[:, None]] = 0
        lefts, rights = np.column_stack((n_left, lefts)), np.column_stack((n_right, rights))
        wide_ids, wide_places = unpack(found, "wide_ids"), unpack(found, "wide_places", np.uint32).astype(np.int64)
        row = bucket.rows(wide_ids) if len(wide_ids) else np.empty(0, np.int64)
        spots = (wide_places[:, None] - np.arange(REACH + 1)).ravel()
        row = np.repeat(row, REACH + 1)
        fits = (spots >= 0) & (bucket.offsets[row] + spots + LENGTH <= bucket.offsets[row + 1])
        whole = np.unique(bucket.offsets[row[fits]] + spots[fits])
        hasher = Hasher(seed=5)
        windows = hasher.ranges(hasher.sums(bucket.data), whole, whole + LENGTH) if len(whole) else np.empty(0, np.uint64)
        row = np.searchsorted(bucket.offsets, whole, "right") - 1
        back = np.empty(len(bucket.ids), np.int64)
        back[bucket.order] = bucket.ids
        window_ids, spots = back[row], whole - bucket.offsets[row]
        lead, late = _firsts(windows, window_ids, spots)
        spread = (mix(window_ids[late].astype(np.uint64)) % np.uint64(key_buckets)).astype(np.int64)
        sent = _send(
            [
                pack((keys % np.uint64(key_buckets)).astype(np.int64), {"keys": keys, "ids": ids, "places": places.astype(np.uint32), "lefts": lefts, "rights": rights}, ["ids"]),
                pack((windows[lead] % np.uint64(key_buckets)).astype(np.int64), {"windows": windows[lead], "window_ids": window_ids[lead], "window_places": spots[lead].astype(np.uint32)}, ["window_ids"]),
                pack(spread, {"late_ids": window_ids[late], "late_places": spots[late].astype(np.uint32)}, ["late_ids"]),
            ],
            key_buckets,
            CONTEXT_COLUMNS,
        )
        return pa.Table.from_batches([sent])

    return texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(step, _schema(CONTEXT_COLUMNS))


def _firsts(hashes: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first holder of each hash, holders in other places) as positions."""
    order = np.lexsort((places, ids, hashes))
    first, ends = runs(hashes[order]) if len(order) else (np.empty(0, np.int64),) * 2
    leader = order[np.repeat(first, ends - first)]
    return order[first], order[(ids[order] != ids[leader]) | (places[order] != places[leader])]


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the tree with a common prefix of at least ``least``.

    ``common[i]`` is that of suffixes i and i + 1. An interval is the largest run of suffixes with its prefix.
    """
    out, stack = [], []
    for i, c in enumerate([*common.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > c:
            depth, first = stack.pop()
            out.append((depth, first, i))
        if c >= least and (not stack or stack[-1][0] < c):
            stack.append((c, first))
    return out


def _common(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the next, within their lengths."""
    if len(rows) < 2:
        return np.empty(0, np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))


def _words_of(rows: np.ndarray) -> list[np.ndarray]:
    """The bytes of each row as big-endian 64-bit columns, which sort as the bytes do."""
    wide = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), wide), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return list(np.ascontiguousarray(padded).view(">u8").astype(np.uint64).T)


def repeat_groups(keys: np.ndarray, lefts: np.ndarray, rights: np.ndarray, length: int = LENGTH):
    """(bytes before, bytes after the anchor, members) of every maximal repeat of at least ``length`` bytes.

    ``lefts`` and ``rights`` hold a length byte and the bytes before (nearest first) and after each anchor. Rows of
    one key are one sorted piece of the suffix array; members are row numbers.
    """
    n_left, n_right, left, right = lefts[:, 0], rights[:, 0], lefts[:, 1:], rights[:, 1:]
    order = np.lexsort([*reversed(_words_of(right)), keys])
    common = _common(right[order], n_right[order])
    common[keys[order][1:] != keys[order][:-1]] = 0
    found = intervals(common, length - REACH)
    pairs = [(c, a) for c, a, b in found if b == a + 1]
    if pairs:
        depth, at = (np.array(x) for x in zip(*pairs))
        x, y = order[at], order[at + 1]
        differ = left[x] != left[y]
        before = np.where(differ.any(axis=1), differ.argmax(axis=1), left.shape[1])
        before = np.minimum(before, np.minimum(n_left[x], n_left[y]))
        for i in np.flatnonzero(before + depth >= length):
            yield int(before[i]), int(depth[i]), np.array([x[i], y[i]])
    for depth, a, b in found:
        if b == a + 1:
            continue
        members = order[a : b + 1]
        by_left = members[np.lexsort([*reversed(_words_of(left[members]))])]
        shared = _common(left[by_left], n_left[by_left])
        if depth >= length and len(members) > 1 and (not len(shared) or shared.min() == 0):
            yield 0, depth, by_left
        for before, first, last in intervals(shared, max(1, length - depth)):
            yield before, depth, by_left[first : last + 1]


COVER_COLUMNS = ["bucket", "cover_ids", "cover_starts", "cover_ends"]


def coverage(context: DataFrame, doc_buckets: int) -> DataFrame:
    """Byte ranges that every occurrence of a maximal repeat but the first covers, by bucket of documents."""

    def step(group: pa.Table) -> pa.Table:
        ids, places = unpack(group, "ids"), unpack(group, "places", np.uint32).astype(np.int64)
        keys = unpack(group, "keys", np.uint64)
        lefts = unpack(group, "lefts", np.uint8).reshape(-1, REACH + 1)
        rights = unpack(group, "rights", np.uint8).reshape(-1, LENGTH + 1)
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((places, ids))] = np.arange(len(ids))
        parts = []
        for before, after, members in repeat_groups(keys, lefts, rights):
            first = members[np.argmin(rank[members])]
            later = members[(ids[members] != ids[first]) | (places[members] != places[first])]
            parts.append((ids[later], places[later] - before, places[later] + after))
        windows, window_ids = unpack(group, "windows", np.uint64), unpack(group, "window_ids")
        spots = unpack(group, "window_places", np.uint32).astype(np.int64)
        late = _firsts(windows, window_ids, spots)[1]
        parts.append((window_ids[late], spots[late], spots[late] + LENGTH))
        late_ids, late_places = unpack(group, "late_ids"), unpack(group, "late_places", np.uint32).astype(np.int64)
        parts.append((late_ids, late_places, late_places + LENGTH))
        ids, starts, ends = (np.concatenate(x) for x in zip(*parts))
        sent = pack(_doc_bucket(ids, doc_buckets), {"cover_ids": ids, "cover_starts": starts.astype(np.uint32), "cover_ends": ends.astype(np.uint32)}, ["cover_ids"])
        return pa.Table.from_batches([_send([sent], doc_buckets, COVER_COLUMNS)])

    return context.groupBy("bucket").applyInArrow(step, _schema(COVER_COLUMNS))


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal runs, ascending."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:] - 1, len(s) - 1)]


def remove_covered(texts: DataFrame, covers: DataFrame, id_type: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row of ``texts``."""

    def step(texts: pa.Table, covers: pa.Table) -> pa.Table:
        cover_ids = np.append(unpack(covers, "cover_ids"), unpack(covers, "copy_ids"))
        places = unpack(covers, "copy_places", np.uint32).astype(np.int64)
        starts = np.append(unpack(covers, "cover_starts", np.uint32).astype(np.int64), np.maximum(0, places - REACH))
        ends = np.append(unpack(covers, "cover_ends", np.uint32).astype(np.int64), places + LENGTH)
        order = np.argsort(cover_ids, kind="stable")
        cover_ids, starts, ends = cover_ids[order], starts[order], ends[order]
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        texts = texts.combine_chunks()
        ids = row_ids(texts.column("doc_id").combine_chunks()) if texts.num_rows else np.empty(0, np.int64)
        data, offsets = text_bytes(texts.column("text").combine_chunks()) if texts.num_rows else (np.empty(0, np.uint8), np.zeros(1, np.int64))
        for i, doc in enumerate(ids):
            raw = data[offsets[i] : offsets[i + 1]]
            a, b = np.searchsorted(cover_ids, doc, "left"), np.searchsorted(cover_ids, doc, "right")
            spans = []
            if b > a:
                s, e = _merged(np.minimum(starts[a:b], len(raw)), np.minimum(ends[a:b], len(raw)))
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(s, e) if y > x]
            kept, at = hashlib.sha256(), 0
            for span in spans:
                kept.update(raw[at : span["start"]])
                at = span["end"]
            kept.update(raw[at:])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(x["end"] - x["start"] for x in spans))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(kept.hexdigest())
            out["spans"].append(spans)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        columns = [texts.column("doc_id"), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]]
        return pa.Table.from_arrays(columns, ["doc_id", *out])

    schema = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>"
    return texts.groupBy("bucket").cogroup(covers.groupBy("bucket")).applyInArrow(step, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove every byte of a repeat of 100 bytes that stands earlier; one row per document with its removed spans.

    The text is read once for anchors and moves once, by document; both steps that need it share that exchange.
    """
    total = text_size(docs)
    key_buckets, doc_buckets = bucket_count(total, KEY_BUCKET_BYTES), bucket_count(total, DOC_BUCKET_BYTES)
    rows = docs.select("doc_id", "text")
    found = written(repeated_anchors(rows, key_buckets, doc_buckets), "repeats-anchors")

    def bucket_of(batches):
        for batch in batches:
            bucket = pa.array(_doc_bucket(row_ids(batch.column("doc_id")), doc_buckets), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), bucket], ["doc_id", "text", "bucket"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = rows.mapInArrow(bucket_of, f"doc_id {kind}, text string, bucket int")
    covers = coverage(contexts(texts, found, key_buckets), doc_buckets)
    copies = found.select("bucket", "copy_ids", "copy_places").where("copy_ids is not null")
    whole = covers.unionByName(copies, allowMissingColumns=True)
    return remove_covered(texts, whole, kind)


@query("op3_maximal_repeats")
def op3(spark, folder):
    return remove_repeats(table(spark, folder, "documents")).drop("spans")
