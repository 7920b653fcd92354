"""Exact Jaccard self-join of word n-gram sets in a metric space, and the groups that its links make.

Jaccard distance is a metric, but texts that share nothing are all at distance 1 from each other, so pivots alone
would leave nearly the whole corpus in one region. The first regions are therefore made by shared content: shingles
are dealt by hash into one class more than two linked sets can differ in, so linked sets agree in a whole class, and
sets that agree in a class are in one region. Inside a region a pivot takes over:

* every member is compared with the pivot; members within the distance are linked through it;
* the rest lie in rings around the pivot. By the triangle inequality only rings at most one threshold apart can hold
  linked pairs, so a ring is joined with itself and the next one;
* a pair is compared through its differences from the pivot. A linked pair without a common difference is linked
  to the pivot on both sides already, so only pairs with a common difference are counted.

Rings are cut into blocks of bounded size; equal sets count once. No link between different sets is lost: see the
proofs at the functions. Hashes of 64 bits stand for shingles.

Null or wordless texts have empty sets and are linked with nothing. Rows without an id are counted but linked with
nothing. Rows that repeat an id share its component. Extra columns pass through ``keep_first`` and are not read
otherwise. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelens.llm.components import Forest, components, one_edge_each
from placelens.llm.packed import bucket_count, pack, runs, text_size, unpack
from placelens.llm.registry import fresh, query, table
from placelens.llm.tables import written
from placelens.llm.textbytes import Hasher, batch_slices, find_words, lower_ascii, mix, shingles

WORDS = 3
PERCENT = 90
BUCKET_BYTES = 4 << 20
MEMBER_BYTES = 32 << 20
RING_BLOCK = 4096
PARTITION_SEEDS = (11, 12, 13, 14)
FAMILY_CHUNK = 256
BAND = 1.6
SAMPLE_DOCS = 50_000
LEAST_COMMON = 5
MAX_COMMON = 400_000
KEY_BITS = np.uint64(40)


def shingle_sets(batch: pa.RecordBatch, hasher: Hasher, width: int):
    """(row number, sorted distinct shingle hashes) of every row of a batch."""
    at = 0
    for rows, data, offsets in batch_slices(batch):
        data = lower_ascii(data)
        starts, ends, owner = find_words(data, offsets)
        words = hasher.ranges(hasher.sums(data), starts, ends)
        grams, owner = shingles(words, owner, rows.num_rows, width)
        bounds = np.searchsorted(owner, np.arange(rows.num_rows + 1))
        for i in range(rows.num_rows):
            own = np.sort(grams[bounds[i] : bounds[i + 1]])
            if len(own) > 1:
                own = own[np.append(True, own[1:] != own[:-1])]
            yield at + i, own
        at += rows.num_rows


class SizeBands:
    """Bands of set sizes, each ``BAND`` times as wide as its start; linked sets are in the same or neighbouring bands.

    As 100 / percent is below ``BAND``, a set smaller than a band's start is not linked to one beyond its end.
    """

    def __init__(self, percent: int):
        self.percent, self.starts, self.known = percent, [1], {}

    def _reach(self, size: int) -> None:
        while self.starts[-1] <= size:
            start = self.starts[-1]
            self.starts.append(max(-(-start * 100 // self.percent) + 1, int(start * BAND)))

    def tags(self, size: int) -> list[int]:
        """The bands in which a set of this size meets others: its own, and the next if a set in that may be linked."""
        self._reach(size)
        band = int(np.searchsorted(self.starts, size, "right")) - 1
        return [band, band + 1] if 100 * size >= self.percent * self.starts[band + 1] else [band]

    def classes(self, band: int) -> tuple[int, int]:
        """(number of classes, most shingles in which linked sets of this band can differ).

        J >= t means |x delta y| <= (1 - t) / (1 + t) * (|x| + |y|), and neither is over the end of the band. There
        are enough classes for the smallest sets to fill one more than that number, with a margin.
        """
        if band not in self.known:
            while band + 1 >= len(self.starts):
                self._reach(self.starts[-1])
            largest, smallest = self.starts[band + 1] - 1, max(1, self.starts[band] * self.percent // 100)
            differ = (100 - self.percent) * 2 * largest // (100 + self.percent)
            n = differ + 1
            while n < 4 * (differ + 1):
                empty = (1 - 1 / n) ** smallest
                if n * (1 - empty) - (n * empty * (1 - empty)) ** 0.5 >= differ + 1:
                    break
                n += max(1, n // 64)
            self.known[band] = n, differ
        return self.known[band]


def region_keys(own: np.ndarray, rare: np.ndarray, bands: SizeBands) -> np.ndarray:
    """Keys of which linked sets share at least one; ``rare`` is the set without common shingles.

    Linked sets differ in at most ``differ`` classes. If one of them fills more than that many, the classes in which
    they agree are not all empty, so they share the key of a filled one. Common shingles are left out first, which
    takes them from both sets and adds no difference. Where too few classes are filled, the whole set is dealt anew
    with other seeds; linked sets that both come to that share a key there. After the last seed empty classes count.
    """
    out = []
    for tag in bands.tags(len(own)):
        n, differ = bands.classes(tag)
        for step, seed in enumerate(PARTITION_SEEDS):
            salted = mix((own if step else rare) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
            part = (salted % np.uint64(n)).astype(np.int64)
            total = np.zeros(n, np.uint64)
            np.add.at(total, part, mix(salted + np.uint64(1)))
            filled = np.bincount(part, minlength=n) > 0
            label = np.arange(n, dtype=np.uint64) + np.uint64((tag * 31 + seed) << 32)
            keys = mix(total ^ mix(label))
            if filled.sum() > differ:
                out.append(keys[filled])
                break
            out.append(keys if seed == PARTITION_SEEDS[-1] else keys[filled])
    return np.concatenate(out)


class Common:
    """Membership in the common shingles, with a table of bits that settles most questions."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.mask = np.sort(hashes), np.uint64((1 << 22) - 1)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes & self.mask).astype(np.int64)] = True

    def without(self, own: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(own & self.mask).astype(np.int64)])
        if not len(maybe):
            return own
        at = np.minimum(np.searchsorted(self.hashes, own[maybe]), len(self.hashes) - 1)
        return np.delete(own, maybe[self.hashes[at] == own[maybe]])


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles of several of about ``SAMPLE_DOCS`` sampled texts, at most ``MAX_COMMON``.

    They only steer the work: whatever they are, no link is lost. Passages that many documents share are not keys.
    """
    total = docs.count()
    if not total:
        return np.empty(0, np.uint64)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, total // SAMPLE_DOCS))) == 0)

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            sets = [own for _, own in shingle_sets(batch, hasher, width)]
            hashes, n = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counted = sample.select("text").distinct().mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= LEAST_COMMON).orderBy(F.desc("n"), "h").limit(MAX_COMMON).select("h").toPandas()["h"]
    return found.to_numpy(np.int64).view(np.uint64)


def short_keys(keys: np.ndarray) -> np.ndarray:
    """The low 40 bits of each key. A bucket has a bounded number of keys, so few meet by chance, and one that does
    only makes a region larger."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5]


def long_keys(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = data.reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of first holders, members, centres): each key's smallest id, and distinct edges of the others to it."""
    order = np.lexsort((ids, keys))
    k, d = keys[order], ids[order]
    first, ends = runs(k) if len(k) else (np.empty(0, np.int64), np.empty(0, np.int64))
    centre = np.repeat(d[first], ends - first)
    edge = d != centre
    pairs = np.unique(np.stack([d[edge], centre[edge]]), axis=1) if edge.any() else np.empty((2, 0), np.int64)
    return order[first], pairs[0], pairs[1]


def regions_and_sizes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(kind, a, b, n, d1, d2): sets (kind 1: id, size, 128-bit digest) and edges between sets that share a key (kind 0).

    A task links the holders of a key among its own rows and sends on one of them, so a key that a third of all
    rows hold is one entry per task at the exchange.
    """
    size = text_size(docs)
    n_buckets = bucket_count(size, BUCKET_BYTES)
    everywhere = common_shingles(docs, width)
    columns = {"keys": np.uint64, "ids": None, "src": None, "dst": None, "info": None}

    def find(batches):
        hasher, bands, common = Hasher(), SizeBands(percent), Common(everywhere)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            keys, owners, sizes, digests = [], [], np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows), np.uint64)
            for i, own in shingle_sets(batch, hasher, width):
                sizes[i] = len(own)
                if len(own):
                    digests[0, i], digests[1, i] = np.add.reduce(mix(own + np.uint64(7))), np.add.reduce(mix(own ^ np.uint64(0xA5A5A5A5)))
                    if known[i]:
                        keys.append(region_keys(own, common.without(own), bands))
                        owners.append(np.full(len(keys[-1]), ids[i]))
            info = np.stack([np.where(known, ids, 0), known.astype(np.int64), sizes, digests[0].view(np.int64), digests[1].view(np.int64)], axis=1)
            spread = (mix(np.arange(len(ids), dtype=np.uint64) // np.uint64(512)) % np.uint64(n_buckets)).astype(np.int64)
            keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            owners = np.concatenate(owners) if owners else np.empty(0, np.int64)
            first, members, centres = _stars(keys, owners)
            sent, held = keys[first], owners[first]
            yield _row_set(pack(((sent >> KEY_BITS) % np.uint64(n_buckets)).astype(np.int64), {"keys": short_keys(sent), "ids": held}, ["ids"]), columns)
            yield _row_set(pack((mix(members.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64), {"src": members, "dst": centres}, ["src", "dst"]), columns)
            yield _row_set(pack(spread, {"info": info}), columns)

    n_members = bucket_count(size, MEMBER_BYTES)
    packed = "bucket int, src binary, dst binary, info binary"

    def reduce_bucket(group: pa.Table) -> pa.Table:
        _, members, centres = _stars(long_keys(unpack(group, "keys", np.uint8)), unpack(group, "ids"))
        # Every key has its own centre; one edge per member keeps what they connect.
        a, b = one_edge_each(np.append(members, unpack(group, "src")), np.append(centres, unpack(group, "dst")))
        info = unpack(group, "info", np.int64).reshape(-1, 5)
        by_member = (mix(a.astype(np.uint64)) % np.uint64(n_members)).astype(np.int64)
        by_row = (mix(info[:, 0].astype(np.uint64)) % np.uint64(n_members)).astype(np.int64)
        names = {"src": None, "dst": None, "info": None}
        parts = [pack(by_member, {"src": a, "dst": b}, ["src", "dst"]), pack(by_row, {"info": info})]
        return pa.Table.from_batches([_row_set(p, names) for p in parts])

    def settle(group: pa.Table) -> pa.Table:
        pairs = np.stack(one_edge_each(unpack(group, "src"), unpack(group, "dst")))
        info = unpack(group, "info", np.int64).reshape(-1, 5)
        n_e, n_i = pairs.shape[1], len(info)
        none = lambda n: pa.nulls(n, pa.int64())
        ids = pa.array(info[:, 0], mask=info[:, 1] == 0)
        edges = [pa.array(np.zeros(n_e, np.int32)), pa.array(pairs[0]), pa.array(pairs[1]), none(n_e), none(n_e), none(n_e)]
        sets = [pa.array(np.ones(n_i, np.int32)), ids, none(n_i), *[pa.array(np.ascontiguousarray(info[:, j])) for j in (2, 3, 4)]]
        return pa.concat_tables(pa.Table.from_arrays(x, ["kind", "a", "b", "n", "d1", "d2"]) for x in (edges, sets))

    sent = docs.select("doc_id", "text").mapInArrow(find, "bucket int, keys binary, ids binary, src binary, dst binary, info binary")
    regions = sent.groupBy("bucket").applyInArrow(reduce_bucket, packed)
    # A set meets others in many buckets; it has one edge once the buckets' edges are sorted by member.
    whole = regions.groupBy("bucket").applyInArrow(settle, "kind int, a bigint, b bigint, n bigint, d1 bigint, d2 bigint")
    return written(whole, "jaccard-regions")


def _row_set(packed: pa.RecordBatch | None, columns: dict) -> pa.RecordBatch:
    """The packed rows with all columns of the exchange; those that are not theirs stay null."""
    n = packed.num_rows if packed is not None else 0
    have = dict(zip(packed.schema.names, packed.columns)) if packed is not None else {}
    names = ["bucket", *columns]
    return pa.RecordBatch.from_arrays([have.get(c, pa.nulls(n, pa.int32() if c == "bucket" else pa.binary())) for c in names], names)


def against_pivot(members: DataFrame, width: int, percent: int) -> DataFrame:
    """(fam, node, n, pivot, linked, distance, delta) of every member of a region but the pivot.

    ``members`` has (fam, node, text, pivot, chunks, task); the pivot goes to every chunk of its region. ``delta`` is the
    packed symmetric difference from the pivot's set.
    """
    chunk = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("chunks"))))
    rows = members.withColumn("chunk", F.explode(chunk))

    def step(group: pa.Table) -> pa.Table:
        hasher = Hasher()
        out = {"fam": [], "node": [], "n": [], "pivot": [], "linked": [], "distance": [], "delta": []}
        group = group.select(["fam", "node", "pivot", "text"]).combine_chunks()
        sets, centres = [], {}
        pivots = dict(zip(group.column("fam").to_pylist(), group.column("pivot").to_pylist()))
        for batch in group.to_batches():
            fam, node = batch.column("fam").to_pylist(), batch.column("node").to_pylist()
            for i, own in shingle_sets(batch, hasher, width):
                sets.append((fam[i], node[i], own))
                if node[i] == pivots[fam[i]]:
                    # Of several sets under the id of the pivot every chunk takes the same one.
                    mark = own.tobytes()
                    if fam[i] not in centres or mark < centres[fam[i]]:
                        centres[fam[i]] = mark
        for f, x, own in sets:
            centre = np.frombuffer(centres[f], np.uint64)
            delta = np.setxor1d(own, centre, assume_unique=True)
            if x == pivots[f] and not len(delta):
                continue
            both = len(own) + len(centre)
            common = (both - len(delta)) // 2
            union = both - common
            out["fam"].append(f)
            out["node"].append(x)
            out["n"].append(len(own))
            out["pivot"].append(pivots[f])
            out["linked"].append(100 * common >= percent * union)
            out["distance"].append(1 - common / union)
            out["delta"].append(delta.tobytes())
        return pa.Table.from_pydict(out, schema=pa.schema([("fam", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("pivot", pa.int64()), ("linked", pa.bool_()), ("distance", pa.float64()), ("delta", pa.binary())]))

    schema = "fam bigint, node bigint, n bigint, pivot bigint, linked boolean, distance double, delta binary"
    return rows.groupBy("task", "chunk").applyInArrow(step, schema)


def ring_links(near: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges that connect what links connect, among members with at least one not linked to the pivot.

    A ring is one threshold wide. The distances of linked sets from the pivot differ by a threshold at most, so they
    are in the same ring or in neighbours, and every pair of blocks of such rings is one unit of work.
    """
    width = (100 - percent) / 100
    alive = near.groupBy("fam").agg(F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("loose")).where("m > 1 and loose > 0").select("fam")
    rows = near.join(alive, "fam").withColumn("ring", F.floor(F.col("distance") / width + 1e-9).cast("int"))
    counts = rows.groupBy("fam", "ring").agg(F.ceil(F.count("*") / RING_BLOCK).cast("int").alias("k"))
    sizes = counts.groupBy("fam").agg(F.map_from_entries(F.collect_list(F.struct("ring", "k"))).alias("k"))
    here = lambda r: F.coalesce(F.try_element_at("k", r), F.lit(0))
    every = lambda n, low, high: F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), n), lambda b: F.struct(low(b), high(b)))
    me, ring = F.col("block"), F.col("ring")
    end = lambda r, b: (r * 65536 + b).cast("bigint")
    same = every(here(ring), lambda b: end(ring, F.least(me, b)).alias("low"), lambda b: end(ring, F.greatest(me, b)).alias("high"))
    up = every(here(ring + 1), lambda b: end(ring, me).alias("low"), lambda b: end(ring + 1, b).alias("high"))
    down = every(here(ring - 1), lambda b: end(ring - 1, b).alias("low"), lambda b: end(ring, me).alias("high"))
    rows = rows.join(sizes, "fam").withColumn("block", F.pmod(F.xxhash64("node"), here(ring).cast("bigint")).cast("int"))
    rows = rows.withColumn("unit", F.explode(F.concat(same, up, down))).withColumn("mine", end(ring, F.col("block")))
    rows = rows.select("fam", "node", "n", "linked", "delta", "mine", F.col("unit.low").alias("low"), F.col("unit.high").alias("high"))

    def step(group: pa.Table) -> pa.Table:
        forest = Forest()
        v = {c: group.column(c).to_numpy() for c in ("fam", "node", "n", "mine", "low", "high")}
        linked = group.column("linked").to_numpy()
        deltas = [np.frombuffer(x, np.uint64) for x in group.column("delta").to_pylist()]
        order = np.lexsort((v["mine"], v["high"], v["low"], v["fam"]))
        first, ends = runs(v["fam"][order], v["low"][order], v["high"][order])
        for a, b in zip(first, ends):
            at = order[a:b]
            low = at[v["mine"][at] == v["low"][at]]
            high = low if v["low"][at[0]] == v["high"][at[0]] else at[v["mine"][at] == v["high"][at]]
            for x, y in _block_links(low, high, v["n"], linked, deltas, percent):
                forest.join(int(v["node"][x]), int(v["node"][y]))
        a, b = forest.edges()
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    task = F.pmod(F.xxhash64("fam", "low", "high"), F.lit(_tasks(near)))
    return rows.withColumn("task", task).groupBy("task").applyInArrow(step, "a bigint, b bigint")


def _tasks(df: DataFrame) -> int:
    """Groups of small units: some per shuffle partition, so that a group stays small and calls stay few."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _block_links(low: np.ndarray, high: np.ndarray, n: np.ndarray, linked: np.ndarray, deltas: list, percent: int):
    """Linked pairs between two blocks (or inside one), from the side that is not linked to the pivot.

    Proof that a common difference is needed: with none, |x delta y| = |dx| + |dy| <= (1 - t) |x or y| and
    |x or y| <= |x or p| + |dy|, so |dx| <= (1 - t) |x or p|: x is linked to the pivot, and so is y.
    """
    sides = [(low, high)] if low is high else [(low, high), (high, low)]
    for ask, other in sides:
        loose = ask[~linked[ask]]
        if not len(loose) or not len(other):
            continue
        sizes = np.array([len(deltas[i]) for i in other])
        elements, owner = np.concatenate([deltas[i] for i in other]), np.repeat(np.arange(len(other)), sizes)
        order = np.argsort(elements, kind="stable")
        elements, owner = elements[order], owner[order]
        for x in loose:
            a, b = np.searchsorted(elements, deltas[x], "left"), np.searchsorted(elements, deltas[x], "right")
            length = b - a
            total = int(length.sum())
            if not total:
                continue
            places = np.repeat(a - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(total)
            shared = np.bincount(owner[places], minlength=len(other))
            met = np.flatnonzero(shared)
            differ = len(deltas[x]) + sizes[met] - 2 * shared[met]
            common = (n[x] + n[other[met]] - differ) // 2
            union = n[x] + n[other[met]] - common
            for y in other[met[100 * common >= percent * union]]:
                if y != x:
                    yield x, y


def jaccard_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row; the component is the smallest id reachable by links."""
    docs = docs.select("doc_id", "text")
    found = regions_and_sizes(docs, width, percent)
    sets = found.where("kind = 1 and n > 0 and a is not null")
    reps = written(sets.groupBy("d1", "d2", "n").agg(F.min("a").alias("rep"), F.count("*").alias("copies")), "jaccard-sets")
    equal = sets.join(reps.where("copies > 1"), ["d1", "d2", "n"]).where("a <> rep").select("a", F.col("rep").alias("b"))
    equal = written(equal, "jaccard-equal")
    regions = components(found.where("kind = 0").select("a", "b").unionByName(equal))
    # An id with unlike texts is one node with several sets.
    nodes = reps.select(F.col("rep").alias("node")).distinct().join(regions, "node").withColumnRenamed("root", "fam")
    sized = nodes.groupBy("fam").agg(F.count("*").alias("m"), F.min("node").alias("pivot")).where("m > 1")
    nodes = nodes.join(sized.withColumn("chunks", F.ceil(F.col("m") / FAMILY_CHUNK).cast("bigint")), "fam")
    nodes = nodes.withColumn("task", F.pmod(F.xxhash64("fam"), F.lit(_tasks(docs))))
    texts = docs.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id").withColumnRenamed("doc_id", "node")
    near = written(against_pivot(texts, width, percent), "jaccard-near")
    links = equal.unionByName(near.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))).unionByName(ring_links(near, percent))
    groups = components(links)
    ids = found.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"))
    return ids.join(groups, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked rows, the one with the smallest id, then text hash. Own columns only.

    Rows are told apart by id and text, so rows that only share an id do not stand for each other; nor do rows
    without an id, which come last in their group. Of rows equal in both one stays.
    """
    key, first = fresh(docs, "_id"), fresh(docs, "_first")
    # Row numbers are written once, so every later read finds the same.
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "jaccard-rows")
    found = jaccard_components(rows.select(F.col(key).alias("doc_id"), F.col("`text`").alias("text")), width, percent)
    order = rows.select(F.col(key).alias("doc_id"), F.col("`doc_id`").alias("id"), F.xxhash64(F.col("`text`")).alias("h"))
    # Rows without words are linked with nothing, also not with rows equal to them: those go by id and text.
    alone = F.when(F.col("n_shingles") == 0, F.struct("id", "h"))
    groups = order.join(found, "doc_id").groupBy(F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component_id"), alone.alias("alone"))
    firsts = groups.agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h", "doc_id")).alias(first))
    kept = rows.join(firsts.select(F.col(f"{first}.doc_id").alias(key)), key, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op10_jaccard_regions")
def op10(spark, folder):
    return jaccard_components(table(spark, folder, "documents"))
