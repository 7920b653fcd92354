"""Toxicity by nearest labelled examples: exact TF-IDF cosine over whole texts through matrices and postings.

A bounded sample of labelled texts (``MAX_EXAMPLES`` per label) gives the examples, which are indexed with all their
terms; document frequencies are counted over all documents. Terms that go with the label beyond chance weigh
``STRESS`` times as much. Every document looks up its nearest examples in an exact search. The
norm of a document is taken over all its terms: those that no example has are counted and joined as a table. Votes are weighted by cosine and calibrated on the examples, each scored without itself.

Null text counts as empty; a text without neighbours has the share of toxic ones among the examples without stressed
terms as its vote. Repeated rows are scored alike. Extra columns are not read. Without labels every score is 0.
Without documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.llm.registry import query, table
from placelens.llm.tables import written
from placelens.llm.textbytes import Hasher, mix, slices, text_bytes

MAX_EXAMPLES = 4000
STRESS = 3.0
CHANCE = 0.05
LEAST_SEEN = 3
LEAST_RATIO = 4.0
PREFIXES = (4, 5)
NEIGHBOURS = 15
# Examples are searched in so many groups, found in so many rounds. Terms of this share of the examples of a group are
# scored as a matrix, others through their postings.
GROUPS = 6
ROUNDS = 5
COMMON = 0.08
WHOLE_TILE = 0.7
BATCH = 512
THRESHOLD = 0.7
SMOOTH = 0.05


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


def _letters() -> np.ndarray:
    """Bytes that belong to terms: ASCII letters and digits and everything beyond ASCII."""
    ok = np.zeros(256, bool)
    ok[128:] = True
    for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
        ok[ord(a) : ord(b) + 1] = True
    return ok


class Terms:
    """(row, term hash, count) of the texts of a batch, rows ascending; one object per task.

    Terms are words and, so that forms of one stem count together, the first ``PREFIXES`` bytes of longer words.
    """

    def __init__(self):
        self.hasher, self.letters = Hasher(seed=9), _letters()

    def hashes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of every occurrence of a term."""
        data, offsets = text_bytes(pc.utf8_lower(column.fill_null("")))
        inside = self.letters[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        rows = np.repeat(np.arange(len(column)), np.diff(np.searchsorted(starts, offsets)))
        sums = self.hasher.sums(data)
        hashes, owners = [self.hasher.ranges(sums, starts, stops)], [rows]
        for n in PREFIXES:
            longer = stops - starts > n
            cut_at = starts[longer]
            hashes.append(mix(self.hasher.ranges(sums, cut_at, cut_at + n) + np.uint64(n)))
            owners.append(rows[longer])
        return np.concatenate(owners), np.concatenate(hashes)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return counted(*self.hashes(column))


def counted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    small = rows.astype(np.uint16) if not len(rows) or rows.max() < 2**16 else rows
    order = order[np.argsort(small[order], kind="stable")]
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return rows[first], hashes[first], np.diff(np.append(first, len(rows)))


class Vocabulary:
    """Sorted hashes of terms, found by their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(64 - max(4, len(hashes).bit_length()))
        edges = np.searchsorted(hashes >> self.shift, np.arange(2 ** (64 - int(self.shift)) + 1, dtype=np.uint64))
        self.first, self.longest = edges[:-1].astype(np.int32), int(np.diff(edges).max())
        self.padded = np.append(hashes, np.zeros(self.longest + 1, np.uint64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, -1 for terms that are not listed."""
        at = self.first[(hashes >> self.shift).astype(np.int64)].astype(np.int64)
        missed = np.flatnonzero(self.padded[at] != hashes)
        for _ in range(self.longest - 1):
            at[missed] += 1
            missed = missed[self.padded[at[missed]] != hashes[missed]]
        at[missed] = -1
        at[at >= len(self.hashes)] = -1
        return at

    def counts(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[tuple, tuple]:
        """(row, number, count) of the listed terms and (row, hash, count) of the others, rows ascending."""
        at = self.find(hashes)
        known = at >= 0
        n = max(1, len(self.hashes))
        keys = np.sort(rows[known] * n + at[known])
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
        owners = keys[first] // n
        return (owners, keys[first] - owners * n, np.diff(np.append(first, len(keys)))), counted(rows[~known], hashes[~known])


def sample_examples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of at most ``MAX_EXAMPLES`` rows per label, and the number of labelled rows of each.

    Only rows outside the held-out third are read. Of several labels of one document the larger counts.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = lambda label: known.where(F.col("toxic") == label).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(MAX_EXAMPLES)
    # At most 2 x MAX_EXAMPLES rows, so the broadcast is bounded.
    sample = F.broadcast(pick(0).unionByName(pick(1)))
    return docs.select("doc_id", "text").join(sample, "doc_id").dropDuplicates(["doc_id"]), counts


def example_terms(examples: DataFrame) -> DataFrame:
    """(doc_id, toxic, terms, counts) of each example."""

    def run(batches):
        terms = Terms()
        for batch in batches:
            for a, b in slices(text_bytes(batch.column("text"))[1]):
                here = batch.slice(a, b - a)
                rows, hashes, counts = terms(here.column("text"))
                sizes = np.bincount(rows, minlength=here.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [here.column("doc_id"), here.column("toxic"), lists(sizes, pa.array(hashes.astype(np.int64))), lists(sizes, pa.array(counts, pa.int32()))],
                    ["doc_id", "toxic", "terms", "counts"],
                )

    kind = examples.schema["doc_id"].dataType.simpleString()
    return examples.mapInArrow(run, f"doc_id {kind}, toxic int, terms array<bigint>, counts array<int>")


def lists(sizes, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def stressed_terms(toxic: np.ndarray, clean: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Which terms go with toxic examples, from the number of toxic and of clean examples of each term.

    A term has to be ``LEAST_RATIO`` times as frequent in toxic examples, and so far above the other ones that
    among all terms tested a single one would get there by chance with probability ``CHANCE``.
    """
    if not n_pos or not n_neg:
        return np.zeros(len(toxic), bool)
    least = NormalDist().inv_cdf(1 - CHANCE / max(1, len(toxic)))
    share = (toxic + clean) / (n_pos + n_neg)
    spread = np.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_neg))
    gap = toxic / n_pos - clean / n_neg
    z = np.divide(gap, spread, out=np.zeros(len(toxic)), where=spread > 0)
    return (z >= least) & (toxic >= LEAST_SEEN) & (toxic / n_pos >= LEAST_RATIO * clean / n_neg)


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each term occurs, counted over all of them."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        terms, known = Terms(), Vocabulary(sent.value)
        n = len(sent.value)
        total = np.zeros(n + 1, np.int64)
        for batch in batches:
            for a, b in slices(text_bytes(batch.column("text"))[1]):
                rows, hashes = terms.hashes(batch.slice(a, b - a).column("text"))
                at = known.find(hashes)
                rows, at = rows[at >= 0], at[at >= 0]
                total[:n] += np.bincount(np.unique(rows * n + at) % n, minlength=n)
            total[-1] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["i", "n"])

    counted = docs.select("text").mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[counted["i"].to_numpy()] = counted["n"].to_numpy()
    return int(out[-1]), out[:-1]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class BlockMaxIndex:
    """Unit vectors of examples in groups of similar ones, and the exact search for the nearest of them.

    In each group the terms of many of its examples are rows of a matrix; all others have postings. Vectors that are
    looked up are grouped alike, so a product only takes the rows that its group uses. Products of single precision tell
    which examples can be among the nearest; their products are then taken in double precision.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list, n_terms: int):
        order = sorted(range(len(vectors)), key=lambda i: [int(t) for t in vectors[i][0][np.argsort(-vectors[i][1], kind="stable")][:3]])
        self.labels, self.ids, self.n = labels[order], [ids[i] for i in order], len(order)
        self.sizes = np.array([len(vectors[i][0]) for i in order])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.terms = np.concatenate([vectors[i][0] for i in order]).astype(np.int32)
        self.weights = np.concatenate([vectors[i][1] for i in order])
        seen: dict[bytes, int] = {}
        self.first_equal = np.array([seen.setdefault(t.tobytes() + w.tobytes(), i) for i, (t, w) in enumerate(self.vectors)])
        owners = np.repeat(np.arange(self.n), self.sizes)
        group = self._group(owners, n_terms)
        # Columns of the matrices and of the scores: examples by group.
        self.place = np.argsort(group, kind="stable")
        self.column = np.argsort(self.place)
        self.edges = np.searchsorted(group[self.place], np.arange(GROUPS + 1))
        self.rows, self.tiles, self.exact = [], [], []
        listed = np.ones(len(self.terms), bool)
        for a, b in zip(self.edges[:-1], self.edges[1:]):
            mine = np.flatnonzero((self.column[owners] >= a) & (self.column[owners] < b))
            common = np.flatnonzero(np.bincount(self.terms[mine], minlength=n_terms) >= max(2, COMMON * (b - a)))
            row = np.full(n_terms, -1, np.int32)
            row[common] = np.arange(len(common))
            mine = mine[row[self.terms[mine]] >= 0]
            exact = np.zeros((b - a, len(common)))
            exact[self.column[owners[mine]] - a, row[self.terms[mine]]] = self.weights[mine]
            listed[mine] = False
            self.rows.append(row)
            self.tiles.append(np.ascontiguousarray(exact.T, np.float32))
            self.exact.append(exact)
        listed = np.flatnonzero(listed)
        listed = listed[np.argsort(self.terms[listed], kind="stable")]
        self.first = np.searchsorted(self.terms[listed], np.arange(n_terms + 1))
        self.posted, self.factors = self.column[owners[listed]].astype(np.int32), self.weights[listed]
        # Rounding of single precision sums, for vectors of length 1.
        self.slack = 2 * (max(len(t) for t in self.tiles) + 4) * 2.0**-24

    @property
    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.terms[a : a + n], self.weights[a : a + n]) for a, n in zip(self.starts, self.sizes)]

    def drop_vectors(self) -> None:
        """Searches do without the vectors themselves."""
        self.terms = self.weights = self.starts = self.sizes = np.empty(0)

    def _group(self, owners: np.ndarray, n_terms: int) -> np.ndarray:
        """Group of each example: some rounds of k-means over the terms that many examples have."""
        often = np.bincount(self.terms, minlength=n_terms) >= max(2, COMMON * self.n)
        row = np.cumsum(often) - 1
        kept = often[self.terms]
        dense = np.zeros((self.n, int(often.sum())), np.float32)
        dense[owners[kept], row[self.terms[kept]]] = self.weights[kept]
        pivots = dense[np.linspace(0, self.n - 1, GROUPS).astype(int)].T
        for _ in range(ROUNDS):
            group = np.argmax(dense @ pivots, axis=1)
            sums = np.stack([dense[group == g].sum(axis=0) for g in range(GROUPS)], axis=1)
            pivots = sums / np.maximum(np.sqrt((sums**2).sum(axis=0)), 1e-12)
        self.pivots = np.zeros((n_terms, GROUPS), np.float32)
        self.pivots[often] = pivots
        return np.argmax(dense @ pivots, axis=1)

    def common_scores(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_rows: int) -> np.ndarray:
        """The part of the matrices in the products of ``n_rows`` vectors with all examples, by column."""
        out = np.zeros((n_rows, self.n), np.float32)
        near = np.zeros((n_rows, GROUPS))
        for g in range(GROUPS):
            near[:, g] = np.bincount(rows, weights * self.pivots[terms, g], n_rows)
        group = np.argmax(near, axis=1)
        for g in np.unique(group):
            members = np.flatnonzero(group == g)
            local = np.full(n_rows, -1)
            local[members] = np.arange(len(members))
            mine = local[rows] >= 0
            here, t, w = local[rows[mine]], terms[mine], weights[mine]
            for row, tile, a, b in zip(self.rows, self.tiles, self.edges[:-1], self.edges[1:]):
                at = row[t]
                hit = at >= 0
                used = np.zeros(len(tile), bool)
                used[at[hit]] = True
                whole = used.sum() > WHOLE_TILE * len(tile)
                number = np.arange(len(tile)) if whole else np.cumsum(used) - 1
                dense = np.zeros((len(members), len(tile) if whole else int(used.sum())), np.float32)
                dense[here[hit], number[at[hit]]] = w[hit]
                out[members, a:b] = dense @ (tile if whole else tile[used])
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and products of the k nearest examples with a product over 0; equal ones by position. Exact."""
        if common is None:
            common = self.common_scores(np.zeros(len(terms), np.int64), terms, weights, 1)[0]
        starts = self.first[terms]
        lengths = self.first[terms + 1] - starts
        at = spans(starts, lengths)
        rest = np.bincount(self.posted[at], self.factors[at] * np.repeat(weights, lengths), self.n).astype(np.float64, copy=False)
        scores = rest + common
        if skip >= 0:
            scores[self.column[skip]] = 0.0
        least = np.partition(scores, self.n - k)[self.n - k] - self.slack * np.sqrt((weights**2).sum()) if self.n > k else 0.0
        columns = np.flatnonzero((scores >= least) & (scores > 0))
        if len(columns) > 4 * k:
            # Many equal examples: products of one of each kind.
            kinds, which = np.unique(self.first_equal[self.place[columns]], return_inverse=True)
            products = self.products(self.column[kinds], terms, weights, rest)[which]
        else:
            products = self.products(columns, terms, weights, rest)
        places = self.place[columns]
        order = np.lexsort((places, -products))[:k]
        return places[order], products[order]

    def products(self, columns: np.ndarray, terms: np.ndarray, weights: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Products of a vector with the examples of some columns in double precision; ``rest`` has the part of the postings."""
        out = rest[columns]
        group = np.searchsorted(self.edges, columns, "right") - 1
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            at = self.rows[g][terms]
            hit = np.flatnonzero(at >= 0)
            out[mine] += self.exact[g][np.ix_(columns[mine] - self.edges[g], at[hit])] @ weights[hit]
        return np.round(out, 12)


def rising_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression (pool adjacent violators): block starts and values."""
    order = np.argsort(x, kind="stable")
    stack: list[list[float]] = []
    for i in order:
        stack.append([x[i], w[i] * y[i], w[i]])
        while len(stack) > 1 and (stack[-2][0] == stack[-1][0] or stack[-2][1] / stack[-2][2] >= stack[-1][1] / stack[-1][2]):
            last = stack.pop()
            stack[-1][1] += last[1]
            stack[-1][2] += last[2]
    return np.array([s[0] for s in stack]), np.array([s[1] / s[2] for s in stack])


class Lookup:
    """The terms of the examples as counts, which are a few MB; every worker lays out the index once."""

    def __init__(self, vocabulary: np.ndarray, factors: np.ndarray, sizes: np.ndarray, at: np.ndarray, counts: np.ndarray):
        self.vocabulary, self.factors, self.sizes, self.at, self.counts = vocabulary, factors, sizes, at, counts
        self.laid = None

    @property
    def index(self) -> BlockMaxIndex:
        if self.laid is None:
            weights, ends = self.weigh(self.at, self.counts), np.cumsum(self.sizes)
            vectors = [(self.at[a:b], weights[a:b] / np.sqrt((weights[a:b] ** 2).sum())) for a, b in zip(ends - self.sizes, ends)]
            n = len(self.sizes)
            self.laid = BlockMaxIndex(vectors, np.zeros(n, np.int64), list(range(n)), len(self.vocabulary))
            self.order = np.array(self.laid.ids)
        return self.laid

    def weigh(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts, dtype=np.float64)) * self.factors[at]

    def nearest(self, rows: np.ndarray, at: np.ndarray, weights: np.ndarray, n_rows: int, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of each row and their products with its vector, whose length is not divided out."""
        index = self.index
        ends = np.searchsorted(rows, np.arange(n_rows + 1))
        for a in range(0, n_rows, BATCH):
            b = min(a + BATCH, n_rows)
            here = slice(ends[a], ends[b])
            common = index.common_scores(rows[here] - a, at[here], weights[here], b - a)
            for r in range(a, b):
                mine = slice(ends[r], ends[r + 1])
                places, products = index.nearest(at[mine], weights[mine], NEIGHBOURS, -1 if skip is None else skip[r], common[r - a])
                yield self.order[places], products


class Scorer:
    """Calibrated scores of texts, and the look-up of their nearest examples as a broadcast."""

    def __init__(self, examples: dict, plain: dict[int, int], counts: dict[int, int], n_docs: int):
        self.ids = sorted(examples)
        self.labels = np.array([examples[i] for i in self.ids], np.int64)
        n = {c: max(1, int((self.labels == c).sum())) for c in (0, 1)}
        self.weight = np.array([counts.get(c, 0) / n[c] for c in (0, 1)])
        mass = [self.weight[c] * plain[c] for c in (0, 1)]
        self.base = (mass[1] + 0.5) / (sum(mass) + 1) if sum(counts.values()) else 0.0
        self.starts, self.values = np.array([0.0]), np.array([self.base])
        self.n_docs, self.sent = n_docs, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sent": None}

    def calibrate(self, spark, lookup: Lookup) -> None:
        """Each example scored without itself."""
        self.sent = sent = spark.sparkContext.broadcast(lookup)

        def run(batches):
            tool = sent.value
            listed = tool.index.vectors
            for batch in batches:
                places = batch.column("id").to_numpy()
                vectors = [listed[i] for i in places]
                at, weights = (np.concatenate(x) for x in zip(*vectors))
                found = list(tool.nearest(np.repeat(np.arange(len(places)), [len(t) for t, _ in vectors]), at, weights, len(places), places))
                yield pa.RecordBatch.from_arrays([pa.array(tool.order[places]), pa.array([self.votes(*f) for f in found], pa.float64())], ["i", "vote"])

        own = spark.range(len(self.ids)).mapInArrow(run, "i bigint, vote double").toArrow().sort_by("i")["vote"].to_numpy()
        self.starts, self.values = rising_fit(own, self.labels, self.weight[self.labels])

    def votes(self, at: np.ndarray, cosine: np.ndarray) -> float:
        y = self.labels[at]
        w = cosine * self.weight[y]
        smooth = SMOOTH * self.weight.max()
        return float(((w * y).sum() + smooth * self.base) / (w.sum() + smooth))

    def score(self, at: np.ndarray, cosine: np.ndarray) -> tuple[float, list[dict]]:
        raw = self.votes(at, cosine)
        fit = self.values[max(0, int(np.searchsorted(self.starts, raw, "right")) - 1)]
        # A trace of the raw vote keeps the order of texts that share a calibrated value.
        total = 0.98 * fit + 0.02 * raw
        return float(total), [{"example": self.ids[a], "cosine": float(c), "toxic": int(self.labels[a])} for a, c in zip(at[:3], cosine[:3])]


def fit_scorer(docs: DataFrame, labels: DataFrame) -> Scorer:
    sample, counts = sample_examples(docs, labels)
    # The terms of at most 2 x MAX_EXAMPLES texts.
    found = example_terms(sample).toArrow().sort_by("doc_id").combine_chunks()
    examples = dict(zip(found["doc_id"].to_pylist(), found["toxic"].to_pylist()))
    sizes = pc.list_value_length(found["terms"]).to_numpy().astype(np.int64)
    hashes = pc.list_flatten(found["terms"]).to_numpy().view(np.uint64)
    seen = pc.list_flatten(found["counts"]).to_numpy()
    seen = seen.astype(np.min_scalar_type(int(seen.max(initial=1))))
    del found
    vocabulary = np.unique(hashes)
    at = np.searchsorted(vocabulary, hashes).astype(np.int32)
    del hashes
    toxic = np.array(list(examples.values()), bool)
    of_toxic = np.repeat(toxic, sizes)
    stressed = stressed_terms(*(np.bincount(at[kind], minlength=len(vocabulary)) for kind in (of_toxic, ~of_toxic)), int(toxic.sum()), int((~toxic).sum()))
    marked = np.zeros(len(sizes), bool)
    marked[np.repeat(np.arange(len(sizes)), sizes)[stressed[at]]] = True
    n_docs, df = document_frequencies(docs, vocabulary)
    factors = (np.log((1 + n_docs) / (1 + df)) + 1) * np.where(stressed, STRESS, 1.0)
    scorer = Scorer(examples, {c: int((~marked & (toxic == c)).sum()) for c in (0, 1)}, counts, n_docs)
    if len(at):
        scorer.calibrate(docs.sparkSession, Lookup(vocabulary, factors, sizes, at, seen))
    return scorer


def nearest_examples(docs: DataFrame, sent) -> DataFrame:
    """(row, doc_id, places, products, squares, others, counts): nearest examples, sum of squares of the known terms, and the terms no example has."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tool = sent.value
        tool.index.drop_vectors()
        terms, vocabulary = Terms(), Vocabulary(tool.vocabulary)
        for batch in batches:
            for a, b in slices(text_bytes(batch.column("text"))[1]):
                here = batch.slice(a, b - a)
                n = here.num_rows
                (rows, at, seen), (others, hashes, counts) = vocabulary.counts(*terms.hashes(here.column("text")))
                weights = tool.weigh(at, seen)
                near = list(tool.nearest(rows, at, weights, n))
                sizes, rest = [len(x) for x, _ in near], np.bincount(others, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        here.column("row"), here.column("doc_id"),
                        lists(sizes, pa.array(np.concatenate([x for x, _ in near]), pa.int32())), lists(sizes, pa.array(np.concatenate([x for _, x in near]), pa.float64())),
                        pa.array(np.bincount(rows, weights**2, n).astype(float)), lists(rest, pa.array(hashes.astype(np.int64))), lists(rest, pa.array(counts, pa.int32())),
                    ],
                    ["row", "doc_id", "places", "products", "squares", "others", "counts"],
                )

    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(run, f"row bigint, doc_id {kind}, places array<int>, products array<double>, squares double, others array<bigint>, counts array<int>")


def score_toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score, evidence) of every row; evidence lists the three nearest examples."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shown = "array<struct<example: bigint, cosine: double, toxic: int>>"
    if scorer.sent is None:
        return docs.select("doc_id", F.lit(float(scorer.base)).alias("score"), F.array().cast(shown).alias("evidence"))
    near = written(nearest_examples(docs, scorer.sent), "toxic-nearest")
    # Terms outside the index move no product, but they lengthen the document.
    pairs = near.select("row", F.inline(F.arrays_zip("others", "counts"))).toDF("row", "term", "n")
    idf = pairs.groupBy("term").agg((F.log((1.0 + scorer.n_docs) / (1.0 + F.count("*"))) + 1).alias("idf"))
    rest = pairs.join(idf, "term").groupBy("row").agg(F.sum(F.pow((1 + F.log("n")) * F.col("idf"), F.lit(2.0))).alias("rest"))
    whole = near.join(rest, "row", "left").select("doc_id", "places", "products", F.sqrt(F.col("squares") + F.coalesce("rest", F.lit(0.0))).alias("norm"))

    def run(batches):
        for batch in batches:
            rows = zip(batch.column("places").to_pylist(), batch.column("products").to_pylist(), batch.column("norm").to_pylist())
            done = [scorer.score(np.array(at, np.int64), np.round(np.array(products) / norm if at else np.empty(0), 12)) for at, products, norm in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in done], pa.float64()), pa.array([x for _, x in done], listed)], ["doc_id", "score", "evidence"])

    listed = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    return whole.mapInArrow(run, f"doc_id {kind}, score double, evidence {shown}")


@query("op9_toxicity_neighbours")
def op9(spark, folder):
    docs = table(spark, folder, "documents")
    scored = score_toxicity(docs, fit_scorer(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
