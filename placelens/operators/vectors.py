"""Exact nearest-neighbour search over vectors and category sets, and an approximate radius form.

Vectors are indexed by cells around pivots. A query goes to the cells that the triangle inequality leaves to it; the
corpus is dealt out by cell once. Sets are found through an inverted index, rare categories first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions.frames import top_per_group
from placelens.session import cut

QUERY_BLOCK = 2048
CELL_ROWS = 8192
# Pivots and the sample they are drawn from; both steer the work, not the result.
MAX_CELLS = 256
PIVOT_SAMPLE = 4096
# Times k postings that are looked up first.
SEEDS = 4
# Pairs whose differences are held at once.
PAIR_SLICE = 65_536


def fit_norms(corpus: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add the L2 norm of each vector."""
    square = F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    return corpus.withColumn("norm", F.sqrt(square))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


@dataclass
class Bounds:
    """Pivots, and per cell the number of rows and their least and largest distance from the pivot. Travels with the
    tasks; its size is bounded by the number of cells."""

    pivots: np.ndarray
    count: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    @property
    def slack(self) -> float:
        """Above the rounding of any distance."""
        return 1e-6 * (1.0 + float(np.abs(self.pivots).max(initial=0.0)) * math.sqrt(self.pivots.shape[1]) + self.outer.max(initial=0.0))


@dataclass
class Cells:
    """Corpus rows (vec_id, vec, cell) and the bounds of their cells."""

    rows: DataFrame
    bounds: Bounds


def index_cells(corpus: DataFrame) -> Cells | None:
    """Cells of (vec_id, vec), one per square root of the rows up to ``MAX_CELLS``; None for an empty corpus."""
    n = corpus.count()
    if not n:
        return None
    sample = _matrix(corpus.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toPandas()["vec"])
    distinct = np.unique(sample, axis=0)
    keep = np.random.default_rng(7).permutation(len(distinct))[: max(1, min(MAX_CELLS, math.isqrt(n)))]
    pivots = distinct[keep]

    def assign(batches):
        for batch in batches:
            far = _distances(_matrix(batch["vec"]), pivots) if len(batch) else np.empty((0, 1))
            cell = far.argmin(axis=1)
            yield batch.assign(cell=cell.astype(np.int32), dist=far[np.arange(len(cell)), cell])

    kind = corpus.schema["vec_id"].dataType.simpleString()
    rows = cut(corpus.select("vec_id", "vec").mapInPandas(assign, f"vec_id {kind}, vec array<double>, cell int, dist double"))
    count, inner, outer = np.zeros(len(pivots)), np.full(len(pivots), np.inf), np.zeros(len(pivots))
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect():
        count[r["cell"]], inner[r["cell"]], outer[r["cell"]] = r["n"], r["low"], r["high"]
    return Cells(rows.drop("dist"), Bounds(pivots, count, inner, outer))


def cells_to_visit(queries: DataFrame, cells: Bounds, reach: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, vec, cell) for every cell that may hold rows within the reach of a query.

    ``reach`` gives the distance that matters to each query from its distances to the pivots.
    """

    def visit(batches):
        for batch in batches:
            if not len(batch):
                continue
            far = _distances(_matrix(batch["vec"]), cells.pivots)
            least = np.maximum(far - cells.outer, cells.inner - far)
            row, cell = np.nonzero((least <= reach(far)[:, None] + cells.slack) & (cells.count > 0))
            yield batch.iloc[row].assign(cell=cell.astype(np.int32))

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInPandas(visit, f"query_id {kind}, vec array<double>, cell int")


def search_cells(visits: DataFrame, cells: Cells, step: Callable, schema: str) -> DataFrame:
    """Run ``step(queries, corpus rows)`` per cell.

    Cells with very many rows or queries are worked on in blocks; only where a cell has more than ``QUERY_BLOCK``
    queries its rows are copied, once per block of them.
    """
    visits = cut(visits)
    count = cells.bounds.count
    asked = np.zeros(len(count))
    for r in visits.groupBy("cell").count().collect():
        asked[r["cell"]] = r["count"]

    def per_cell(values: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1)

    blocks = per_cell(np.maximum(1, -(-asked // QUERY_BLOCK)))
    chunks = per_cell(np.maximum(1, -(-count // CELL_ROWS)))
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns), n.cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q = visits.withColumn("block", own(visits, blocks)).withColumn("chunk", every(chunks))
    c = cells.rows.withColumn("chunk", own(cells.rows, chunks)).withColumn("block", every(blocks))
    c = c.where(per_cell(asked) > 0)
    keys = ["cell", "chunk", "block"]
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(step, schema)


def skipped_share(queries: DataFrame, cells: Bounds, visits: DataFrame) -> float:
    """Share of the (query, cell) pairs that were never looked at."""
    return 1.0 - visits.count() / max(1, queries.count() * int((cells.count > 0).sum()))


def _best(matrix: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of the k largest scores per row, equal scores by id."""
    by_id = np.argsort(ids, kind="stable")
    order = by_id[np.argsort(-matrix[:, by_id], axis=1, kind="stable")[:, :k]]
    return np.repeat(np.arange(len(matrix)), order.shape[1]), order.ravel()


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _query_side(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"))


def _corpus_side(corpus: DataFrame) -> DataFrame:
    return corpus.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def _pair_schema(queries: DataFrame, corpus: DataFrame, score: str) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"query_id {kind(queries, 'query_id')}, vec_id {kind(corpus, 'vec_id')}, {score} double"


def _unit_side(rows: DataFrame, key: str) -> DataFrame:
    """Vectors of unit length; those of zero length are marked."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    sized = rows.withColumn("_norm", norm)
    return sized.select(key, F.transform("vec", lambda x: F.try_divide(x, F.col("_norm"))).alias("vec"), (F.col("_norm") == 0).alias("zero"))


def top_k_reach(cells: Bounds, k: int) -> Callable[[np.ndarray], np.ndarray]:
    """Distance within which a query is sure to find k rows: cells by their far ends until they hold k rows."""

    def reach(far: np.ndarray) -> np.ndarray:
        ends = np.where(cells.count > 0, far + cells.outer, np.inf)
        order = np.argsort(ends, axis=1)
        held = np.cumsum(cells.count[order], axis=1) >= k
        first = np.where(held.any(axis=1), held.argmax(axis=1), far.shape[1] - 1)
        bound = ends[np.arange(len(far)), order[np.arange(len(far)), first]]
        return np.where(held.any(axis=1), bound, np.inf)

    return reach


def cosine_top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Best k corpus rows per query by cosine; inputs are (query_id, vec) and (vec_id, embedding).

    Between vectors of unit length the nearest are those with the largest cosine. A zero vector on either side
    scores 0, and k may exceed the corpus: of the zero vectors, and for a query that is one, the k smallest ids
    compete, as they all score alike.
    """
    schema = _pair_schema(queries, corpus, "similarity")
    asked, known = _unit_side(_query_side(queries), "query_id"), _unit_side(_corpus_side(corpus), "vec_id")
    cells = index_cells(known.where("not zero"))
    nothing = lambda pairs: pairs.withColumn("similarity", F.lit(0.0)).select("query_id", "vec_id", "similarity")
    ids = lambda rows: rows.select("vec_id").orderBy("vec_id").limit(k)
    parts = [
        nothing(asked.where("not zero").select("query_id").join(F.broadcast(ids(known.where("zero"))))),
        nothing(asked.where("zero").select("query_id").join(F.broadcast(ids(known)))),
    ]

    def step(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        scores = _matrix(q["vec"]) @ _matrix(c["vec"]).T
        rows, cols = _best(scores, c["vec_id"].to_numpy(), k)
        return pd.DataFrame(
            {
                "query_id": q["query_id"].to_numpy()[rows],
                "vec_id": c["vec_id"].to_numpy()[cols],
                "similarity": scores[rows, cols],
            }
        )

    if cells is not None:
        visits = cells_to_visit(asked.where("not zero").drop("zero"), cells.bounds, top_k_reach(cells.bounds, k))
        parts.append(search_cells(visits, cells, step, schema))
    scored = parts[0]
    for more in parts[1:]:
        scored = scored.unionByName(more)
    return top_per_group(scored, ["query_id"], [F.desc("similarity"), F.asc("vec_id")], k)


def radius_neighbors(queries: DataFrame, corpus: DataFrame, radius: float) -> DataFrame:
    """All corpus rows within a Euclidean distance of each query; inputs as for ``cosine_top_k``."""

    def step(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})
        asked, points = _matrix(q["vec"]), _matrix(c["vec"])
        squares = (asked**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :]
        # The product form rounds, so it only picks pairs that may lie within; their differences decide.
        rows, cols = np.nonzero(squares - 2.0 * (asked @ points.T) <= radius**2 + 1e-9 * (squares + 1.0))
        parts = []
        for at in range(0, len(rows), PAIR_SLICE):
            r, k = rows[at : at + PAIR_SLICE], cols[at : at + PAIR_SLICE]
            parts.append(np.sqrt(((asked[r] - points[k]) ** 2).sum(axis=1)))
        distance = np.concatenate(parts) if parts else np.empty(0)
        hit = distance <= radius
        return pd.DataFrame(
            {
                "query_id": q["query_id"].to_numpy()[rows[hit]],
                "vec_id": c["vec_id"].to_numpy()[cols[hit]],
                "distance": distance[hit],
            }
        )

    schema = _pair_schema(queries, corpus, "distance")
    cells = index_cells(_corpus_side(corpus))
    if cells is None:
        return queries.sparkSession.createDataFrame([], schema)
    visits = cells_to_visit(_query_side(queries), cells.bounds, lambda far: np.full(len(far), radius))
    return search_cells(visits, cells, step, schema)


def _set_similarity(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b))


def set_pairs(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(slice, cats, ref_cats, ref_id, similarity) of the pairs that are compared to find the best k sets of each set.

    The sets that share the rarest categories of a query, as many as make a few times k postings, give its first k,
    and so a similarity t that the others have to reach. A set with t shares at least t^2 |cats| categories, so it holds one of the rarest categories of the
    query up to that many from the end, and its size is within a factor t^2: only those are compared. Common
    categories are looked up for queries only that found too little by rarer ones.
    """
    postings = corpus.select("slice", F.explode("ref_cats").alias("cat"), "ref_cats", "ref_id")
    rarity = postings.groupBy("slice", "cat").agg(F.count("*").alias("df"))
    ordered = (
        queries.select("slice", "cats", F.explode("cats").alias("cat"))
        .join(rarity, ["slice", "cat"])
        .groupBy("slice", "cats")
        .agg(F.array_sort(F.collect_list(F.struct("df", "cat"))).alias("by_df"))
        .withColumn("known", F.transform("by_df", lambda x: x["cat"]))
    )
    ordered = cut(ordered)

    def compared(asked: DataFrame, bound: Column | None) -> DataFrame:
        pairs = asked.join(postings, ["slice", "cat"])
        if bound is not None:
            size, other = F.size("cats"), F.size("ref_cats")
            pairs = pairs.where((other + 1e-9 >= bound * size) & (size + 1e-9 >= bound * other))
        pairs = pairs.withColumn("similarity", _set_similarity("cats", "ref_cats"))
        return pairs.select("slice", "cats", "ref_cats", "ref_id", "similarity")

    before = lambda i: F.aggregate(F.slice("by_df", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x["df"])
    rare = F.filter("by_df", lambda x, i: before(i) < SEEDS * k)
    seeds = ordered.select("slice", "cats", F.explode(F.transform(rare, lambda x: x["cat"])).alias("cat"))
    first = compared(seeds, None).distinct()
    best = top_per_group(first, ["slice", "cats"], [F.desc("similarity")], k)
    least = best.where(F.col("rank") == k).select("slice", "cats", "similarity")
    bounded = ordered.join(least, ["slice", "cats"], "left").withColumn("t2", F.coalesce(F.col("similarity") * F.col("similarity"), F.lit(0.0)))
    # Categories the corpus does not have cannot be shared, but count in the size.
    missing = F.size("cats") - F.size("known")
    probes = F.greatest(F.lit(1), F.size("cats") - F.greatest(F.lit(1), F.ceil(F.col("t2") * F.size("cats") - 1e-9).cast("int")) + 1 - missing)
    probed = bounded.select("slice", "cats", "t2", F.explode(F.slice("known", F.lit(1), F.least(probes, F.size("known")))).alias("cat"))
    return compared(probed, F.col("t2")).distinct()


def set_top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Best k distinct sets of the same slice per set by cosine, ties by the smallest id.

    Inputs are (slice, cats) and (slice, ref_cats, ref_id). Sets that share nothing score 0 and fill up the list; as
    they do not depend on the query, the first 2 k of a slice by id are enough.
    """
    queries, corpus = queries.select("slice", "cats").distinct(), corpus.select("slice", "ref_cats", "ref_id")
    order = [F.desc("similarity"), F.asc("ref_id")]
    hits = cut(top_per_group(set_pairs(queries, corpus, k), ["slice", "cats"], order, k))
    short = queries.join(hits.where(F.col("rank") == k).select("slice", "cats"), ["slice", "cats"], "left_anti")
    spare = top_per_group(corpus, ["slice"], [F.asc("ref_id")], 2 * k).drop("rank")
    filled = short.join(spare, "slice").join(hits.select("slice", "cats", "ref_id"), ["slice", "cats", "ref_id"], "left_anti")
    rows = hits.drop("rank").unionByName(filled.withColumn("similarity", F.lit(0.0)).select(hits.drop("rank").columns))
    best = top_per_group(rows, ["slice", "cats"], order, k).withColumnRenamed("ref_id", "set_id")
    return best.select("slice", "cats", "ref_cats", "set_id", "similarity")


def approx_neighbors(queries: DataFrame, corpus: DataFrame, radius: float, tables: int = 8, width: float = 1.0) -> DataFrame:
    """Radius search by random projections: distances are exact, some pairs may be missed."""
    q = queries.select("query_id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    c = corpus.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=42
    )
    pairs = lsh.fit(c).approxSimilarityJoin(q, c, radius, "distance")
    return pairs.select(
        F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.vec_id").alias("vec_id"), "distance"
    )
