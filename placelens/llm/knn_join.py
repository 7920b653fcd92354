"""Exact top-k search by inner product as a Voronoi kNN join.

With M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0): the nearest rows of a
query are then those with the largest inner product, so distances, and with them the triangle inequality, rank inner
products. Rows and queries are grouped by their nearest pivot. Summaries of the groups (radii, and the smallest
distances to the pivot) bound the k-th distance of every query group; a row is copied to the query groups whose bound it
can meet, and no other. Each piece of a query group is solved by block products, cell by cell, and cells that the
triangle inequality rules out for the queries left are skipped. Scores are integers throughout.

Where no bound can hold, as among random directions, every row goes to every query group; the work is then that of
one product of all queries with all rows, in pieces of bounded size.

Vectors that are null or hold null or non-finite components take no part, nor do rows without id. Shorter vectors
count as zero beyond their end. A repeated row is a candidate as often as it occurs, and asked once; rows with the id
of a query are never its candidates. Ties go to the smaller id. Scores have to fit a long. Extra columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelens.llm.registry import query, table
from placelens.llm.tables import written

SCALE = 256
TOP = 5
EVERY = 50
#: Pivots steer the work, never the result. Their distances and bounds (4 MB at most) travel with the tasks.
MAX_PIVOTS = 512
#: Rows among which pivots are chosen.
PIVOT_SAMPLE = 8192
GROUP_QUERIES = 8192
PIECE_ROWS = 131_072
BLOCK_ROWS = 4096
BLOCK_SCORES = 1 << 23
#: If an id has as many rows, queries are compared with all rows.
MOST_OWN = 64
SLACK = 1e-6


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v) of all rows that take part, components as floor(scale * x)."""
    v = F.col(f"`{vector}`")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.where(F.col(f"`{key}`").isNotNull() & v.isNotNull() & F.forall(v, lambda x: good(x.cast("double"))))
    return rows.select(F.col(f"`{key}`").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of integers, zero beyond their end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[owner]] = flat
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


@dataclass
class Space:
    """The lifted space: the longest norm, the number of components and the pivots in it."""

    norm: float
    width: int
    pivots: np.ndarray

    def lift(self, rows: np.ndarray, is_query: bool) -> np.ndarray:
        rows = rows.astype(np.float64)
        rest = np.zeros(len(rows)) if is_query else np.sqrt(np.maximum(0, self.norm**2 - (rows * rows).sum(axis=1)))
        return np.concatenate([rows, rest[:, None]], axis=1)

    @property
    def slack(self) -> float:
        """Above the rounding of any distance."""
        return SLACK * (1 + self.norm)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def choose_space(rows: DataFrame) -> Space | None:
    """Pivots are drawn from the distinct vectors of a sample by hash; None for an empty table."""
    n, norm2, width = rows.agg(F.count("*"), F.max(squared_norm(F.col("v"))), F.max(F.size("v"))).first()
    if not n:
        return None
    picked = rows.select("id", "v").orderBy(F.xxhash64("id", F.lit(11)), "id").limit(PIVOT_SAMPLE).toArrow()
    sample = np.unique(matrix(picked.column("v"), width), axis=0)
    space = Space(math.sqrt(norm2), width, np.empty((0, width + 1)))
    count = max(1, min(MAX_PIVOTS, math.isqrt(n), len(sample)))
    space.pivots = space.lift(sample[np.random.default_rng(5).permutation(len(sample))[:count]], False)
    return space


def assign(rows: DataFrame, space: Space, is_query: bool) -> DataFrame:
    """Add the nearest pivot (``cell``) and the distance to it."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                far = distances(space.lift(matrix(part.column("v"), space.width), is_query), space.pivots)
                cell = far.argmin(axis=1)
                columns = [*part.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays(columns, [*names, "cell", "dist"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, cell int, dist double")


@dataclass
class Plan:
    """What follows from the summaries, all of it bounded by the number of pivots.

    ``first`` and ``splits``: number of the first query group of each cell, and how many there are. ``low`` and
    ``high``: per cell of queries and cell of rows, the distances to the pivot that a row needs to be of use.
    ``pieces``: per cell of queries, into how many pieces the rows of one of its groups are dealt.
    """

    cells: np.ndarray
    first: np.ndarray
    splits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    pieces: np.ndarray


def summarise(rows: DataFrame, asked: DataFrame, own: int, space: Space, top: int, least_tasks: int) -> Plan:
    """``own``: how many rows a query may find under its own id, which bounds cannot count on."""
    p, own = len(space.pivots), min(own, MOST_OWN)
    by_cell = W.partitionBy("cell").orderBy("dist")
    near = rows.select("cell", "dist").withColumn("rank", F.row_number().over(by_cell)).where(F.col("rank") <= top + own)
    closest = np.full((p, top + own), np.inf)
    for cell, dist, rank in near.collect():
        closest[cell, rank - 1] = dist
    count, radius, inner = np.zeros(p), np.zeros(p), np.full(p, np.inf)
    for cell, n, high, low in rows.groupBy("cell").agg(F.count("*"), F.max("dist"), F.min("dist")).collect():
        count[cell], radius[cell], inner[cell] = n, high, low
    queries, reach = np.zeros(p, np.int64), np.zeros(p)
    for cell, n, high in asked.groupBy("cell").agg(F.count("*"), F.max("dist")).collect():
        queries[cell], reach[cell] = n, high

    cells = np.flatnonzero(queries)
    if not len(cells):
        return Plan(*[cells] * 6)
    apart = distances(space.pivots[cells], space.pivots)
    # For any query of a cell, its distance to a row is at most reach + distance of the pivots + the row's own.
    through = apart[:, :, None] + closest[None, :, :] + reach[cells, None, None]
    bound = np.sort(through.reshape(len(cells), -1), axis=1)[:, top + own - 1] + space.slack
    if own == MOST_OWN:
        bound[:] = np.inf
    low, high = apart - (reach[cells] + bound)[:, None], apart + (reach[cells] + bound)[:, None]

    # Neighbouring cells share a group, up to its size; a cell with more queries is several groups.
    first, splits, group, room = np.zeros(len(cells), np.int64), np.ones(len(cells), np.int64), -1, 0
    order, left = [], set(range(len(cells)))
    at = 0
    while left:
        order.append(at)
        left.discard(at)
        if left:
            rest = np.fromiter(left, np.int64)
            at = int(rest[apart[at][cells[rest]].argmin()])
    for i in order:
        n = queries[cells[i]]
        if n > room:
            splits[i] = -(-n // GROUP_QUERIES)
            first[i], room = group + 1, GROUP_QUERIES * splits[i] - n if splits[i] == 1 else 0
            group += splits[i]
        else:
            first[i], room = group, room - n
    # Cells of one group take the same rows: the union of what each needs.
    for g in np.unique(first):
        same = first == g
        low[same], high[same] = low[same].min(axis=0), high[same].max(axis=0)
    met = (low <= radius) & (high >= inner) & (count > 0)
    needed = (met * count).sum(axis=1)
    groups = max(1, group + 1)
    pieces = np.maximum(-(-needed // PIECE_ROWS), -(-least_tasks // groups)).astype(np.int64)
    return Plan(cells, first, splits, low - space.slack, high + space.slack, np.maximum(1, pieces))


def deal_queries(asked: DataFrame, plan: Plan) -> DataFrame:
    """Every query once for each piece of its group."""
    lookup = {int(c): i for i, c in enumerate(plan.cells)}
    cell = F.element_at(F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair]), F.col("cell"))
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("place") + 1)
    rows = asked.withColumn("place", cell)
    group = pick(plan.first) + F.pmod(F.xxhash64("id", "asked"), pick(plan.splits))
    return rows.select(
        "asked", "id", "v", group.alias("group"), F.explode(F.sequence(F.lit(0), (pick(plan.pieces) - 1).cast("int"))).alias("piece")
    )


def deal_rows(rows: DataFrame, plan: Plan) -> DataFrame:
    """Every row to the query groups that need it, to one piece of each."""
    heads, at = np.unique(plan.first, return_index=True)
    low, high, splits, pieces = plan.low[at], plan.high[at], plan.splits[at], plan.pieces[at]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                cell, dist, row = (part.column(c).to_numpy() for c in ("cell", "dist", "row"))
                for g in range(len(heads)):
                    use = np.flatnonzero((low[g][cell] <= dist) & (dist <= high[g][cell]))
                    if not len(use):
                        continue
                    kept = part.take(pa.array(use))
                    mixed = row[use].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
                    piece = pa.array((mixed % np.uint64(pieces[g])).astype(np.int32))
                    for s in range(splits[g]):
                        group = pa.array(np.full(len(use), heads[g] + s, np.int64))
                        yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("v"), kept.column("cell"), kept.column("dist"), group, piece], out)

    out = ["id", "v", "cell", "dist", "group", "piece"]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, v array<bigint>, cell int, dist double, group bigint, piece int")


def exact_kind(a: np.ndarray, b: np.ndarray):
    """The fastest number type in which all products and sums are exact integers."""
    longest = lambda m: math.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    most = longest(a) * longest(b) * (1 + 1e-9)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def best_of(owner: np.ndarray, score: np.ndarray, ident: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``top`` of each owner by falling score, then rising id."""
    order = np.lexsort((ident, -score, owner))
    owner, score, ident = owner[order], score[order], ident[order]
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    keep = rank < top
    return owner[keep], score[keep], ident[keep]


def solve(q_id: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, cell: np.ndarray, dist: np.ndarray, space: Space, top: int):
    """(query position, score, id) of the best rows of each query.

    Cells come by their least possible distance; a block of cells is multiplied only with the queries whose k-th
    distance so far reaches into one of them.
    """
    order = np.argsort(cell, kind="stable")
    ids, rows, cell, dist = ids[order], rows[order], cell[order], dist[order]
    present, start = np.unique(cell, return_index=True)
    ends = np.append(start[1:], len(cell))
    outer, inner = np.maximum.reduceat(dist, start), np.minimum.reduceat(dist, start)
    kind = exact_kind(q, rows)
    q_fast, rows_fast = q.astype(kind), rows.astype(kind)
    lifted = space.lift(q, True)
    q_norm2 = (lifted * lifted).sum(axis=1)
    far = distances(lifted, space.pivots[present])
    least = np.maximum(0, np.maximum(far - outer, inner - far)) - space.slack
    visit = np.argsort(least.min(axis=0), kind="stable")
    kth = np.full(len(q), -np.inf)
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, ids.dtype))
    done = 0
    while done < len(visit):
        until, size = done, 0
        while until < len(visit) and (size == 0 or size + ends[visit[until]] - start[visit[until]] <= BLOCK_ROWS):
            size += ends[visit[until]] - start[visit[until]]
            until += 1
        block = visit[done:until]
        done = until
        limit = np.sqrt(np.maximum(0, q_norm2 + space.norm**2 - 2 * kth))
        active = np.flatnonzero((least[:, block] <= limit[:, None]).any(axis=1))
        if not len(active):
            continue
        at = np.concatenate([np.arange(start[c], ends[c]) for c in block])
        # A cell of any size is multiplied in blocks of bounded size, and many queries in turns.
        for a in range(0, len(at), BLOCK_ROWS):
            here = at[a : a + BLOCK_ROWS]
            turn = max(1, BLOCK_SCORES // len(here))
            for b in range(0, len(active), turn):
                who = active[b : b + turn]
                scores = q_fast[who] @ rows_fast[here].T
                own = q_id[who][:, None] == ids[here]
                floor = kth[who].copy()
                if len(here) > top:
                    # A score below the top + 1 best of the block cannot count, the query's own row aside.
                    spare = min(len(here) - 1, top + int(own.sum(axis=1).max(initial=0)) - 1)
                    floor = np.maximum(floor, np.partition(scores, len(here) - 1 - spare, axis=1)[:, len(here) - 1 - spare])
                x, y = np.nonzero((scores >= floor[:, None]) & ~own)
                merged = (held[0], who[x]), (held[1], scores[x, y].astype(np.int64)), (held[2], ids[here[y]])
                held = best_of(*[np.concatenate(m) for m in merged], top)
                full = np.bincount(held[0], minlength=len(q)) >= top
                worst = np.full(len(q), np.inf)
                np.minimum.at(worst, held[0], held[1])
                # Beyond 2^53 a float may lie above the integer it stands for.
                kth[full] = np.nextafter(worst[full], -np.inf) if kind is np.int64 else worst[full]
    return held


def solve_pieces(asked: DataFrame, rows: DataFrame, space: Space, top: int, kind: str) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"asked": pa.array([], pa.int64()), "query_id": left.column("id").slice(0, 0), "id": left.column("id").slice(0, 0), "score": pa.array([], pa.int64())})
        q_id, q_key = left.column("id").to_numpy(), left.column("asked").to_numpy()
        ids, cell, dist = (right.column(c).to_numpy() for c in ("id", "cell", "dist"))
        q, r = matrix(left.column("v"), space.width), matrix(right.column("v"), space.width)
        owner, score, found = solve(q_id, q, ids, r, cell, dist, space, top)
        return pa.table({"asked": q_key[owner], "query_id": q_id[owner], "id": found, "score": score})

    pairs = asked.groupBy("group", "piece").cogroup(rows.groupBy("group", "piece"))
    return pairs.applyInArrow(run, f"asked bigint, query_id {kind}, id {kind}, score bigint")


def top_inner_products(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score) of the ``top`` highest inner products of each query; ``is_query`` reads column ``id``."""
    spark = vectors.sparkSession
    source = whole_vectors(vectors, key, vector, scale)
    kind = source.schema["id"].dataType.simpleString()
    space = choose_space(source)
    if space is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score bigint")
    # Row numbers are written once, so a lost task deals its rows as before.
    rows = written(assign(source, space, False).withColumn("row", F.monotonically_increasing_id()), "knn-rows")
    asked = rows.where(is_query).select("id", "v").distinct()
    asked = written(assign(asked, space, True).withColumn("asked", F.monotonically_increasing_id()), "knn-queries")
    least_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = rows.where(is_query).groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    plan = summarise(rows, asked, own, space, top, least_tasks)
    if not len(plan.cells):
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score bigint")
    found = solve_pieces(deal_queries(asked, plan), deal_rows(rows, plan), space, top, kind)
    order = W.partitionBy("asked").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op11_voronoi_search", SQL)
def op11(spark, folder):
    found = top_inner_products(table(spark, folder, "embeddings"), F.col("id") % EVERY == 0)
    return found.withColumnRenamed("id", "vec_id")
