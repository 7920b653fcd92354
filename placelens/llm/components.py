"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.llm.tables import written


class Forest:
    """Union-find over the integers seen by one task; the root of a tree is its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root and up != x:
            parent[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.parent.setdefault(min(a, b), min(a, b))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of every member that is not a root."""
        pairs = [(x, r) for x in self.parent if (r := self.find(x)) != x]
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def one_edge_each(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as (member, root), the root the smallest node: one edge of every node but the roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        low = np.minimum(up[x], up[y])
        np.minimum.at(up, up[x], low)
        np.minimum.at(up, up[y], low)
        while ((further := up[up]) != up).any():
            up = further
        apart = up[x] != up[y]
        x, y = x[apart], y[apart]
    members = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[members], nodes[up[members]]


def _thin(edges: DataFrame) -> DataFrame:
    """The same components with at most one edge per node of a task.

    The edges of a node meet in one task, which leaves it one. Nodes that were roots of several of its neighbours may
    get one from each such task, so the rows go through twice.
    """

    def run(batches):
        a, b, waiting = np.empty(0, np.int64), np.empty(0, np.int64), []
        for batch in batches:
            waiting.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            # Work on as many new edges as are kept, so that each is looked at a few times only.
            if sum(len(x) for x, _ in waiting) > max(len(a), 1 << 18):
                a, b = one_edge_each(*(np.concatenate([kept, *new]) for kept, new in zip((a, b), zip(*waiting))))
                waiting = []
        a, b = one_edge_each(*(np.concatenate([kept, *new]) for kept, new in zip((a, b), zip(*waiting) if waiting else ((), ()))))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = edges.select("a", "b")
    for _ in range(2):
        rows = rows.repartition("a").mapInArrow(run, "a bigint, b bigint")
    return rows


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b), bigint, roots included; the root is the smallest node.

    Each step is a grouped minimum and a join; a node with very many neighbours only meets their minimum. The edge
    table is written per round and the rounds end when it no longer changes.
    """
    state = written(_thin(edges.where("a is not null and b is not null and a <> b")), "edges")
    seen = None
    while True:
        mark = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark["n"] == 0 or (seen is not None and mark == seen):
            break
        seen = mark
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("n"), "m"), F.struct(F.col("b").alias("n"), "m"))).alias("e"))
        state = written(small.select(F.col("e.n").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
    found = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
