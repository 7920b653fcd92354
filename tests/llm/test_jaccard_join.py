import random

import numpy as np
import pytest

from placelens.llm import jaccard_join
from placelens.llm.components import _thin, components
from placelens.llm.jaccard_join import Common, SizeBands, jaccard_components, keep_first, region_keys
from placelens.llm.queries import QUERIES
from tests.llm.rows import ODD, SF, brute_components, documents, shingles, table


def check(df, rows, width, percent):
    got, want = df.collect(), brute_components(rows, width, percent)
    assert len(got) == len(rows)
    texts = sorted((len(shingles(t, width)), i is None, i or 0) for i, t in rows)
    assert sorted((r["n_shingles"], r["doc_id"] is None, r["doc_id"] or 0) for r in got) == texts
    assert [(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None and want[r["doc_id"]] != r["component_id"]] == []


def test_query_against_brute_force(spark):
    check(QUERIES["op10_jaccard_regions"](spark, SF), [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()], 3, 90)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_odd_rows(spark, width, percent):
    check(jaccard_components(documents(spark, clash=True), width, percent), [(r[0], r[1]) for r in ODD], width, percent)


def test_empty_table(spark):
    assert jaccard_components(documents(spark, [])).count() == 0


def cloud(seed, copies, edits):
    """Copies of one text with a few changed words each, copies of copies, and a passage in many other texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(150)]
    rows, family = [], [base]
    for _ in range(copies):
        w = list(rng.choice(family[:20]))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = word()
        family.append(w)
    rows = [" ".join(w) for w in family]
    rows += [" ".join(base[:40] + [word() for _ in range(rng.randint(3, 60))]) for _ in range(40)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k], "en", "s") for i, k in enumerate(order)]


@pytest.mark.parametrize("percent,edits,block", [(90, 6, 4096), (90, 4, 7), (80, 10, 16)])
def test_clouds_of_near_copies(spark, monkeypatch, percent, edits, block):
    monkeypatch.setattr(jaccard_join, "LEAST_COMMON", 20)
    monkeypatch.setattr(jaccard_join, "RING_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FAMILY_CHUNK", 16)
    rows = cloud(percent + edits, 160, edits)
    docs = documents(spark, rows, clash=True).repartition(5)
    check(jaccard_components(docs, 3, percent), [(r[0], r[1]) for r in rows], 3, percent)
    kept = keep_first(docs, 3, percent)
    want = brute_components([(r[0], r[1]) for r in rows], 3, percent)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_kept_rows_of_odd_input(spark):
    kept = keep_first(documents(spark, clash=True), 5, 80).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 3, 4, 5, 7, 8, 10]


def test_unlike_texts_of_one_id(spark):
    """Links of each text of an id count, and no text stands for another because it has the same id."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, "en", "s"), (2, b, "en", "s"), (5, a + " more", "en", "s"), (5, b + " more", "en", "s")]
    check(jaccard_components(documents(spark, rows), 3, 90), [(r[0], r[1]) for r in rows], 3, 90)
    assert sorted((r["doc_id"], r["text"][0]) for r in keep_first(documents(spark, rows), 3, 90).collect()) == [(1, "a"), (2, "b")]
    unlike = [(7, a, "en", "s"), (7, b, "en", "s"), (None, a, "en", "s"), (None, b + " more", "en", "s"), (None, "c " * 9, "en", "s"), (7, a, "en", "s")]
    kept = keep_first(documents(spark, unlike), 3, 90).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in kept) == [(0, "c"), (7, "a"), (7, "b")]


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        bands = SizeBands(percent)
        for size in [*range(1, 60), 133, 500]:
            x = np.unique(rng.integers(1, 2**63, size, dtype=np.uint64))
            for _ in range(6):
                y = x.copy()
                while True:
                    drop, add = rng.random() < 0.5, rng.integers(1, 2**63, 1, dtype=np.uint64)
                    z = np.delete(y, rng.integers(len(y))) if drop and len(y) > 1 else np.union1d(y, add)
                    common = len(np.intersect1d(x, z))
                    if 100 * common < percent * (len(x) + len(z) - common):
                        break
                    y = z
                for common in (x[:0], x[::3], np.union1d(x[1:], y)):
                    rare = Common(common).without
                    assert set(region_keys(x, rare(x), bands)) & set(region_keys(y, rare(y), bands))


def test_edges_per_node_do_not_grow_with_partitions(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAST_COMMON", 20)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        docs = documents(spark, cloud(3, 900, 8)).repartition(9)
        edges = jaccard_join.regions_and_sizes(docs, 5, 80).where("kind = 0").select("a", "b")
        thin = _thin(edges)
        nodes = edges.select("a").union(edges.select("b")).distinct().count()
        assert nodes > 800 and edges.count() < 2 * nodes and thin.count() < 1.2 * nodes
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(9)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
