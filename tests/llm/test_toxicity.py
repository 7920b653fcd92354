import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from placelens.llm.queries import QUERIES
from placelens.llm.toxicity import GROUPS, NEIGHBOURS, BlockMaxIndex, Terms, Vocabulary, fit_scorer, rising_fit, score_toxicity
from tests.llm.rows import ODD, documents, table


def test_index_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(80, rng.integers(1, 9), replace=False))
        w = rng.integers(1, 5, len(t)).astype(float)
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = BlockMaxIndex(vectors, np.zeros(700, int), list(range(700)), 80)
    dense = np.zeros((700, 80))
    for i, (t, w) in enumerate(index.vectors):
        dense[i, t] = w
    for i in range(0, 700, 7):
        t, w = vectors[i]
        cosine = np.round(dense[:, t] @ w, 12)
        want = [j for j in np.lexsort((np.arange(700), -cosine)) if cosine[j] > 0][:NEIGHBOURS]
        at, got = index.nearest(t, w, NEIGHBOURS)
        assert np.allclose(cosine[at], cosine[want], atol=1e-9) and np.allclose(got, cosine[at], atol=1e-9)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, "labels", sf).collect()}
    got = QUERIES["op9_toxicity_neighbours"](spark, sf).collect()
    assert len(got) == table(spark, "documents", sf).count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    test = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, _, y in test if y], [s for s, _, y in test if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.75
    assert np.mean([p for _, p, y in test if y]) >= 0.7 and np.mean([p for _, p, y in test if not y]) <= 0.03


def test_odd_rows_and_missing_labels(spark):
    docs = documents(spark, ODD + [(50 + i, "you idiot scum" if i % 2 else "you kind friend", "en", "a") for i in range(60)], clash=True)
    rows = [(50 + i, 1, i % 2, "x") for i in range(60)] + [(50, 1, 0, "x"), (None, 1, 1, "x"), (51, 1, None, "x"), (99999, 1, 1, "x")]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")
    scored = score_toxicity(docs, fit_scorer(docs, labels)).collect()
    assert len(scored) == len(ODD) + 60
    assert all(r["score"] >= 0.7 for r in scored if (r["doc_id"] or 0) > 50 and r["doc_id"] % 2)
    assert all(r["score"] < 0.3 for r in scored if (r["doc_id"] or 0) < 50 or r["doc_id"] % 2 == 0)
    none = score_toxicity(docs, fit_scorer(docs, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.0}
    assert score_toxicity(documents(spark, []), fit_scorer(documents(spark, []), labels)).count() == 0


def test_rising_fit():
    x, y = rising_fit(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert x.tolist() == [1, 2, 4] and y.tolist() == [0, 0.5, 1]


def test_cosine_is_over_whole_texts(spark):
    """Evidence has the cosines over all terms of the texts, also of texts without any stressed term."""
    rows = [(i, f"filler{i % 7} story{i % 11} of plain words number{i}" + (" idiot scum" if i % 2 else ""), "en", "a") for i in range(80)]
    rows += [(500, "unmarked yet labelled toxic", "en", "a"), (501, "unmarked yet labelled toxic", "en", "a"), (502, "idiot " + " ".join(f"rare{i}" for i in range(200)), "en", "a")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)] + [(500, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert zlib.crc32(b"500") % 3 != 1
    scorer = fit_scorer(docs, labels)
    got = {r["doc_id"]: r["evidence"] for r in score_toxicity(docs, scorer).collect()}
    terms = Terms()
    bags = {}
    for i, text, *_ in rows:
        _, hashes, counts = terms(pa.array([text]))
        bags[i] = dict(zip(hashes.tolist(), counts.tolist()))
    df = Counter(t for bag in bags.values() for t in bag)
    factor = dict(zip((lookup := scorer.sent.value).vocabulary.tolist(), lookup.factors.tolist()))
    plain = {t: np.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}
    weigh = lambda bag: {t: (1 + np.log(n)) * factor.get(t, plain[t]) for t, n in bag.items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    for i in bags:
        v = weigh(bags[i])
        cosine = {j: sum(x * w.get(t, 0) for t, x in v.items()) / norm(v) / norm(w) for j in bags if (w := weigh(bags[j])) and (j < 80 or j == 500) and zlib.crc32(str(j).encode()) % 3 != 1}
        assert np.allclose([e["cosine"] for e in got[i]], sorted((c for c in cosine.values() if c > 0), reverse=True)[:3], atol=1e-9)
    assert got[501][0]["example"] == 500 and got[501][0]["cosine"] > 1 - 1e-9
    assert got[502][0]["cosine"] < 0.2


def test_grouped_search_is_exact():
    """Long vectors of unlike vocabularies with many copies: each weight is held once, and batches find what brute force does."""
    rng = np.random.default_rng(5)
    pool = []
    for i in range(240):
        t = np.unique(np.concatenate([rng.choice(60, 25) + 100 * (i % 3), rng.integers(300, 4000, 20)]))
        w = rng.random(len(t)) + 0.1
        pool.append((t, w / np.sqrt((w * w).sum())))
    vectors = pool + [pool[7]] * 90
    n = len(vectors)
    index = BlockMaxIndex(vectors, np.zeros(n, int), list(range(n)), 4000)
    assert len(index.tiles) == GROUPS and sum((x != 0).sum() for x in index.exact) + len(index.posted) == sum(len(t) for t, _ in vectors)
    dense = np.zeros((n, 4000))
    for i, (t, w) in enumerate(index.vectors):
        dense[i, t] = w
    rows = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
    common = index.common_scores(rows, np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors]) * 30, n)
    for i, (t, w) in enumerate(vectors):
        product = np.round(dense[:, t] @ (w * 30), 9)
        at, got = index.nearest(t, w * 30, NEIGHBOURS, common=common[i])
        assert np.allclose(got, np.sort(product)[::-1][:NEIGHBOURS], atol=1e-8) and np.allclose(product[at], got, atol=1e-8)
        assert all(a < b for a, b, x, y in zip(at, at[1:], got, got[1:]) if x == y)


def test_vocabulary_numbers_and_counts():
    rng = np.random.default_rng(6)
    hashes = np.unique(np.concatenate([rng.integers(0, 2**64, 500, dtype=np.uint64), np.arange(5, dtype=np.uint64), np.array([2**64 - 1], np.uint64)]))
    known = Vocabulary(hashes)
    asked = np.concatenate([hashes, hashes + np.uint64(7), np.array([2**64 - 2, 6], np.uint64)])
    number = {h: i for i, h in enumerate(hashes.tolist())}
    assert known.find(asked).tolist() == [number.get(h, -1) for h in asked.tolist()]
    rows = np.array([0, 0, 0, 2, 2])
    listed, others = known.counts(rows, np.array([hashes[3], 6, hashes[3], hashes[0], 6], np.uint64))
    assert [x.tolist() for x in listed] == [[0, 2], [3, 0], [2, 1]] and [x.tolist() for x in others] == [[0, 2], [6, 6], [1, 1]]
    assert Vocabulary(np.empty(0, np.uint64)).find(hashes).tolist() == [-1] * len(hashes)
