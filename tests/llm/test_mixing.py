import numpy as np
import pytest

from placelens.llm import mixing
from placelens.llm.mixing import decide_copies, pivotal, take_copies
from placelens.llm.queries import QUERIES
from tests.llm.rows import ODD, SF, WORD, documents, plain, table


def targets(sizes):
    """Source -> target: 150 % by weight, and what is above twice the size shared again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def check(got, rows):
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want, taken, largest = targets(sizes), {}, {}
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_query_reaches_its_targets_and_reruns_agree(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table(spark, "documents").collect()]
    check(decide_copies(table(spark, "documents")).collect(), rows)
    q = QUERIES["op5_pivotal_mix"]
    assert plain(q(spark, SF)) == plain(q(spark, SF))


def test_odd_rows_and_a_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 3)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rows = ODD + [(100 + i, "w " * (i % 37 + 1), "en", "abc"[i % 3] if i % 5 else "a") for i in range(300)]
    docs = documents(spark, rows, clash=True)
    decided = decide_copies(docs)
    check(decided.collect(), rows)
    taken = take_copies(docs, decided)
    assert taken.columns == docs.columns
    want = {}
    for r in decided.collect():
        want[r["key"]] = want.get(r["key"], 0) + r["copies"]
    got = {}
    for r in taken.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_empty_tables(spark):
    assert decide_copies(documents(spark, [])).count() == 0
    blank = documents(spark, [(1, None, "en", None), (2, "", "en", "a")])
    assert [r["copies"] for r in decide_copies(blank).collect()] == [0, 0]


def test_pivotal_keeps_words_and_probabilities():
    rng = np.random.default_rng(5)
    sizes, p = rng.integers(1, 50, 40).astype(float), rng.uniform(0.05, 0.95, 40)
    hits = np.zeros(40)
    for i in range(3000):
        out, last = pivotal(sizes, p, np.random.default_rng(i))
        assert (out * sizes).sum() == pytest.approx((p * sizes).sum())
        certain = np.delete(out, last) if last >= 0 else out
        assert set(certain) <= {0.0, 1.0}
        hits += out
    assert abs(hits / 3000 - p).max() < 0.05
