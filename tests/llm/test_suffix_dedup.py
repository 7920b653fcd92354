import hashlib
import random

import numpy as np
import pytest

from placelens.llm import suffix_dedup
from placelens.llm.queries import QUERIES
from placelens.llm.suffix_dedup import intervals, remove_repeats
from tests.llm.rows import ODD, SF, documents, table


def brute(rows):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} with rows of one id and text as one document."""
    seen, out = set(), {}
    for i, text in sorted(dict(rows).items(), key=lambda r: (r[0] is None, r[0])):
        raw = (text or "").encode()
        flag = np.zeros(len(raw), bool)
        for o in range(len(raw) - 99):
            s = raw[o : o + 100]
            if s in seen:
                flag[o : o + 100] = True
            seen.add(s)
        spans = int((np.diff(np.append(0, flag.astype(int))) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~flag])
        out[i] = (len(raw), int(flag.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(df, rows):
    got = [(r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in df.collect()]
    want = brute(rows)
    assert len(got) == len(rows)
    assert [g for g in got if want[g[0]] != g[1]] == []


def test_query_against_brute_force(spark):
    check(QUERIES["op3_maximal_repeats"](spark, SF), [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()])


def test_odd_rows(spark):
    check(remove_repeats(documents(spark, clash=True)), [(r[0], r[1]) for r in ODD])


def test_empty_table(spark):
    assert remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("wide", [256, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_spliced_texts(spark, monkeypatch, seed, wide):
    """Few letters, shared passages cut at random, edits, periodic runs: all kinds of partial overlap."""
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "KEY_BUCKET_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "DOC_BUCKET_BYTES", 15_000)
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab ") for _ in range(600)) for _ in range(4)] + ["xyz" * 150, "q" * 400]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) - 1)
            parts.append(p[a : a + rng.randint(60, 320)])
            parts.append("".join(rng.choice("cdefg") for _ in range(rng.randint(0, 40))))
        text = list("".join(parts))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = "#"
        rows.append((i, "".join(text), "en", "s"))
    rng.shuffle(rows)
    check(remove_repeats(documents(spark, rows).repartition(7)), [(r[0], r[1]) for r in rows])


def test_interval_tree():
    # Suffixes of "banana": a ana anana banana na nana
    assert sorted(intervals(np.array([1, 3, 0, 0, 2]), 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]
    assert intervals(np.array([], int), 1) == []
