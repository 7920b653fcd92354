import hashlib

import numpy as np
import pyarrow as pa

from placelens.llm import fingerprints
from placelens.llm.fingerprints import EMPTY, Fingerprinter, as_text, densify, fingerprint_edits, from_text, likeness, probe_order
from placelens.llm.queries import QUERIES
from tests.llm.rows import ODD, SF, documents, shingles, table


def edits(rows):
    """[(doc_id, text, edited text, next text)] in the order of ids, nulls last, then of texts."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        out.append((i, t, t[: len(t) - q] + nxt[:q], nxt))
    return out


def words(text):
    from tests.llm.rows import WORD

    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def check(got, rows):
    want = edits(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    a = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key)
    b = sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want), key=key)
    assert a == b
    return want


def test_query_and_estimates(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    got = QUERIES["op4_one_permutation_minhash"](spark, SF).collect()
    want = {i: (t, e, n) for i, t, e, n in check(got, rows)}
    prints, errors = {}, []
    for r in got:
        t, e, n = want[r["doc_id"]]
        prints.setdefault(t, set()).add(r["fingerprint"])
        prints.setdefault(e, set()).add(r["edited_fingerprint"])
        for seen, other in ((r["near_edited"], e), (r["near_next"], n)):
            a, b = words(t), words(other)
            errors.append(seen - (len(a & b) / len(a | b) if a | b else 1.0))
    assert all(len(v) == 1 for v in prints.values())
    errors = np.array(errors)
    assert abs(errors).max() < 0.16 and np.sqrt((errors**2).mean()) < 0.04 and abs(errors.mean()) < 0.02


def test_odd_rows_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_BYTES", 1 << 14)
    got = fingerprint_edits(documents(spark, clash=True)).collect()
    check(got, [(r[0], r[1]) for r in ODD])
    empty = [r for r in got if r["doc_id"] in (2, 3, 4)]
    assert all(r["fingerprint"] == "" for r in empty)


def test_one_row_follows_itself_and_empty_table(spark):
    one = fingerprint_edits(documents(spark, [(1, "a b c d e f g h", "en", "a")])).collect()
    assert one[0]["near_next"] == 1.0
    assert fingerprint_edits(documents(spark, [])).count() == 0


def test_densification_asks_in_a_fixed_order():
    order = probe_order(64)
    rng = np.random.default_rng(3)
    values = np.full((3, 64), EMPTY)
    for row, n in enumerate((1, 20, 64)):
        values[row, rng.choice(64, n, replace=False)] = rng.integers(0, 1000, n, dtype=np.uint64)
    out = densify(values, order)
    for row in range(3):
        for i in range(64):
            asked = i if values[row, i] != EMPTY else next(j for j in order[i] if values[row, j] != EMPTY)
            assert out[row, i] == values[row, asked]


def test_stored_form_round_trips():
    tool = Fingerprinter()
    packed = tool.packed(pa.array(["a b c d e f", "", None, "a b c d e f"]))
    again = np.stack([from_text(x) for x in as_text(packed)])
    assert likeness(packed, again).tolist() == [1.0, 1.0, 1.0, 1.0]
    assert likeness(packed[:1], packed[1:2])[0] == 0.0


def test_rows_helper():
    assert shingles("A b", 3) == {("a", "b")}
