import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placelens.llm import packing
from placelens.llm.packing import WordEncoder, pack, pack_documents, patterns, pieces, sequences, tokenizer_path
from placelens.llm.queries import QUERIES
from tests.llm.rows import ODD, SF, documents, table

TEXTS = ["", " ", "It's 's\x0b<|endoftext|>x", "á ́b İ ΣΑΣ Σ.", "a b c\x1cd\x85e", "naïve café́", "123 4.5 x²"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts, tokenizer):
    """Pieces are right, sequences have no gaps and no overlaps; returns the number of sequences."""
    want = Counter()
    for i, t in texts:
        ids = np.array(whole(tokenizer, t), "<u4")
        for n, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[i, n, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins)


def test_query_fills_sequences(spark, tokenizer):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    rows = QUERIES["op7_best_two_fit"](spark, SF).collect()
    n = check(rows, texts, tokenizer)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_odd_rows_and_blocks(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 4)
    rows = ODD + [(200 + i, t, "en", "a") for i, t in enumerate(TEXTS * 3)]
    check(pack_documents(documents(spark, rows, clash=True), tokenizer_path()).collect(), [(r[0], r[1]) for r in rows], tokenizer)


def test_empty_table(spark):
    assert pack_documents(documents(spark, []), tokenizer_path()).count() == 0


def test_sequences_hold_the_ids(spark, tokenizer):
    parts = pieces(documents(spark, ODD), tokenizer_path())
    packed = pack(parts, ["doc_id", "piece", "ids_crc32"])
    made = {r["sequence_id"]: bytes(r["ids"]) for r in sequences(packed).collect()}
    for r in packed.collect():
        assert made[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])


def test_words_in_a_row_are_the_text(tokenizer, monkeypatch):
    encode = WordEncoder(tokenizer_path())
    monkeypatch.setattr(packing, "CACHE_WORDS", 4)
    texts = TEXTS + ["There, THERE. there!? don't 's. İstanbul, ΟΔΟΣ, é́t \u212a K\u0301, ﬁne. ǅ ª² x1, <|startoftext|>.", "naïve, Naïve. NAÏVE"]
    for part in (texts, texts[::-1], texts[:1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(part)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 9), max_size=12))
def test_patterns_use_everything_once(counts):
    used = Counter()
    for bins, lengths in patterns(counts, 50):
        assert bins > 0 and sum(k * v for k, v in lengths.items()) <= 50
        for k, v in lengths.items():
            used[k] += bins * v
    assert used == Counter(counts)


def test_two_documents_replace_the_smallest():
    # Greedy takes 60 and 35 and leaves 5; 20 and 20 in the place of 35 fill the bin.
    assert patterns({60: 1, 35: 1, 20: 2}, 100)[0] == (1, {60: 1, 20: 2})
