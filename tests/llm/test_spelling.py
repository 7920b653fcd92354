import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from placelens.llm.spelling import Reducer, near_words, reduced_vocabulary, spelling_variants
from tests.llm.rows import ODD, documents, plain, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, t, *_ in rows:
        for run in RUN.findall(t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    pairs = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, found in pairs.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted([(w, form[w], root(w), n[w], len(pairs[w]), n.get(form[w])) for w in n], key=repr)


def test_chains_ties_and_letters(spark):
    words = {"kitchen": 2000, "kitchens": 150, "kitxhens": 14, "kitxhenz": 2, "bitchen": 2, "gärtner": 30, "gÄrtner": 2, "gärtne÷": 3, "aaaaaaa": 25, "aaaaaaaa": 2, "aaaaaaab": 25, "aaaaaab": 2, "Strasse": 3, "strasze": 40}
    text = " ".join(" ".join([w] * c) for w, c in words.items())
    rows = ODD + [(100 + i, text, "en", "a") for i in range(3)] + [(None, "Repeated " * 3, None, None)]
    docs = documents(spark, rows, clash=True)
    assert plain(spelling_variants(docs)) == brute(rows)


def test_roots_reach_through_long_chains(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = [(1, " ".join(" ".join([w] * (2 * 11**i)) for i, w in enumerate(chain)), "en", "a")]
    got = plain(spelling_variants(documents(spark, rows)))
    assert got == brute(rows)
    assert {r[2] for r in got} == {"abcdefghij"}


def test_near_words_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abiqé"), rng.integers(7, 10))) for _ in range(900)} | {"x" * 5000, "x" * 5001, "y" + "x" * 5000})
    rows = reduced_vocabulary(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint"))
    got = [(r["word"], r["near"]) for r in near_words(rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if near(a, b)}


def test_neighbourhoods_are_made_once_each():
    tool = Reducer(3)
    tool.load(pa.array(["aabbcab"]))
    keys = np.concatenate([k for _, k in tool.neighbours()])
    symbols = [ord(c) % 3 for c in "aabbcab"]
    shorter = {tuple(symbols[:i] + symbols[i + 1 :]) for i in range(7)}
    larger = {tuple(symbols[:i] + [c] + symbols[i + 1 :]) for i in range(7) for c in range(symbols[i] + 1, 3)}
    assert len(keys) == len(set(keys.tolist())) == 1 + len(shorter) + len(larger)


def test_query_words_are_whole(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "documents").limit(40).collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert plain(spelling_variants(docs)) == brute(rows)


def test_empty_tables(spark):
    assert spelling_variants(documents(spark, [])).count() == 0
    assert spelling_variants(documents(spark, [(1, None, None, None), (2, "short and few", None, None)])).count() == 0
