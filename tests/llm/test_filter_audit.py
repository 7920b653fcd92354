from collections import Counter
from itertools import permutations

import numpy as np

from placelens.llm.filter_audit import all_steps, audit_documents, contractions
from tests.llm.rows import LONG, ODD, WORD, documents

MORE = [
    (20, "x " * 100, "en", "a"),
    (19, "x " * 100, "de", "a"),
    (19, "x " * 100, "de", "a"),
    (None, "x " * 100, "", "a"),
    (None, "only without id $", "en", "a"),
    (None, "only without id $", "fr", "a"),
    (21, "LOUD WORDS # " + LONG, "en", "a"),
    (22, " ".join(f"w{i}" for i in range(100)), "en", "a"),
    (23, "É Ü # |", None, None),
]
LABELS = [(1, 1, 0), (1, 0, 1), (6, 1, 1), (10, 0, 1), (20, 1, None), (19, None, 1), (None, 1, 1), (999, 1, 1)]


def brute(rows, labels):
    """Runs every order over the documents, one after the other."""
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(t or "", []).append(i)
    docs = []
    for i, t, lang, _ in rows:
        t = t or ""
        words, known = WORD.findall(t), [x for x in ids[t] if x is not None]
        copy = bool(known) and (i is None or i > min(known))
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": copy,
        }
        good = any(q == 1 for k, q, _ in labels if k is not None and k == i)
        toxic = any(x == 1 for k, _, x in labels if k is not None and k == i)
        docs.append((lang or "", fails, good, toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[part, f] += len(gone)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                failing = sum(d[1][f] for d in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, quality int, toxic int, text string")


def test_all_orders_of_odd_rows(spark):
    rows = ODD + MORE
    got = audit_documents(documents(spark, rows, clash=True), labels(spark, LABELS)).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(found) == len(got)
    assert found == brute(rows, LABELS)


def test_many_copies_are_one_row_before_their_first_is_looked_for(spark):
    rows = [(i, "same words here", "en" if i % 2 else "de", "a") for i in range(500, 0, -1)]
    got = audit_documents(documents(spark, rows), labels(spark, [(1, 1, 0), (2, 1, 0)]))
    copies = {(r["part"], r["removed"], r["good_lost"]) for r in got.where("filter_order LIKE 'E%' AND step = 1").collect()}
    assert copies == {("en", 249, 0), ("de", 250, 1)}


def test_empty_tables(spark):
    assert audit_documents(documents(spark, []), labels(spark, [])).count() == 0
    got = audit_documents(documents(spark, [(1, None, None, None)]), labels(spark, [])).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""}


def test_contractions_take_any_number_of_filters():
    tensor = np.random.default_rng(3).integers(0, 50, (3, 2, 2, 2))
    found = contractions(tensor, "ABC")
    at = all_steps("ABC").index(("BAC", 1))
    assert found["removed"][at] == tensor[0, 1, 0, :].sum()
    assert found["kept"][at] == tensor[0, 0, 0, :].sum()
    assert found["redundant"][at] == tensor[0, 1, 1, :].sum()
    assert found["unique_fails"][at] == tensor[0, 1, 0, 0]
    total = {f: [found["shapley"][i] for i, (o, s) in enumerate(all_steps("ABC")) if o[s] == f] for f in "ABC"}
    failing_any = tensor[0].sum() - tensor[0, 0, 0, 0]
    assert sum(v[0] for v in total.values()) == 6 * failing_any
