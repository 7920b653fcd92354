from collections import Counter

from placelens.llm.quality_rules import SYMBOLS, keep_good, quality_rules
from tests.llm.rows import ODD, WORD, documents

SHOUT = "THE HOUSE AND THE GARDEN ARE ON THE HILL " * 1 + " ".join(f"WORD{chr(65 + i % 26)}{chr(65 + i // 26)} THE" for i in range(80))
GOOD = "The house and the garden are on the hill. " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} the" for i in range(80))
EDGE = [
    (21, GOOD, "en", "a"),
    (22, SHOUT, "en", "a"),
    (23, GOOD + " ##" * 40, "en", "a"),
    (24, "\n".join(["same line"] * 3 + [" ", " "]), "en", "a"),
    (25, "a b c a b c x a b c", "en", "a"),
    (26, "a a a a", "en", "a"),
    (27, "x y", "en", "a"),
]


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if n[g] > 1 for d in range(3)}
    return (len(w), sum(map(len, w)), sum(c in SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered))


def test_metrics_of_odd_rows(spark):
    rows = ODD + EDGE
    docs = documents(spark, rows, clash=True)
    judged = quality_rules(docs, verdict="verdict")
    assert judged.columns == [*docs.columns, "verdict"]
    for r in judged.collect():
        v = r["verdict"]
        want = brute(r["text"])
        assert (v["n_words"], v["word_chars"], v["n_symbols"], v["n_dup_lines"], v["n_repeat_words"]) == want
        assert v["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert v["kept"] == (not v["failed"])
    failed = {r["doc_id"]: r["verdict"]["failed"] for r in judged.collect()}
    assert failed[21] == [] and failed[22] == ["capitals"] and failed[23] == ["symbols"]


def test_clean_rows_pass_with_their_columns(spark):
    docs = documents(spark, ODD + EDGE, clash=True)
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [21]


def test_empty_table(spark):
    assert quality_rules(documents(spark, [])).count() == 0
    assert keep_good(documents(spark, [])).count() == 0


def test_no_user_functions_and_no_shuffle(spark):
    plan = quality_rules(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
