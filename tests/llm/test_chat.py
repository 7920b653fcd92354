from placelens.llm.chat import collapse_and_render, numbered_turns
from tests.llm.rows import plain

SCHEMA = "conv_id bigint, turn int, role string, text string, nth string, p1 string, segment string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def chat(*turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_prefixes_and_copies_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "bye")
    rows = [(1, 0, *a), (2, 0, *a), (2, 1, *b), (3, 5, *a), (3, 7, *b), (3, 9, *c), (4, 0, *b), (4, 1, *a), (5, 0, *a), (5, 1, *b), (5, 2, *c), (6, 0, *a), (6, 1, "user", "hello")]
    got = collapse_and_render(conversations(spark, rows)).select("conv_id", "rendered")
    assert plain(got) == [(3, chat(a, b, c)), (4, chat(b, a)), (6, chat(a, ("user", "hello")))]


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (None, 0, "user", "x"), (None, 0, "user", "x"), (2, 0, "user", ""), (7, 0, "user", None)]
    got = collapse_and_render(conversations(spark, rows)).select("conv_id", "rendered")
    # Conversation 7 is the start of 1; null and empty text differ.
    assert plain(got) == [(1, chat(("user", ""), ("", ""))), (2, chat(("user", ""))), (None, chat(("user", "x"), ("user", "x")))]


def test_ties_go_by_text(spark, monkeypatch):
    from placelens.llm import chat as module

    monkeypatch.setattr(module, "RANGE_ROWS", 2)
    long = "same beginning " * 9
    rows = [(1, 1, "user", t) for t in ("z", "y", long + "b", "x", long + "a", None)] + [(1, 1, "assistant", "zz")]
    (got,) = collapse_and_render(conversations(spark, rows)).collect()
    assert got["rendered"] == chat(("assistant", "zz"), *[("user", t) for t in (long + "a", long + "b", "x", "y", "z", "")])


def test_empty_table(spark):
    assert collapse_and_render(conversations(spark, [])).count() == 0


def test_a_long_conversation_is_spread_and_kept_whole(spark, monkeypatch):
    from placelens.llm import chat as module

    monkeypatch.setattr(module, "RANGE_ROWS", 50)
    rows = [(1, i, "user", f"t{i % 7}") for i in range(1000)] + [(2, i, "user", f"t{i % 7}") for i in range(700)]
    turns = numbered_turns(conversations(spark, rows))
    assert sorted(r["nth"] for r in turns.where("conv_id = 1").collect()) == list(range(1, 1001))
    got = collapse_and_render(conversations(spark, rows)).orderBy("segment").collect()
    assert {r["conv_id"] for r in got} == {1}
    assert "".join(r["rendered"] for r in got) == chat(*[("user", f"t{i % 7}") for i in range(1000)])
