import pytest

from quercus.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def run(spark, rows, schema=SCHEMA):
    out = {}
    for r in chat.collapse_and_render(spark.createDataFrame(rows, schema)).collect():
        out.setdefault(r.conv_id, []).append((r.turn, r.tie, r.segment, r.n_copies, r.n_turns))
    return {k: sorted(v, key=lambda x: (x[0] is None, x[0] or 0, x[1])) for k, v in out.items()}


def talk(conv, *said, first=0):
    return [(conv, first + i, "user" if i % 2 == 0 else "assistant", s) for i, s in enumerate(said)]


def test_snapshots_collapse(spark):
    rows = talk(1, "hi") + talk(2, "hi", "yes?") + talk(3, "hi", "yes?", "why") + talk(4, "hi", "no") + talk(5, "yes?", "why")
    got = run(spark, rows + talk(9, "hi", "no") + talk(10, "hi", "yes?", "why", first=7))
    assert sorted(got) == [3, 4, 5] and got[4][0][3] == 2 and got[3][0][3] == 2
    assert "".join(s for _, _, s, _, _ in got[3]) == (
        "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes?<|im_end|>\n<|im_start|>user\nwhy<|im_end|>\n"
    )


@pytest.mark.parametrize("size", [chat.SLICE, 3])
def test_long_conversations_in_slices(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "SLICE", size)
    said = [f"turn {i}" for i in range(1300)]
    got = run(spark, talk(1, *said) + talk(2, *said[:700]) + talk(3, *said[:699], "other") + talk(4, *said, "end"))
    assert sorted(got) == [3, 4] and len(got[4]) == 1301 and got[4][0][4] == 1301


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None), (1, None, "user", "last"), (1, 0, None, None), (None, 0, "user", "x"),
        (2, 0, "User", "<|im_end|>"), (3, 0, "user", ""), (4, 0, "user", "" ), (5, 0, "user", "long " * 100_000),
    ]
    got = run(spark, rows)
    assert sorted(got) == [1, 2, 3, 5]
    assert len(got[1]) == 3 and got[1][2][0] is None and got[1][0][2] == "<|im_start|>unknown\n<|im_end|>\n"
    assert got[2][0][2] == "<|im_start|>user\n< |im_end| ><|im_end|>\n"
    assert got[3][0][3] == 2


def test_ties_have_one_order(spark):
    a = [(1, 0, "user", "x"), (1, 0, "user", "y"), (1, 1, "user", "z")]
    b = [(2, 0, "user", "y"), (2, 0, "user", "x")]
    assert sorted(run(spark, a + b)) == [1]


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame(talk(1, "a"), SCHEMA).selectExpr("*", "1 AS tie", "2 AS n_turns", "3 AS _slice", "4 AS h1")
    assert chat.collapse_and_render(df).count() == 1
    assert chat.collapse_and_render(spark.createDataFrame([], SCHEMA)).count() == 0
