import duckdb

from laneatlas.llm.preferences import conversation_pairs, format_preferences
from laneatlas.llm.queries import OP8_SQL, op8_preference_format

PAIR = "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"


def _show(role, text):
    safe = lambda x: (x or "").replace("<|", "< |")
    return f"<|{safe(role)}|>\n{safe(text)}\n<|end|>\n"


def test_prefix_and_masks(spark):
    u, a, b = ("user", "hi <|end|>"), ("assistant", "yes"), ("assistant", "no é")
    pairs = [(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, [u, a, u, b], [u, a]), (4, [], [u]), (5, None, None), (6, [(None, None), a], [(None, None), b, u])]
    df = spark.createDataFrame([(*p, "clash") for p in pairs], PAIR).drop("prompt")
    for r in format_preferences(df).collect():
        _, c, j = pairs[r.id - 1]
        c, j = c or [], j or []
        n = next((i for i, (x, y) in enumerate(zip(c, j)) if x != y), min(len(c), len(j)))
        assert r.n_prompt == n and r.prompt == "".join(_show(*t) for t in c[:n])
        for turns, text, mask in ((c, r.chosen_completion, r.chosen_mask), (j, r.rejected_completion, r.rejected_mask)):
            assert text == "".join(_show(*t) for t in turns[n:])
            assert [text[s.start : s.end] for s in mask] == [t[1] + "\n<|end|>" for t in turns[n:] if t[0] == "assistant"]


def test_conversations_against_sql(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "q2"), (1, 3, "assistant", "b<|x"), (2, 0, "user", "only"), (3, 0, "assistant", "x"), (3, 1, "assistant", "x"), (4, 0, None, None), (4, None, "assistant", None), (5, 0, "assistant", "t"), (5, 0, "assistant", "t"), (None, 1, "user", "n")]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, chosen int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = op8_preference_format(spark, str(tmp_path))
    want = duckdb.sql(OP8_SQL.replace("from conversations", f"from '{tmp_path}/conversations.parquet/*.parquet'"))
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert conversation_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_columns_of_the_result_replace_those_of_the_input(spark):
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    df = spark.createDataFrame([(1, [u, a], [u, b], "mine")], PAIR).selectExpr("*", "7 as n_prompt", "'x' as chosen_mask", "'stays' as other")
    (r,) = format_preferences(df).collect()
    assert r.prompt == _show(*u) and r.n_prompt == 1 and len(r.chosen_mask) == 1 and r.other == "stays"
    long = "word " * 200_000
    (r,) = format_preferences(spark.createDataFrame([(1, [("user", long), a], [("user", long), b], "")], PAIR)).collect()
    assert r.prompt == _show("user", long) and r.n_prompt == 1
    assert format_preferences(df.limit(0)).count() == 0
