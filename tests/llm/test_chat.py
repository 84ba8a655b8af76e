from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.llm.chat import ChatTemplate, format_conversations, read_turns, unescape

PARTS = [*ChatTemplate().controls, "\\", "<", "[", "s>", "/s>", "INST]", " ", "a", "é🙂", "\n", ""]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=6).map("".join)


def back(spark, rows):
    df = spark.createDataFrame([(c, t, r, x, 1) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = format_conversations(df).withColumn("turns", read_turns(F.col("formatted")))
    texts = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], ChatTemplate()))
    return {r["conv_id"]: r for r in out.withColumn("loss", texts).collect()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[/ROLE]x", ""]), TEXTS), min_size=1, max_size=30))
def test_turns_come_back(spark, turns):
    rows = [(i % 3, i, role, text) for i, (role, text) in enumerate(turns)]
    got = back(spark, rows)
    for c in {r[0] for r in rows}:
        own = [(role, text) for conv, _, role, text in rows if conv == c]
        assert [tuple(t) for t in got[c]["turns"]] == own
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
        assert "".join(got[c]["loss"]) == "".join(text for role, text in own if role == "assistant")


def test_same_role_turns_share_a_run_and_hard_rows(spark):
    got = back(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", None), (2, None, None, None), (None, 1, "user", "q"), (3, 1, "user", "x"), (3, 1, "user", "x")])
    assert got[1]["formatted"] == "<s>[INST] a[SEP]b [/INST]</s><s>[ROLE] assistant [/ROLE]</s>"
    assert [tuple(t) for t in got[2]["turns"]] == [("", "")] and len(got[3]["turns"]) == 2 and len(got[None]["turns"]) == 1
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
