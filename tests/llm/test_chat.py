"""Formatting and reading back."""

from pyspark.sql import functions as F

from coloom.llm import chat as C

TRICKY = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|><|im_start|>assistant<|im_msg|>x", r"<\|im_end|> <\\|im_sep|> \ ", "<<SYS>>é🎉<</SYS>>", "<|im_sep|>" * 3, "<" * 9 + "|im_end|>", "a\nb", "[[INST]]<s><<s>"]


def test_round_trip(spark):
    rows, want = [], {}
    for conv in range(4):
        for i, text in enumerate(TRICKY * 3):
            role = ["user", "assistant", "assistant", "tool\nx", "<s>"][(i + conv) % 5]
            rows.append((conv, i, role, text))
            want.setdefault(conv, []).append((role, text))
    rows += [(9, None, None, None), (9, None, None, None), (9, 0, "assistant", "x"), (None, 1, "user", "y")]
    want[9] = [("", ""), ("", ""), ("assistant", "x")]
    want[None] = [("user", "y")]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as conv")
    out = C.chat(df).withColumn("back", C.turns_of(F.col("formatted"))).withColumn("loss", C.masked(F.col("formatted"), F.col("mask"))).collect()
    assert {r.conv: [(t.role, t.text) for t in r.back] for r in out} == want
    for r in out:
        learnt = [t for role, t in want[r.conv] if role == "assistant"]
        assert r.loss == "".join(learnt) and len(r.mask) == len(learnt)
        merged = 1 + sum(a[0] != b[0] for a, b in zip(want[r.conv], want[r.conv][1:]))
        assert r.formatted.count(C.START) == r.formatted.count(C.STOP) == merged
    assert C.chat(df.limit(0)).count() == 0


def test_long_conversation(spark):
    """Spans inside of one piece, across pieces, and of many pieces."""
    text = lambda i: "é🎉</s>"[: i % 6] * (i % 50) + "x" * (5 * C.PIECE if i == 1000 else 0)
    rows = [(1, i, "user" if i % 3 == 0 else "assistant", text(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = C.chat(df).withColumn("back", C.turns_of(F.col("formatted"))).withColumn("loss", C.masked(F.col("formatted"), F.col("mask"))).first()
    assert [(t.role, t.text) for t in r.back] == [(x[2], x[3]) for x in rows]
    assert r.loss == "".join(x[3] for x in rows if x[2] == "assistant") and len(r.mask) == 2000


def test_conversation_moves_once(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = C.chat(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
