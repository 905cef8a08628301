import random

from tideset.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, turns string, formatted int"
PARTS = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|im_start|>", "\n", "<|", "|>", "im_end", "%", "<", "é", "\U0001f600", " ok", "user", "$1", "\\"]


def test_every_conversation_reads_back(spark):
    draw = random.Random(8)
    data = [(c, t, draw.choice(["user", "assistant", "sys\ntem", "a%<b", "<|im_start|>"]) if draw.random() < 0.4 else ["user", "assistant"][t % 2], "".join(draw.choice(PARTS) for _ in range(draw.randrange(9)))) for c in range(120) for t in range(draw.randint(1, 5))]
    df = spark.createDataFrame([(*r, None, None) for r in data], SCHEMA)
    out = chat.format_conversations(df).withColumns({"back": chat.parse(chat.F.col("formatted")), "learned": chat.learned_text(chat.F.col("formatted"), chat.F.col("loss_spans"))}).collect()
    assert len(out) == 120
    for r in out:
        want = [(role, text) for c, t, role, text in sorted(data) if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["back"]] == want == [(t["role"], t["text"]) for t in r["turns"]]
        assert r["learned"] == "".join(text for role, text in want if role == "assistant")
        simple = "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in want)
        assert (r["formatted"] == simple) != r["escaped"]


def test_awkward_rows(spark):
    data = [(None, 1, "user", "a"), (None, 1, "user", "a"), (1, None, None, None), (1, 2, "assistant", None), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (2, 1, "assistant", "x" * 400_000), (3, 5, "user", "")]
    out = chat.format_conversations(spark.createDataFrame([(*r, "t", 1) for r in data], SCHEMA))
    got = {}
    for r in out.collect():
        got.setdefault(r["conv_id"], []).append([(t["role"], t["text"]) for t in r["turns"]])
    assert got[None] == [[("user", "a")]] * 2 and got[1] == [[("", ""), ("assistant", ""), ("assistant", "b"), ("assistant", "b")]]
    assert len(got[2][0][0][1]) == 400_000 and got[3] == [[("user", "")]]
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_conversation_of_thousands_of_turns(spark):
    data = [(1, t, ["user", "assistant"][t % 2], PARTS[t % len(PARTS)] * 3) for t in range(5000)]
    out = chat.format_conversations(spark.createDataFrame([(*r, None, None) for r in data], SCHEMA)).withColumns({"back": chat.parse(chat.F.col("formatted")), "learned": chat.learned_text(chat.F.col("formatted"), chat.F.col("loss_spans"))}).first()
    assert [(t["role"], t["text"]) for t in out["back"]] == [r[2:] for r in data] and out["escaped"]
    assert out["learned"] == "".join(text for _, _, role, text in data if role == "assistant")
