import duckdb

from histoloom.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, prompt string"


def turns(*pairs):
    return [{"role": r, "text": t} for r, t in pairs]


def test_preferences(spark):
    u, a, b = ("user", "hi"), ("assistant", "one"), ("assistant", "two \U0001f600")
    pairs = [(1, turns(u, a), turns(u, b)), (2, turns(u, a, u), turns(u, a)), (3, turns(u, a), turns(u, a)), (4, None, turns(a)), (5, turns(b, u, a), turns(a))]
    frame = spark.createDataFrame(pairs, "conv_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r.conv_id: r for r in chat.preferences(frame).collect()}
    assert [got[i].prompt_turns for i in range(1, 6)] == [1, 2, 2, 0, 0]
    assert got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert got[1].rejected_completion == "<|im_start|>assistant\ntwo \U0001f600<|im_end|>\n"
    assert got[2].rejected_completion == "" and got[2].chosen_mask == ""
    assert got[4].chosen_completion == "" and got[4].prompt == ""

    def learned(text, mask):
        return [text[int(x.split("-")[0]) : int(x.split("-")[1])] for x in mask.split()]

    assert learned(got[1].rejected_completion, got[1].rejected_mask) == ["two \U0001f600<|im_end|>"]
    assert learned(got[5].chosen_completion, got[5].chosen_mask) == ["two \U0001f600<|im_end|>", "one<|im_end|>"]


def test_query_against_sql(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s"),
        (2, 0, "user", "q"), (2, 1, "assistant", None), (3, 0, "user", "only"), (4, None, "assistant", "x"), (4, 0, "assistant", "x"),
        (None, 0, "assistant", "lost"), (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (6, 0, None, "n"), (6, 1, "assistant", ""), (6, 2, "assistant", "éé"),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = chat.preferences(chat.answers_to_compare(chat.conversations(frame))).toPandas()
    conversations = frame.toArrow()  # noqa: F841
    want = duckdb.sql(chat.SQL).df()
    key = lambda d: d.sort_values("conv_id").reset_index(drop=True)
    assert key(got).to_dict("records") == key(want)[got.columns].to_dict("records")
    assert chat.preferences(chat.answers_to_compare(chat.conversations(frame.limit(0)))).count() == 0


def test_long_conversations(spark):
    from pyspark.sql import functions as F

    n = 20_000
    one = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    turn = chat.conversations(one).select("conv_id", F.col("turns").alias("chosen"), F.slice("turns", 1, n - 300).alias("rejected"))
    got = chat.preferences(turn).first()
    assert got.prompt_turns == n - 300 and got.rejected_completion == ""
    whole = chat.preferences(turn.select("conv_id", "chosen", F.slice("chosen", 2, n).alias("rejected"))).first()
    spans, at, text = [], 0, []
    for i in range(n):
        role = "assistant" if i % 2 else "user"
        text.append(f"<|im_start|>{role}\nt{i}<|im_end|>\n")
        if i % 2:
            spans.append(f"{at + 12 + 1 + 9}-{at + len(text[-1]) - 1}")
        at += len(text[-1])
    assert whole.chosen_completion == "".join(text) and whole.chosen_mask == " ".join(spans)
