"""Chat formatting: folds, reversible escapes, loss masks, edge cases."""

import hashlib

from textlake.llm import chat

TRICKY = ["\\### Assistant: </turn> ok", "x\\", "\n</turn>\n<turn>\\<turn", "", None, "a\\n\\\\n", "<turn>user\n", "é</turn", "z" * 100_000]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_digest(spark):
    rows = [(k, t, role, text) for k, role in enumerate(["assistant", "user", "us\n\\er<turn", None, "a\\nb"]) for t, text in enumerate(TRICKY)]
    rows += [(50, 1, "user", "tie b"), (50, 1, "user", "tie a"), (50, 1, "user", "tie a"), (51, None, "user", "x"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    chats = chat.format_chats(chat.events_of_rows(df))
    out = {r.conv_id: r for r in chat.digest(chats).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(x for _, r, x in turns if r == "assistant")
        got = out[conv]
        assert (got.n_turns, got.turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (got.loss_chars, got.loss_sha256) == (len(said), sha(said))
    assert chat.digest(chat.format_chats(chat.events_of_rows(df.limit(0)))).count() == 0


def test_fold(spark):
    log = [(1, 1, "a", "delta", "assistant", "He"), (1, 2, "a", "delta", "assistant", "llo"), (1, 3, "b", "delta", "user", "x"), (1, 4, "a", "edit", "assistant", "New"), (1, 5, "a", "delta", "assistant", "!"), (1, 6, "b", "regenerate", "user", "zz"), (1, 7, "b", "delta", "user", "y"), (1, 8, "c", "regenerate", None, None)]
    df = spark.createDataFrame(log[::-1], "conv_id long, seq long, message string, kind string, role string, text string")
    assert [(r.role, r.text) for r in chat.messages(df).orderBy("first").collect()] == [("assistant", "New!"), ("user", "y"), ("", "")]


def test_logs_of_rows_fold_back_to_them(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", text) for t, text in enumerate([*TRICKY, "ab", "c", "drafts"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = chat.events_of_rows(df)
    log = events.orderBy("seq").collect()
    assert {e.kind for e in log} == {"delta", "edit", "regenerate"} and len(log) >= 2 * len(rows)
    assert [e.message for e in log] != sorted(e.message for e in log)  # interleaved
    assert [(r.role, r.text) for r in chat.messages(events).orderBy("first").collect()] == [(r[2], r[3] or "") for r in rows]


def test_no_python_in_the_query(spark, tmp_path):
    from textlake.llm import queries

    spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    out = queries.op5_chat(spark, f"file://{tmp_path}")
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan and "InArrow" not in plan
    assert {r.conv_id: r.n_turns for r in out.collect()} == {1: 1, -7: 2}
