from datetime import datetime

import pytest

from memloom.llm import conversations as cv

SCHEMA = "conversation_message_row_id string, session_id string, message_id string, sequence int, role string, status string, content string, reply_to_message_id string, revision int, operation string, stored_at timestamp, slice int"


def row(s, m, seq, role, content="text", status="completed", reply=None, rev=1, op="append"):
    return (f"{s}{m}{rev}", s, m, seq, role, status, content, reply, rev, op, datetime(2025, 1, 1), 7)


OK = [row("ok", "1", 1, " User\n"), row("ok", "2", 2, "ASSISTANT", reply="1"), row("ok", "2", 2, "ASSISTANT", reply="1")]
CASES = {
    "ok": (OK, []),
    "edited": ([row("edited", "1", 1, "user"), row("edited", "2", 2, "assistant", " "), row("edited", "2", 2, "assistant", rev=2, op="replace")], []),
    "deleted": ([row("deleted", "1", 1, "user"), row("deleted", "2", 2, "assistant"), row("deleted", "2", 2, "assistant", rev=2, op="delete")], ["missing_answer"]),
    "deleted_counts": ([row("deleted_counts", "1", 1, "user"), row("deleted_counts", "2", 2, "bot", op="delete"), row("deleted_counts", "3", 3, "assistant")], []),
    "gap": ([row("gap", "1", 1, "user"), row("gap", "2", 3, "assistant")], ["broken_sequence"]),
    "twice": ([row("twice", "1", 1, "user"), row("twice", "2", 2, "assistant"), row("twice", "3", 2, "tool")], ["broken_sequence"]),
    "null_sequence": ([row("null_sequence", "1", 1, "user"), row("null_sequence", "2", 2, "assistant"), row("null_sequence", "3", None, "tool")], ["broken_sequence"]),
    "blank": ([row("blank", "1", 1, "user", "　\n"), row("blank", "2", 2, "assistant", "")], ["no_content", "missing_answer"]),
    "no_user": ([row("no_user", "1", 1, "system"), row("no_user", "2", 2, "assistant")], ["no_user"]),
    "role": ([row("role", "1", 1, "user"), row("role", "2", 2, "assistant"), row("role", "3", 3, None)], ["unknown_role"]),
    "reply": ([row("reply", "1", 1, "user"), row("reply", "2", 2, "assistant", reply="9")], ["unknown_reply"]),
    "failed": ([row("failed", "1", 1, "user"), row("failed", "2", 2, "assistant", status="failed")], ["missing_answer"]),
    "two_users": ([row("two_users", "1", 1, "user"), row("two_users", "2", 2, "user"), row("two_users", "3", 3, "assistant")], ["missing_answer"]),
    "silent": ([], ["no_content", "no_user"]),
}


@pytest.mark.parametrize("slice_size", [1, 2, 4096])
def test_every_reason(spark, slice_size):
    messages = spark.createDataFrame([r for rows, _ in CASES.values() for r in rows], SCHEMA)
    sessions = spark.createDataFrame([(s,) for s in CASES], "session_id string")
    got = {r.session_id: r.reasons for r in cv.judge(sessions, messages, slice_size).collect()}
    assert got == {s: reasons for s, (_, reasons) in CASES.items()}


def test_dialogue_and_empty_tables(spark):
    messages = spark.createDataFrame([r for rows, _ in CASES.values() for r in rows], SCHEMA)
    sessions = spark.createDataFrame([(s,) for s in CASES], "session_id string")
    got = cv.dialogue(sessions, messages).where("session_id = 'ok'").orderBy("sequence").collect()
    assert [(r.sequence, r.role) for r in got] == [(1, "user"), (2, "assistant")]
    assert {r.session_id for r in cv.dialogue(sessions, messages).select("session_id").collect()} == {"ok", "edited", "deleted_counts"}
    assert cv.judge(sessions.limit(0), messages.limit(0)).count() == 0
    assert all(r.reasons for r in cv.judge(sessions, messages.limit(0)).collect())


def test_a_session_of_many_turns(spark):
    rows = [row("big", str(i), i + 1, "user" if i % 2 == 0 else "assistant") for i in range(3000)]
    sessions = spark.createDataFrame([("big",)], "session_id string")
    assert cv.judge(sessions, spark.createDataFrame(rows, SCHEMA), 64).first().reasons == []
