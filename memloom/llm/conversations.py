"""Problem 3: conversations from message rows, read as an event log.

fold      creates, edits, deletes, retries and redeliveries of a message become its final state: the row of the highest revision.
judge     each session gets the reasons against it; a session without any is usable.
dialogue  the live messages of the usable sessions in order, with normalised roles.

A session may hold a third of all rows: messages are folded per message, ordered work is done in slices of the sequence, and only sums
and one row per slice meet per session.

Defined results: rows with a null session_id belong to no session; messages with a null message_id are one message of their session;
equal revisions (which the log does not have) fall to the later stored_at, then the larger row id; repeated rows change nothing; a
session without rows has the reasons no_content and no_user; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.slices import lead_across

ROLES = ("user", "assistant", "tool", "system")
REASONS = ("broken_sequence", "no_content", "no_user", "unknown_role", "unknown_reply", "missing_answer")
#: Messages of one slice of a session: a parameter that only spreads the work.
SLICE = 4096


def filled(text: Column) -> Column:
    """Whether a text holds anything but white space; false for null."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def fold(messages: DataFrame, with_content: bool = False) -> DataFrame:
    """One row for each (session_id, message_id): sequence, role (lower case, trimmed), live, filled, done, reply_to and, if asked for, content."""
    role = F.lower(F.regexp_replace("role", r"(?U)^\s+|\s+$", ""))
    state = [
        F.col("sequence"),
        role.alias("role"),
        F.coalesce(F.col("operation") != "delete", F.lit(True)).alias("live"),
        filled(F.col("content")).alias("filled"),
        F.coalesce(F.col("status") == "completed", F.lit(False)).alias("done"),
        F.col("reply_to_message_id").alias("reply_to"),
    ] + ([F.col("content")] if with_content else [])
    newest = F.struct("revision", "stored_at", "conversation_message_row_id")
    x = messages.where("session_id IS NOT NULL").groupBy("session_id", "message_id").agg(F.max_by(F.struct(*state), newest).alias("m"))
    return x.select("session_id", "message_id", "m.*")


def judge(sessions: DataFrame, messages: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """Rows (session_id, reasons) for every session of sessions; reasons is empty for a usable one."""
    m = fold(messages).withColumn("slice", F.floor(F.col("sequence") / slice_size))
    user, answer = F.col("live") & (F.col("role") == "user"), F.col("live") & (F.col("role") == "assistant") & F.col("done") & F.col("filled")

    # Numbers: one row for each (session, sequence) first, so that a repeated number shows however large the session is.
    numbers = m.groupBy("session_id", "slice", "sequence").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("live") & F.col("filled")).alias("content"),
        F.count_if(user).alias("users"),
        F.count_if(F.col("live") & ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).alias("strange"),
    )
    sums = numbers.groupBy("session_id").agg(
        (F.coalesce((F.min("sequence") != 1) | (F.max("sequence") != F.sum("n")) | (F.count("sequence") != F.sum("n")), F.lit(True))).alias("broken_sequence"),
        (F.sum("content") == 0).alias("no_content"),
        (F.sum("users") == 0).alias("no_user"),
        (F.sum("strange") > 0).alias("unknown_role"),
    )
    # Turns: in the order of users and usable answers no user may be followed by another user or by the end.
    at = F.struct("sequence", "message_id").alias("_at")  # messages with the same number go by their ids
    turns = m.where(F.col("sequence").isNotNull() & (user | answer)).select("session_id", "slice", at, F.col("role").alias("_kind"))
    asked = lead_across(turns, ["session_id"], F.col("_kind"), "_at", "_next").where("_kind = 'user'")
    missing = asked.groupBy("session_id").agg(F.bool_or(F.coalesce(F.col("_next") == "user", F.lit(True))).alias("missing_answer"))
    # Replies: each target once.
    replies = fold(messages).where("live AND reply_to IS NOT NULL").select("session_id", F.col("reply_to").alias("message_id")).dropDuplicates()
    known = messages.select("session_id", "message_id").dropDuplicates()
    lost = replies.join(known, ["session_id", "message_id"], "left_anti").select("session_id").dropDuplicates().withColumn("unknown_reply", F.lit(True))

    x = sessions.select("session_id").dropDuplicates().join(sums, "session_id", "left").join(missing, "session_id", "left").join(lost, "session_id", "left")
    empty = {"no_content", "no_user"}
    flags = [F.when(F.coalesce(F.col(r), F.col("broken_sequence").isNull() if r in empty else F.lit(False)), F.lit(r)) for r in REASONS]
    return x.select("session_id", F.array_compact(F.array(*flags)).alias("reasons"))


def dialogue(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows (session_id, sequence, message_id, role, content): the live messages of usable sessions; sequence orders them."""
    usable = judge(sessions, messages).where(F.size("reasons") == 0).select("session_id")
    return fold(messages, with_content=True).where("live").join(usable, "session_id", "left_semi").select("session_id", "sequence", "message_id", "role", "content")
