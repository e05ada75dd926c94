"""What a session's messages tell: turns, debug loops, pasted errors, word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions import columns as C

LOOP_THRESHOLD = 5
SESSION = ["provider", "session_id"]


def turns(messages: DataFrame) -> DataFrame:
    """(session, turn, user_text, assistant_text): a user message and the assistant's texts up to the next one."""
    ordered = Window.partitionBy(*SESSION).orderBy("message_index")
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    placed = spoken.withColumn("turn", F.sum((F.col("role") == "user").cast("bigint")).over(ordered)).filter("turn > 0")
    texts = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("message_index", "content"))))
    return placed.groupBy(*SESSION, "turn").agg(
        F.max(F.when(F.col("role") == "user", F.col("content"))).alias("user_text"),
        F.array_join(F.transform(texts, lambda x: x["content"]), "\n").alias("assistant_text"),
    )


def not_blank(name: str):
    return F.col(name).rlike(r"\S")


def user_turn_counts(turn_rows: DataFrame) -> DataFrame:
    """(session, user_turn_count) of sessions that have some."""
    return turn_rows.filter(not_blank("user_text")).groupBy(*SESSION).agg(F.count("*").alias("user_turn_count"))


def debug_loops(turn_rows: DataFrame) -> DataFrame:
    """(session, debug_loop_flag): whether an error's signature comes back in five turns.

    A turn that only says that it still fails carries the signature before it on. Such turns make a run
    with the turn they follow, and the run's first signature holds for all that come after it.
    """
    told = turn_rows.filter(not_blank("user_text") & not_blank("assistant_text"))
    ordered = Window.partitionBy(*SESSION).orderBy("turn")
    runs = told.withColumn("run", F.sum((~C.is_continuation(F.col("user_text"))).cast("bigint")).over(ordered)).withColumn("own", C.error_signature(F.col("user_text")))
    carried = Window.partitionBy(*SESSION, "run").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    signed = runs.withColumn("signature", F.first("own", ignorenulls=True).over(carried)).filter(F.col("signature").isNotNull())
    return signed.groupBy(*SESSION, "signature").agg(F.count("*").alias("n")).groupBy(*SESSION).agg(F.max((F.col("n") >= LOOP_THRESHOLD).cast("int")).alias("debug_loop_flag"))


def error_pastes(messages: DataFrame) -> DataFrame:
    """(session, mid_session_error_paste_flag): an error pasted in a user message after the first one."""
    users = messages.filter(F.col("role") == "user")
    first = users.groupBy(*SESSION).agg(F.min("message_index").alias("_first"))
    later = (F.col("message_index") > F.col("_first")) & C.is_error_paste(F.col("content"))
    return users.join(first, SESSION).groupBy(*SESSION).agg(F.max(later.cast("int")).alias("mid_session_error_paste_flag"))


def summaries(messages: DataFrame) -> DataFrame:
    """One row for each session with user turns."""
    rows = turns(messages)
    joined = user_turn_counts(rows).join(debug_loops(rows), SESSION, "left").join(error_pastes(messages), SESSION, "left")
    return joined.fillna(0, ["debug_loop_flag", "mid_session_error_paste_flag"])


def user_words(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role") == "user").groupBy(*SESSION).agg(F.sum(C.word_count(F.col("content"))).alias("user_word_count"))
