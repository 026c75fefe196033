"""Chat history as a table: recent messages, upsert, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.operators.sampling import first_per_key


def recent_messages(messages: DataFrame, limit: int = 10, order: str = "oldest") -> DataFrame:
    """``limit`` messages per session by time. ``oldest`` returns the start of the session, which
    is what existing callers get; ``newest`` its end."""
    ts = F.asc("ts") if order == "oldest" else F.desc("ts")
    tie = F.asc("message_id") if order == "oldest" else F.desc("message_id")
    return first_per_key(messages, ["session_id"], [ts, tie], limit).drop("_rank")


def upsert_messages(base: DataFrame, new: DataFrame) -> DataFrame:
    """``base`` with rows of the same ``message_id`` replaced and others added.

    Of new rows with one id the latest counts, of equally late ones that with the largest hash of all
    its columns. The base is only filtered; Spark broadcasts the new ids where the batch is small.
    """
    last = first_per_key(new, ["message_id"], [F.desc("ts"), F.xxhash64(*new.columns).desc()]).drop("_rank")
    return base.join(new.select("message_id").distinct(), "message_id", "left_anti").select(base.columns).unionByName(last)


def delete_session(base: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What remains, and ``session_id, deleted`` counts."""
    gone = sessions.select("session_id").distinct()
    kept = base.join(gone, "session_id", "left_anti")
    deleted = base.join(gone, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("deleted"))
    return kept, deleted
