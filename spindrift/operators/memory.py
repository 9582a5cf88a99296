"""Session memory over (session, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEPT = 20


def last_turns(turns: DataFrame, n: int = KEPT, key: str = "conv_id") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("turn"))
    return turns.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def history(turns: DataFrame, session, n: int = KEPT, key: str = "conv_id") -> DataFrame:
    """The kept turns of a session, in order; none of an unknown one."""
    return last_turns(turns.filter(F.col(key) == session), n, key).orderBy("turn")


def context(turns: DataFrame, n: int = KEPT, key: str = "conv_id") -> DataFrame:
    """(key, turn_count, history): the kept turns of every session as an ordered array; the count is theirs."""
    kept = last_turns(turns, n, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))  # n at most
    return kept.select(key, F.size("history").cast("long").alias("turn_count"), "history")


def reset(turns: DataFrame, sessions: DataFrame, key: str = "conv_id") -> DataFrame:
    """The turns without those of the given sessions."""
    return turns.join(sessions.select(key), key, "left_anti")


def condensed(turns: DataFrame, n: int = 5, chars: int = 100, key: str = "conv_id") -> DataFrame:
    """(key, turn_count, summary): the starts of the last n user turns."""
    users = last_turns(turns.filter("role = 'user'"), n, key)
    joined = users.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, chars).alias("t")))).alias("s"))  # n at most
    counts = turns.groupBy(key).agg(F.count(F.lit(1)).alias("turn_count"))
    return counts.join(joined, key, "left").select(key, "turn_count", F.coalesce(F.array_join(F.transform("s", lambda x: x["t"]), " | "), F.lit("")).alias("summary"))


def last_user_query(turns: DataFrame, chars: int = 4000, key: str = "conv_id", strict: bool = False) -> DataFrame:
    """(key, query): the last user turn that isn't blank, without white space around it; sessions without one are left out, or fail the job with ``strict``."""
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    users = turns.filter("role = 'user'").withColumn("_t", bare).filter("_t <> ''").groupBy(key).agg(F.substring(F.max_by("_t", "turn"), 1, chars).alias("query"))
    if not strict:
        return users
    every = turns.select(key).distinct().join(users, key, "left")
    return every.select(key, F.coalesce("query", F.raise_error(F.concat(F.lit("no user message in session "), F.col(key).cast("string"))).cast("string")).alias("query"))
