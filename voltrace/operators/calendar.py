"""Trading sessions: the numbered calendar, as-of lookups and day-0 anchors.

The calendar is a small dimension (a row for each session). An as-of lookup isn't a range join: the calendar is spread
to a row for each calendar day with the sessions before and after it, and calls join that by date, broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOOK_DAYS = 10
EARLY_MINUTE = 9 * 60 + 30


def number_sessions(days: DataFrame, day: str = "session_date") -> DataFrame:
    """(session_date, idx): distinct days numbered from 0 in order."""
    return days.select(F.col(day).alias("session_date")).distinct().withColumn("idx", (F.row_number().over(Window.orderBy("session_date")) - 1).cast("long"))


def day_map(sessions: DataFrame, look: int = LOOK_DAYS) -> DataFrame:
    """For each calendar day near a session: (day, last_date, last_idx, next_date, next_idx, prior_date, prior_idx).

    last is the latest session on or before the day, next the earliest on or after it, each within ``look`` days; prior is
    the session before next, if within ``look`` days of next. Days without any aren't listed.
    """
    in_order = Window.orderBy("session_date")
    known = sessions.withColumns({"before_date": F.lag("session_date").over(in_order), "before_idx": F.lag("idx").over(in_order)})
    back = known.select(F.explode(F.sequence(F.col("session_date"), F.date_add("session_date", look))).alias("day"), F.struct("session_date", "idx").alias("s"))
    last = back.groupBy("day").agg(F.max("s").alias("l"))
    prior = F.when(F.col("before_date") >= F.date_sub("session_date", look), F.struct(F.col("before_date").alias("session_date"), F.col("before_idx").alias("idx")))
    ahead = known.select(F.explode(F.sequence(F.date_sub("session_date", look), F.col("session_date"))).alias("day"), F.struct("session_date", "idx", prior.alias("p")).alias("s"))
    nxt = ahead.groupBy("day").agg(F.min("s").alias("n"))
    return last.join(nxt, "day", "full").select(
        "day",
        F.col("l.session_date").alias("last_date"),
        F.col("l.idx").alias("last_idx"),
        F.col("n.session_date").alias("next_date"),
        F.col("n.idx").alias("next_idx"),
        F.col("n.p.session_date").alias("prior_date"),
        F.col("n.p.idx").alias("prior_idx"),
    )


def anchor_day0(calls: DataFrame, sessions: DataFrame, date: str = "call_date", minute: str | None = "known_minute") -> DataFrame:
    """calls with as_of (date) and day0_idx: the last session on or before the date, or, for a call known to be before
    09:30, the session before the first one on or after it. NULL where no session is near."""
    days = F.broadcast(day_map(sessions))  # under 30 rows a session
    joined = calls.join(days, calls[date] == days["day"], "left")
    early: Column = F.coalesce(F.col(minute) < EARLY_MINUTE, F.lit(False)) if minute else F.lit(False)
    return joined.select(
        *calls.columns,
        F.when(early, F.col("prior_date")).otherwise(F.col("last_date")).alias("as_of"),
        F.when(early, F.col("prior_idx")).otherwise(F.col("last_idx")).alias("day0_idx"),
    )


def session_offsets(anchored: DataFrame, sessions: DataFrame, back: int, ahead: int) -> DataFrame:
    """(calls' columns, offset, session_date) for offsets -back..ahead around day 0; missing sessions give no row."""
    spread = anchored.where("day0_idx IS NOT NULL").withColumn("offset", F.explode(F.sequence(F.lit(-back), F.lit(ahead))))
    spread = spread.withColumn("at_idx", F.col("day0_idx") + F.col("offset"))
    return spread.join(F.broadcast(sessions.withColumnRenamed("idx", "at_idx")), "at_idx").drop("at_idx")


def sessions_between(spans: DataFrame, sessions: DataFrame, first: str, last: str) -> DataFrame:
    """spans with n_sessions: sessions from first to last, both included, as the difference of two as-of numbers."""
    days = day_map(sessions)
    begin = F.broadcast(days.select(F.col("day").alias(first), F.col("next_idx").alias("begin_idx")))
    end = F.broadcast(days.select(F.col("day").alias(last), F.col("last_idx").alias("end_idx")))
    found = spans.join(begin, first, "left").join(end, last, "left")
    count = F.greatest(F.col("end_idx") - F.col("begin_idx") + 1, F.lit(0))
    return found.select(*spans.columns, F.coalesce(count, F.lit(0)).cast("long").alias("n_sessions"))
