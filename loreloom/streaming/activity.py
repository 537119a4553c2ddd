"""Daily activity in local time as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Local midnight of UTC+9 is 15:00 UTC of the day before.
LOCAL_START = "15 hours"


def closed_days(messages: DataFrame, *, user: str, delay: str = "1 hour", start: str = LOCAL_START) -> DataFrame:
    """``date, questions, askers`` of every local day, once, when the watermark has passed its end; both numbers are exact.

    Two chained stateful steps: one row for each user and day, then one for each day. Only (user, day) counts move to the
    second step, so a day's users are never held together. Append mode.
    """
    of_user = messages.withWatermark("ts", delay).groupBy(F.window("ts", "1 day", "1 day", start).alias("w"), F.col(user)).agg(F.count("*").alias("n"))
    days = of_user.groupBy(F.window(F.window_time("w"), "1 day", "1 day", start).alias("w")).agg(F.sum("n").alias("questions"), F.count("*").alias("askers"))
    return days.select(F.to_date(F.col("w.end") - F.expr("interval 15 hours")).alias("date"), "questions", "askers")


def daily_activity(messages: DataFrame, *, user: str, delay: str = "1 hour", start: str = LOCAL_START) -> DataFrame:
    """Questions and (approximate) askers per local day, while it runs. Messages: ``ts`` and the user."""
    day = F.window("ts", "1 day", "1 day", start)
    counted = messages.withWatermark("ts", delay).groupBy(day.alias("w")).agg(
        F.count("*").alias("questions"), F.approx_count_distinct(user, 0.02).alias("active_users"))
    return counted.select(F.to_date(F.col("w.end") - F.expr("interval 15 hours")).alias("date"), "questions", "active_users")
