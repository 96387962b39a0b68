"""Recurring review tasks: due dates, status changes, boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Interval lengths in days, and the order of status groups on a board.
INTERVAL_DAYS = {"daily": 1, "weekly": 7, "biweekly": 14, "monthly": 30, "quarterly": 90}
STATUS_ORDER = ["overdue", "pending", "completed", "snoozed", "dismissed"]


def interval_days(interval: Column, override: Column) -> Column:
    days = F.create_map(*[F.lit(x) for kv in INTERVAL_DAYS.items() for x in kv])
    return F.coalesce(F.try_element_at(days, override), F.try_element_at(days, interval), F.lit(30))


def _after(base: Column, days: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(base.cast("timestamp")) + days.cast("bigint") * 86_400_000)


def completed(tasks: DataFrame, at: Column) -> DataFrame:
    return (
        tasks.withColumn("status", F.lit("completed")).withColumn("last_completed_at", at)
        .withColumn("next_due_at", _after(at, interval_days(F.col("interval"), F.col("interval_override"))))
        .withColumn("snooze_until", F.lit(None).cast("timestamp"))
    )


def snoozed(tasks: DataFrame, until: Column) -> DataFrame:
    return tasks.withColumn("status", F.lit("snoozed")).withColumn("snooze_until", until)


def rescheduled(tasks: DataFrame, interval: str, now: Column) -> DataFrame:
    base = F.coalesce(F.col("last_completed_at").cast("timestamp"), now)
    return tasks.withColumn("interval_override", F.lit(interval)).withColumn(
        "next_due_at", _after(base, F.lit(INTERVAL_DAYS[interval]))
    )


def swept(tasks: DataFrame, now: Column) -> DataFrame:
    """Ended snoozes return to pending; what is due becomes overdue (`newly_overdue`)."""
    woke = (F.col("status") == "snoozed") & F.col("snooze_until").isNotNull() & (F.col("snooze_until") <= now)
    status = F.when(woke, "pending").otherwise(F.col("status"))
    due = status.isin("pending", "completed") & (F.col("next_due_at") <= now)
    return tasks.select(
        *[c for c in tasks.columns if c not in ("status", "snooze_until")],
        F.when(due, "overdue").otherwise(status).alias("status"),
        F.when(~woke, F.col("snooze_until")).alias("snooze_until"),
        F.coalesce(due, F.lit(False)).alias("newly_overdue"),
    )


def auto_completed(tasks: DataFrame, triggers: DataFrame) -> DataFrame:
    """Open tasks that a finished run of their kind completes. `triggers` (repo, trigger, at)."""
    last = triggers.groupBy("repo", "trigger").agg(F.max("at").alias("at"))
    open_ones = tasks.where(F.col("status").isin("overdue", "pending"))
    return completed(open_ones.join(last, ["repo", "trigger"]), F.col("at")).drop("at")


def task_summary(tasks: DataFrame, now: Column, soon_hours: int = 24) -> DataFrame:
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    soon = F.col("status").isin("pending", "completed") & (F.col("next_due_at") <= now + F.make_interval(hours=F.lit(soon_hours)))
    return tasks.groupBy("repo").agg(
        F.count("*").alias("total"), *[n(s) for s in STATUS_ORDER], F.sum(F.when(soon, 1).otherwise(0)).alias("due_soon")
    )


def task_board(tasks: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status")).cast("int")
    return tasks.withColumn("group_rank", rank).orderBy("group_rank", F.col("priority").desc(), "repo", "task_id")
