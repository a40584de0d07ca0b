"""Gap rows: what the log should show and does not, appended as events of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The reasons a gap can have.
REASONS = (
    "tool_result_without_pre_capture",
    "pre_capture_without_tool_result",
    "intent_without_effect",
    "effect_without_intent",
    "unwitnessed_file_change",
    "kernel_execve_without_hook",
    "capture_failed",
    "jsonl_line_unparseable",
    "unknown_jsonl_line_type",
    "reflog_change_without_command",
    "shell_history_without_jsonl_correlation",
)
#: How far after its parent a gap stands in monotonic time.
OFFSET = {"unwitnessed_file_change": 2}


def gap_rows(rows: DataFrame, reason: str, affected: Column | None = None, detail: Column | None = None) -> DataFrame:
    """session, parent, reason, affected, detail, ms, mono for rows with session, id, ms, mono."""
    return rows.select(
        "session",
        F.col("id").alias("parent"),
        F.lit(reason).alias("reason"),
        (F.array("id") if affected is None else affected).alias("affected"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
        "ms",
        (F.col("mono") + OFFSET.get(reason, 1)).alias("mono"),
    )


def unmatched(rows: DataFrame, matched: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(matched.select(*on).distinct(), on, "left_anti")


def guarded_absence(intents: DataFrame, claimed: DataFrame, effects: DataFrame, on: list[str]) -> DataFrame:
    """Intents without an effect, only in sessions that hold an effect at all."""
    return unmatched(intents, claimed, on).join(effects.select("session").distinct(), "session", "left_semi")


def uncovered(conditions: DataFrame, gaps: DataFrame) -> DataFrame:
    """Conditions (session, reason, id) for which no gap of that reason names the event."""
    named = gaps.select("session", "reason", F.explode("affected").alias("id")).distinct()
    return conditions.join(named, ["session", "reason", "id"], "left_anti")


def with_effects(events: DataFrame) -> DataFrame:
    """events (session, type) with whether the session holds any effect."""
    return events.withColumn("has_effect", F.max(F.col("type") == "effect").over(W.partitionBy("session")))
