"""The driver's `events` table as an event log.

session = user_id, order = (microseconds, event_id). A view is an intent, a click an
effect, a purchase a result, a signup a kernel execution and an error a gap source;
`k` of props stands for hashes, paths and process ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: event types of the driver's table and what they stand for.
TYPES = {"view": "intent", "click": "effect", "purchase": "result", "signup": "exec", "error": "gap"}
#: Half a day: mean spacing per user is eleven hours, so both branches of a match occur.
WINDOW_MS = 12 * 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, session_id, type, us, ms, k, value."""
    events = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("event_type")]
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("session_id"),
        kind.alias("type"),
        us.alias("us"),
        F.floor(us / 1000).cast("long").alias("ms"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "value",
    )


#: The same log for DuckDB, as a common table expression named e.
LOG_SQL = f"""e AS (
  SELECT event_id, user_id::VARCHAR AS session_id,
         CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items())} END AS type,
         epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, json_extract_string(props, '$.k')::INT AS k, value
  FROM events)"""
