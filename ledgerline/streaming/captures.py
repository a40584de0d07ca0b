"""The capture store as a stream: event time, keyed state, absence and bounded runs.

The store is a folder of immutable files, so a file stream reads it as it grows. Event
time is the time that a record states, never the time at which it is processed. What
cannot be read goes on as a row that says so; no task fails over a bad file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.sources.captures import RECORD
from ledgerline.sources.events import wall_ms

PENDING_MS = 3_600_000
LATE = "10 minutes"


def read_store(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """name, raw, modified of every file that the store gets."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("id"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("modified"))


def parsed(files: DataFrame) -> DataFrame:
    """id, kind, session, input_hash, captured (event time), failed: one row per file."""
    rows = files.withColumn("r", F.from_json("raw", RECORD))
    ms = F.coalesce(wall_ms(F.col("r.capturedAt")), F.unix_millis("modified"))
    kind = F.when(F.col("r.kind").isNotNull(), F.col("r.kind")).when(F.col("r.argv").isNotNull(), "command").otherwise("malformed")
    return rows.select("id", kind.alias("kind"), F.col("r.sessionId").alias("session"), F.col("r.inputHash").alias("input_hash"), F.timestamp_millis(ms).alias("captured"), (kind == "malformed").alias("failed"), "r")


def sides(rows: DataFrame, late: str = LATE) -> tuple[DataFrame, DataFrame]:
    """Intents and effects of a stream, each with its watermark."""
    keyed = rows.where("session is not null and input_hash is not null")
    intent = keyed.where("kind = 'command'").select("session", "input_hash", F.col("id").alias("intent_id"), F.col("captured").alias("intent_at")).withWatermark("intent_at", late)
    effect = keyed.where("kind = 'effect'").select("session", "input_hash", F.col("id").alias("effect_id"), F.col("captured").alias("effect_at")).withWatermark("effect_at", late)
    return intent, effect


def paired(intent: DataFrame, effect: DataFrame, within: str = "1 hour", how: str = "inner") -> DataFrame:
    """Effects with their intents; with how leftOuter also intents whose effect never came.

    Both sides may be streams: the time bound lets state go, and the outer side is emitted
    once the watermark has passed it.
    """
    e = effect.withColumnsRenamed({"session": "e_session", "input_hash": "e_hash"})
    on = (F.col("session") == F.col("e_session")) & (F.col("input_hash") == F.col("e_hash")) & (F.col("effect_at") >= F.col("intent_at")) & (F.col("effect_at") <= F.col("intent_at") + F.expr(f"interval {within}"))
    out = intent.join(e, on, how)
    took = F.greatest(F.lit(0), F.unix_millis("effect_at") - F.unix_millis("intent_at"))
    return out.select("session", "input_hash", "intent_id", "intent_at", "effect_id", "effect_at", took.alias("duration_ms"))


def absences(pairs: DataFrame) -> DataFrame:
    """Gap rows of an outer pairing."""
    return pairs.where("effect_id is null").select("session", F.col("intent_id").alias("id"), F.lit("intent_without_effect").alias("reason"), F.col("intent_at").alias("at"))


_TAKEN = T.StructType([T.StructField("session", T.StringType()), T.StructField("input_hash", T.StringType()), T.StructField("intent_id", T.StringType()), T.StructField("effect_id", T.StringType()), T.StructField("duration_ms", T.LongType()), T.StructField("state", T.StringType())])
_HELD = T.StructType([T.StructField("ids", T.ArrayType(T.StringType())), T.StructField("at", T.ArrayType(T.LongType()))])


def pending_markers(rows: DataFrame, ttl_ms: int = PENDING_MS, late: str = LATE) -> DataFrame:
    """Take-once pairing in keyed state: an intent waits under (session, hash) for one effect.

    A waiting intent is taken by the next effect of its key and is gone then; one that
    waits longer than ttl_ms in event time is reported as expired. An effect that finds
    nothing is reported as unmatched.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, at = (list(x) for x in (state.get if state.exists else ([], [])))
        out = []
        if state.hasTimedOut:
            out = [(*key, i, None, None, "expired") for i in ids]
            state.remove()
        else:
            rows_of = pd.concat(list(batches)).sort_values(["captured_ms", "id"])
            for own, kind, when in zip(rows_of["id"], rows_of["kind"], rows_of["captured_ms"], strict=True):
                while at and when - at[0] > ttl_ms:
                    at.pop(0)
                    out.append((*key, ids.pop(0), None, None, "expired"))
                if kind == "command":
                    ids.append(own)
                    at.append(int(when))
                elif ids:
                    began = at.pop()
                    out.append((*key, ids.pop(), own, max(0, int(when) - began), "taken"))
                else:
                    out.append((*key, None, own, None, "unmatched"))
            if ids:
                state.update((ids, at))
                state.setTimeoutTimestamp(max(at[0] + ttl_ms, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[f.name for f in _TAKEN.fields])

    keyed = rows.where("kind in ('command', 'effect') and session is not null and input_hash is not null").select("session", "input_hash", "id", "kind", "captured", F.unix_millis("captured").alias("captured_ms")).withWatermark("captured", late)
    return keyed.groupBy("session", "input_hash").applyInPandasWithState(step, _TAKEN, _HELD, "append", "EventTimeTimeout")


def hourly(rows: DataFrame, late: str = LATE) -> DataFrame:
    """Records per hour of event time and kind."""
    return rows.withWatermark("captured", late).groupBy(F.window("captured", "1 hour"), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "kind", "n")


def sliding(rows: DataFrame, width: str = "10 minutes", step: str = "5 minutes", late: str = LATE) -> DataFrame:
    return rows.withWatermark("captured", late).groupBy(F.window("captured", width, step), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def activity(rows: DataFrame, pause: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Stretches of activity per session, closed by a pause."""
    grouped = rows.where("session is not null").withWatermark("captured", late).groupBy("session", F.session_window("captured", pause))
    return grouped.agg(F.count("*").alias("n")).select("session", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n")


def collector_counters(rows: DataFrame) -> DataFrame:
    """Seen, recorded and uncharacterized records of a kernel collector."""
    kernel = rows.where("kind = 'execve'")
    return kernel.agg(F.count("*").alias("seen"), F.count_if(F.size("r.argv") > 0).alias("recorded"), F.count_if(F.coalesce(F.size("r.argv"), F.lit(0)) <= 0).alias("uncharacterized"))


def split_late(rows: DataFrame, newest: Column, allowed: str = LATE) -> tuple[DataFrame, DataFrame]:
    """Rows in time and rows that come later than allowed: the latter are kept apart, not lost."""
    late = F.col("captured") < newest - F.expr(f"interval {allowed}")
    return rows.where(~late), rows.where(late)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", timeout_s: int = 600) -> None:
    """Process what there is and stop; sink gets each batch once per epoch and must be idempotent.

    A stream that is not through in time is an error, never a result in part; its checkpoint
    lets a later call go on from there.
    """
    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout_s):
            raise TimeoutError(f"the stream was not through after {timeout_s} s")
    finally:
        query.stop()


def exec_records(raw: Column) -> Column:
    """pid, monotonic time and name of a 32-byte kernel record in little-endian bytes."""
    byte = lambda at: F.hex(F.substring(raw, at, 1))
    word = lambda at, n: F.conv(F.concat(*[byte(i) for i in range(at + n - 1, at - 1, -1)]), 16, 10).cast("long")
    name = F.substring(raw, 17, 16).cast("string")
    return F.struct(word(1, 4).alias("pid"), word(9, 8).alias("mono"), F.substring_index(name, "\x00", 1).alias("comm"))
