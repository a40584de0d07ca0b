"""The capture store: one JSON file per record, named by a ULID, plus a sidecar of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.functions import ulid
from ledgerline.operators import scope
from ledgerline.sources.events import iso, wall_ms

SIDECAR = "capture-failed.log"

_FILE = "array<struct<path: string, preSha256: string, postSha256: string, sizeBytes: bigint, change: string>>"
_TREE = "array<struct<pid: bigint, ppid: bigint, exe: string, argv0: string>>"
RECORD = f"""kind string, toolName string, argv array<string>, cwd string, envHash string, envSubset map<string,string>, ttyId string,
user string, hostname string, parentProcessTree {_TREE}, fileArgs {_FILE}, files {_FILE}, source string, captureSchemaVersion int,
inputHash string, capturedAt string, capturedAtSource string, sessionId string, exitCode bigint, durationMs bigint, intentEventId string,
pid bigint, ppid bigint, ancestry array<bigint>, comm string, exe string, monoNs string, phase string, errorClass string, message string"""


def store_records(files: DataFrame) -> DataFrame:
    """name, raw, mtime_ms from files (name, content, modified) of a store and its sidecar."""
    own = files.where(F.col("name").endswith(".json")).select(F.regexp_replace("name", r"\.json$", "").alias("name"), F.col("content").alias("raw"), F.unix_millis("modified").alias("mtime_ms"))
    side = files.where(F.col("name") == SIDECAR).select(F.explode(F.split("content", "\n")).alias("line"), F.unix_millis("modified").alias("mtime_ms")).where("trim(line) <> ''")
    return own.unionByName(side.select(F.get_json_object("line", "$.ulid").alias("name"), F.get_json_object("line", "$.payload").alias("raw"), "mtime_ms"))


def _kind() -> Column:
    timed = wall_ms(F.col("r.capturedAt")).isNotNull()
    has = lambda *names: [F.col(f"r.{n}").isNotNull() for n in names]
    every = lambda cs: F.array_min(F.array(*cs))
    return (
        F.when(~F.col("named") | F.col("r").isNull(), "malformed")
        .when((F.col("r.kind") == "capture_failed") & timed & every(has("phase", "errorClass", "message")), "capture_failed")
        .when((F.col("r.kind") == "effect") & timed & every(has("toolName", "inputHash")), "effect")
        .when((F.col("r.kind") == "execve") & timed & every(has("pid", "argv")), "execve")
        .when(F.col("r.argv").isNotNull(), "command")
        .otherwise("malformed")
    )


def scan_store(files: DataFrame) -> DataFrame:
    """id, record_kind, r (the record), captured_ms, captured_at, captured_source, record_session.

    A record without a usable time takes that of its file, and says so. Members of the
    wrong type become null and are dropped from arrays; malformed records stay, as such.
    """
    rows = store_records(files).select("name", "mtime_ms", F.from_json("raw", RECORD).alias("r"), ulid.is_valid(F.col("name")).alias("named"))
    rows = rows.withColumn("record_kind", _kind())
    recorded = wall_ms(F.col("r.capturedAt"))
    whole = lambda c: F.filter(F.coalesce(c, F.array().cast(_FILE)), lambda f: f["path"].isNotNull() & f["change"].isNotNull())
    fixed = F.col("r").withField("files", whole(F.col("r.files"))).withField("argv", F.filter("r.argv", lambda a: a.isNotNull())).withField("ancestry", F.filter(F.coalesce("r.ancestry", F.array().cast("array<bigint>")), lambda p: p.isNotNull())).withField("cwd", F.coalesce("r.cwd", F.lit(""))).withField("ppid", F.coalesce("r.ppid", F.lit(0).cast("bigint"))).withField("monoNs", F.coalesce("r.monoNs", F.lit("0")))
    return rows.select(
        F.col("name").alias("id"),
        "record_kind",
        fixed.alias("r"),
        F.coalesce(recorded, "mtime_ms").alias("captured_ms"),
        F.when(recorded.isNotNull(), F.col("r.capturedAt")).otherwise(iso(F.col("mtime_ms"))).alias("captured_at"),
        F.when(recorded.isNotNull(), "recorded").otherwise("derived-from-mtime").alias("captured_source"),
        F.col("r.sessionId").alias("record_session"),
    )


def scoped(records: DataFrame, session: Column, opted_in: Column, low: Column, high: Column) -> DataFrame:
    """records with `decision`: include, or why a record does not belong to the session."""
    decided = scope.decide(F.col("record_session"), session, opted_in, F.col("captured_ms"), low, high)
    return records.withColumn("decision", F.when(F.col("record_kind") == "malformed", "malformed").otherwise(decided))


def capture_events(records: DataFrame, session: str) -> DataFrame:
    """Included records as events; the order of ids breaks ties of time."""
    kinds = F.create_map(*[F.lit(x) for p in (("command", "shell_command_pre"), ("effect", "tool_call_effect"), ("execve", "process_spawn"), ("capture_failed", "gap")) for x in p])
    rows = records.where("decision = 'include'")
    tool = F.when(F.col("r.toolName").isNotNull(), F.concat(F.lit(" while capturing "), "r.toolName")).otherwise("")
    lost = F.concat(F.lit("Capturing failed at "), "captured_at", F.lit(", phase "), "r.phase", tool, F.lit(": "), "r.errorClass", F.lit(", "), "r.message")
    source = F.when(F.col("record_kind") == "execve", "kernel").when(F.col("record_kind") == "effect", "claude-posttooluse").otherwise(F.col("r.source"))
    return rows.select(
        "id",
        F.col("captured_at").alias("wall_ts"),
        F.col("captured_ms").alias("ms"),
        (F.row_number().over(W.partitionBy(F.lit(session)).orderBy("id")) - 1).cast("long").alias("mono"),
        F.lit(session).alias("session"),
        F.when(F.col("r.source") == "shell-shim", "shell").otherwise("agent-a").alias("agent"),
        kinds[F.col("record_kind")].alias("type"),
        source.alias("source"),
        F.when(F.col("record_kind") == "capture_failed", "capture_failed").alias("reason"),
        F.when(F.col("record_kind") == "capture_failed", lost).alias("detail"),
        "r",
    )


def store_stats(files: DataFrame) -> DataFrame:
    """Records, bytes, oldest and newest file, and whether the store wants pruning."""
    held = files.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0)).alias("bytes"), F.min("modified").alias("oldest"), F.max("modified").alias("newest"))
    return held.withColumn("warn", (F.col("records") > 5000) | (F.col("bytes") > 25 * 1024 * 1024))


def prunable(files: DataFrame, now_ms: int, older_than_ms: int) -> DataFrame:
    """Files last changed before the cutoff; nothing is deleted here."""
    return files.where(F.unix_millis("modified") < now_ms - older_than_ms).select("path", "modified")


def duration_ms(text: str) -> int:
    """`<int>[smhd]` in milliseconds."""
    import re

    m = re.fullmatch(r"(\d+)([smhd])", text)
    if not m:
        raise ValueError(f"no duration: {text}")
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]] * 1000
