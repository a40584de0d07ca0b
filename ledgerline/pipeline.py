"""From the sources of a session to its merged timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import ulid
from ledgerline.functions.shapes import STRING, struct
from ledgerline.plans.merge import WINDOW_MS, merge
from ledgerline.sources import captures, history
from ledgerline.sources.events import payload_json, wall_ms
from ledgerline.sources.files import read_files
from ledgerline.sources.logs import agent_a_sessions, agent_b_sessions, scan_agent_a, scan_agent_b

ENVELOPE = ("id", "wall_ts", "mono", "session", "agent", "parent", "type", "payload", "payload_hash")


@F.pandas_udf(struct(payload=STRING, payload_hash=STRING))
def _as_payload(text):
    """Payload text and its hash from JSON text."""
    import json

    import pandas as pd

    return pd.DataFrame([payload_json(json.loads(t)) for t in text], columns=["payload", "payload_hash"])


def _enveloped(rows: DataFrame, payload, session, src: int, order: list[str]) -> DataFrame:
    """Rows with id, wall_ts, mono, agent, type as envelope rows of a source."""
    from pyspark.sql import Window as W

    made = rows.withColumn("session", session).withColumn("_p", _as_payload(payload)).withColumns({"payload": F.col("_p.payload"), "payload_hash": F.col("_p.payload_hash"), "src_ord": F.lit(src)})
    return made.withColumn("seq", F.row_number().over(W.partitionBy("session").orderBy(*order)).cast("long"))


def history_source(files: DataFrame, session: str, started, src: int) -> DataFrame:
    rows = history.history_events(history.scan_history(files), started)
    payload = F.to_json(F.struct("argv", F.lit("").alias("cwd"), F.lit("").alias("envHash"), F.lit("reconstructed").alias("source"), F.lit(2).alias("captureSchemaVersion"), F.col("wall_ts").alias("capturedAt"), F.lit("reconstructed").alias("capturedAtSource")))
    rows = rows.withColumn("id", ulid.from_time(wall_ms(F.col("wall_ts")), F.col("path"), F.col("line_no"), F.col("stage"))).withColumn("mono", F.col("line_no").cast("long")).withColumn("parent", F.lit(None).cast("string"))
    return _enveloped(rows, payload, F.lit(session), src, ["path", "line_no", "stage"]).select(*ENVELOPE, "src_ord", "seq")


def reflog_source(files: DataFrame, session: str, started, src: int) -> DataFrame:
    rows = history.reflog_events(history.scan_reflog(files), started)
    own = lambda ordinal: ulid.from_time(wall_ms(F.col("wall_ts")), F.col("path"), F.col("line_no"), ordinal)
    linked = F.col("ordinal") == 1
    rows = rows.withColumn("id", own(F.col("ordinal"))).withColumn("parent", F.when(linked, own(F.lit(0)))).withColumn("mono", (2 * F.col("line_no") + F.col("ordinal")).cast("long")).withColumn("agent", F.lit("git"))
    spawn = F.to_json(F.struct(F.lit(0).alias("pid"), F.lit(0).alias("ppid"), F.lit("git").alias("exe"), "argv", F.lit("").alias("cwd"), F.lit("reconstructed").alias("source")))
    gap = F.to_json(F.struct("reason", F.when(linked, F.array("parent")).otherwise(F.array().cast("array<string>")).alias("affectedEventIds"), "detail"))
    return _enveloped(rows, F.when(F.col("type") == "gap", gap).otherwise(spawn), F.lit(session), src, ["path", "line_no", "ordinal"]).select(*ENVELOPE, "src_ord", "seq")


def capture_source(records: DataFrame, session: str, src: int) -> DataFrame:
    rows = captures.capture_events(records, session).withColumn("parent", F.lit(None).cast("string"))
    gap = F.to_json(F.struct("reason", F.array().cast("array<string>").alias("affectedEventIds"), "detail"))
    keep = {"ignoreNullFields": "false"}
    pre = F.to_json(F.struct("r.argv", "r.cwd", "r.envHash", "r.envSubset", "r.ttyId", "r.user", "r.hostname", "r.parentProcessTree", F.transform(F.coalesce("r.fileArgs", F.array().cast(captures._FILE)), lambda f: F.struct(f["path"].alias("path"), f["preSha256"].alias("preSha256"), f["sizeBytes"].alias("sizeBytes"))).alias("fileArgs"), "r.source", "r.captureSchemaVersion", "r.inputHash", F.col("wall_ts").alias("capturedAt"), "r.sessionId"), keep)
    effect = F.to_json(F.struct(F.lit("effect").alias("kind"), "r.toolName", "r.cwd", "r.exitCode", "r.durationMs", "r.intentEventId", F.when(F.col("r.intentEventId").isNotNull(), "recorded").otherwise("none").alias("intentEventIdSource"), "r.inputHash", "r.files", F.col("source").alias("source"), F.lit(3).alias("captureSchemaVersion"), F.col("wall_ts").alias("capturedAt"), "r.monoNs", "r.sessionId"), keep)
    spawn = F.to_json(F.struct("r.pid", "r.ppid", "r.exe", "r.argv", "r.cwd", "r.comm", "r.ancestry", "r.monoNs", F.lit("kernel").alias("source"), F.lit(None).cast("string").alias("matchedIntentEventId")), keep)
    payload = F.when(F.col("type") == "gap", gap).when(F.col("type") == "tool_call_effect", effect).when(F.col("type") == "process_spawn", spawn).otherwise(pre)
    return _enveloped(rows, payload, F.lit(session), src, ["id"]).select(*ENVELOPE, "src_ord", "seq")


def load_and_merge(spark: SparkSession, session: str, *, agent_a: str | None = None, agent_b: str | None = None, shell_history: str | None = None, reflog: str | None = None, store: str | None = None, include_unattributed: bool = False, window_ms: int = WINDOW_MS) -> dict[str, DataFrame]:
    """events (merged), exclusions (why store records were left out) of one session's sources."""
    log = scan_agent_b(read_files(spark, agent_b), session) if agent_b else scan_agent_a(read_files(spark, agent_a), session)
    facts = (agent_b_sessions(read_files(spark, agent_b)) if agent_b else agent_a_sessions(read_files(spark, agent_a))).orderBy("started").first()  # of several logs the earliest
    started = F.lit(facts.started if facts else None).cast("string")
    from pyspark.sql import Window as W

    parts = [log.withColumn("src_ord", F.lit(0)).withColumn("seq", F.row_number().over(W.partitionBy("session").orderBy("path", "line_no", "ordinal")).cast("long")).select(*ENVELOPE, "src_ord", "seq")]
    if shell_history:
        parts.append(history_source(read_files(spark, shell_history), session, started, 1))
    if reflog:
        parts.append(reflog_source(read_files(spark, reflog), session, started, 2))
    excluded = None
    if store:
        ends = log.agg(F.min(wall_ms(F.col("wall_ts"))).alias("a"), F.max(wall_ms(F.col("wall_ts"))).alias("b")).first()
        low, high = (F.lit(x).cast("long") for x in ((ends.a - 60_000, ends.b + 60_000) if ends.a is not None else (None, None)))
        records = captures.scoped(captures.scan_store(read_files(spark, store)), F.lit(facts.agent_session if facts else None).cast("string"), F.lit(include_unattributed), low, high)
        parts.append(capture_source(records, session, 3))
        by = records.groupBy("decision").agg(F.count("*").alias("n"))
        included, excluded = by.where("decision = 'include'"), by.where("decision <> 'include'")
    events = parts[0]
    for more in parts[1:]:
        events = events.unionByName(more)
    out = {"events": merge(events, window_ms)}
    return out | ({"inclusions": included, "exclusions": excluded} if excluded is not None else {})
