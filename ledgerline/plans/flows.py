"""Queries that run whole flows (sources, sinks, verification, streams) over the driver's tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.adapter import LOG_SQL, event_log, table
from ledgerline.functions import jcs, shell, ulid
from ledgerline.operators import rules
from ledgerline.plans import exports, merge, verify
from ledgerline.sinks import commit_fields, event_line, seal, write_bundle
from ledgerline.sources import captures, history, hooks
from ledgerline.sources.events import iso
from ledgerline.sources.logs import agent_a_sessions, agent_b_sessions, scan_agent_a, scan_agent_b
from ledgerline.streaming import captures as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _files(rows: DataFrame, path: str, order: str, line) -> DataFrame:
    """path, content: one file per value of path, its lines in order."""
    held = rows.select(F.col(path).cast("string").alias("path"), F.col(order).alias("o"), line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n")
    return held.groupBy("path").agg(text.alias("content"))


def _stamp():
    return F.concat(F.lit("2025-01-01T00:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("Z"))


# --- sources -----------------------------------------------------------------------------

_TURNS = "CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'assistant_message' ELSE 'gap' END"


def _agent_a_files(spark: SparkSession, d: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("content"), _stamp().alias("timestamp"), F.concat(F.lit("c"), F.col("conv_id")).alias("session_id"), F.concat(F.lit("/w/"), F.col("turn") % 3).alias("cwd")))
    return _files(table(spark, d, "conversations"), "conv_id", "turn", line)


@query("s1_agent_a_scan", f"SELECT 'c' || conv_id AS session, {_TURNS} AS type, count(*) AS n, count(DISTINCT turn) AS ids FROM conversations GROUP BY ALL")
def s1_agent_a_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan_agent_a(_agent_a_files(spark, d)).groupBy("session", "type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("s1_agent_a_parents", """WITH p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line FROM conversations)
SELECT 'c' || conv_id AS session, line AS line_no, CASE WHEN parent IS NULL THEN NULL ELSE line - 1 END AS parent_line FROM p""")
def s1_agent_a_parents(spark: SparkSession, d: str) -> DataFrame:
    events = scan_agent_a(_agent_a_files(spark, d))
    above = events.select("session", F.col("id").alias("parent"), F.col("line_no").cast("long").alias("parent_line"))
    return events.join(above, ["session", "parent"], "left").select("session", F.col("line_no").cast("long").alias("line_no"), "parent_line")


@query("s1_agent_a_sessions", """SELECT conv_id::VARCHAR AS path, 'c' || conv_id AS agent_session, min('2025-01-01T00:00:' || lpad((turn % 60)::VARCHAR, 2, '0') || 'Z') AS started,
array_to_string(list_distinct(list('/w/' || (turn % 3) ORDER BY turn)), ',') <> '' AS has_cwds FROM conversations GROUP BY conv_id""")
def s1_agent_a_session_facts(spark: SparkSession, d: str) -> DataFrame:
    return agent_a_sessions(_agent_a_files(spark, d)).select("path", "agent_session", "started", (F.size("cwds") > 0).alias("has_cwds"))


def _agent_b_files(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"), F.concat(F.lit("r"), F.col("conv_id")).alias("id"))
    line = F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, _stamp()).alias("timestamp"), F.when(F.col("turn") == 0, "session_meta").otherwise("response_item").alias("type"), item.alias("payload")))
    return _files(table(spark, d, "conversations"), "conv_id", "turn", line)


@query("s4_agent_b_scan", f"SELECT conv_id::VARCHAR AS path, {_TURNS} AS type, count(*) AS n, min('2025-01-01T00:00:' || lpad((turn // 2 * 2 % 60)::VARCHAR, 2, '0') || 'Z') AS first_ts FROM conversations WHERE turn > 0 AND role <> 'system' GROUP BY ALL")
def s4_agent_b_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan_agent_b(_agent_b_files(spark, d)).groupBy("path", "type").agg(F.count("*").alias("n"), F.min("wall_ts").alias("first_ts"))


@query("s6_agent_b_sessions", "SELECT conv_id::VARCHAR AS path, 'v2' AS form, 'r' || conv_id AS agent_session, '2025-01-01T00:00:00Z' AS started FROM conversations WHERE turn = 0")
def s6_agent_b_sessions(spark: SparkSession, d: str) -> DataFrame:
    return agent_b_sessions(_agent_b_files(spark, d)).where("agent_session is not null").select("path", "form", "agent_session", "started")


@query("s9_bash_history", f"""WITH {LOG_SQL}, r AS (SELECT session_id AS path, us, event_id, CASE k % 3 WHEN 0 THEN NULL ELSE us // 1000000 * 1000 END AS at_ms, type, k FROM e)
SELECT path, at_ms, 'run ' || type AS command, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT path, at_ms, 'wc ''' || k || ' x''' AS command, count(*) FROM r WHERE k % 2 = 0 GROUP BY ALL""")
def s9_bash_history(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    seconds, k = F.floor(F.col("us") / 1_000_000).cast("string"), F.col("k")
    command = F.concat(F.lit("run "), "type", F.when(k % 2 == 0, F.concat(F.lit(" | wc '"), k, F.lit(" x'"))).otherwise(""))
    line = F.when(k % 3 == 0, command).when(k % 3 == 1, F.concat(F.lit("#"), seconds, F.lit("\n"), command)).otherwise(F.concat(seconds, F.lit("  "), command))
    return history.scan_history(_files(log, "session_id", "event_id", line)).groupBy("path", "at_ms", "command").agg(F.count("*").alias("n"))


@query("s10_fish_history", f"WITH {LOG_SQL} SELECT session_id AS path, CASE WHEN k % 2 = 0 THEN us // 1000000 * 1000 END AS at_ms, 'do ' || k AS command, count(*) AS n FROM e GROUP BY ALL")
def s10_fish_history(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    when = F.when(F.col("k") % 2 == 0, F.concat(F.lit("\n  when: "), F.floor(F.col("us") / 1_000_000).cast("string"))).otherwise("")
    line = F.concat(F.lit("- cmd: do "), F.col("k"), when, F.lit("\n  paths:\n    - /x"))
    return history.scan_history(_files(log, "session_id", "event_id", line)).groupBy("path", "at_ms", "command").agg(F.count("*").alias("n"))


@query("s12_reflog", """SELECT o_custkey::VARCHAR AS path, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE 'commit' END AS action, count(*) AS n FROM orders GROUP BY ALL""")
def s12_reflog(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    line = F.when(key % 3 == 0, F.concat(F.lit("abcdef0 (HEAD -> main) commit: "), key, F.lit(" 2025-01-01 00:00:00 +0000"))).when(key % 3 == 1, F.concat(F.lit("abcdef0 commit: "), key)).otherwise(F.lit("no entry"))
    return history.scan_reflog(_files(table(spark, d, "orders"), "o_custkey", "o_orderkey", line)).groupBy("path", "action").agg(F.count("*").alias("n"))


def _store(spark: SparkSession, d: str) -> DataFrame:
    """The event log as a capture store: intents, effects, executions and failures."""
    log = event_log(spark, d)
    at, k, own = iso(F.col("ms")), F.col("k"), ulid.from_time(F.col("ms"), F.lit("r"), F.col("event_id"))
    common = [at.alias("capturedAt"), F.when(k % 5 > 0, F.col("session_id")).alias("sessionId"), F.col("us").cast("string").alias("monoNs")]
    hashed = F.concat(F.lit("h"), k % 20).alias("inputHash")
    argv = F.array(F.lit("bash"), F.lit("-c"), F.concat(F.lit("run "), k))
    file = lambda *more: F.array(F.struct(F.concat(F.lit("/f/"), k % 7).alias("path"), *more))
    digest = F.concat(F.lit("d"), k % 3)
    command = F.to_json(F.struct(argv.alias("argv"), F.lit("/w").alias("cwd"), F.lit("claude-pretooluse").alias("source"), hashed, file(digest.alias("preSha256")).alias("fileArgs"), F.array(F.struct(k.alias("pid"), (k + 1).alias("ppid"))).alias("parentProcessTree"), *common))
    effect = F.to_json(F.struct(F.lit("effect").alias("kind"), F.lit("Bash").alias("toolName"), hashed, file(digest.alias("postSha256"), F.lit("modified").alias("change")).alias("files"), *common))
    execve = F.to_json(F.struct(F.lit("execve").alias("kind"), k.alias("pid"), (k + 1).alias("ppid"), F.array(k + 2).alias("ancestry"), F.array(F.lit("x")).alias("argv"), F.lit("/x").alias("exe"), *common))
    failed = F.to_json(F.struct(F.lit("capture_failed").alias("kind"), F.lit("write").alias("phase"), F.lit("E").alias("errorClass"), F.lit("m").alias("message"), *common))
    raw = F.when(F.col("type") == "intent", command).when(F.col("type") == "effect", effect).when(F.col("type") == "exec", execve).when(F.col("type") == "gap", failed).otherwise(F.lit('{"odd": 1}'))
    return log.select("event_id", "session_id", F.concat(own, F.lit(".json")).alias("name"), raw.alias("content"), F.timestamp_millis("ms").alias("modified"))


@query("s14_store_scan", f"""WITH {LOG_SQL} SELECT CASE type WHEN 'intent' THEN 'command' WHEN 'effect' THEN 'effect' WHEN 'exec' THEN 'execve' WHEN 'gap' THEN 'capture_failed' ELSE 'malformed' END AS record_kind,
CASE WHEN type = 'result' THEN 'derived-from-mtime' ELSE 'recorded' END AS captured_source, count(*) AS n, sum(ms)::BIGINT AS ms FROM e GROUP BY ALL""")
def s14_store_scan(spark: SparkSession, d: str) -> DataFrame:
    return captures.scan_store(_store(spark, d)).groupBy("record_kind", "captured_source").agg(F.count("*").alias("n"), F.sum("captured_ms").alias("ms"))


@query("s24_hook_inputs", "SELECT event_id, event_type IN ('view') OR (event_type = 'click' AND json_extract_string(props, '$.k')::INT % 2 = 0) AS should_hash, sha256('{\"toolInput\":{\"command\":\"' || CASE WHEN json_extract_string(props, '$.k')::INT % 2 = 0 THEN 'rm ' ELSE 'ls ' END || json_extract_string(props, '$.k') || '\"},\"toolName\":\"' || CASE event_type WHEN 'view' THEN 'Edit' WHEN 'click' THEN 'Bash' ELSE 'Read' END || '\"}') AS input_hash FROM events")
def s24_hook_inputs(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    tool = F.when(F.col("event_type") == "view", "Edit").when(F.col("event_type") == "click", "Bash").otherwise("Read")
    command = F.concat(F.when(k % 2 == 0, "rm ").otherwise("ls "), k)
    raw = F.to_json(F.struct(tool.alias("tool_name"), F.struct(command.alias("command")).alias("tool_input")))
    return hooks.parse(events.select("event_id", raw.alias("raw"))).select("event_id", "should_hash", "input_hash")


# --- commands and rules ------------------------------------------------------------------


@query("f5_history_stages", "SELECT doc_id, len(list_filter(string_split_regex(text, '[|;]'), lambda x: regexp_matches(x, '[^ \\t\\n\\r]'))) AS stages FROM (SELECT doc_id, regexp_replace(text, '[\"''\\\\&]', '', 'g') AS text FROM documents)")
def f5_history_stages(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace("text", r"""["'\\&]""", "")
    return table(spark, d, "documents").select("doc_id", F.size(shell.history_stages(plain)).cast("long").alias("stages"))


@query("r1_simple_commands", f"WITH {LOG_SQL} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'rm -rf /' || k ELSE 'git -C /r push --force' END AS command, CASE WHEN k % 2 = 0 THEN 'rm-rf' ELSE 'git-push-force' END AS rule_id FROM e")
def r1_simple_commands(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    text = F.when(k % 2 == 0, F.concat(F.lit("cd /x && sudo -u root bash -c 'rm -rf /"), k, F.lit("'"))).otherwise(F.lit("(echo $(ls); env A=1 git -C /r push --force)"))
    log = event_log(spark, d).select("event_id", F.lit("tool_call_intent").alias("type"), F.lit("Bash").alias("tool_name"), text.alias("command"), F.lit(None).cast("array<string>").alias("argv"))
    commands = rules.event_commands(log)
    found = rules.matches(commands, rules.rule_table(spark))
    return found.join(commands.select("event_id", "idx", F.array_join("argv", " ").alias("command")), ["event_id", "idx"]).select("event_id", "command", "rule_id")


# --- merge, sealing, exports -------------------------------------------------------------


def merged_log(spark: SparkSession, d: str) -> DataFrame:
    """The event log as a capture store, read back, scoped per session and merged."""
    store = _store(spark, d)
    records = captures.scan_store(store).join(store.select(F.regexp_replace("name", r"\.json$", "").alias("id"), F.col("session_id").alias("owner")), "id")
    nothing = F.lit(None).cast("long")
    records = captures.scoped(records, F.col("owner"), F.lit(True), nothing, nothing)
    kinds = F.create_map(*[F.lit(x) for p in (("command", "shell_command_pre"), ("effect", "tool_call_effect"), ("execve", "process_spawn"), ("capture_failed", "gap")) for x in p])
    body = F.to_json(F.struct("r.toolName", "r.argv", "r.cwd", "r.source", "r.inputHash", "r.fileArgs", "r.files", "r.pid", "r.ppid", "r.ancestry", "r.exe", "r.parentProcessTree"))
    kernel = F.when(F.col("record_kind") == "execve", F.regexp_replace(body, r"^\{", '{"source":"kernel",')).when(F.col("record_kind") == "capture_failed", F.lit('{"reason":"capture_failed","affectedEventIds":[]}')).otherwise(body)
    rows = records.where("decision = 'include'").withColumn("payload", kernel)
    rows = rows.select("id", F.col("captured_at").alias("wall_ts"), F.col("captured_ms").alias("mono"), F.col("owner").alias("session"), F.lit("agent-a").alias("agent"), F.lit(None).cast("string").alias("parent"), kinds[F.col("record_kind")].alias("type"), "payload", F.lit(3).alias("src_ord"), F.col("captured_ms").alias("seq"))
    return merge.merge(rows.withColumn("payload_hash", F.sha2(jcs.jcs("payload").cast("binary"), 256)), 12 * 3_600_000)


@query("merge_timeline")
def merge_timeline(spark: SparkSession, d: str) -> DataFrame:
    events = merged_log(spark, d)
    reason = F.when(F.col("type") == "gap", F.get_json_object("payload", "$.reason"))
    return events.groupBy("type", reason.alias("reason")).agg(F.count("*").alias("n"), F.count("linked_pre").alias("linked_pre"), F.count("linked_effect").alias("linked_effect"), F.count("linked_intent").alias("linked_intent"))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """Turns as events whose canonical JSON SQL can state."""
    turns = table(spark, d, "conversations")
    own = F.concat(F.lpad(F.col("conv_id").cast("string"), 13, "0"), F.lpad(F.col("turn").cast("string"), 13, "0"))
    text = F.md5(F.col("text").cast("binary"))
    payload = F.concat(F.lit('{"text":"'), text, F.lit('"}'))
    return turns.select(own.alias("id"), F.lit("2025-01-01T00:00:00.000Z").alias("wall_ts"), F.col("turn").alias("mono"), F.col("conv_id").cast("string").alias("session"), F.lit("a").alias("agent"), F.lit(None).cast("string").alias("parent"), F.lit("prompt").alias("type"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("payload_hash"))


_OWN = "lpad(conv_id::VARCHAR, 13, '0') || lpad(turn::VARCHAR, 13, '0')"
_SALT = f"sha256('salt:seed:' || {_OWN} || ':/text')"
_COMMITTED = f"""c AS (SELECT conv_id, turn, {_OWN} AS id, sha256('["' || {_SALT} || '","/text","' || md5(text) || '"]') AS digest FROM conversations),
p AS (SELECT *, '{{"text":{{"$commitment":"' || digest || '"}}}}' AS payload FROM c),
m AS (SELECT *, sha256(payload) AS ph, '{{"agentId":"a","id":"' || id || '","monoNs":"' || turn || '","parentEventId":null,"payloadHash":"' || sha256(payload) || '","sessionId":"' || conv_id || '","type":"prompt","wallTs":"2025-01-01T00:00:00.000Z"}}' AS md FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM m),
s AS (SELECT conv_id, turn, id, payload, ph, n, sha256(unhex(repeat('00', 32)) || encode(ph || md)) AS h FROM o WHERE n = 1
      UNION ALL SELECT o.conv_id, o.turn, o.id, o.payload, o.ph, o.n, sha256(unhex(s.h) || encode(o.ph || o.md)) FROM s JOIN o ON o.conv_id = s.conv_id AND o.n = s.n + 1)"""


@query("h9_commit_fields", f"WITH RECURSIVE {_COMMITTED} SELECT id, payload, ph AS payload_hash FROM m")
def h9_commit_fields(spark: SparkSession, d: str) -> DataFrame:
    return commit_fields(_prompts(spark, d), "seed").select("id", "payload", "payload_hash")


@query("k1_sealed_lines", f"""WITH RECURSIVE {_COMMITTED} SELECT id, '{{"id":"' || id || '","wallTs":"2025-01-01T00:00:00.000Z","monoNs":"' || turn || '","sessionId":"' || conv_id || '","agentId":"a","parentEventId":null,"type":"prompt","payload":' || payload || ',"payloadHash":"' || ph || '","chainHash":"' || h || '"}}' AS line FROM s""")
def k1_sealed_lines(spark: SparkSession, d: str) -> DataFrame:
    return seal(commit_fields(_prompts(spark, d), "seed")).select("id", event_line().alias("line"))


@query("k10_action_records", f"SELECT {_OWN} AS id, 'decision' AS action, 'success' AS outcome FROM conversations")
def k10_action_records(spark: SparkSession, d: str) -> DataFrame:
    made = exports.action_records(_prompts(spark, d), "ns")
    return made.select("id", F.get_json_object("record", "$.action_type").alias("action"), F.get_json_object("record", "$.outcome").alias("outcome"))


@query("k7_narrative_rows", "SELECT conv_id::VARCHAR AS session, 1::BIGINT AS section, turn - min(turn) OVER (PARTITION BY conv_id) AS place, 'User: ' || md5(text) AS line FROM conversations")
def k7_narrative_rows(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    events = _prompts(spark, d).withColumn("is_gap", F.lit(False)).withColumn("src_ord", F.lit(0)).withColumn("seq", F.row_number().over(W.partitionBy("session").orderBy("id")).cast("long"))
    return exports.narrative_rows(events).select("session", "section", "place", "line")


#: What the checks say of an untouched unsigned bundle without effects.
_CHECKS = {"manifest-parse": "PASS", "schema-version": "PASS", "mode-declaration": "PASS", "mode-contract": "PASS", "signature-verify": "SKIPPED", "payload-hash": "PASS", "chain-replay": "PASS", "intent-effect": "SKIPPED", "file-continuity": "SKIPPED", "merkle-root": "PASS", "commitments": "PASS", "timestamp-verify": "SKIPPED", "timestamp-backdating": "SKIPPED", "anchor-status": "SKIPPED", "artifact-events-jsonl": "PASS", "ruleset-integrity": "PASS", "files-map": "PASS", "attestation-files": "PASS", "bundle-completeness": "PASS"}


@query("v_verify_bundle", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}')" for n, s in _CHECKS.items()) + ") v(name, status)")
def v_verify_bundle(spark: SparkSession, d: str) -> DataFrame:
    """All turns sealed as one session, written, and verified from the files.

    One bundle is one folder of one session's size; it stands where executors can read it.
    """
    shared = _shared(spark)
    root = tempfile.mkdtemp(prefix="bundle-", dir=shared.removeprefix("file://") if shared.startswith(("file:/", "/")) else None)
    try:
        events = _prompts(spark, d).withColumn("session", F.lit("s"))
        write_bundle(spark, events, f"{root}/b", bundle_id="b", produced_at="2025-01-02T00:00:00.000Z", seed="seed")
        rows = [(r.name, r.status) for r in verify.verify_bundle(spark, f"{root}/b").collect()]
    finally:
        shutil.rmtree(root, ignore_errors=True)
    return spark.createDataFrame(rows, "name string, status string")


# --- streams -----------------------------------------------------------------------------


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of store records."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.when(F.col("event_type") == "view", "command").when(F.col("event_type") == "click", "effect").otherwise("execve")
    k = F.get_json_object("props", "$.k").cast("int")
    return rows.select(F.col("event_id").cast("string").alias("id"), kind.alias("kind"), F.col("user_id").cast("string").alias("session"), (k % 10).cast("string").alias("input_hash"), F.col("ts").cast("timestamp").alias("captured"))


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    return (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="ledgerline-")).rstrip("/")


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Rows of a stream over what there is now, as a table in the shared folder."""
    out = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    streams.run_available(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"), f"{out}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("t7_hourly", "SELECT date_trunc('hour', ts) AS hour, CASE event_type WHEN 'view' THEN 'command' WHEN 'click' THEN 'effect' ELSE 'execve' END AS kind, count(*) AS n FROM events GROUP BY ALL")
def t7_hourly(spark: SparkSession, d: str) -> DataFrame:
    return _drained(spark, streams.hourly(_streamed(spark, d)), "complete").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "kind", "n")


@query("t4_stream_pairs", """SELECT i.event_id::VARCHAR AS intent_id, f.event_id::VARCHAR AS effect_id, (epoch_us(f.ts) // 1000 - epoch_us(i.ts) // 1000)::BIGINT AS duration_ms FROM events i JOIN events f
ON i.event_type = 'view' AND f.event_type = 'click' AND i.user_id = f.user_id AND json_extract_string(i.props, '$.k')::INT % 10 = json_extract_string(f.props, '$.k')::INT % 10 AND f.ts >= i.ts AND f.ts <= i.ts + INTERVAL 6 HOUR""")
def t4_stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    intent, effect = streams.sides(_streamed(spark, d))
    return _drained(spark, streams.paired(intent, effect, "6 hours"), "append").select("intent_id", "effect_id", "duration_ms")
