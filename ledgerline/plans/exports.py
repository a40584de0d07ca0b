"""Narratives and exports of a merged timeline."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import crypto, jcs
from ledgerline.operators import integrity, timeline
from ledgerline.plans.relational import escaped

#: What an event is called in an action log, and the events that get a receipt.
ACTIONS = {
    **dict.fromkeys(("prompt", "assistant_message"), "decision"),
    **dict.fromkeys(("tool_call_intent", "tool_call_executed", "shell_command_pre", "process_spawn"), "tool_call"),
    **dict.fromkeys(("tool_call_effect", "tool_result", "shell_command_post", "file_diff"), "tool_response"),
    "error": "error",
    **dict.fromkeys(("gap", "env_change", "capture_failed"), "lifecycle"),
}
FAILURES = ("gap", "capture_failed", "error")
#: Payload fields that an action's detail repeats, under the names it gives them.
DETAILS = {
    "tool_call_intent": {"tool": "toolName"},
    "tool_call_executed": {"tool": "toolName"},
    "tool_result": {"tool": "toolName", "exit_code": "exitCode"},
    "tool_call_effect": {"tool": "toolName", "exit_code": "exitCode"},
    "shell_command_pre": {"argv": "argv", "cwd": "cwd", "capture_source": "source"},
    "shell_command_post": {"exit_code": "exitCode"},
    "file_diff": {"path": "path"},
    "process_spawn": {"argv": "argv", "pid": "pid", "capture_source": "source"},
    "env_change": {"key": "key"},
    "error": {"message": "message", "code": "code"},
    "gap": {"reason": "reason"},
}
RECEIPTED = ("tool_call_intent", "tool_result", "shell_command_pre", "shell_command_post", "process_spawn", "tool_call_effect")


def _field(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


def _cut(text: Column, most: int) -> Column:
    flat = F.regexp_replace(text, r"\s+", " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def summary() -> Column:
    """One line about an event."""
    argv = F.array_join(F.from_json(_field("argv"), "array<string>"), " ")
    says = {
        "prompt": F.concat(F.lit("User: "), _cut(_field("text"), 120)),
        "assistant_message": F.concat(F.lit("Agent: "), _cut(_field("content"), 120)),
        "tool_call_intent": F.concat(F.lit("Calls "), _field("toolName"), F.lit(" "), _cut(F.coalesce(_field("toolInput"), F.lit("")), 100)),
        "tool_result": F.concat(F.lit("Result of "), _field("toolName"), F.lit(", exit "), F.coalesce(_field("exitCode"), F.lit("unknown"))),
        "file_diff": F.concat(F.lit("Edits "), _field("path")),
        "error": F.concat(F.lit("Error: "), _cut(_field("message"), 120)),
        "gap": F.concat(F.lit("GAP "), _field("reason"), F.lit(": "), _cut(F.coalesce(_field("detail"), F.lit("")), 200)),
        "shell_command_pre": F.concat(F.lit("Runs "), _cut(argv, 200)),
        "shell_command_post": F.concat(F.lit("Ended with exit "), F.coalesce(_field("exitCode"), F.lit("unknown"))),
        "process_spawn": F.concat(F.lit("Process "), _field("exe"), F.lit(" "), _cut(F.coalesce(argv, F.lit("")), 80)),
        "tool_call_effect": F.concat(F.lit("Effect of "), _field("toolName"), F.lit(", exit "), F.coalesce(_field("exitCode"), F.lit("unknown"))),
    }
    out = F.col("type")
    for kind, text in says.items():
        out = F.when(F.col("type") == kind, F.coalesce(text, F.col("type"))).otherwise(out)
    return out


def narrative_rows(events: DataFrame) -> DataFrame:
    """session, section, hour, place, wall_ts, type, line: the text of a narrative, row by row."""
    rows = events.withColumn("line", summary()).withColumn("hour", F.substring("wall_ts", 1, 13)).withColumn("first", F.when(F.col("is_gap"), 0).otherwise(1))
    numbered = timeline.runs(rows, ["session"], ["wall_ts", "mono", "first", "src_ord", "seq"], F.col("hour"))
    return timeline.counter(numbered, ["session"], ["wall_ts", "mono", "first", "src_ord", "seq"], "place").select("session", "section", "hour", "place", "wall_ts", "type", "line")


def markdown(events: DataFrame, title: str, chunk: int = 10_000) -> str:
    """A narrative of one session. The text is pinned by the bundle, not evidence of its own."""
    out, section = [f"# {title}", "", "This narrative is derived from the events and pinned by the bundle's files map; it is not evidence.", ""], None
    for row in narrative_rows(events).orderBy("place").toLocalIterator():
        if row.section != section:
            section = row.section
            out += ["", f"## {(row.hour or 'undated').replace('T', ' ')}:00", ""]
        out.append(f"- `{row.wall_ts}` {'**' + row.line + '**' if row.type == 'gap' else row.line}")
    return "\n".join(out) + "\n"


def html(events: DataFrame, title: str) -> str:
    safe = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    rows = narrative_rows(events).withColumn("line", escaped(F.col("line")))
    items = "\n".join(f'<li class="{r.type}"><time>{r.wall_ts}</time> {r.line}</li>' for r in rows.orderBy("place").toLocalIterator())
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{safe}</title></head><body><h1>{safe}</h1><ol>\n{items}\n</ol></body></html>\n'


def verify_text(manifest: dict) -> str:
    """How to check a bundle, as the file that travels with it."""
    return f"Bundle {manifest['bundleId']}\nMode {manifest['producer']['mode']}\nRoot {manifest['rootHash']}\nMerkle root {manifest.get('merkleRoot')}\n\nCheck it with: python -m ledgerline verify <folder>\n"


def certification_text(manifest: dict, custodian: str = "[name]") -> str:
    """A custodian's statement that a digital record was made by a process and is unchanged."""
    return (
        f"CERTIFICATION OF A RECORD GENERATED BY AN ELECTRONIC PROCESS\n\nI, {custodian}, certify that bundle {manifest['bundleId']} was made by {manifest['producer']['tool']} {manifest['producer']['version']} "
        f"on {manifest['producedAt']} from the session {manifest['session']['sessionId']}, that its events hash to the root {manifest['rootHash']} and to the Merkle root {manifest.get('merkleRoot')}, "
        f"and that the process records {manifest['counts']['gaps']} gaps where its sources show less than happened.\n\nSigned: ______________________  Date: ______________\n"
    )


# --- action records, one chain per session -----------------------------------------------

_RECORD = "id string, record string, prev_hash string"


def _uuid8(namespace: str, own: str) -> str:
    h = hashlib.sha256(f"{namespace}:{own}".encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-8{h[13:16]}-{int(h[16], 16) & 3 | 8:x}{h[17:20]}-{h[20:32]}"


def _detail(namespace: str, own: str, kind: str, payload: dict) -> dict:
    out = {"event_type": kind, "event_id": own} | {name: payload.get(field) for name, field in DETAILS.get(kind, {}).items()}
    if kind == "tool_call_effect":
        closes = payload.get("intentEventId")
        out["closes_record_id"] = _uuid8(namespace, closes) if closes else None
        out["files_changed"] = [{"path": f["path"], "change": f["change"]} for f in payload.get("files") or [] if f.get("change") != "unchanged"]
    if kind == "gap":
        out["affected_record_ids"] = [_uuid8(namespace, x) for x in payload.get("affectedEventIds") or []]
    return out


def action_records(events: DataFrame, namespace: str, version: str = "0.1.0") -> DataFrame:
    """One record per event in the order of ids; each names the hash of the record before it."""
    kind = F.create_map(*[F.lit(x) for p in ACTIONS.items() for x in p])[F.col("type")]
    failed = F.col("type").isin(*FAILURES) | (F.coalesce(_field("exitCode").cast("int"), F.lit(0)) != 0)
    rows = events.select(
        "session",
        "id",
        integrity.uuid8(namespace, F.col("id")).alias("record_id"),
        "wall_ts",
        "agent",
        "type",
        F.coalesce(kind, F.lit("lifecycle")).alias("action"),
        F.when(failed, "failure").otherwise("success").alias("outcome"),
        F.when(F.col("parent").isNotNull(), integrity.uuid8(namespace, F.col("parent"))).alias("parent_id"),
        F.col("payload_hash").alias("input_hash"),
        "payload",
    )

    def walk(batches):
        import pyarrow as pa

        session, last = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["session"] != session:
                    session, last = r["session"], None
                record = {"record_id": r["record_id"], "timestamp": r["wall_ts"], "agent_id": f"urn:agent:{r['agent']}", "agent_version": version, "session_id": _uuid8(namespace, session), "action_type": r["action"], "action_detail": _detail(namespace, r["id"], r["type"], json.loads(r["payload"])), "outcome": r["outcome"], "trust_level": "L1", "parent_record_id": r["parent_id"], "prev_hash": last, "input_hash": r["input_hash"]}
                text = jcs.canonical(record)
                out.append({"id": r["id"], "record": text, "prev_hash": last})
                last = hashlib.sha256(text.encode()).hexdigest()
            yield pa.RecordBatch.from_pylist(out, pa.schema([("id", pa.string()), ("record", pa.string()), ("prev_hash", pa.string())]))

    return rows.repartition("session").sortWithinPartitions("session", "id").mapInArrow(walk, _RECORD)


def receipts(events: DataFrame, issuer: str, policy_digest: str) -> DataFrame:
    """Receipts of actions, chained over their payloads; the signature is added by sign_receipts."""
    rows = events.where(F.col("type").isin(*RECEIPTED)).select("session", "id", "wall_ts", "type", "payload_hash", F.coalesce(_field("toolName"), F.lit("shell")).alias("tool"))

    def walk(batches):
        import pyarrow as pa

        session, last, n = None, "0" * 64, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["session"] != session:
                    session, last, n = r["session"], "0" * 64, 0
                payload = {"type": f"agent.action.{r['type']}", "issued_at": r["wall_ts"], "issuer_id": issuer, "payload_digest": f"sha256:{r['payload_hash']}", "action_ref": r["id"], "iteration_id": n, "previousReceiptHash": last, "decision": "observed", "tool_name": r["tool"], "policy_digest": policy_digest}
                text = jcs.canonical(payload)
                out.append({"id": r["id"], "record": text, "prev_hash": last})
                last, n = hashlib.sha256(text.encode()).hexdigest(), n + 1
            yield pa.RecordBatch.from_pylist(out, pa.schema([("id", pa.string()), ("record", pa.string()), ("prev_hash", pa.string())]))

    return rows.repartition("session").sortWithinPartitions("session", "id").mapInArrow(walk, _RECORD)


def sign_receipts(spark: SparkSession, made: DataFrame, private: bytes) -> list[str]:
    """Receipts of one session with their signatures; keys never leave the driver."""
    out = []
    for row in made.orderBy("id").toLocalIterator():
        signature = base64.b64encode(crypto.sign(spark, private, row.record.encode())).decode()
        out.append(jcs.canonical({"payload": json.loads(row.record), "signature": {"alg": "EdDSA", "sig": signature}, "anchors": []}))
    return out


def statement(spark: SparkSession, manifest: dict, private: bytes, public_pem: str) -> bytes:
    """The bundle's statement as COSE_Sign1 over its canonical manifest facts."""
    claim = {"bundleId": manifest["bundleId"], "rootHash": manifest["rootHash"], "merkleRoot": manifest["merkleRoot"], "counts": manifest["counts"], "producedAt": manifest["producedAt"]}
    return crypto.cose_sign1(spark, private, jcs.canonical(claim).encode(), {3: "application/json", 4: crypto.did_key(public_pem).encode()})


# --- tool summary and text report --------------------------------------------------------


def text_report(events: DataFrame, destructive: DataFrame) -> str:
    """Counts, destructive operations, gaps and tools of a session as text."""
    body = events.agg(F.count("*").alias("n"), F.count_if(F.col("type") == "gap").alias("gaps"), F.count_if(F.col("type") == "file_diff").alias("files"), F.count_if(F.col("type") == "error").alias("errors")).first()
    kinds = events.select(F.coalesce(_field("toolName"), F.lit("unknown")).alias("tool"), F.when(F.col("type") == "tool_call_intent", "intent").when(F.col("type") == "tool_result", "result").alias("kind")).where("kind is not null")
    tools = timeline.tool_summary(kinds, "tool", "kind").orderBy("tool").collect()
    ops = destructive.orderBy("event_id").collect()
    lines = [f"events {body.n}, gaps {body.gaps}, file changes {body.files}, errors {body.errors}", f"destructive operations {len(ops)}"]
    lines += [f"  {o.event_id}: " + ", ".join(f"{m.rule_id} ({m.severity})" for m in o.matches) for o in ops]
    lines += [f"tool {t.tool}: {t.n_intent} calls, {t.n_result} results" for t in tools]
    return "\n".join(lines) + "\n"
