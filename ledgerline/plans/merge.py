"""All sources of a session to one correlated timeline with its gaps.

events in: id, wall_ts, mono, session, agent, parent, type, payload, payload_hash, src_ord,
seq (the place within its source). Every step partitions by session, so one plan serves a
single session and millions of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.functions import jcs, ulid
from ledgerline.functions.shapes import LONG, STRING, array, struct
from ledgerline.functions.shell import words
from ledgerline.operators import correlate, gaps, timeline
from ledgerline.plans.relational import described, truncated
from ledgerline.sources.events import payload_json, wall_ms
from ledgerline.tables import kept

WINDOW_MS = 5000
#: Fixed value: the source that marks an intent which an effect must close.
HOOKED = "claude-pretooluse"

_FILES = array(struct(path=STRING, preSha256=STRING, postSha256=STRING))
_BODY = struct(
    toolUseId=STRING,
    toolName=STRING,
    toolInput=struct(command=STRING, argv=array(STRING), cwd=STRING),
    argv=array(STRING),
    cwd=STRING,
    source=STRING,
    inputHash=STRING,
    intentEventId=STRING,
    capturedAt=STRING,
    fileArgs=_FILES,
    files=_FILES,
    pid=LONG,
    ppid=LONG,
    ancestry=array(LONG),
    exe=STRING,
    parentProcessTree=array(struct(pid=LONG, ppid=LONG)),
    reason=STRING,
)
_REWRITTEN = struct(payload=STRING, payload_hash=STRING)


def ordered(events: DataFrame) -> DataFrame:
    """Distinct events with ms, the parsed body `b` and `at`, the place in the session's timeline."""
    first = timeline.dedup_first(events, ["session", "id"], ["src_ord", "seq"])
    line = W.partitionBy("session").orderBy("wall_ts", "mono", "src_ord", "seq")
    out = first.withColumn("b", F.from_json("payload", _BODY)).withColumn("ms", wall_ms(F.col("wall_ts")))
    return out.withColumn("at", F.row_number().over(line).cast("long"))


def _asked(of: DataFrame) -> DataFrame:
    """cwd and argv that a tool call names."""
    typed = F.when(F.trim(F.coalesce("b.toolInput.command", F.lit(""))) != "", words(F.col("b.toolInput.command"))).otherwise(F.coalesce("b.toolInput.argv", F.array().cast("array<string>")))
    return of.select("session", "id", F.col("at").alias("seq"), "ms", "mono", "wall_ts", F.coalesce("b.toolInput.cwd", F.lit("")).alias("cwd"), typed.alias("argv"), F.col("b.toolUseId").alias("use"))


def links(events: DataFrame, window_ms: int = WINDOW_MS) -> dict[str, DataFrame]:
    """The correlations of an ordered timeline: results, intents, effects, execs, breaks."""
    of = lambda kind: events.where(F.col("type") == kind)
    pre = of("shell_command_pre")
    pres = pre.select("session", F.col("at").alias("pre_seq"), F.col("ms").alias("pre_ms"), F.col("b.cwd").alias("pre_cwd"), F.col("b.argv").alias("pre_argv"))
    intents = _asked(of("tool_call_intent"))
    lookup = correlate.last_by_key(intents.where("use is not null"), ["session", "use"], "seq", ["cwd", "argv"])
    results = of("tool_result").select("session", "id", F.col("at").alias("seq"), "ms", F.col("b.toolUseId").alias("use")).join(lookup, ["session", "use"], "left")
    results = results.withColumn("argv", F.coalesce("argv", F.array().cast("array<string>")))
    by_result = correlate.scored_matches(results.select("session", "seq", "ms", "cwd", "argv"), pres, window_ms)
    by_intent = correlate.exclusive(correlate.scored_matches(intents.select("session", "seq", "ms", "cwd", "argv"), pres, window_ms), by_result)

    effects = of("tool_call_effect").select("session", F.col("at").alias("seq"), "ms", F.col("b.intentEventId").alias("intent_id"), F.col("b.inputHash").alias("input_hash"))
    known = pre.select("session", F.col("at").alias("intent_seq"), F.col("ms").alias("intent_ms"), F.col("id").alias("intent_id"), F.col("b.inputHash").alias("intent_hash"))
    claims = correlate.claim_effects(effects, known, window_ms)

    pids = F.concat(F.array("b.pid", "b.ppid"), F.coalesce("b.ancestry", F.array().cast("array<bigint>")))
    tree = F.flatten(F.transform(F.coalesce("b.parentProcessTree", F.array().cast("array<struct<pid:bigint,ppid:bigint>>")), lambda p: F.array(p["pid"], p["ppid"])))
    execs = of("process_spawn").where("b.source = 'kernel'").select("session", F.col("at").alias("seq"), "ms", pids.alias("pids"))
    spawned = correlate.kernel_matches(execs, pre.select("session", F.col("at").alias("intent_seq"), F.col("ms").alias("intent_ms"), tree.alias("intent_pids")), window_ms)

    left = lambda df, column, out: df.select("session", F.col("at").alias("seq"), F.col("id").alias("event_id"), F.posexplode(column).alias("nth", "f")).select("session", "seq", "event_id", F.col("f.path").alias("path"), F.col(f"f.{out}").alias("hash"))
    wrote = left(of("tool_call_effect"), "b.files", "postSha256").withColumnRenamed("hash", "post_hash")
    read = left(pre, "b.fileArgs", "preSha256").withColumnRenamed("hash", "pre_hash")
    return {"results": by_result, "intents": by_intent, "effects": claims, "execs": spawned, "breaks": correlate.file_breaks(wrote, read)}


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def gap_events(events: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """Every gap that the correlations leave: session, parent, reason, affected, detail, ms, mono, wall_ts."""
    key = lambda df, c: df.select("session", F.col(c).alias("at"))
    of = lambda kind: events.where(F.col("type") == kind)
    missing = lambda rows, *matched: rows.join(matched[0] if len(matched) == 1 else matched[0].union(matched[1]), ["session", "at"], "left_anti")
    pre, effect = of("shell_command_pre"), of("tool_call_effect")
    shown = truncated(F.array_join("b.argv", " "))
    claimed = found["effects"].where("intent_seq is not null")
    with_effects = effect.select("session").distinct()
    kernel = of("process_spawn").where("b.source = 'kernel'")
    spawned = truncated(F.when(F.size("b.argv") > 0, F.array_join("b.argv", " ")).otherwise(F.col("b.exe")))
    named = F.when(F.coalesce("b.intentEventId", F.lit("")) != "", _text(" (under the unknown intent ", F.col("b.intentEventId"), ")")).otherwise("")
    parts = [
        (missing(of("tool_result"), key(found["results"], "seq")), "tool_result_without_pre_capture", _text("A result of ", F.coalesce("b.toolName", F.lit("unknown")), " came at ", F.col("wall_ts"), ": no command was captured ahead of it.")),
        (missing(pre, key(found["results"], "pre_seq"), key(found["intents"], "pre_seq")), "pre_capture_without_tool_result", _text("A command was captured at ", F.col("wall_ts"), " and no result followed: ", shown)),
        (missing(pre.where(F.col("b.source") == HOOKED), key(claimed, "intent_seq")).join(with_effects, "session", "left_semi"), "intent_without_effect", _text("No record tells how this ended: ", shown)),
        (effect.join(key(found["effects"].where("how = 'none'"), "seq"), ["session", "at"], "left_semi"), "effect_without_intent", _text("What ", F.col("b.toolName"), " did is recorded", named, " without a capture of its start.")),
        (missing(kernel, key(found["execs"], "seq")), "kernel_execve_without_hook", _text("Only the kernel saw this process, at ", F.col("wall_ts"), ": ", spawned)),
    ]
    out = [gaps.gap_rows(rows.withColumn("_w", F.col("wall_ts")), reason, None, detail) for rows, reason, detail in parts]
    breaks = found["breaks"].select("session", F.col("seq").alias("at"), "path", "hash", "previous_hash", "previous_event_id").join(pre, ["session", "at"])
    detail = _text("Between ", F.col("previous_event_id"), " and ", F.col("id"), " this file went from ", described(F.col("previous_hash")), " to ", described(F.col("hash")), ": ", F.col("path"))
    out.append(gaps.gap_rows(breaks, "unwitnessed_file_change", F.array("previous_event_id", "id"), detail))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    at = events.select("session", F.col("id").alias("parent"), "wall_ts", "agent")
    return whole.join(at, ["session", "parent"])


@F.pandas_udf(_REWRITTEN)
def _gap_payload(reason: pd.Series, affected: pd.Series, detail: pd.Series) -> pd.DataFrame:
    made = [payload_json({"reason": r, "affectedEventIds": list(a), "detail": d}) for r, a, d in zip(reason, affected, detail, strict=True)]
    return pd.DataFrame(made, columns=["payload", "payload_hash"])


@F.pandas_udf(_REWRITTEN)
def _relinked(payload: pd.Series, name: pd.Series, value: pd.Series, source: pd.Series) -> pd.DataFrame:
    """A payload with the id that correlation found, and its new hash."""
    import json

    out = []
    for text, key, own, how in zip(payload, name, value, source, strict=True):
        body = json.loads(text) | {key: own}
        if how is not None:
            body["intentEventIdSource"] = how
        out.append(payload_json(body))
    return pd.DataFrame(out, columns=["payload", "payload_hash"])


def merge(events: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """The timeline: originals with linked_pre, linked_effect, linked_intent, and gap events among them."""
    rows = kept(ordered(events), "timeline")  # every correlation reads it
    found = {name: kept(df, f"links-{name}") for name, df in links(rows, window_ms).items()}
    ids = rows.select("session", F.col("at").alias("_at"), F.col("id").alias("_id"))

    def linked(df: DataFrame, own: str, other: str, name: str) -> DataFrame:
        return df.select("session", F.col(own).alias("at"), F.col(other).alias("_at")).join(ids, ["session", "_at"]).select("session", "at", F.col("_id").alias(name))

    pre = linked(found["results"], "seq", "pre_seq", "linked_pre").union(linked(found["intents"], "seq", "pre_seq", "linked_pre")).union(linked(found["execs"], "seq", "intent_seq", "linked_pre"))
    firm = found["effects"].where("how in ('recorded', 'correlated')")
    out = rows.join(pre, ["session", "at"], "left").join(linked(firm, "seq", "intent_seq", "linked_intent"), ["session", "at"], "left").join(linked(firm, "intent_seq", "seq", "linked_effect"), ["session", "at"], "left")
    # only payloads that a correlation completes are written and hashed again
    guessed = found["effects"].where("how = 'correlated'").select("session", F.col("seq").alias("at"), F.lit(True).alias("_guessed"))
    out = out.join(guessed, ["session", "at"], "left")
    kernel = (F.col("type") == "process_spawn") & (F.col("b.source") == "kernel")
    new = F.when(F.coalesce("_guessed", F.lit(False)), _relinked("payload", F.lit("intentEventId"), "linked_intent", F.lit("correlated"))).when(F.coalesce(kernel, F.lit(False)), _relinked("payload", F.lit("matchedIntentEventId"), "linked_pre", F.lit(None).cast("string")))
    out = out.withColumn("_new", new).withColumns({"payload": F.coalesce("_new.payload", "payload"), "payload_hash": F.coalesce("_new.payload_hash", "payload_hash"), "is_gap": F.lit(False)})

    holes = gap_events(rows, found).withColumn("_p", _gap_payload("reason", "affected", "detail"))
    seq = F.row_number().over(W.partitionBy("session").orderBy("reason", "parent", F.array_join("affected", ","), "detail")).cast("long")
    holes = holes.withColumn("seq", seq)
    holes = holes.select(
        "session",
        ulid.from_time(F.col("ms"), F.lit("gap"), F.col("reason"), F.col("parent"), F.col("seq")).alias("id"),
        "wall_ts",
        "mono",
        "agent",
        "parent",
        F.lit("gap").alias("type"),
        F.col("_p.payload").alias("payload"),
        F.col("_p.payload_hash").alias("payload_hash"),
        F.lit(-1).alias("src_ord"),
        "seq",
        F.lit(True).alias("is_gap"),
    )
    columns = [*holes.columns, "linked_pre", "linked_effect", "linked_intent"]
    return out.select(*columns).unionByName(holes, allowMissingColumns=True)


def canonical_hash(payload: Column) -> Column:
    return F.sha2(jcs.jcs(payload).cast("binary"), 256)


def commands_of(events: DataFrame) -> DataFrame:
    """The columns that rule matching reads: event_id, type, tool_name, command, argv."""
    body = F.from_json("payload", _BODY)
    return events.select(F.col("id").alias("event_id"), "type", body["toolName"].alias("tool_name"), body["toolInput"]["command"].alias("command"), body["argv"].alias("argv"))
