"""Session logs of both agents: from files to events, in one plan without collecting.

Every file is one session. Facts of a session (start, id, working folders) are grouped
from its lines; whatever cannot be read becomes a gap event, never nothing.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.functions.normalize import rollout_format, rollout_meta
from ledgerline.functions.shapes import STRING, struct
from ledgerline.sources.events import agent_a_drafts, agent_b_drafts, as_events, wall_ms
from ledgerline.sources.files import lines


def agent_a_sessions(files: DataFrame) -> DataFrame:
    """path, started (earliest time as text), agent_session, cwds (in the order first seen)."""
    rows = lines(files)
    field = lambda name: F.nullif(F.get_json_object("line", f"$.{name}"), F.lit(""))
    rows = rows.select("path", "line_no", field("timestamp").alias("ts"), F.coalesce(field("sessionId"), field("session_id")).alias("own"), field("cwd").alias("cwd"))
    facts = rows.groupBy("path").agg(F.min_by("ts", wall_ms(F.col("ts"))).alias("started"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("line_no"))).alias("agent_session"))
    seen = rows.where("cwd is not null").groupBy("path", "cwd").agg(F.min("line_no").alias("at"))
    seen = seen.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cwd"))), lambda x: x["cwd"]).alias("cwds"))
    return facts.join(seen, "path", "left")


def scan_agent_a(files: DataFrame, session: str | None = None) -> DataFrame:
    """Events of agent-A logs (path, content), flat or nested grammar line by line."""
    sessions = agent_a_sessions(files).select("path", "started", F.coalesce(F.lit(session).cast("string"), "agent_session", "path").alias("session"))
    rows = lines(files).join(sessions, "path").select("path", "line_no", "session", agent_a_drafts("line", "started", "session").alias("drafts"))
    return as_events(rows, "agent-a")


_HEAD = struct(form=STRING, ts=STRING, cwd=STRING, session=STRING, meta_cwd=STRING, version=STRING, started=STRING)


@F.pandas_udf(_HEAD)
def _head(line: pd.Series) -> pd.DataFrame:
    out = []
    for text in line:
        try:
            got = json.loads(text)
        except ValueError:
            got = None
        form = rollout_format(got)
        row = dict.fromkeys(("form", "ts", "cwd", "session", "meta_cwd", "version", "started"))
        if isinstance(got, dict):
            body = got["payload"] if isinstance(got.get("payload"), dict) else got
            meta = next((m for f in ("v2", "v1") if (m := rollout_meta(got, f)) and (f == "v2" or form != "v2")), None) or {}
            ts, cwd = got.get("timestamp"), body.get("cwd")
            row |= {"form": form, "ts": ts if isinstance(ts, str) else None, "cwd": cwd if isinstance(cwd, str) else None}
            row |= {"session": meta.get("session"), "meta_cwd": meta.get("cwd"), "version": meta.get("version"), "started": meta.get("started")}
        out.append(row)
    return pd.DataFrame(out, columns=["form", "ts", "cwd", "session", "meta_cwd", "version", "started"])


def _headed(files: DataFrame) -> DataFrame:
    return lines(files).withColumn("h", _head("line"))


def agent_b_sessions(files: DataFrame) -> DataFrame:
    """path, form, agent_session, started, cwd, version: from the first line that tells."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    told = F.col("h.session").isNotNull() | F.col("h.started").isNotNull() | F.col("h.meta_cwd").isNotNull()
    meta = F.min_by(F.struct("h.session", "h.started", "h.meta_cwd", "h.version"), F.when(told, F.col("line_no")))
    facts = _headed(files).groupBy("path").agg(F.coalesce(F.min_by("h.form", at("h.form")), F.lit("v2")).alias("form"), meta.alias("m"), F.min_by("h.ts", wall_ms(F.col("h.ts"))).alias("first_ts"))
    return facts.select("path", "form", F.col("m.session").alias("agent_session"), F.coalesce("m.started", "first_ts").alias("started"), F.col("m.meta_cwd").alias("cwd"), F.col("m.version").alias("version"))


def scan_agent_b(files: DataFrame, session: str | None = None) -> DataFrame:
    """Events of agent-B rollouts; a line without a time has that of the last line with one."""
    sessions = agent_b_sessions(files).select("path", "form", "started", F.coalesce(F.lit(session).cast("string"), "agent_session", "path").alias("session"))
    line = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = _headed(files).withColumn("carried", F.last(F.when(wall_ms(F.col("h.ts")).isNotNull(), F.col("h.ts")), ignorenulls=True).over(line)).join(sessions, "path")
    rows = rows.select("path", "line_no", "session", agent_b_drafts("line", "form", F.coalesce("carried", "started")).alias("drafts"))
    return as_events(rows.where(F.size("drafts") > 0), "agent-b", ("prompt", "assistant_message"))
