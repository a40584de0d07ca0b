"""The event envelope: its schema, and how drafts of log lines become events."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ledgerline.functions import jcs, ulid
from ledgerline.functions.shapes import INT, STRING, array, struct
from ledgerline.functions.normalize import LAST, agent_a, agent_b, own_time

#: The closed set of event types.
TYPES = ("prompt", "assistant_message", "tool_call_intent", "tool_call_executed", "tool_result", "file_diff", "env_change", "error", "gap", "shell_command_pre", "shell_command_post", "process_spawn", "tool_call_effect", "capture_failed")

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("wall_ts", T.StringType()),
        T.StructField("mono", T.LongType()),
        T.StructField("session", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("payload_hash", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("ordinal", T.IntegerType()),
    ]
)

_DRAFTS = array(struct(type=STRING, payload=STRING, payload_hash=STRING, parent=INT, mono=INT, wall_ts=STRING))


def wall_ms(text: Column) -> Column:
    """Milliseconds of an ISO time; null where it is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def iso(ms: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def payload_json(payload: dict) -> tuple[str, str]:
    """A payload as it is written, and the hash of its canonical form."""
    return json.dumps(payload, ensure_ascii=False, separators=(",", ":")), hashlib.sha256(jcs.canonical(payload).encode("utf-8", "surrogatepass")).hexdigest()


def _rows(drafts, at: str | None, session: str | None) -> list[dict]:
    out = []
    for draft in drafts:
        text, digest = payload_json(own_time(draft, draft.wall_ts or at, session))
        out.append({"type": draft.type, "payload": text, "payload_hash": digest, "parent": draft.parent, "mono": draft.mono, "wall_ts": draft.wall_ts or at})
    return out


@F.pandas_udf(_DRAFTS)
def agent_a_drafts(line: pd.Series, at: pd.Series, session: pd.Series) -> pd.Series:
    return pd.Series([_rows(agent_a(x), t, s) for x, t, s in zip(line, at, session, strict=True)])


@F.pandas_udf(_DRAFTS)
def agent_b_drafts(line: pd.Series, form: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([_rows(agent_b(x, f), t, None) for x, f, t in zip(line, form, at, strict=True)])


def as_events(rows: DataFrame, agent: str, anchors: tuple[str, ...] | None = None) -> DataFrame:
    """Events from (path, line_no, session, drafts).

    Ids follow from the place of an event, so a second run gives the same. A line advances
    monotonic time by one. LAST is the last event of an earlier line or, with anchors, the
    last earlier event of one of those types.
    """
    line = W.partitionBy("path").orderBy("line_no")
    rows = rows.withColumn("at", F.row_number().over(line) - 1)
    out = rows.select("path", "line_no", "session", "at", F.size("drafts").alias("n"), F.posexplode("drafts").alias("ordinal", "d"))
    own = lambda ordinal: ulid.from_time(wall_ms(F.col("d.wall_ts")), F.col("path"), F.col("line_no"), ordinal)
    out = out.withColumn("id", own(F.col("ordinal")))
    stands = (F.col("ordinal") == F.col("n") - 1) if anchors is None else F.col("d.type").isin(*anchors)
    before = W.partitionBy("path").orderBy("line_no").rangeBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(stands, F.struct("line_no", "ordinal", "id"))).over(before)["id"]
    parent = F.when(F.col("d.parent") == LAST, last).when(F.col("d.parent").isNotNull(), own(F.col("d.parent")))
    return out.select(
        "id",
        F.col("d.wall_ts").alias("wall_ts"),
        (F.col("at") + F.col("d.mono")).cast("long").alias("mono"),
        "session",
        F.lit(agent).alias("agent"),
        parent.alias("parent"),
        F.col("d.type").alias("type"),
        F.col("d.payload").alias("payload"),
        F.col("d.payload_hash").alias("payload_hash"),
        "path",
        F.col("line_no").cast("int").alias("line_no"),
        F.col("ordinal").cast("int").alias("ordinal"),
    )
