"""Which capture records belong to a session, and why the others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARGIN_MS = 60_000
DECISIONS = ("include", "other-session", "unattributed", "outside-session-window")


def window_bounds(start_ms: Column, end_ms: Column, margin: int = MARGIN_MS) -> tuple[Column, Column]:
    """The session's window; both null when either end is unknown."""
    known = start_ms.isNotNull() & end_ms.isNotNull()
    return F.when(known, start_ms - margin), F.when(known, end_ms + margin)


def decide(record_session: Column, session: Column, opted_in: Column, at_ms: Column, low: Column, high: Column) -> Column:
    """One of DECISIONS for each record."""
    outside = low.isNotNull() & (at_ms.isNull() | (at_ms < low) | (at_ms > high))
    return (
        F.when(record_session.isNotNull() & session.isNotNull(), F.when(record_session == session, "include").otherwise("other-session"))
        .when(~opted_in, "unattributed")
        .when(record_session.isNotNull(), "include")
        .when(outside, "outside-session-window")
        .otherwise("include")
    )


def histogram(decided: DataFrame, column: str = "decision") -> DataFrame:
    """How many records each reason for exclusion holds back."""
    return decided.where(F.col(column) != "include").groupBy(F.col(column).alias("reason")).agg(F.count("*").alias("n"))


def in_tree(ancestry: Column, pid: Column, agent_pid: Column) -> Column:
    """Whether a process descends from the agent and is not the agent itself."""
    return F.coalesce(F.array_contains(F.filter(ancestry, lambda p: p.isNotNull()), agent_pid), F.lit(False)) & (pid != agent_pid)


#: Environment names that are kept, and names whose values are hashed.
KEPT_PREFIXES = ("AWS_", "GH_", "OPENAI_", "ANTHROPIC_", "RAILWAY_")
SECRET = "SECRET|TOKEN|KEY|PASSWORD|CREDENTIALS"


def redacted_env(env: Column, prefixes: tuple[str, ...] = KEPT_PREFIXES, reveal: bool = False) -> Column:
    """The allowed part of an environment; values of secret names as sha256:<hash>."""
    allowed = F.map_filter(env, lambda k, _: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(k, p)))
    if reveal:
        return allowed
    return F.transform_values(allowed, lambda k, v: F.when(F.upper(k).rlike(SECRET), F.concat(F.lit("sha256:"), F.sha2(v.cast("binary"), 256))).otherwise(v))


def sanitized(message: Column, home: Column, most: int = 300) -> Column:
    """First line of an error message: control characters as spaces, the home folder as ~, cut at `most`."""
    line = F.substring_index(message, "\n", 1)
    line = F.regexp_replace(line, r"[\x00-\x1F\x7F]", " ")
    line = F.when(F.coalesce(home, F.lit("")) != "", F.replace(line, home, F.lit("~"))).otherwise(line)
    return F.substring(line, 1, most)
