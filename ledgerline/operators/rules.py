"""Destructive-command rules: which rule fires on which simple command of which event.

Rules are a small table and every criterion is a higher-order function over the command's
words, so matching is one nested loop against a broadcast table whose size is checked.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.shell import argv_commands, text_commands

RULE_ROWS = 10_000
SCHEMA = "rule_ord int, rule_id string, severity string, argv_head array<string>, contains_any array<string>, any_regex string, stdin_regex string"
SEVERITIES = ("low", "medium", "high", "critical")

#: The default rules, as (id, severity, argvHead, argvContainsAny, anyArgvRegex, stdinRegex).
DEFAULT_RULES = (
    ("terraform-destroy", "critical", ["terraform", "destroy"], None, None, None),
    ("terraform-apply-auto-approve", "high", ["terraform", "apply"], ["-auto-approve", "--auto-approve"], None, None),
    ("rm-rf", "critical", ["rm"], ["-rf", "-fr", "-Rf", "-fR"], None, None),
    ("aws-s3-rb", "critical", ["aws", "s3", "rb"], None, None, None),
    ("aws-rds-delete", "critical", ["aws", "rds", "delete-db-instance"], None, None, None),
    ("aws-ec2-terminate", "critical", ["aws", "ec2", "terminate-instances"], None, None, None),
    ("gcloud-sql-delete", "critical", ["gcloud", "sql", "instances", "delete"], None, None, None),
    ("kubectl-delete", "high", ["kubectl", "delete"], None, None, None),
    ("git-push-force", "high", ["git", "push"], ["--force", "-f", "--force-with-lease"], None, None),
    ("git-reset-hard", "medium", ["git", "reset", "--hard"], None, None, None),
    ("sql-drop", "critical", None, None, r"(?i)\b(DROP\s+(TABLE|DATABASE|SCHEMA))\b", None),
    ("railway-volume-delete", "critical", ["gh", "api", "graphql"], None, None, r"(?i)\bvolumeDelete\b"),
)


def usable_regex(spark: SparkSession, pattern: str | None) -> str | None:
    """The pattern, or null where Java cannot compile it: such a criterion never holds."""
    if pattern is None:
        return None
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  a py4j error of any kind means an unusable pattern
        return None
    return pattern


def rule_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    """Rules as rows, in order; criteria that are absent are null and unusable regexes match nothing."""
    rows = []
    for n, (rule_id, severity, head, contains, any_rx, stdin_rx) in enumerate(rules):
        checked = [None if p is None else usable_regex(spark, p) or r"(?!)" for p in (any_rx, stdin_rx)]
        rows.append((n, rule_id, severity if severity in SEVERITIES else "medium", head, contains, *checked))
    return spark.createDataFrame(rows, SCHEMA)


def _head(argv: Column, head: Column) -> Column:
    same = F.zip_with(F.slice(argv, 1, F.greatest(F.size(head), F.lit(1))), head, lambda a, h: F.coalesce(F.lower(a) == F.lower(h), F.lit(False)))
    return (F.size(argv) >= F.size(head)) & F.forall(same, lambda x: x)


def criteria(argv: Column, bare: Column, exact: bool = False) -> Column:
    """Whether all criteria of the rule in this row hold for a command; none at all never hold."""
    head = F.col("argv_head").isNull() | _head(argv, F.col("argv_head")) | _head(bare, F.col("argv_head"))
    meets = (lambda a, t: a == t) if exact else (lambda a, t: F.contains(a, t))
    contains = F.col("contains_any").isNull() | F.exists(argv, lambda a: F.exists(F.col("contains_any"), lambda t: meets(a, t)))
    any_rx = F.col("any_regex").isNull() | F.exists(argv, lambda a: F.regexp_like(a, F.col("any_regex")))
    stdin = F.col("stdin_regex").isNull() | F.regexp_like(F.array_join(argv, " "), F.col("stdin_regex"))
    some = F.coalesce(F.col("argv_head").isNotNull() | F.col("contains_any").isNotNull() | F.col("any_regex").isNotNull() | F.col("stdin_regex").isNotNull(), F.lit(False))
    return some & F.coalesce(head & contains & any_rx & stdin, F.lit(False))


def matches(commands: DataFrame, rules: DataFrame, exact: bool = False) -> DataFrame:
    """First matching command per (event_id, rule). commands: event_id, idx, argv, bare_argv."""
    if rules.limit(RULE_ROWS + 1).count() > RULE_ROWS:
        raise ValueError(f"a ruleset of more than {RULE_ROWS} rules")
    hits = commands.join(F.broadcast(rules), criteria(F.col("argv"), F.col("bare_argv"), exact))
    narrowed = F.when(F.col("any_regex").isNotNull(), F.filter("argv", lambda a: F.regexp_like(a, F.col("any_regex")))).otherwise(F.col("argv"))
    first = F.min_by(F.struct("idx", narrowed.alias("matched_argv")), F.col("idx"))
    found = hits.groupBy("event_id", "rule_ord", "rule_id", "severity").agg(first.alias("m"))
    return found.select("event_id", "rule_ord", "rule_id", "severity", F.col("m.idx").alias("idx"), F.col("m.matched_argv").alias("matched_argv"))


def event_commands(events: DataFrame) -> DataFrame:
    """Simple commands of events (event_id, type, tool_name, command, argv), one row each."""
    bash = (F.col("type") == "tool_call_intent") & (F.lower("tool_name") == "bash")
    pre = events.where(F.col("type") == "shell_command_pre").select("event_id", F.explode(argv_commands("argv")).alias("c"))
    intent = events.where(bash).select("event_id", F.explode(text_commands("command")).alias("c"))
    return pre.union(intent).select("event_id", "c.*")


def destructive_index(found: DataFrame) -> DataFrame:
    """Per event its matches in rule order."""
    return found.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "rule_id", "severity", "idx"))).alias("matches"))


def as_regex(text: str) -> re.Pattern | None:
    """A rule's regex for use on the driver; null where it is not one."""
    try:
        return re.compile(text)
    except re.error:
        return None
