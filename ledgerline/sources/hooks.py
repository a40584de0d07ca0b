"""Hook inputs (one JSON object per tool call half) as capture records.

Running inside an agent is not Spark's business; inputs arrive as rows, in batch or from a
stream, and become the records that a capture store holds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import jcs
from ledgerline.functions.shapes import STRING
from ledgerline.operators.scope import redacted_env

#: Tools whose files are always hashed, command texts that call for it, keys of an exit code.
HASHED_TOOLS = ("Edit", "Write", "MultiEdit")
HASHED_COMMANDS = (r"\brm\s", r"\bmv\s", r"\bcp\s", r"\bchmod\s", r"\bchown\s", r"\bdd\s", r"\bmkfs", r"\bformat\s", r"\btruncate\s", r"\bsed\s.*-i", r"\bsed\s.*--in-place", r"\bperl\s.*-i", r"\bruby\s.*-i")
EXIT_KEYS = ("exit_code", "exitCode", "returncode", "status")
PATHS = r"""(?:^|\s)(\.{0,2}/[^\s;|&<>()'"`$]+)"""


@F.pandas_udf(STRING)
def _call(text: pd.Series) -> pd.Series:
    """Canonical JSON of toolName and toolInput; null where there is no tool name."""
    out = []
    for one in text:
        try:
            got = jcs.parse(one) if one is not None else None
        except ValueError:
            got = None
        named = isinstance(got, dict) and isinstance(got.get("tool_name"), str)
        given = got.get("tool_input") if named else None
        out.append(jcs.canonical({"toolName": got["tool_name"], "toolInput": given if isinstance(given, dict) else {}}) if named else None)
    return pd.Series(out, dtype=object)


def exit_code(text: Column, at: str = "$.tool_response") -> Column:
    """The first numeric exit code that a response states."""
    return F.coalesce(*[F.get_json_object(text, f"{at}.{k}").try_cast("int") for k in EXIT_KEYS])


def argv(tool: Column, text: Column) -> Column:
    """What a tool call runs, as words."""
    command, path = F.get_json_object(text, "$.tool_input.command"), F.get_json_object(text, "$.tool_input.file_path")
    bash = F.when(command.isNotNull(), F.array(F.lit("bash"), F.lit("-c"), command)).otherwise(F.array(F.lit("bash")))
    return F.when(tool == "Bash", bash).when(tool.isin("Edit", "Write"), F.array(F.lower(tool), F.coalesce(path, F.lit("")))).otherwise(F.array(F.lower(tool)))


def should_hash(tool: Column, command: Column) -> Column:
    """Whether the files of a call are hashed before it runs."""
    risky = F.lit(False)
    for pattern in HASHED_COMMANDS:
        risky = risky | command.rlike(f"(?i){pattern}")
    return tool.isin(*HASHED_TOOLS) | ((tool == "Bash") & F.coalesce(risky, F.lit(True)))


def paths(command: Column) -> Column:
    """Paths that a command names, in order, without deciding whether they exist."""
    return F.regexp_extract_all(command, F.lit(PATHS), F.lit(1))


def parse(inputs: DataFrame, raw: str = "raw") -> DataFrame:
    """tool, cwd, session, argv, input_hash, should_hash, paths, exit_code, failed; one row per input."""
    text = F.col(raw)
    tool = F.get_json_object(text, "$.tool_name")
    command = F.when(tool == "Bash", F.get_json_object(text, "$.tool_input.command"))
    rows = inputs.withColumn("_call", _call(text))
    return rows.select(
        *[c for c in inputs.columns if c != raw],
        tool.alias("tool"),
        F.coalesce(F.get_json_object(text, "$.cwd"), F.lit("")).alias("cwd"),
        F.coalesce(F.get_json_object(text, "$.session_id"), F.lit("")).alias("session"),
        argv(tool, text).alias("argv"),
        F.sha2(F.col("_call").cast("binary"), 256).alias("input_hash"),
        should_hash(tool, command).alias("should_hash"),
        F.coalesce(paths(command), F.array().cast("array<string>")).alias("paths"),
        exit_code(text).alias("exit_code"),
        F.col("_call").isNull().alias("failed"),
    )


def with_environment(rows: DataFrame, env: str = "env") -> DataFrame:
    """env_subset (allowed names, secrets hashed) and env_hash over the whole environment."""
    whole = F.array_sort(F.transform(F.map_entries(env), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.withColumns({"env_subset": redacted_env(F.col(env)), "env_hash": F.sha2(F.array_join(whole, "\n").cast("binary"), 256)})
