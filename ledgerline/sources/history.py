"""Shell histories and git reflogs as commands, events and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.functions.shell import command_line, history_stages
from ledgerline.sources.events import iso
from ledgerline.sources.files import lines

#: The line forms of history files and of reflogs.
MARKER = r"^#(\d{9,11})$"
ZSH = r"^:\s*(\d+):\d+;(.+)$"
EPOCH = r"^(\d{9,11})\s+(.+)$"
FISH_ENTRY = r"^- cmd:\s?(.*)$"
FISH_WHEN = r"^\s+when:\s*(\d+)\s*$"
REFLOG = r"^([0-9a-f]{7,40})\s+\(([^)]+)\)\s+([^:]+?):\s+(.+?)(?:\s+(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+[+-]\d{4}))?\s*$"
REFLOG_BARE = r"^([0-9a-f]{7,40})\s+([^:]+?):\s+(.+)$"


def _found(line: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def _staged(commands: DataFrame) -> DataFrame:
    """One row per pipeline stage: path, line_no, stage, at_ms, command, argv."""
    out = commands.select("path", "line_no", "at_ms", F.posexplode(history_stages("command")).alias("stage", "argv"))
    return out.select("path", "line_no", "stage", "at_ms", command_line("argv").alias("command"), "argv")


def is_fish(content: Column) -> Column:
    return content.rlike(r"(?m)^- cmd:")


def scan_bash(files: DataFrame) -> DataFrame:
    """bash and zsh histories; a `#epoch` line dates the command after it."""
    rows = lines(files).withColumn("line", F.trim("line"))
    marker = _found(F.col("line"), MARKER, 1).cast("long")
    rows = rows.withColumn("marker", marker).withColumn("dated", F.lag("marker").over(W.partitionBy("path").orderBy("line_no")))
    rows = rows.where("marker is null")
    zsh, epoch = _found(F.col("line"), ZSH, 1), _found(F.col("line"), EPOCH, 1)
    seconds = F.coalesce(zsh.try_cast("long"), epoch.try_cast("long"), F.col("dated"))
    command = F.when(zsh.isNotNull(), F.regexp_extract("line", ZSH, 2)).when(epoch.isNotNull(), F.regexp_extract("line", EPOCH, 2)).otherwise(F.col("line"))
    return _staged(rows.select("path", "line_no", (seconds * 1000).alias("at_ms"), command.alias("command")))


def _unescaped(value: Column) -> Column:
    """Only a backslash before n or before a backslash is an escape."""
    hidden = F.replace(value, F.lit("\\\\"), F.lit("\x00"))
    return F.replace(F.replace(hidden, F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))


def scan_fish(files: DataFrame) -> DataFrame:
    """fish histories; entries are numbered by a running count and every stage is kept."""
    rows = lines(files)
    entry = F.col("line").rlike(FISH_ENTRY)
    rows = rows.withColumn("entry", F.sum(entry.cast("int")).over(W.partitionBy("path").orderBy("line_no"))).where("entry > 0")
    command = F.when(entry, F.regexp_extract("line", FISH_ENTRY, 1))
    when = F.when(F.col("line").rlike(FISH_WHEN), F.regexp_extract("line", FISH_WHEN, 1).try_cast("long"))
    found = rows.groupBy("path", "entry").agg(F.min("line_no").alias("line_no"), F.max(command).alias("command"), F.max_by(when, F.when(when.isNotNull(), F.col("line_no"))).alias("seconds"))
    return _staged(found.where("command <> ''").select("path", "line_no", (F.col("seconds") * 1000).alias("at_ms"), _unescaped(F.col("command")).alias("command")))


def scan_history(files: DataFrame) -> DataFrame:
    fish = is_fish(F.col("content"))
    return scan_bash(files.where(~fish)).unionByName(scan_fish(files.where(fish)))


def scan_reflog(files: DataFrame) -> DataFrame:
    """path, line_no, commit, ref, action, description, at_ms; commit is null where a line has no known form."""
    rows = lines(files).withColumn("line", F.trim("line"))
    full = F.col("line").rlike(REFLOG)
    pick = lambda g, b: F.when(full, F.regexp_extract("line", REFLOG, g)).otherwise(_found(F.col("line"), REFLOG_BARE, b))
    at = F.unix_millis(F.try_to_timestamp(_found(F.col("line"), REFLOG, 5), F.lit("yyyy-MM-dd HH:mm:ss Z")))
    return rows.select("path", "line_no", "line", pick(1, 1).alias("commit"), F.when(full, F.regexp_extract("line", REFLOG, 2)).alias("ref"), pick(3, 2).alias("action"), pick(4, 3).alias("description"), at.alias("at_ms"))


def history_events(commands: DataFrame, started: Column) -> DataFrame:
    """Reconstructed pre-captures of history commands; undated ones stand at the session's start."""
    at = F.coalesce(iso(F.col("at_ms")), started)
    return commands.select("path", "line_no", "stage", F.lit("shell").alias("agent"), at.alias("wall_ts"), F.lit("shell_command_pre").alias("type"), "argv", F.lit("reconstructed").alias("source"))


def reflog_events(entries: DataFrame, started: Column) -> DataFrame:
    """Two rows per entry, the git process and the gap that no command was seen; unread lines are gaps."""
    at = F.coalesce(iso(F.col("at_ms")), started).alias("wall_ts")
    read = entries.where("commit is not null")
    argv = F.concat(F.array(F.lit("git"), "action"), F.split("description", " "))
    short = F.substring("commit", 1, 7)
    detail = F.concat(F.lit("No captured command explains "), short, F.lit(", which the reflog has as "), "action", F.lit(": "), "description")
    nothing = F.lit(None).cast("string")
    spawn = read.select("path", "line_no", F.lit(0).alias("ordinal"), at, F.lit("process_spawn").alias("type"), argv.alias("argv"), nothing.alias("reason"), nothing.alias("detail"))
    gap = read.select("path", "line_no", F.lit(1).alias("ordinal"), at, F.lit("gap").alias("type"), F.lit(None).cast("array<string>").alias("argv"), F.lit("reflog_change_without_command").alias("reason"), detail.alias("detail"))
    lost = entries.where("commit is null").select("path", "line_no", F.lit(0).alias("ordinal"), at, F.lit("gap").alias("type"), F.lit(None).cast("array<string>").alias("argv"), F.lit("unknown_jsonl_line_type").alias("reason"), F.substring("line", 1, 200).alias("detail"))
    return spawn.unionByName(gap).unionByName(lost)
