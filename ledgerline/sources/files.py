"""Reading text files whole, and their lines in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, name, content, modified: one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("name"),
        F.col("value").alias("content"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def lines(files: DataFrame) -> DataFrame:
    """path, line_no, line: blank lines are left out but keep their number."""
    split = files.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return split.where(F.trim("line") != "").withColumn("line", F.regexp_replace("line", "\r$", ""))
