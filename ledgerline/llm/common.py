"""What several corpus operators share: the shared folder, cut lineage, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The upper-case letters that are folded, and their lower-case forms.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: What counts as a word of folded text, and what stands between words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Rows up to which a keyed side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000
#: Keys up to which a bitmap of them may be broadcast, at BITS bits (so 2 bytes) a key.
MARKED_KEYS = 16_000_000
BITS = 16
#: Fixed value: bits in one bitmap of bitmap_construct_agg().
BITMAP = 32_768
#: Fixed value: the setting by which an execution drops its shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and lost executors cost nothing.

    The shuffles of the write are dropped when it has ended, as nothing reads them again.
    Tables of one application stand in a folder of its id, to be dropped when it is over.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a keyed side, broadcast only while its counted rows stay within the bound.

    right must be cheap to count (a written table). Beyond the bound both sides are
    exchanged on the key, which adaptive execution can split where a key is hot.
    """
    small = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right, on, how)


def folded(text: Column) -> Column:
    """Text in lower case; null is empty.

    For words of a-z that is the same as folding A-Z alone: the one other character whose
    lower case is such a letter (the Kelvin sign) is put aside first.
    """
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def worded(text: Column) -> Column:
    """The words of the folded text; cut between them, as gathering matches copies the text for each."""
    return F.array_remove(F.split(folded(text), BETWEEN), "")


def fresh(df: DataFrame) -> str:
    """A prefix that no column of df begins with, for columns made inside an operator."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def parted(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among `keys`, rows whose key surely is not), nothing moved.

    keys: a written table of one long column `key`. A broadcast bitmap of their slots
    decides; its size follows the counted keys. Above MARKED_KEYS all rows may be among
    them. Rows of a null key are in the second part.
    """
    n = keys.count()
    if not n:
        return df.where("false"), df
    if n > MARKED_KEYS:
        return df.where(key.isNotNull()), df.where(key.isNull())
    p = fresh(df)
    slots = -(-n * BITS // BITMAP) * BITMAP
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(slots)) + 1
    marks = keys.where("key is not null").select(slot(F.col("key")).alias("slot"))
    marks = marks.groupBy(F.bitmap_bucket_number("slot").alias(f"{p}bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias(f"{p}bits"))
    own = df.withColumn(f"{p}slot", F.when(key.isNotNull(), slot(key)))
    own = own.withColumn(f"{p}bucket", F.bitmap_bucket_number(f"{p}slot")).withColumn(f"{p}bit", F.bitmap_bit_position(f"{p}slot"))
    own = own.join(F.broadcast(marks), f"{p}bucket", "left")
    octet = f"cast(conv(hex(substring({p}bits, cast({p}bit div 8 as int) + 1, 1)), 16, 10) as int)"
    own = own.withColumn(f"{p}in", F.expr(f"coalesce(shiftright({octet}, cast({p}bit % 8 as int)) & 1, 0) = 1"))
    made = [f"{p}{c}" for c in ("slot", "bucket", "bit", "bits", "in")]
    return own.where(f"{p}in").drop(*made), own.where(f"not {p}in").drop(*made)
