"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), calls one corpus operator and returns the columns
of documents for what it keeps; the last returns the packed pieces. run() writes every
stage's result to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from ledgerline.llm.common import parted, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided, under the language found."""
    found = language_id.identify(docs, keep=COLUMNS)
    return found.where("accepted").withColumn("lang", F.col("language")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that an earlier one has; one of nothing else goes."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    out = out.where("line_dedup.n_removed < line_dedup.n_lines or line_dedup.n_removed = 0")
    return out.withColumn("n_chars", F.when(F.col("line_dedup.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), one of equal rows.

    Documents without words are in no group. Those without an id are linked with nothing.
    """
    gone = near_dedup.link(docs).where("not kept").select("doc_id").distinct()
    docs = _without(docs, written(gone, "copies"), [F.col("doc_id")])
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"))
    same = written(texts.groupBy("doc_id", "th").count().where("count > 1").select(F.xxhash64("doc_id", "th").alias("key")), "equal-rows")
    maybe, single = parted(docs, F.xxhash64("doc_id", F.xxhash64("text")), same)
    return single.unionByName(maybe.dropDuplicates(["doc_id", "text"])) if same.limit(1).count() else docs


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; those that do go, with an id or without."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, written(found.select("doc_id", "th").distinct(), "leaks"), [F.col("doc_id"), F.xxhash64("text")])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the bins that hold them."""
    return packing.pack(docs)


def _without(docs: DataFrame, gone: DataFrame, by: list[Column]) -> DataFrame:
    """docs without those whose values `by` stand in `gone`; only texts that may be among them are exchanged."""
    docs = docs.select(*COLUMNS)
    maybe, clear = parted(docs, F.xxhash64(*by), gone.select(F.xxhash64(*gone.columns).alias("key")))
    named = gone.toDF(*[f"gone_{c}" for c in gone.columns])
    same = [x.eqNullSafe(F.col(c)) for x, c in zip(by, named.columns, strict=True)]
    return maybe.join(named, reduce(lambda x, y: x & y, same), "left_anti").unionByName(clear)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("best_fit_packing", pack_sequences),
]

#: Language ID and packing are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
