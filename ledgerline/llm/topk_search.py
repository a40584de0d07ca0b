"""Exact top-k inner products by MaxScore over shards.

A query is a list of terms, one per dimension, and a shard holds the postings of every
dimension together with the largest and smallest value in it, which bounds what a term
can add. The threshold of a query is its k-th best score in all shards that the task has
searched so far; it is carried from shard to shard. By it the terms, widest bound first,
are split: the essential ones are the shortest head such that a row that is at its lowest
in all of them cannot reach the threshold with the rest. Their postings are traversed
(none, if the whole shard cannot reach it); the other terms are probed in steps, for the
rows alone that are still competitive. What the tasks have found is merged by rank, so
the result is exact.

The queries are a stated set and go in blocks of at most BLOCK_BYTES, one after another,
to where the shards are; the vectors of the shards are never exchanged.

Results in odd cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; vectors of different length are not compared; rows that
repeat an id are candidates each, and one query (the smallest vector); rows with the
query's own id are no candidates for it; fewer than k candidates give fewer rows; empty
tables give an empty result. A score beyond 64 bits raises an error, as no long holds it. Other columns
are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.llm import textops as tx
from ledgerline.llm.common import shared_dir, table, written

SHARD_ROWS = 4096
#: Queries in a block, and the bytes that its vectors have at most.
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
#: Dimensions that a probing step adds.
STEP = 8


def usable(vec: str) -> Column:
    return F.col(vec).isNotNull() & F.expr(f"forall(`{vec}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def _packed(most: int, most_bytes: int):
    """Runs of vectors of one length as (pack, dim, ids, values)."""

    def run(batches):
        at, held = TaskContext.get().partitionId() << 32, {}

        def pack(dim, whole):
            """Emit what is held of this length in packs of `rows`; the rest too if whole."""
            nonlocal at
            rows = limit(dim)
            ids, values = (np.concatenate(x) for x in held[dim])
            done = len(ids) if whole else len(ids) // rows * rows
            for i in range(0, done, rows):
                at += 1
                to = min(i + rows, done)
                yield pa.RecordBatch.from_pylist([{"pack": at, "dim": dim, "ids": ids[i:to].tobytes(), "vals": values[i * dim : to * dim].tobytes()}], schema)
            held[dim] = [ids[done:]], [values[done * dim :]]

        limit = lambda dim: max(1, min(most, most_bytes // (8 * dim + 8)))
        schema = pa.schema([("pack", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vals", pa.binary())])
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            vecs = batch.column(1)
            size = np.diff(np.asarray(vecs.offsets))
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size).tolist():
                rows_of = np.flatnonzero(size == dim)
                own = held.setdefault(dim, ([], []))
                own[0].append(ids[rows_of])
                own[1].append(flat[(starts[rows_of][:, None] + np.arange(dim)).ravel()])
                if sum(map(len, own[0])) >= limit(dim):
                    yield from pack(dim, False)
        for dim in list(held):
            if sum(map(len, held[dim][0])):
                yield from pack(dim, True)

    return run


def maxscore(ids: np.ndarray, columns: np.ndarray, most: np.ndarray, least: np.ndarray, qid: int, query: np.ndarray, k: int, floor) -> tuple[np.ndarray, np.ndarray]:
    """Of the k best of a shard for one query, those that reach `floor`, as (ids, scores). Exact.

    columns: one row per dimension; most, least: its bounds. Integers, as float64 where
    every sum stays below 2**53. floor: the score to reach, None for any.
    """
    high, low = np.maximum(most * query, least * query), np.minimum(most * query, least * query)
    order = np.argsort(-(high - low), kind="stable")
    left = np.concatenate([np.cumsum(high[order][::-1])[::-1], high[:0], [0]])  # bound of the terms from a place on
    at = len(order)
    if floor is not None:
        lowest = np.concatenate([[0], np.cumsum(low[order])]) + left
        at = int(np.append(np.flatnonzero(lowest < floor), at)[0])
        if not at and left[0] < floor:
            return ids[:0], ids[:0]
    alive = np.flatnonzero(ids != qid)
    partial = (query[order[:at]] @ columns[order[:at]])[alive] if at else np.zeros(len(alive), columns.dtype)
    while True:
        if floor is not None:
            keep = partial + left[at] >= floor
            alive, partial = alive[keep], partial[keep]
        if at == len(order) or not len(alive):
            break
        to = min(at + STEP, len(order))
        partial = partial + query[order[at:to]] @ columns[np.ix_(order[at:to], alive)]
        at = to
    top = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive[top]], partial[top]


def _searched(dim: int, qids: np.ndarray, queries: np.ndarray, k: int):
    """The k best of all shards of a task for each query of a block."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    weight = float(np.abs(queries.astype(float)).sum(axis=1).max(initial=0))

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(qids)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                columns = (np.frombuffer(row["vals"], np.int64) if row["vals"] else np.zeros(0, np.int64)).reshape(len(ids), dim).T
                exact = float(np.abs(columns.astype(float)).max(initial=0)) * weight < 2**53
                kind = np.float64 if exact else object
                columns, own = np.ascontiguousarray(columns.astype(kind)), queries.astype(kind)
                most, least = columns.max(axis=1), columns.min(axis=1)
                for n, (qid, query) in enumerate(zip(qids.tolist(), own, strict=True)):
                    held = best[n]
                    found = maxscore(ids, columns, most, least, qid, query, k, held[1][-1] if len(held[1]) == k else None)
                    if len(found[0]):
                        whole = [np.concatenate(x) for x in zip(held, found, strict=True)]
                        top = np.lexsort((whole[0], -whole[1]))[:k]
                        best[n] = whole[0][top], whole[1][top]
        for at in range(0, len(qids), 1000):
            part = best[at : at + 1000]
            scores = [int(x) for _, s in part for x in s]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[at : at + 1000], [len(i) for i, _ in part])), pa.array(np.concatenate([i for i, _ in part])), pa.array(scores, pa.int64())], schema=schema)

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """query_id, rank, vec_id, score: both inputs hold integer vectors as array<long>."""
    spark, fields = candidates.sparkSession, "pack long, dim int, ids binary, vals binary"
    pick = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.expr(f"not exists(`{vec_col}`, x -> x is null)")).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    shards = written(pick(candidates).mapInArrow(tx.trimmed(_packed(SHARD_ROWS, BLOCK_BYTES)), fields), "shards")
    asked = written(pick(queries).groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    # as few tasks as there are blocks, so that each of them is full
    asked = asked.coalesce(1 + asked.count() // BLOCK_ROWS)
    blocks = written(asked.mapInArrow(tx.trimmed(_packed(BLOCK_ROWS, BLOCK_BYTES)), fields), "blocks")
    out = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/ranked-{uuid.uuid4().hex}"
    result = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], result).write.parquet(out)
    for pack, dim in sorted(blocks.select("pack", "dim").collect()):  # one row for each block
        block = blocks.where(F.col("pack") == pack).first()
        qids = np.frombuffer(block.ids, np.int64)
        vecs = (np.frombuffer(block.vals, np.int64) if block.vals else np.zeros(0, np.int64)).reshape(len(qids), dim)
        found = shards.where(F.col("dim") == dim).mapInArrow(tx.trimmed(_searched(dim, qids, vecs, k)), "query_id long, vec_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
    return spark.read.schema(result).parquet(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(usable("embedding"))
    vectors = vectors.select("vec_id", F.expr("transform(embedding, x -> floor(256 * cast(x as double)))").alias("vec"))
    return search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
