"""Conflict-constrained best-fit packing.

Texts are cut into sequences of `capacity` tokens (whitespace-separated words). A text
fills as many bins of its own as it can; its remainder is packed best-fit, longest first:
the bins of a shard are kept ordered by residual room, each with a bitmap of its sources
and one of its duplicate clusters, and the search goes on from the tightest bin that has
room to its successors until one holds neither the source nor the cluster.

The cluster of a text is its group of near copies where `clusters` names one (the query
takes the components of near_dedup.link, five-word shingles, similarity 0.8); without
`clusters` and `cluster`, only texts equal but for case are in conflict.

Remainders are dealt by hash to shards of about `shard_rows`, whose number follows the
input; a shard is packed by one task that reads its rows in order, so memory is bounded.

Results in odd cases: a null or blank text has no tokens and no bin (bin_id and piece are
null, one row); null sources are in conflict with nothing; a null cluster likewise; rows
that repeat a doc_id are packed each; texts of a multiple of the capacity have no
remainder; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import near_dedup
from ledgerline.llm import textops as tx
from ledgerline.llm.common import folded, join_small, table, written

CAPACITY = 2048
SHARD_ROWS = 4096
_OUT = pa.schema([("row", pa.int64()), ("bin_id", pa.string())])


def tokens(text: str) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), "")).cast("long")


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """Bin of each (tokens, source, cluster); items in the order in which they are placed."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources, clusters, names = [], [], {}
    bit = lambda kind, x: 0 if x is None else 1 << names.setdefault((kind, x), len(names))
    out = []
    for size, source, cluster in items:
        s, c = bit("s", source), bit("c", cluster)
        at = bisect_left(order, (size, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            room, into = order.pop(at)
        else:
            room, into = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[into] |= s
        clusters[into] |= c
        if room > size:
            insort(order, (room - size, into))
        out.append(into)
    return out


def _packer(capacity: int):
    def run(batches):
        shard, rows, items = None, [], []

        def packed():
            bins = best_fit(items, capacity)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([f"{shard}-{b}" for b in bins], pa.string())], schema=_OUT)

        for batch in batches:
            for own, row, size, source, cluster in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if own != shard:
                    if rows:
                        yield packed()
                    shard, rows, items = own, [], []
                rows.append(row)
                items.append((size, source, cluster))
        if rows:
            yield packed()

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text", source: Column | None = None, cluster: Column | None = None, clusters: DataFrame | None = None, size: Column | None = None) -> DataFrame:
    """doc_id, piece, start_token, n_tokens, bin_id: one row per piece of every text.

    clusters (th, component): the cluster of the texts whose `cluster` (a hash of the text, if not given) is th, a written
    table; others are their own. size: the tokens of a text, where they are counted already.
    """
    source = F.col("source") if source is None else source
    if cluster is None:
        cluster = F.xxhash64(F.col(text_col) if clusters is not None else folded(F.col(text_col)))
    size = tokens(text_col) if size is None else size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n"), source.alias("source"), cluster.alias("cluster"))
    if clusters is not None:
        rows = join_small(rows.withColumnRenamed("cluster", "th"), clusters, ["th"])
        rows = rows.select("doc_id", "n", "source", F.coalesce("component", "th").alias("cluster"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "measured")
    rest = rows.where(f"n % {capacity} > 0")
    shards = max(1, -(-rest.count() // shard_rows))
    rest = rest.select(F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).alias("shard"), "row", (F.col("n") % capacity).alias("size"), "source", "cluster", "doc_id")
    dealt = rest.repartition("shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "row")
    bins = dealt.mapInArrow(tx.trimmed(_packer(capacity)), "row long, bin_id string")
    whole = F.expr(f"if(n >= {capacity}, transform(sequence(0L, n div {capacity} - 1), p -> p), cast(array() as array<bigint>))")
    full = rows.select("row", "doc_id", F.explode(whole).alias("piece"))
    alone = F.concat_ws("-", F.lit("whole"), "row", "piece")
    full = full.select("doc_id", "piece", (F.col("piece") * capacity).alias("start_token"), F.lit(capacity).cast("long").alias("n_tokens"), alone.alias("bin_id"))
    part = rows.where(f"n % {capacity} > 0 or n = 0").join(bins, "row", "left")
    some = F.col("n") > 0
    part = part.select("doc_id", F.when(some, F.expr(f"n div {capacity}")).alias("piece"), F.when(some, F.expr(f"n - n % {capacity}")).alias("start_token"), (F.col("n") % capacity).alias("n_tokens"), "bin_id")
    return full.union(part)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source") -> DataFrame:
    """near_dedup.sign() of the texts by their hash, as ids may be null or repeat, with doc_id and source of the rows."""
    return near_dedup.sign(docs.select(F.xxhash64(text_col).alias("doc"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.col(source).alias("source")))


def copies(docs: DataFrame, read: DataFrame, text_col: str = "text") -> DataFrame:
    """(th, component) of the texts that have near copies; read: signed(docs)."""
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    linked = near_dedup.link(texts, id_col="th", signed=read).where("component_id <> doc_id")
    return written(linked.select(F.col("doc_id").alias("th"), F.col("component_id").alias("component")).distinct(), "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the texts counts their tokens and signs them."""
    docs = table(spark, sf_dir, "documents")
    read = signed(docs)
    return pack(read, cluster=F.col("doc"), clusters=copies(docs, read), size=F.col("n_words"))
