"""Hash chains, Merkle trees and salted commitments as DataFrame operations.

Building a chain is serial within a session and parallel across sessions; verifying one
needs only the stored hash of the row before, so it is one window pass. Merkle levels are
built by grouping positions in halves, one shuffle per level, each half the size. Audit paths
are built block by block, one shuffle for ten levels, without a join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.tables import kept

ZERO = "00" * 32
EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def json_text(value: Column) -> Column:
    """A string as canonical JSON; null is the JSON null."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, escape in (("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")):
        out = F.replace(out, F.lit(char), F.lit(escape))
    for code in range(32):
        if chr(code) not in "\b\t\n\f\r":
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    # few strings hold anything to escape, and 34 passes cost more than one look
    out = F.when(value.rlike(r'[\x00-\x1f"\\]'), out).otherwise(value)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


#: Fixed value: the hashed fields of an event, in canonical order.
METADATA = ("agentId", "id", "monoNs", "parentEventId", "payloadHash", "sessionId", "type", "wallTs")


def metadata_json(columns: dict[str, Column]) -> Column:
    """The canonical JSON of an event's eight hashed fields; every one is a string or null."""
    parts = [F.concat(F.lit(f'"{name}":'), json_text(columns[name].cast("string"))) for name in METADATA]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def link(previous_hex: Column, payload_hash: Column, metadata: Column) -> Column:
    """SHA-256 of the previous 32 bytes, the payload hash as text and the metadata."""
    return F.sha2(F.concat(F.unhex(previous_hex), payload_hash.cast("binary"), metadata.cast("binary")), 256)


def chain_root(rows: DataFrame, at: list[str], order: str, payload_hash: str = "payload_hash", metadata: str = "metadata") -> DataFrame:
    """Last hash of the chain of each group. Groups stream through, none is gathered into a row."""
    walked = chain(rows.select(*at, order, payload_hash, metadata), at, order, payload_hash, metadata)
    return walked.groupBy(*at).agg(F.max_by("chain_hash", order).alias("root_hash"), F.count("*").alias("n"))


def chain(rows: DataFrame, at: list[str], order: str, payload_hash: str = "payload_hash", metadata: str = "metadata") -> DataFrame:
    """rows with chain_hash. Groups are walked in order, one at a time, batch by batch."""
    import hashlib

    import pyarrow as pa

    schema = rows.schema.add("chain_hash", "string") if "chain_hash" not in rows.columns else rows.schema
    places = [rows.columns.index(c) for c in at]
    ph, md = rows.columns.index(payload_hash), rows.columns.index(metadata)

    def walk(batches):
        own, last = None, b""
        for batch in batches:
            out = []
            for key, p, m in zip(zip(*(batch.column(i).to_pylist() for i in places), strict=True), batch.column(ph).to_pylist(), batch.column(md).to_pylist(), strict=True):
                if key != own:
                    own, last = key, bytes(32)
                last = hashlib.sha256(last + (p or "").encode() + (m or "").encode()).digest()
                out.append(last.hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "chain_hash"])

    return rows.repartition(*at).sortWithinPartitions(*at, order).mapInArrow(walk, schema)


def chain_breaks(rows: DataFrame, at: list[str], order: str, stored: str = "chain_hash", payload_hash: str = "payload_hash", metadata: str = "metadata") -> DataFrame:
    """Rows whose stored hash does not follow from the stored hash before it.

    By induction a chain without such rows is the chain that a replay would build.
    """
    line = W.partitionBy(*at).orderBy(order)
    expected = link(F.coalesce(F.lag(stored).over(line), F.lit(ZERO)), F.col(payload_hash), F.col(metadata))
    return rows.withColumn("expected", expected).where(~F.col("expected").eqNullSafe(F.col(stored)))


def leaf(data: Column) -> Column:
    """Merkle leaf of bytes (RFC 6962)."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), data), 256)


def node(left_hex: Column, right_hex: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left_hex), F.unhex(right_hex)), 256)


def _level(df: DataFrame) -> DataFrame:
    return kept(df, "level")


def merkle_levels(leaves: DataFrame, at: list[str], cut: Callable[[DataFrame], DataFrame] = _level) -> list[DataFrame]:
    """Levels of the trees of all groups from the leaves (at, idx, hash) up to the roots.

    The leaves and every fourth level are cut, so nothing is derived from further below.

    A level pairs places 2i and 2i + 1; a lone last node is promoted. That equals the split
    at the largest power of two for any number of leaves.
    """
    levels = [cut(leaves.select(*at, F.col("idx").cast("long").alias("idx"), "hash"))]
    most = levels[0].agg(F.max("idx")).first()[0] or 0
    for turn in range(int(most).bit_length()):
        side = lambda odd: F.max(F.when(F.col("idx") % 2 == odd, F.col("hash")))
        pairs = levels[-1].groupBy(*at, F.floor(F.col("idx") / 2).cast("long").alias("up")).agg(side(0).alias("l"), side(1).alias("r"))
        made = pairs.select(*at, F.col("up").alias("idx"), F.when(F.col("r").isNull(), F.col("l")).otherwise(node(F.col("l"), F.col("r"))).alias("hash"))
        levels.append(cut(made) if turn % 4 == 3 else made)
    return levels


def merkle_roots(leaves: DataFrame, at: list[str], cut: Callable[[DataFrame], DataFrame] = _level) -> DataFrame:
    return roots_of(merkle_levels(leaves, at, cut), at)


def roots_of(levels: list[DataFrame], at: list[str]) -> DataFrame:
    return levels[-1].select(*at, F.col("hash").alias("merkle_root"))


def inclusion_proofs(leaves: DataFrame, at: list[str], cut: Callable[[DataFrame], DataFrame] = _level) -> DataFrame:
    """at, idx, hash, path: siblings from the leaf up, each with the side on which it stands."""
    return proven_leaves(leaves, at, cut).drop("merkle_root")


#: Fixed value: levels of a block of a tree. A task holds the 2 ** BLOCK_LEVELS leaves of one block, whatever the size of the tree.
BLOCK_LEVELS = 10
_PATH = "array<struct<hash: string, left: boolean>>"


def proven_leaves(leaves: DataFrame, at: list[str], cut: Callable[[DataFrame], DataFrame] = _level) -> DataFrame:
    """at, idx, hash, path and merkle_root of leaves (at, idx, hash) whose idx runs from 0 without gaps.

    Blocks of leaves are trees of their own, and their roots are the leaves of the tree above.
    What that tree has for a block, the rest of its paths and the root, travels as JSON among the
    block's rows, ahead of them: there is no join, so nothing is broadcast, and null keys are keys.
    """
    rows = cut(leaves.select(*at, F.col("idx").cast("long").alias("idx"), F.unhex("hash").alias("hash")))
    return _proven(rows, at, rows.agg(F.max("idx")).first()[0] or 0, cut, BLOCK_LEVELS)


def _proven(rows: DataFrame, at: list[str], most: int, cut: Callable[[DataFrame], DataFrame], bits: int) -> DataFrame:
    dealt = rows.select(*at, F.shiftright("idx", bits).alias("_block"), "idx", "hash")
    if most >> bits:
        above = _proven(cut(_by_block(dealt, at, bits, proofs=False)), at, most >> bits, cut, bits)
        rest = F.to_json(F.struct("path", "merkle_root")).cast("binary")  # a column of its own would cost every leaf more than its hashing
        dealt = dealt.unionByName(above.select(*at, F.col("idx").alias("_block"), F.lit(-1).cast("long").alias("idx"), rest.alias("hash")))
    return _by_block(dealt, at, bits, proofs=True)


@lru_cache(128)
def _siblings(n: int):
    """Of each of n leaves and each level: the sibling's place among the nodes, whether there is one, whether it stands left."""
    import numpy as np

    own, below, width, levels = np.arange(n), 0, n, []
    while width > 1:
        levels.append((below + (own ^ 1), (own ^ 1) < width, own % 2 == 1))
        own, below, width = own >> 1, below + width, (width + 1) >> 1
    return tuple(np.array(x).reshape(len(levels), n).T for x in (zip(*levels, strict=True) if levels else ([], [], [])))


def _nodes(hashes: list) -> list:
    """The nodes of a tree, level by level, from the leaves to the root; what stands above a null is null."""
    import hashlib

    nodes, level = list(hashes), hashes
    while len(level) > 1:
        level = [p[0] if len(p) == 1 else None if None in p else hashlib.sha256(b"\1" + p[0] + p[1]).digest() for p in (level[i : i + 2] for i in range(0, len(level), 2))]
        nodes += level
    return nodes


def _by_block(dealt: DataFrame, at: list[str], bits: int, proofs: bool) -> DataFrame:
    """With proofs, the leaves with path and merkle_root; else the root of each block as a leaf of the tree above."""
    import json

    import numpy as np
    import pyarrow as pa

    size = 1 << bits

    def whole(batches):
        """The rows of whole blocks, and where each block begins and the last one ends."""
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            keys = list(zip(*(rows.column(c).to_pylist() for c in (*at, "_block")), strict=True))
            bounds = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            if len(bounds) > 1:
                yield rows.slice(0, bounds[-1]).combine_chunks(), bounds
            rest = rows.slice(bounds[-1]) if bounds else rows
            if rest.num_rows > size + 1:
                raise ValueError("places in a tree have to run from 0 without gaps or repeats")
        if rest is not None and rest.num_rows:
            yield rest.combine_chunks(), [0, rest.num_rows]

    def text(nodes):
        return pa.array([None if x is None else x.hex() for x in nodes], pa.string())

    def walk(batches):
        for rows, bounds in whole(batches):
            block, idx, hashes = (rows.column(c).to_pylist() for c in ("_block", "idx", "hash"))
            nodes, leaves, steps, left, lengths, roots, firsts = [], [], [], [], [], [], []
            for a, b in pairwise(bounds):
                ahead = idx[a] == -1
                first, n = a + ahead, b - a - ahead
                above = json.loads(hashes[a]) if ahead else {}
                more = above.get("path", [])
                least = 1 if all(s["left"] for s in more) else size  # only the last block of a tree may have fewer
                if idx[first:b] != list(range(block[a] * size, block[a] * size + n)) or not least <= n <= size:
                    raise ValueError("places in a tree have to run from 0 without gaps or repeats")
                base, tree = len(nodes), _nodes(hashes[first:b])
                firsts.append(first)
                roots.append(above.get("merkle_root") if ahead else tree[-1] and tree[-1].hex())
                if not proofs:
                    nodes.append(tree[-1])
                    continue
                place, there, side = _siblings(n)
                rest = np.arange(len(more)) + len(tree)
                place = np.hstack([place, np.tile(rest, (n, 1))]).astype(np.int64) + base
                there = np.hstack([there, np.ones((n, len(more)))]).astype(bool)
                side = np.hstack([side, np.tile([s["left"] for s in more], (n, 1))]).astype(bool)
                nodes += tree
                nodes += [bytes.fromhex(s["hash"]) if "hash" in s else None for s in more]
                leaves.append((np.arange(first, b), np.arange(base, base + n), np.full(n, len(roots) - 1)))
                steps.append(place[there])
                left.append(side[there])
                lengths.append(there.sum(axis=1))
            if not proofs:
                own = rows.select(at).take(pa.array(firsts)).columns
                yield from pa.Table.from_arrays([*own, pa.array([block[f] for f in firsts], pa.int64()), pa.array(nodes, pa.binary())], names=[*at, "idx", "hash"]).to_batches()
                continue
            nodes = text(nodes)
            row, leaf, tree = (pa.array(np.concatenate(x)) for x in zip(*leaves, strict=True))
            path = pa.StructArray.from_arrays([nodes.take(pa.array(np.concatenate(steps))), pa.array(np.concatenate(left))], names=["hash", "left"])
            path = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)), path)
            own = rows.select([*at, "idx"]).take(row).columns
            yield from pa.Table.from_arrays([*own, nodes.take(leaf), path, pa.array(roots, pa.string()).take(tree)], names=[*at, "idx", "hash", "path", "merkle_root"]).to_batches()

    made = dealt.select(*at, "idx", "hash")
    made = made.select(*at, "idx", F.hex("hash").alias("hash"), F.lit(None).cast(_PATH).alias("path"), F.lit(None).cast("string").alias("merkle_root")) if proofs else made
    return dealt.repartition(*at, "_block").sortWithinPartitions(*at, "_block", "idx").mapInArrow(walk, made.schema)


def proven_root(leaf_hash: Column, path: Column) -> Column:
    """Root that an audit path leads to."""
    return F.aggregate(path, leaf_hash, lambda h, s: F.when(s["left"], node(s["hash"], h)).otherwise(node(h, s["hash"])))


def commitment(salt: Column, path: Column, value_json: Column) -> Column:
    """SHA-256 of the canonical JSON array of salt, path and value; the value is canonical already."""
    return F.sha2(F.concat(F.lit("["), json_text(salt), F.lit(","), json_text(path), F.lit(","), value_json, F.lit("]")).cast("binary"), 256)


def seeded_salt(seed: str, n: Column) -> Column:
    """Deterministic salts: SHA-256 of a seed and a number."""
    return F.sha2(F.concat(F.lit(f"salt:{seed}:"), n.cast("string")).cast("binary"), 256)


def opening_report(placeholders: DataFrame, openings: DataFrame, digests: Column) -> DataFrame:
    """One row per placeholder or opening: (event_id, path, state) with state ok, unopened, orphan or mismatch.

    placeholders: event_id, path, digest; openings: event_id, path and what `digests` reads.
    """
    opened = openings.select("event_id", "path", digests.alias("_opened"))
    both = placeholders.join(opened, ["event_id", "path"], "full_outer")
    state = F.when(F.col("_opened").isNull(), "unopened").when(F.col("digest").isNull(), "orphan").when(F.col("digest") == F.col("_opened"), "ok").otherwise("mismatch")
    return both.select("event_id", "path", state.alias("state"))


def uuid8(namespace: str, value: Column) -> Column:
    """A version 8 UUID from the SHA-256 of a namespace and an id."""
    h = F.sha2(F.concat(F.lit(namespace + ":"), value).cast("binary"), 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
