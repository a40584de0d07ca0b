"""The correlation joins between results, intents, effects and kernel executions.

Inputs are DataFrames with `session`, an order column `seq` that is total within a
session, and a time `ms`. Links come back as columns; rows are never changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ledgerline.operators.intervals import argv_overlap, best, interval_join, related_paths, time_score

LEAST_SCORE = 5
EARLY_MS = 1000


def last_by_key(rows: DataFrame, keys: list[str], seq: str, keep: list[str]) -> DataFrame:
    """The last row of each key (a lookup in which later rows replace earlier ones)."""
    picked = F.max_by(F.struct(*keep), F.col(seq))
    return rows.groupBy(*keys).agg(picked.alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in keep])


def scored_matches(targets: DataFrame, pres: DataFrame, window_ms: int, least: int = LEAST_SCORE) -> DataFrame:
    """Per target the pre-capture with the highest score, the earliest of equals.

    targets: session, seq, ms, cwd, argv; pres: session, pre_seq, pre_ms, pre_cwd, pre_argv.
    Returns session, seq, pre_seq, score. Not exclusive: many targets may name one pre.
    """
    pairs = interval_join(targets, pres, ["session"], "ms", "pre_ms", window_ms, window_ms)
    near = (F.coalesce("cwd", F.lit("")) != "") & related_paths(F.coalesce("pre_cwd", F.lit("")), F.col("cwd"))
    score = F.when(near, 10).otherwise(0) + 5 * argv_overlap(F.col("pre_argv"), F.col("argv")) + time_score(F.col("pre_ms") - F.col("ms"))
    pairs = pairs.withColumn("score", score.cast("long"))
    found = best(pairs, ["session", "seq"], [F.negative("score"), F.col("pre_ms"), F.col("pre_seq")], ["pre_seq", "score"])
    return found.where(F.col("score") >= least)


def exclusive(matches: DataFrame, taken: DataFrame, key: str = "pre_seq", order: str = "seq") -> DataFrame:
    """Of single best matches those whose key is not taken and that come first for it; no second best."""
    free = matches.join(taken.select("session", key).distinct(), ["session", key], "left_anti")
    first = free.groupBy("session", key).agg(F.min(order).alias(order))
    return free.join(first, ["session", key, order], "left_semi")


def claim_recorded(effects: DataFrame, intents: DataFrame) -> DataFrame:
    """Effects that name a known intent; the first of an intent claims it.

    effects: session, seq, intent_id; intents: session, intent_id, intent_seq.
    Returns session, seq, intent_id, intent_seq, claims.
    """
    named = effects.select("session", "seq", "intent_id").join(intents.select("session", "intent_id", "intent_seq"), ["session", "intent_id"])
    first = named.groupBy("session", "intent_id").agg(F.min("seq").alias("_first"))
    return named.join(first, ["session", "intent_id"]).withColumn("claims", F.col("seq") == F.col("_first")).drop("_first")


_CLAIMS = T.StructType([T.StructField("session", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("intent_seq", T.LongType()), T.StructField("how", T.StringType())])


def claim_effects(effects: DataFrame, intents: DataFrame, window_ms: int) -> DataFrame:
    """Bind effects to intents: by recorded id, else by nearest equal input hash, greedily.

    effects: session, seq, ms, intent_id, input_hash; intents: session, intent_seq,
    intent_ms, intent_id, intent_hash. Returns session, seq, intent_seq, how, with how in
    recorded, correlated, late (the intent was claimed before) and none (intent_seq null).

    Recorded ids bind set-wise. The greedy part is order-dependent, so only sessions that
    hold an effect without a known intent are walked, one after another in each task.
    """
    recorded = claim_recorded(effects, intents)
    loose = effects.join(recorded.select("session", "seq"), ["session", "seq"], "left_anti")
    walked = loose.select("session").distinct()
    plain = recorded.join(walked, "session", "left_anti").select("session", "seq", "intent_seq", F.when(F.col("claims"), "recorded").otherwise("late").alias("how"))

    known = recorded.select("session", "seq", F.col("intent_seq").alias("known"))
    rows = effects.join(walked, "session", "left_semi").join(known, ["session", "seq"], "left").select("session", F.lit(True).alias("effect"), "seq", "ms", F.col("input_hash").alias("hash"), "known")
    rows = rows.unionByName(intents.join(walked, "session", "left_semi").select("session", F.lit(False).alias("effect"), F.col("intent_seq").alias("seq"), F.col("intent_ms").alias("ms"), F.col("intent_hash").alias("hash"), F.lit(None).cast("long").alias("known")))

    def bound(rows):
        """Claims of one session's rows (effect, seq, ms, hash, known), in order."""
        by_hash, taken, out = {}, set(), []
        for effect, seq, ms, own, _ in rows:
            if not effect and own is not None:
                by_hash.setdefault(own, []).append((ms, seq))
        for effect, seq, ms, own, known in rows:
            if not effect:
                continue
            if known is not None:
                out.append((seq, known, "late" if known in taken else "recorded"))
                taken.add(known)
                continue
            near = [(abs(t - ms), s) for t, s in by_hash.get(own, ()) if s not in taken and abs(t - ms) <= window_ms]
            if near:
                gap, s = min(near)  # the nearest, of equals the one met first
                out.append((seq, s, "correlated"))
                taken.add(s)
            else:
                out.append((seq, None, "none"))
        return out

    def walk(batches):
        import pyarrow as pa

        schema = pa.schema([("session", pa.string()), ("seq", pa.int64()), ("intent_seq", pa.int64()), ("how", pa.string())])
        own, held = None, []

        def closed():
            return pa.RecordBatch.from_pylist([{"session": own, "seq": s, "intent_seq": i, "how": h} for s, i, h in bound(held)], schema)

        for batch in batches:
            for session, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if session != own and held:
                    yield closed()
                    held = []
                own = session
                held.append(row)
        if held:
            yield closed()

    dealt = rows.repartition("session").sortWithinPartitions("session", "seq", "effect")
    return plain.unionByName(dealt.mapInArrow(walk, _CLAIMS))


def last_value_before(events: DataFrame, at: list[str], seq: str, known: str, value: list[str]) -> DataFrame:
    """For each row the struct of `value` from the last earlier row where `known` holds.

    The struct keeps "known to be null" apart from "never known", which is a null struct.
    """
    order = W.partitionBy(*at).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("previous", F.last(F.when(F.col(known), F.struct(*value)), ignorenulls=True).over(order))


def file_breaks(effects: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads whose hash differs from what the last effect left at that path.

    effects: session, path, seq, post_hash, event_id; reads: session, path, seq, pre_hash, event_id.
    """
    both = effects.select("session", "path", "seq", F.lit(True).alias("wrote"), F.col("post_hash").alias("hash"), "event_id")
    both = both.unionByName(reads.select("session", "path", "seq", F.lit(False).alias("wrote"), F.col("pre_hash").alias("hash"), "event_id"))
    found = last_value_before(both, ["session", "path"], "seq", "wrote", ["hash", "event_id"])
    broken = ~F.col("wrote") & F.col("previous").isNotNull() & ~F.col("previous.hash").eqNullSafe(F.col("hash"))
    return found.where(broken).select("session", "path", "seq", "event_id", "hash", F.col("previous.hash").alias("previous_hash"), F.col("previous.event_id").alias("previous_event_id"))


def kernel_matches(execs: DataFrame, intents: DataFrame, window_ms: int, early_ms: int = EARLY_MS) -> DataFrame:
    """Per kernel execution the nearest intent of its process tree, the earliest of equals.

    execs: session, seq, ms, pids; intents: session, intent_seq, intent_ms, intent_pids. The
    execution may come window_ms after the intent and early_ms before it. Not exclusive.
    """
    known = lambda c: F.filter(c, lambda x: x.isNotNull())  # noqa: E731  (overlap with a null member is null)
    pairs = interval_join(execs, intents, ["session"], "ms", "intent_ms", window_ms, early_ms)
    pairs = pairs.where(F.arrays_overlap(known(F.col("pids")), known(F.col("intent_pids"))))
    return best(pairs, ["session", "seq"], [F.abs(F.col("ms") - F.col("intent_ms")), F.col("intent_ms"), F.col("intent_seq")], ["intent_seq"])


def attach_parents(events: DataFrame) -> DataFrame:
    """session, id, parent, seq -> the same with `attached`: the parent, if it stands earlier."""
    parents = events.select("session", F.col("id").alias("parent"), F.col("seq").alias("parent_seq"))
    joined = events.join(parents, ["session", "parent"], "left")
    return joined.withColumn("attached", F.when(F.col("parent_seq") < F.col("seq"), F.col("parent"))).drop("parent_seq")
