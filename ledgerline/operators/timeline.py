"""Timeline order, running values, run-length sections, aggregates and the causal forest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.tables import kept

#: Rounds of pointer jumping after which the table is cut.
CUT_EVERY = 2


def order_columns() -> list[Column]:
    """Timeline order: time as text, monotonic time, gaps before originals, source, place in it."""
    return [F.col("wall_ts"), F.col("mono"), F.desc("is_gap"), F.col("src_ord"), F.col("seq")]


def dedup_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order (never an arbitrary one)."""
    rest = [c for c in rows.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(picked.alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def running_last(rows: DataFrame, at: list[str], order: list[str], value: Column, name: str, including: bool = False) -> DataFrame:
    """The last value that is not null of the rows before each row (or up to it)."""
    frame = W.partitionBy(*at).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if including else -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(frame))


def previous(rows: DataFrame, at: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    return rows.withColumn(name, F.lag(value).over(W.partitionBy(*at).orderBy(*order)))


def counter(rows: DataFrame, at: list[str], order: list[str], name: str = "mono") -> DataFrame:
    return rows.withColumn(name, (F.row_number().over(W.partitionBy(*at).orderBy(*order)) - 1).cast("long"))


def runs(rows: DataFrame, at: list[str], order: list[str], value: Column, name: str = "section") -> DataFrame:
    """Number the runs of equal values along the order; a value that returns starts a new run."""
    line = W.partitionBy(*at).orderBy(*order)
    changed = F.coalesce((~value.eqNullSafe(F.lag(value).over(line))).cast("int"), F.lit(1))
    first = F.row_number().over(line) == 1
    marked = rows.withColumn("_new", F.when(first, 1).otherwise(changed))
    return marked.withColumn(name, F.sum("_new").over(line).cast("long")).drop("_new")


def hour_sections(rows: DataFrame, at: list[str], order: list[str], wall_ts: str) -> DataFrame:
    """One row per run of an hour text along the timeline."""
    hour = F.substring(F.col(wall_ts), 1, 13)
    numbered = runs(rows.withColumn("hour", hour), at, order, F.col("hour"))
    return numbered.groupBy(*at, "section").agg(F.first("hour").alias("hour"), F.count("*").alias("n"))


def tool_summary(rows: DataFrame, tool: str, kind: str) -> DataFrame:
    """Per tool how many intents and results there are."""
    return rows.groupBy(tool).agg(F.count_if(F.col(kind) == "intent").alias("n_intent"), F.count_if(F.col(kind) == "result").alias("n_result"))


def bounds(rows: DataFrame, at: list[str], order: list[str], value: str) -> DataFrame:
    """First and last value of each group in the stated order (not smallest and largest)."""
    by = F.struct(*order)
    return rows.groupBy(*at).agg(F.min_by(value, by).alias("first"), F.max_by(value, by).alias("last"))


def first_seen(rows: DataFrame, at: list[str], value: str, order: list[str]) -> DataFrame:
    """Distinct values of each group with the place at which they were first seen."""
    seen = rows.groupBy(*at, value).agg(F.min(F.struct(*order)).alias("_at"))
    return seen.withColumn("place", F.row_number().over(W.partitionBy(*at).orderBy("_at")).cast("long")).select(*at, value, "place")


def _state(df: DataFrame) -> DataFrame:
    return kept(df, "forest")


def forest(events: DataFrame, cut=_state) -> DataFrame:
    """session, id, root, depth of a forest given as session, id, parent (null for roots).

    Parents come from attach_parents, so they exist and stand earlier: there are no cycles.

    Pointer jumping: every round doubles the distance that a row has looked up, so rounds
    grow with the logarithm of the deepest chain. `cut` ends lineage every few rounds.
    """
    state = events.select("session", "id", F.coalesce("parent", "id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    turn = 0
    while True:
        turn += 1
        above = state.select("session", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        state = state.join(above, ["session", "up"], "left").select("session", "id", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        if turn % CUT_EVERY == 0:
            state = cut(state)
            inner = events.where("parent is not null").select("session", F.col("id").alias("up"))
            if not state.join(inner, ["session", "up"], "left_semi").limit(1).count():
                return state.withColumnRenamed("up", "root")


def children_order(events: DataFrame) -> DataFrame:
    """Place of each row among the children of its parent, by time alone, ties as they stood."""
    line = W.partitionBy("session", "parent").orderBy("wall_ts", "seq")
    return events.withColumn("child", F.row_number().over(line).cast("long"))
