"""Interval joins as equi-joins on time buckets, and the arg-max that picks a match.

Spark has no native range join. Rows are bucketed by the width of the window, the probing
side is repeated for the two buckets that its window can touch, and the exact bounds are a
residual predicate; so the join is an ordinary shuffled equi-join on (keys, bucket) whose
cost follows the number of candidates, and adaptive execution can split hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, before: int, after: int) -> DataFrame:
    """Pairs of equal keys with right_at - left_at in [-before, after].

    Column names other than the keys must differ between the sides. Null times match nothing.
    """
    width = max(before + after, 1)
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    probes = F.sequence(bucket(F.col(left_at) - before), bucket(F.col(left_at) + after))
    probing = left.where(F.col(left_at).isNotNull()).withColumn("_bucket", F.explode(probes))
    held = right.where(F.col(right_at).isNotNull()).withColumn("_bucket", bucket(F.col(right_at)))
    gap = F.col(right_at) - F.col(left_at)
    return probing.join(held, [*keys, "_bucket"]).where((gap >= -before) & (gap <= after)).drop("_bucket")


def best(pairs: DataFrame, target: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Per target the pair that comes first in `order`; combined on the map side, no window."""
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = F.min_by(F.struct(*keep), ranked)
    return pairs.groupBy(*target).agg(picked.alias("_best")).select(*target, *[F.col(f"_best.{c}").alias(c) for c in keep])


def time_score(gap_ms: Column) -> Column:
    """10 for the same second, one less for each second apart, not below 0."""
    return F.greatest(F.lit(0), F.lit(10) - F.floor(F.abs(gap_ms) / 1000)).cast("long")


def related_paths(a: Column, b: Column) -> Column:
    """Whether one path begins with the other, case aside and without trailing slashes."""
    x, y = (F.lower(F.regexp_replace(c, "/+$", "")) for c in (a, b))
    return F.startswith(x, y) | F.startswith(y, x)


def argv_overlap(a: Column, b: Column, depth: int = 5) -> Column:
    """At how many of the first positions two argvs hold the same word, case aside."""
    same = F.zip_with(F.slice(a, 1, depth), F.slice(b, 1, depth), lambda x, y: F.coalesce((F.lower(x) == F.lower(y)).cast("int"), F.lit(0)))
    return F.coalesce(F.aggregate(same, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
