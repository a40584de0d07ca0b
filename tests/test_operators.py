"""Operators whose result depends on order, against plain Python."""

import random

from pyspark.sql import functions as F

from ledgerline.functions import ulid
from ledgerline.operators import correlate
from ledgerline.operators.intervals import interval_join
from ledgerline.plans.relational import global_places


def claims(effects, intents, window):
    """Brute force of the greedy binding of one session."""
    by_id = {i["intent_id"]: i for i in intents}
    taken, out = set(), []
    for e in sorted(effects, key=lambda x: x["seq"]):
        intent = by_id.get(e["intent_id"])
        if intent is not None:
            out.append((e["seq"], intent["intent_seq"], "late" if intent["intent_seq"] in taken else "recorded"))
            taken.add(intent["intent_seq"])
            continue
        near = [(abs(i["intent_ms"] - e["ms"]), i["intent_seq"]) for i in intents if i["intent_hash"] == e["input_hash"] and i["intent_seq"] not in taken and abs(i["intent_ms"] - e["ms"]) <= window]
        out.append((e["seq"], min(near)[1], "correlated") if near else (e["seq"], None, "none"))
        taken |= {min(near)[1]} if near else set()
    return out


def test_effects_claim_greedily(spark):
    rng = random.Random(9)
    effects, intents = [], []
    for s in range(12):
        for seq in range(60):
            at, h = seq * 1000 + rng.randrange(3000), f"h{rng.randrange(4)}"
            if rng.random() < 0.5:
                intents.append({"session": f"s{s}", "intent_seq": seq, "intent_ms": at, "intent_id": f"i{seq}", "intent_hash": h})
            else:
                effects.append({"session": f"s{s}", "seq": seq, "ms": at, "intent_id": rng.choice([None, None, f"i{rng.randrange(60)}"]) if s > 2 else f"i{rng.randrange(60)}", "input_hash": h})
    e = spark.createDataFrame(effects, "session string, seq long, ms long, intent_id string, input_hash string")
    i = spark.createDataFrame(intents, "session string, intent_seq long, intent_ms long, intent_id string, intent_hash string")
    got = sorted((r.session, r.seq, r.intent_seq, r.how) for r in correlate.claim_effects(e, i, 5000).collect())
    want = sorted((s, *c) for s in {x["session"] for x in effects} for c in claims([x for x in effects if x["session"] == s], [x for x in intents if x["session"] == s], 5000))
    assert got == want and {x[3] for x in got} == {"recorded", "late", "correlated", "none"}


def test_interval_join_has_inclusive_bounds(spark):
    left = spark.createDataFrame([("a", 1, 1000), ("a", 2, None), ("b", 3, -5)], "k string, l long, t long")
    right = spark.createDataFrame([("a", 10, 990), ("a", 11, 989), ("a", 12, 1005), ("a", 13, 1006), ("b", 14, -15), ("b", 15, None)], "k string, r long, u long")
    got = interval_join(left, right, ["k"], "t", "u", 10, 5).select("l", "r").collect()
    assert sorted(map(tuple, got)) == [(1, 10), (1, 12), (3, 14)]


def test_file_breaks_tell_absent_from_unknown(spark):
    effects = spark.createDataFrame([("s", "/a", 1, None, "e1"), ("s", "/b", 1, "x", "e1"), ("s", "/b", 3, "y", "e3")], "session string, path string, seq long, post_hash string, event_id string")
    reads = spark.createDataFrame([("s", "/a", 2, None, "r2"), ("s", "/a", 4, "z", "r4"), ("s", "/b", 2, "x", "r2"), ("s", "/b", 4, "x", "r4"), ("s", "/c", 2, "q", "r2")], "session string, path string, seq long, pre_hash string, event_id string")
    got = {(r.path, r.event_id, r.previous_hash) for r in correlate.file_breaks(effects, reads).collect()}
    assert got == {("/a", "r4", None), ("/b", "r4", "y")}


def test_global_places_equal_a_total_order(spark):
    rows = [(f"h{i % 7}", i) for i in range(100)]
    got = global_places(spark.createDataFrame(rows, "wall string, n long"), [F.col("wall"), F.col("n")], "wall").orderBy("place").collect()
    assert [(r.wall, r.n) for r in got] == sorted(rows) and [r.place for r in got] == list(range(1, 101))


def test_ulids_on_columns_and_on_the_driver_agree(spark):
    (r,) = spark.range(1).select(ulid.from_time(F.lit(1740823200000), F.lit("a"), F.lit(1)).alias("id"), F.sha2(F.lit("a|1"), 256).alias("h")).collect()
    assert r.id == ulid.encode(1740823200000, bytes.fromhex(r.h)[:10])
    bad = spark.createDataFrame([("8" + "0" * 25,), ("short",), (None,)], "id string")
    assert not any(x.v for x in bad.select(ulid.is_valid(F.col("id")).alias("v")).collect())
