"""The capture store as a stream gives what a batch over the same files gives."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerline.streaming import captures


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    rows = {
        "a": {"argv": ["ls"], "capturedAt": "2025-01-01T00:00:00Z", "sessionId": "s", "inputHash": "h1"},
        "b": {"kind": "effect", "capturedAt": "2025-01-01T00:00:03Z", "sessionId": "s", "inputHash": "h1", "toolName": "B"},
        "c": {"argv": ["rm"], "capturedAt": "2025-01-01T00:10:00Z", "sessionId": "s", "inputHash": "h2"},
        "d": {"kind": "effect", "capturedAt": "2025-01-01T00:20:00Z", "sessionId": "t", "inputHash": "h3", "toolName": "B"},
        "e": {"kind": "execve", "capturedAt": "2025-01-01T01:30:00Z", "sessionId": "s", "pid": 4, "argv": ["x"]},
        "g": {"argv": ["end"], "capturedAt": "2025-01-01T09:00:00Z", "sessionId": "z", "inputHash": "h9"},
        "h": {"kind": "effect", "capturedAt": "2025-01-01T09:00:01Z", "sessionId": "z", "inputHash": "h9", "toolName": "B"},
    }
    for i, (name, body) in enumerate(rows.items()):
        (root / f"{name}.json").write_text(json.dumps(body))
        os.utime(root / f"{name}.json", (1735730000 + i, 1735730000 + i))  # files arrive in this order
    (root / "bad.json").write_text("{no json")
    return root


def collected(stream, tmp_path, mode="append"):
    out = []
    captures.run_available(stream, lambda df, n: out.extend(r.asDict() for r in df.collect()), str(tmp_path / "ck"), mode)
    return out


def test_every_file_is_a_row(spark, store, tmp_path):
    got = collected(captures.parsed(captures.read_store(spark, str(store), 3)).select("id", "kind", "failed"), tmp_path)
    assert {r["id"]: r["kind"] for r in got} == {"a": "command", "b": "effect", "c": "command", "d": "effect", "e": "execve", "g": "command", "h": "effect", "bad": "malformed"}
    assert [r["id"] for r in got if r["failed"]] == ["bad"]


def test_stream_join_pairs_intents_and_effects(spark, store, tmp_path):
    intent, effect = captures.sides(captures.parsed(captures.read_store(spark, str(store))))
    got = collected(captures.paired(intent, effect), tmp_path)
    assert {(r["intent_id"], r["effect_id"], r["duration_ms"]) for r in got} == {("a", "b", 3000), ("g", "h", 1000)}


def test_absence_is_emitted_when_the_watermark_passes(spark, store, tmp_path):
    intent, effect = captures.sides(captures.parsed(captures.read_store(spark, str(store), 2)), "1 minute")
    got = collected(captures.absences(captures.paired(intent, effect, how="leftOuter")), tmp_path)
    assert [r["id"] for r in got] == ["c"]


def test_markers_are_taken_once_and_expire(spark, store, tmp_path):
    got = collected(captures.pending_markers(captures.parsed(captures.read_store(spark, str(store), 2)).where("not failed"), late="1 minute"), tmp_path)
    assert {(r["intent_id"], r["effect_id"], r["state"]) for r in got} >= {("a", "b", "taken"), (None, "d", "unmatched"), ("g", "h", "taken")}
    assert ("c", None, "expired") in {(r["intent_id"], r["effect_id"], r["state"]) for r in got}


def test_windows_equal_the_batch(spark, store, tmp_path):
    batch = spark.read.format("text").option("wholetext", True).load(str(store)).select(F.col("_metadata.file_name").alias("id"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("modified"))
    rows = captures.parsed(batch).where("not failed")
    want = {(str(r.hour), r.kind, r.n) for r in captures.hourly(rows).collect()}
    got = collected(captures.hourly(captures.parsed(captures.read_store(spark, str(store))).where("not failed")), tmp_path, "complete")
    assert {(str(r["hour"]), r["kind"], r["n"]) for r in got} == want
    assert captures.activity(rows).where("session = 's'").count() == 2
    assert captures.sliding(rows).agg(F.sum("n")).first()[0] == 2 * rows.count()
    assert captures.collector_counters(rows).first().asDict() == {"seen": 1, "recorded": 1, "uncharacterized": 0}
    fresh, late = captures.split_late(rows, F.timestamp_millis(F.lit(1735722000000)))
    assert late.count() == 5 and fresh.count() == 2


def test_kernel_records(spark):
    raw = (1234).to_bytes(4, "little") + bytes(4) + (10**12 + 7).to_bytes(8, "little") + b"bash".ljust(16, b"\0")
    got = spark.createDataFrame([(bytearray(raw),)], "raw binary").select(captures.exec_records(F.col("raw")).alias("r")).first().r
    assert (got.pid, got.mono, got.comm) == (1234, 10**12 + 7, "bash")
