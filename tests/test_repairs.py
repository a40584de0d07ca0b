"""Cases that once went wrong: control characters, long chains, streams that stop early, sealed rules, links of lines, audit paths."""

import hashlib
import json
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import jcs
from ledgerline.operators import integrity, rules, timeline
from ledgerline.plans.verify import root_of
from ledgerline.sinks import event_line
from ledgerline.sources.rulesets import parse_ruleset, ruleset_text
from ledgerline.streaming.captures import run_available


def test_every_control_character_is_escaped(spark):
    texts = [(f"a{chr(c)}b",) for c in range(34)] + [("plain",), ('q"\\',), (None,)]
    got = spark.createDataFrame(texts, "t string").select("t", integrity.json_text(F.col("t")).alias("j")).collect()
    assert all(r.j == ("null" if r.t is None else jcs.canonical(r.t)) for r in got) and json.loads(got[0].j) == "a\0b"


def test_long_chains_have_a_root(spark):
    rows = [("s", f"{i:04}", f"{i - 1:04}" if i else None) for i in range(200)]
    got = {r.id: (r.root, r.depth) for r in timeline.forest(spark.createDataFrame(rows, "session string, id string, parent string")).collect()}
    assert got == {f"{i:04}": ("0000", i) for i in range(200)}


def test_a_stream_that_is_not_through_is_an_error():
    stream = MagicMock()
    query = stream.writeStream.foreachBatch.return_value.outputMode.return_value.option.return_value.trigger.return_value.start.return_value
    query.awaitTermination.return_value = False
    with pytest.raises(TimeoutError):
        run_available(stream, lambda df, n: None, "/nowhere", timeout_s=1)
    query.stop.assert_called_once()


def test_the_default_rules_survive_being_sealed():
    assert parse_ruleset(ruleset_text(rules.DEFAULT_RULES))["rules"] == [tuple(r) for r in rules.DEFAULT_RULES]


def test_links_are_written_with_the_line(spark):
    names = ["id", "wall_ts", "mono", "session", "agent", "parent", "type", "payload", "payload_hash", "chain_hash", "linked_pre", "linked_effect", "linked_intent"]
    rows = [("1", "t", 1, "s", "a", None, "x", "{}", "p", "c", "pre", None, 'in"t'), ("2", "t", 2, "s", "a", "1", "x", "{}", "p", "c", None, None, None)]
    df = spark.createDataFrame(rows, "id string, wall_ts string, mono long, session string, agent string, parent string, type string, payload string, payload_hash string, chain_hash string, linked_pre string, linked_effect string, linked_intent string")
    assert df.columns == names
    one, two = (json.loads(r.line) for r in df.orderBy("id").select(event_line(links=True).alias("line")).collect())
    assert one["correlation"] == {"linkedIntentId": 'in"t', "linkedShellCommandPreId": "pre"} and "correlation" not in two
    assert "correlation" not in json.loads(df.select(event_line().alias("line")).first().line)


def _audit_path(hashes: list[bytes], i: int) -> list[tuple[str, bool]]:
    """Siblings of leaf i from the leaf up, by the split at the largest power of two."""
    if len(hashes) == 1:
        return []
    k = 1 << ((len(hashes) - 1).bit_length() - 1)
    own, other = (hashes[:k], hashes[k:]) if i < k else (hashes[k:], hashes[:k])
    return [*_audit_path(own, i % k), (root_of(other).hex(), i >= k)]


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_audit_paths_need_no_join_and_cross_blocks(spark, bits, monkeypatch):
    monkeypatch.setattr(integrity, "BLOCK_LEVELS", bits)
    trees = {n or None: [hashlib.sha256(bytes([n, i])).digest() for i in range(n or 6)] for n in (0, 1, 2, 3, 4, 5, 8, 9, 17, 33)}
    leaves = spark.createDataFrame([(n, i, h.hex()) for n, hashes in trees.items() for i, h in enumerate(hashes)], "session int, idx long, hash string")
    proofs = integrity.inclusion_proofs(leaves, ["session"])
    plan = proofs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    got = {(r.session, r.idx): (r.hash, [tuple(s) for s in r.path]) for r in proofs.collect()}
    assert got == {(n, i): (h.hex(), _audit_path(hashes, i)) for n, hashes in trees.items() for i, h in enumerate(hashes)}
    roots = {r.session: r.merkle_root for r in integrity.proven_leaves(leaves, ["session"]).collect()}
    assert roots == {n: root_of(hashes).hex() for n, hashes in trees.items()}


@pytest.mark.parametrize("bits", [1, 10])
def test_audit_paths_of_no_leaves_null_leaves_and_gaps(spark, bits, monkeypatch):
    monkeypatch.setattr(integrity, "BLOCK_LEVELS", bits)
    at = lambda *rows: integrity.proven_leaves(spark.createDataFrame([("s", *r) for r in rows], "session string, idx long, hash string"), ["session"])
    assert at().collect() == []
    a, b = at((0, "00" * 32), (1, None)).orderBy("idx").collect()
    assert (a.path, b.path, a.merkle_root, b.hash) == ([(None, False)], [("00" * 32, True)], None, None)
    for rows in ([(1, "00" * 32)], [(0, "00" * 32), (2, "00" * 32)], [(0, "00" * 32), (0, "00" * 32)]):
        with pytest.raises(Exception, match="without gaps or repeats"):
            at(*rows).collect()
