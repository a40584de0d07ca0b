"""Sealing, verifying, tampering, disclosing and exporting a bundle."""

import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import crypto, jcs
from ledgerline.operators import integrity
from ledgerline.plans import exports, verify
from ledgerline.sinks import disclose, write_bundle
from ledgerline.sources.events import payload_json

SHAPE = "id string, wall_ts string, mono long, session string, agent string, parent string, type string, payload string, payload_hash string"


def event(n, kind, payload, parent=None):
    text, digest = payload_json(payload)
    return (f"0{n:025d}", f"2025-01-01T00:00:{n:02d}.000Z", n, "s", "agent-a", parent, kind, text, digest)


def rows():
    pre = lambda h: {"argv": ["ls"], "cwd": "/", "source": "claude-pretooluse", "fileArgs": [{"path": "/a", "preSha256": h}], "envSubset": {}, "captureSchemaVersion": 3}
    effect = lambda i: {"kind": "effect", "toolName": "Bash", "intentEventId": i, "files": [{"path": "/a", "preSha256": "x", "postSha256": "y", "change": "modified"}]}
    out = [event(0, "prompt", {"text": "do € \"it\""}), event(1, "shell_command_pre", pre("x"))]
    out += [event(2, "tool_call_effect", effect(out[1][0])), event(3, "shell_command_pre", pre("y")), event(4, "gap", {"reason": "intent_without_effect", "affectedEventIds": [f"0{3:025d}"], "detail": "d"})]
    out += [event(5, "shell_command_pre", pre("z")), event(6, "gap", {"reason": "unwitnessed_file_change", "affectedEventIds": [f"0{2:025d}", f"0{5:025d}"], "detail": "d"})]
    out += [event(7, "gap", {"reason": "intent_without_effect", "affectedEventIds": [f"0{5:025d}"], "detail": "d"}), event(8, "tool_result", {"toolName": "Bash", "output": "1e2", "exitCode": None})]
    return out


@pytest.fixture(scope="module")
def key(spark):
    return crypto.new_key(spark)


@pytest.fixture(scope="module")
def bundle(spark, key, tmp_path_factory):
    root = tmp_path_factory.mktemp("b") / "bundle"
    public, private = key
    write_bundle(spark, spark.createDataFrame(rows(), SHAPE), str(root), bundle_id="B", produced_at="2025-01-02T00:00:00.000Z", seed="seed", private=private, public_pem=public, narrative={"narrative.md": "# x\n"}, raw={"log/a b.jsonl": b"{}\n"})
    return root


def statuses(spark, path, **more):
    return {r.name: r.status for r in verify.verify_any(spark, str(path), **more).collect()}


def test_an_untouched_bundle_passes(spark, bundle, key):
    got = statuses(spark, bundle, pin=crypto.fingerprint(key[0]), revoked=[])
    assert "FAIL" not in got.values() and got["anchor-status"] == "WARN"
    assert {"payload-hash", "chain-replay", "merkle-root", "commitments", "files-map", "intent-effect", "file-continuity", "key-fingerprint-pin"} <= set(got)
    assert verify.report(verify.verify_bundle(spark, str(bundle))).endswith("PASS")


def test_sealing_is_deterministic(spark, bundle, key, tmp_path):
    write_bundle(spark, spark.createDataFrame(rows(), SHAPE).repartition(3), str(tmp_path / "x"), bundle_id="B", produced_at="2025-01-02T00:00:00.000Z", seed="seed", private=key[1], public_pem=key[0], narrative={"narrative.md": "# x\n"}, raw={"log/a b.jsonl": b"{}\n"})
    for file in ("events.jsonl", "manifest.json", "commitments.json"):
        assert (tmp_path / "x" / file).read_bytes() == (bundle / file).read_bytes()


def edit_line(n, change):
    def run(root):
        file = root / "events.jsonl"
        own = file.read_text().splitlines()
        own[n] = change(own[n])
        file.write_text("\n".join(own) + "\n")

    return run


def edit_manifest(change):
    def run(root):
        m = json.loads((root / "manifest.json").read_text())
        change(m)
        (root / "manifest.json").write_text(jcs.canonical(m))

    return run


def edit_openings(change):
    def run(root):
        c = json.loads((root / "commitments.json").read_text())
        change(c["openings"])
        (root / "commitments.json").write_text(json.dumps(c))

    return run


TAMPERED = {
    "payload": (edit_line(8, lambda x: x.replace('"exitCode":null', '"exitCode":0')), "payload-hash"),
    "time": (edit_line(8, lambda x: x.replace("00:00:08", "00:00:09")), "chain-replay"),
    "number": (edit_line(8, lambda x: x.replace('"monoNs":"8"', '"monoNs":8')), "chain-replay"),
    "signature": (edit_manifest(lambda m: m["signatures"][0].update(signature="AA" + m["signatures"][0]["signature"][2:])), "signature-verify"),
    "manifest": (edit_manifest(lambda m: m["counts"].update(gaps=0)), "signature-verify"),
    "mode": (edit_manifest(lambda m: m["producer"].update(mode="other")), "mode-declaration"),
    "version": (edit_manifest(lambda m: m.update(schemaVersion=9)), "schema-version"),
    "opening value": (edit_openings(lambda o: o[0].update(value="else")), "commitments"),
    "opening lost": (edit_openings(lambda o: o.pop()), "commitments"),
    "file changed": (lambda root: (root / "narrative.md").write_text("# y\n"), "files-map"),
    "file added": (lambda root: (root / "raw/extra").write_text("x"), "files-map"),
    "file lost": (lambda root: (root / "raw/log/a b.jsonl").unlink(), "files-map"),
    "rules": (lambda root: (root / "rules/destructive.yaml").write_text("rules: [x]"), "ruleset-integrity"),
    "attestation": (lambda root: (root / "attestations/signatures.json").write_text("[]"), "attestation-files"),
}


@pytest.mark.parametrize("what", TAMPERED)
def test_tampering_fails_its_check(spark, bundle, tmp_path, what):
    change, check = TAMPERED[what]
    shutil.copytree(bundle, tmp_path / "t")
    change(tmp_path / "t")
    assert statuses(spark, tmp_path / "t")[check] == "FAIL"


def test_pairing_and_continuity_need_their_gaps(spark, tmp_path):
    for lost, check in ((4, "intent-effect"), (6, "file-continuity")):
        some = [r for i, r in enumerate(rows()) if i != lost]
        root = tmp_path / str(lost)
        write_bundle(spark, spark.createDataFrame(some, SHAPE), str(root), bundle_id="B", produced_at="2025-01-02T00:00:00.000Z", seed="s")
        got = statuses(spark, root)
        assert got[check] == "FAIL" and got["chain-replay"] == "PASS" and got["signature-verify"] == "SKIPPED"


def test_revoked_and_unknown_keys(spark, bundle, key):
    own = crypto.fingerprint(key[0])
    assert statuses(spark, bundle, pin="00")["key-fingerprint-pin"] == "FAIL"
    assert statuses(spark, bundle, revoked=[{"fingerprint": own.upper(), "status": "revoked"}])["revocation-list"] == "FAIL"
    assert crypto.did_key(key[0]).startswith("did:key:z6Mk")


def test_disclosure_round_trip_and_tampering(spark, bundle, tmp_path):
    out = tmp_path / "d"
    document = disclose(spark, str(bundle), str(out), "0,2-3", "/argv", ("narrative.md",))
    assert [x["index"] for x in document["disclosed"]] == [0, 2, 3] and len(document["withheld"]) == 6
    assert (out / "events.jsonl").read_text().splitlines() == [(bundle / "events.jsonl").read_text().splitlines()[i] for i in (0, 2, 3)]
    got = statuses(spark, out)
    assert "FAIL" not in got.values() and got["disclosure-inclusion"] == "PASS"
    assert document["fields"]["withheld"] == ["/envSubset", "/text"]
    held = json.loads((out / "disclosure.json").read_text())
    held["withheld"][0]["chainHash"] = "00" * 32
    (out / "disclosure.json").write_text(json.dumps(held))
    assert statuses(spark, out)["disclosure-inclusion"] == "FAIL"
    held["withheld"].pop()
    (out / "disclosure.json").write_text(json.dumps(held))
    assert statuses(spark, out)["disclosure-parse"] == "FAIL"
    one, two = (verify.read_bundle(spark, str(p)) for p in (bundle, out))
    assert verify.disclosed_overlap(one, one).count() == 0 and two.count() == 3


def test_merkle_levels_equal_the_recursive_tree(spark):
    data = [(n, i, hashlib.sha256(bytes([0, i])).hexdigest()) for n in (1, 2, 3, 5, 8, 13, 31, 32, 33) for i in range(n)]
    leaves = spark.createDataFrame(data, "session int, idx long, hash string")
    roots = {r.session: r.merkle_root for r in integrity.merkle_roots(leaves, ["session"]).collect()}
    for n in roots:
        assert bytes.fromhex(roots[n]) == verify.root_of([hashlib.sha256(bytes([0, i])).digest() for i in range(n)])
    proofs = integrity.inclusion_proofs(leaves, ["session"]).withColumn("root", integrity.proven_root(F.col("hash"), F.col("path")))
    assert all(r.root == roots[r.session] for r in proofs.collect())


def test_exports_are_chained(spark, bundle, key):
    events = verify.read_bundle(spark, str(bundle))
    last = None
    for r in exports.action_records(events, "ns").orderBy("id").collect():
        assert json.loads(r.record)["prev_hash"] == last and jcs.canonical(json.loads(r.record)) == r.record
        last = hashlib.sha256(r.record.encode()).hexdigest()
    made = exports.receipts(events, crypto.did_key(key[0]), "sha256:0")
    signed = [json.loads(x) for x in exports.sign_receipts(spark, made, key[1])]
    assert len(signed) == 5 and signed[0]["payload"]["previousReceiptHash"] == "0" * 64
    import base64

    for s in signed:
        assert crypto.verify(spark, key[0], jcs.canonical(s["payload"]).encode(), base64.b64decode(s["signature"]["sig"]))
    statement = exports.statement(spark, json.loads((bundle / "manifest.json").read_text()), key[1], key[0])
    assert statement[0] == 0xD2


def test_anchoring(spark, bundle, key, tmp_path):
    from ledgerline.sinks import anchor

    shutil.copytree(bundle, tmp_path / "a")
    made = anchor(spark, str(tmp_path / "a"), None, "2025-02-01T00:00:00.000Z", key[1], key[0])
    assert anchor(spark, str(tmp_path / "a"), None, "2026-01-01T00:00:00.000Z", key[1], key[0]) == made
    got = statuses(spark, tmp_path / "a")
    assert got["anchor-status"] == "PASS" and "FAIL" not in got.values()
    (tmp_path / "a/anchor.json").write_text(json.dumps(made | {"anchoredAt": "2024-01-01T00:00:00.000Z"}))
    assert statuses(spark, tmp_path / "a")["anchor-status"] == "FAIL"
    with pytest.raises((ValueError, IndexError)):
        anchor(spark, str(bundle), b"\x30\x00", "2025-02-01T00:00:00.000Z", key[1], key[0])


def test_growth_is_proven(spark, key, tmp_path):
    documents = []
    for n in (6, 9):
        root = tmp_path / str(n)
        write_bundle(spark, spark.createDataFrame(rows()[:n], SHAPE), str(root), bundle_id="B", produced_at="2025-01-02T00:00:00.000Z", seed="seed", private=key[1], public_pem=key[0])
        documents.append(disclose(spark, str(root), str(tmp_path / f"d{n}"), "0", earlier=documents[-1] if documents else None))
    assert statuses(spark, tmp_path / "d9")["tree-consistency"] == "PASS"
    held = json.loads((tmp_path / "d9/disclosure.json").read_text())
    held["consistency"]["proof"][0] = "00" * 32
    (tmp_path / "d9/disclosure.json").write_text(json.dumps(held))
    assert statuses(spark, tmp_path / "d9")["tree-consistency"] == "FAIL"
    with pytest.raises(ValueError):
        disclose(spark, str(tmp_path / "9"), str(tmp_path / "x"), "0", earlier=documents[0] | {"merkleRoot": "00" * 32})


def test_key_catalog(tmp_path):
    from ledgerline import keys

    path = str(tmp_path / "keys.json")
    keys.added(path, "A", "t0")
    keys.rotated(path, "A", "B", "t1")
    keys.revoked(path, "a", "t2", "lost")
    found = {k["fingerprint"]: k["status"] for k in keys.rotated(path, "A", "C", "t3")}
    assert found == {"A": "revoked", "B": "active", "C": "active"}
    with pytest.raises(KeyError):
        keys.revoked(path, "Z", "t")


def test_timestamp_requests():
    made = crypto.timestamp_request(bytes(32), b"\xff" * 8)
    top = crypto.children(crypto.der(made)[1])
    assert [t for t, _ in top] == [0x02, 0x30, 0x02, 0x01] and crypto.children(top[1][1])[1] == (0x04, bytes(32))
