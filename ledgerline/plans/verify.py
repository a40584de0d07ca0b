"""Verifying a bundle or a disclosure: an ordered list of named checks, one row each.

Checks over events (hashes, chain, tree, pairing, continuity, openings) are DataFrame
queries; checks of the one manifest run on the driver. A failed check that makes the rest
meaningless ends the run, and that is a row too.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import crypto, jcs
from ledgerline.functions.shapes import STRING, array, struct
from ledgerline.operators import integrity
from ledgerline.operators.correlate import file_breaks
from ledgerline.sinks import PLACEHOLDER, UNMAPPED, UNMAPPED_BELOW, event_metadata, safe_path, signing_form

PASS, FAIL, WARN, SKIPPED = "PASS", "FAIL", "WARN", "SKIPPED"
RESULT = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("status", T.StringType()), T.StructField("detail", T.StringType())])
REQUIRED = ("manifest.json", "events.jsonl", "commitments.json", "rules/destructive.yaml", "attestations")
#: Fixed value: the source that marks an intent which must be closed by an effect.
HOOKED = "claude-pretooluse"
SHOWN = 8

_LINE = "id string, wallTs string, monoNs string, sessionId string, agentId string, parentEventId string, type string, payloadHash string, chainHash string, correlation struct<linkedEffectId: string, linkedIntentId: string, linkedShellCommandPreId: string>"


@F.pandas_udf(STRING)
def _payload(line: pd.Series) -> pd.Series:
    """The payload of an event line as canonical JSON."""
    out = []
    for text in line:
        try:
            found = jcs.parse(text)
            out.append(jcs.canonical(found["payload"]) if isinstance(found, dict) and "payload" in found else None)
        except (ValueError, RecursionError):
            out.append(None)
    return pd.Series(out, dtype=object)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """idx, line and the fields of every event of a bundle; payload is canonical JSON."""
    whole = spark.read.text(f"{path}/events.jsonl", wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", "\n")).alias("idx", "line")).where("line <> ''")
    rows = rows.withColumn("e", F.from_json("line", _LINE)).withColumn("payload", _payload("line"))
    strict = F.get_json_object("line", "$.monoNs").isNotNull() & F.col("line").rlike(r'"monoNs"\s*:\s*"(0|[1-9][0-9]*)"')
    return rows.select(
        F.col("idx").cast("long").alias("idx"),
        "line",
        F.col("e.id").alias("id"),
        F.col("e.wallTs").alias("wall_ts"),
        F.col("e.monoNs").alias("mono"),
        strict.alias("mono_text"),
        F.col("e.sessionId").alias("session"),
        F.col("e.agentId").alias("agent"),
        F.col("e.parentEventId").alias("parent"),
        F.col("e.type").alias("type"),
        F.col("e.payloadHash").alias("payload_hash"),
        F.col("e.chainHash").alias("chain_hash"),
        F.col("e.correlation").alias("correlation"),
        "payload",
    )


def _shown(problems: list[str]) -> str:
    more = len(problems) - SHOWN
    return "; ".join(problems[:SHOWN]) + (f"; and {more} more" if more > 0 else "")


def _some(problems: DataFrame, what: str, *columns: str) -> tuple[str, str] | None:
    """FAIL with the first few rows of a DataFrame of problems, None when there are none."""
    n = problems.count()
    if not n:
        return None
    rows = problems.select(*columns).orderBy(*columns).limit(SHOWN).collect()
    return FAIL, f"{n} {what}: " + _shown([" ".join(str(x) for x in r) for r in rows])


class Bundle:
    """What the checks of one run share."""

    def __init__(self, spark: SparkSession, path: str, pin: str | None = None, revoked: list[dict] | None = None, anchor_key: str | None = None):
        self.spark, self.path, self.pin, self.revoked = spark, Path(path), pin, revoked
        self.manifest: dict = {}
        self._events: DataFrame | None = None

    @property
    def events(self) -> DataFrame:
        if self._events is None:
            self._events = read_bundle(self.spark, str(self.path)).cache()
        return self._events

    def json(self, name: str):
        file = self.path / name
        return json.loads(file.read_text()) if file.exists() else None

    def digest(self, name: str) -> str | None:
        file = self.path / name
        return hashlib.sha256(file.read_bytes()).hexdigest() if file.is_file() else None


Check = Callable[[Bundle], list[tuple[str, str, str]]]


def check_schema(b: Bundle) -> list:
    v = b.manifest.get("schemaVersion")
    return [("schema-version", PASS if v in (2, 3) else FAIL, f"schemaVersion {v}")]


def check_mode(b: Bundle) -> list:
    mode = b.manifest.get("producer", {}).get("mode")
    return [("mode-declaration", PASS if mode in ("signed", "dev-unsigned") else FAIL, f"producer.mode is {mode!r}")]


def check_contract(b: Bundle) -> list:
    m = b.manifest
    signatures, stamps = len(m.get("signatures") or []), len(m.get("timestamps") or [])
    if m["producer"]["mode"] == "dev-unsigned":
        good = not signatures and not stamps
    else:
        good = signatures > 0 and (stamps > 0 or bool(m.get("anchorStatus")))
    return [("mode-contract", PASS if good else FAIL, f"{signatures} signatures, {stamps} timestamps, anchor {m.get('anchorStatus')!r}")]


def check_identity(b: Bundle) -> list:
    out, own = [], b.manifest["producer"].get("keyFingerprint") or ""
    if b.pin is not None:
        same = own.lower() == b.pin.lower()
        out.append(("key-fingerprint-pin", PASS if same else FAIL, f"the bundle names key {own}"))
    if b.revoked is not None:
        gone = own.lower() in {k["fingerprint"].lower() for k in b.revoked if k.get("status") == "revoked"}
        out.append(("revocation-list", FAIL if gone else PASS, "the key is revoked" if gone else "the key is not revoked"))
    return out


def check_signatures(b: Bundle) -> list:
    if b.manifest["producer"]["mode"] == "dev-unsigned":
        return [("signature-verify", SKIPPED, "dev-unsigned")]
    message, problems = signing_form(b.manifest).encode(), []
    for n, s in enumerate(b.manifest.get("signatures") or []):
        try:
            good = s.get("scheme") == "ed25519" and crypto.verify(b.spark, s["publicKey"], message, base64.b64decode(s["signature"], validate=True))
            own = b.manifest["producer"].get("keyFingerprint")
            if good and own and crypto.fingerprint(s["publicKey"]) != own:
                problems.append(f"signature {n} is by another key than the one named")
        except (ValueError, KeyError):
            good = False
        if not good:
            problems.append(f"signature {n} is not valid")
    if not b.manifest.get("signatures"):
        problems.append("there is no signature")
    return [("signature-verify", FAIL if problems else PASS, _shown(problems) or "every signature is valid")]


def check_chain(b: Bundle) -> list:
    e = b.events
    wrong = _some(e.where(~F.sha2(F.col("payload").cast("binary"), 256).eqNullSafe(F.col("payload_hash"))), "payloads do not have their hash", "id")
    out = [("payload-hash", *(wrong or (PASS, "every payload has its hash")))]
    if b.manifest["producer"]["mode"] == "dev-unsigned" and not b.manifest.get("rootHash"):
        return [*out, ("chain-replay", SKIPPED, "an unsigned bundle without a chain")]
    if b.manifest.get("schemaVersion") == 3 and (bad := _some(e.where(~F.coalesce("mono_text", F.lit(False))), "events have a monoNs that is no decimal text", "id")):
        return [*out, ("chain-replay", *bad)]
    from pyspark.sql import Window as W

    line = W.orderBy("idx")  # one bundle is one chain
    unsorted = e.withColumn("before", F.lag("id").over(line)).where("before >= id")
    if bad := _some(unsorted, "events are out of order", "id"):
        return [*out, ("chain-replay", *bad)]
    rows = e.withColumn("metadata", event_metadata()).withColumn("all", F.lit(0))
    empty = rows.where("chain_hash is null or chain_hash = ''").count()
    if empty:
        replayed = integrity.chain_root(rows, ["all"], "id").first()
        root = replayed.root_hash if replayed else ""
        return [*out, ("chain-replay", PASS if root == b.manifest.get("rootHash") else FAIL, f"replayed {root}; {empty} events carry no hash")]
    bad = _some(integrity.chain_breaks(rows, ["all"], "id"), "events break the chain", "id")
    last = rows.agg(F.max_by("chain_hash", "id")).first()[0] or ""
    if not bad and last != b.manifest.get("rootHash"):
        bad = FAIL, f"the chain ends in {last}, the manifest says {b.manifest.get('rootHash')}"
    return [*out, ("chain-replay", *(bad or (PASS, "the chain follows from every event")))]


def _field(name: str, kind: str = "string"):
    return F.get_json_object("payload", f"$.{name}").cast(kind)


def _gap_names(e: DataFrame) -> DataFrame:
    named = F.from_json(F.get_json_object("payload", "$.affectedEventIds"), "array<string>")
    return e.where("type = 'gap'").select(_field("reason").alias("reason"), F.explode(named).alias("id")).distinct()


def intent_effect_problems(e: DataFrame) -> DataFrame:
    """(problem, id) over the events of one bundle."""
    gaps = _gap_names(e)
    effects = e.where("type = 'tool_call_effect'").select("idx", "id", "correlation", F.nullif(_field("intentEventId"), F.lit("")).alias("intent"))
    pres = e.where("type = 'shell_command_pre'").select(F.col("id").alias("intent"), F.col("correlation").alias("pre_correlation"), _field("source").alias("source"))
    joined = effects.join(pres, "intent", "left")
    covered = lambda reason: gaps.where(F.col("reason") == reason).select("id")
    loose = joined.where("source is null and pre_correlation is null").join(pres.select("intent").distinct(), "intent", "left_anti")
    loose = loose.join(covered("effect_without_intent"), "id", "left_anti").select(F.lit("effect without a known intent and without a gap").alias("problem"), "id")
    known = effects.join(pres, "intent")
    first = known.groupBy("intent").agg(F.min("idx").alias("first"))
    known = known.join(first, "intent")
    twice = known.where("idx > first").select(F.lit("intent closed twice").alias("problem"), "id")
    crossed = known.where("idx = first").where((F.col("pre_correlation.linkedEffectId") != F.col("id")) | (F.col("correlation.linkedIntentId") != F.col("intent"))).select(F.lit("links and payload disagree").alias("problem"), "id")
    open_ = pres.where(F.col("source") == HOOKED).join(known.select("intent"), "intent", "left_anti").withColumnRenamed("intent", "id")
    open_ = open_.join(covered("intent_without_effect"), "id", "left_anti").select(F.lit("intent without an effect and without a gap").alias("problem"), "id")
    return loose.union(twice).union(crossed).union(open_)


def check_intent_effect(b: Bundle) -> list:
    if not b.events.where("type = 'tool_call_effect'").limit(1).count():
        return [("intent-effect", SKIPPED, "no effects in this bundle")]
    bad = _some(intent_effect_problems(b.events), "problems", "problem", "id")
    return [("intent-effect", *(bad or (PASS, "every intent has its effect or a gap, and every effect its intent")))]


def continuity_problems(e: DataFrame) -> DataFrame:
    """File changes that no event witnessed and no gap tells of."""
    files = lambda name: F.from_json(F.get_json_object("payload", f"$.{name}"), "array<struct<path: string, preSha256: string, postSha256: string>>")
    own = F.lit("all").alias("session")
    wrote = e.where("type = 'tool_call_effect'").select(own, "idx", "id", F.explode(files("files")).alias("f"))
    read = e.where("type = 'shell_command_pre'").select(own, "idx", "id", F.explode(files("fileArgs")).alias("f"))
    broken = file_breaks(
        wrote.select("session", F.col("f.path").alias("path"), F.col("idx").alias("seq"), F.col("f.postSha256").alias("post_hash"), F.col("id").alias("event_id")),
        read.select("session", F.col("f.path").alias("path"), F.col("idx").alias("seq"), F.col("f.preSha256").alias("pre_hash"), F.col("id").alias("event_id")),
    )
    told = _gap_names(e).where("reason = 'unwitnessed_file_change'").select(F.col("id").alias("event_id"))
    return broken.join(told, "event_id", "left_anti").select("event_id", "path")


def check_continuity(b: Bundle) -> list:
    if not b.events.where("type = 'tool_call_effect'").limit(1).count():
        return [("file-continuity", SKIPPED, "no effects in this bundle")]
    bad = _some(continuity_problems(b.events), "unwitnessed changes without a gap", "path", "event_id")
    return [("file-continuity", *(bad or (PASS, "no file changed unseen between two events")))]


def _tree(e: DataFrame) -> DataFrame:
    return e.select(F.lit(0).alias("session"), "idx", integrity.leaf(F.unhex("chain_hash")).alias("hash"))


def check_merkle(b: Bundle) -> list:
    stated = b.manifest.get("merkleRoot")
    if not stated:
        return [("merkle-root", WARN, "the manifest states no Merkle root")]
    found = integrity.merkle_roots(_tree(b.events), ["session"]).first()
    root = found.merkle_root if found else integrity.EMPTY_ROOT
    return [("merkle-root", PASS if root == stated else FAIL, f"the events give {root}")]


_PLACES = array(struct(path=STRING, digest=STRING))


@F.pandas_udf(_PLACES)
def _placeholders(payload: pd.Series) -> pd.Series:
    def found(text):
        body = json.loads(text) if text else None
        if not isinstance(body, dict):
            return []
        return [{"path": f"/{k}", "digest": v[PLACEHOLDER]} for k, v in body.items() if isinstance(v, dict) and list(v) == [PLACEHOLDER] and isinstance(v[PLACEHOLDER], str)]

    return payload.map(found)


def opening_states(spark: SparkSession, e: DataFrame, openings: list[dict]) -> DataFrame:
    """(event_id, path, state) of every placeholder and opening."""
    places = e.select("id", F.explode(_placeholders("payload")).alias("p")).select(F.col("id").alias("event_id"), F.col("p.path").alias("path"), F.col("p.digest").alias("digest"))
    rows = [(o["eventId"], o["path"], o["salt"], jcs.canonical(o["value"])) for o in openings]
    opened = spark.createDataFrame(rows, "event_id string, path string, salt string, value string")
    return integrity.opening_report(places, opened, integrity.commitment(F.col("salt"), F.col("path"), F.col("value")))


def check_commitments(b: Bundle, complete: bool = True) -> list:
    held = b.json("commitments.json")
    states = opening_states(b.spark, b.events, (held or {}).get("openings", []))
    wrong = states.where("state <> 'ok'" if complete else "state in ('orphan', 'mismatch')")
    bad = _some(wrong, "openings are missing or wrong", "state", "event_id", "path")
    return [("commitments", *(bad or (PASS, "every commitment opens to its value" if complete else "every opening fits its commitment")))]


def check_timestamps(b: Bundle) -> list:
    stamps = b.manifest.get("timestamps") or []
    if not stamps:
        return [("timestamp-verify", SKIPPED, "no timestamps"), ("timestamp-backdating", SKIPPED, "no timestamps")]
    want, problems, times = hashlib.sha256(signing_form(b.manifest).encode()).hexdigest(), [], []
    for n, stamp in enumerate(stamps):
        try:
            info = crypto.timestamp_info(base64.b64decode(stamp["tokenBase64"]))
            times.append(info["time"])
            if info["imprint"] != want:
                problems.append(f"timestamp {n} is over something else")
        except (ValueError, KeyError, IndexError, StopIteration) as e:
            problems.append(f"timestamp {n} cannot be read: {e}")
    produced = datetime.fromisoformat(b.manifest["producedAt"])
    late = [t for t in times if produced > t + timedelta(seconds=1)]
    # whoever made a token is not known here: its signature and certificates are not checked, so none passes
    return [("timestamp-verify", FAIL if problems else WARN, _shown(problems) or "every timestamp is over this manifest; their signatures are not checked"), ("timestamp-backdating", FAIL if late else PASS, "produced after its timestamp" if late else "produced before its timestamps")]


def check_anchor(b: Bundle) -> list:
    if b.manifest["producer"]["mode"] == "dev-unsigned":
        return [("anchor-status", SKIPPED, "dev-unsigned")]
    anchor = b.json("anchor.json")
    if b.manifest.get("timestamps"):
        return [("anchor-status", PASS, "dated when it was sealed")]
    if anchor is None:
        return [("anchor-status", WARN, "sealed without a timestamp and not anchored since")]
    want = hashlib.sha256(signing_form(b.manifest).encode()).hexdigest()
    body = {k: v for k, v in anchor.items() if k not in ("publicKey", "signature")}
    try:
        own = crypto.fingerprint(anchor["publicKey"]) == b.manifest["producer"].get("keyFingerprint")
        signed = crypto.verify(b.spark, anchor["publicKey"], jcs.canonical(body).encode(), base64.b64decode(anchor["signature"]))
        dated = anchor.get("tokenBase64") is None or crypto.timestamp_info(base64.b64decode(anchor["tokenBase64"]))["imprint"] == want
    except (ValueError, KeyError, IndexError, StopIteration) as e:
        return [("anchor-status", FAIL, f"the anchor cannot be read: {e}")]
    good = anchor.get("manifestHash") == want and own and signed and dated
    if good and anchor.get("tokenBase64"):
        return [("anchor-status", WARN, "anchored later, by a timestamp whose signature is not checked")]
    return [("anchor-status", PASS if good else FAIL, "anchored later" if good else f"manifest {anchor.get('manifestHash') == want}, key {own}, signature {signed}, token {dated}")]


def check_artifacts(b: Bundle) -> list:
    out = []
    for name, file, stated in (("artifact-events-jsonl", "events.jsonl", "eventsJsonlSha256"), ("ruleset-integrity", "rules/destructive.yaml", "rulesetHash")):
        own = b.digest(file)
        out.append((name, PASS if own is not None and own == b.manifest.get(stated) else FAIL, f"{file}: {own}"))
    return out


def tree_bytes(spark: SparkSession, root: Path) -> DataFrame:
    """path, bytes, sha256 of the files of a folder that a files map would list."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root))
    name = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), "^[a-z]+:/*", "/")
    rows = found.select(F.substring_index(name, str(root.resolve()) + "/", -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return rows.where(~F.col("path").isin(*UNMAPPED) & ~F.startswith("path", F.lit(UNMAPPED_BELOW)))


def check_files(b: Bundle, only: list[str] | None = None) -> list:
    name = "files-map" if only is None else "disclosure-files"
    listed = b.manifest.get("files")
    if listed is None:
        return [(name, WARN, "the manifest has no files map")]
    try:
        for path in listed:
            safe_path(path)
    except ValueError as e:
        return [(name, FAIL, str(e))]
    if any(f.is_symlink() for f in b.path.rglob("*")):
        return [(name, FAIL, "there is a symbolic link in the folder")]
    rows = [(k, f"{v['sha256']}:{v['bytes']}") for k, v in listed.items() if only is None or k in only]
    want = b.spark.createDataFrame(rows, "path string, digest string")
    have = tree_bytes(b.spark, b.path).select("path", F.concat_ws(":", "sha256", "bytes").alias("digest"))
    if only is not None:
        have = have.where(F.col("path").isin(*only)) if only else have.limit(0)
    from ledgerline.plans.relational import file_diff

    bad = _some(file_diff(want, have).where("state <> 'same'"), "files differ from the map", "state", "path")
    return [(name, *(bad or (PASS, f"{len(rows)} files are as listed")))]


def check_attestations(b: Bundle) -> list:
    """Signature blocks by position and tokens by name are those of the manifest, and no others."""
    problems, folder = [], b.path / UNMAPPED_BELOW
    held = b.json("attestations/signatures.json")
    if not isinstance(held, dict) or held.get("blocks") != (b.manifest.get("signatures") or []):
        problems.append("signatures.json is not what the manifest holds")
    wanted = {f"{n}.tsr": t.get("tokenBase64", "") for n, t in enumerate(b.manifest.get("timestamps") or [])}
    found = {f.name for f in folder.iterdir() if f.is_file()} if folder.is_dir() else set()
    for name, token in wanted.items():
        if name not in found:
            problems.append(f"{name} is missing")
        elif base64.b64encode((folder / name).read_bytes()).decode() != token:
            problems.append(f"{name} is not the manifest's token")
    problems += [f"{name} is named by nothing" for name in sorted(found - set(wanted) - {"anchor.tsr"})]
    return [("attestation-files", FAIL if problems else PASS, _shown(problems) or "files and manifest agree")]


def check_complete(b: Bundle) -> list:
    missing = [p for p in REQUIRED if not (b.path / p).exists()]
    return [("bundle-completeness", FAIL if missing else PASS, f"missing: {missing}" if missing else "every part is there")]


#: The order of the checks, and whether a failure makes the rest meaningless.
ORDER: tuple[tuple[Check, bool], ...] = (
    (check_schema, True),
    (check_mode, True),
    (check_contract, False),
    (check_identity, False),
    (check_signatures, True),
    (check_chain, False),
    (check_intent_effect, False),
    (check_continuity, False),
    (check_merkle, False),
    (check_commitments, False),
    (check_timestamps, False),
    (check_anchor, False),
    (check_artifacts, False),
    (check_files, False),
    (check_attestations, False),
    (check_complete, False),
)


def run(b: Bundle, order: tuple[tuple[Check, bool], ...]) -> list[tuple[str, str, str]]:
    out: list[tuple[str, str, str]] = []
    try:
        b.manifest = json.loads((b.path / "manifest.json").read_text())
        if not isinstance(b.manifest, dict) or not isinstance(b.manifest.get("producer"), dict):
            raise ValueError("not a manifest")
        out.append(("manifest-parse", PASS, "the manifest can be read"))
    except (OSError, ValueError) as e:
        return [("manifest-parse", FAIL, str(e)[:200])]
    for check, stops in order:
        rows = check(b)
        out += rows
        if stops and any(r[1] == FAIL for r in rows):
            return [*out, ("remaining-checks", SKIPPED, f"not run: {rows[-1][0]} failed")]
    return out


def verify_bundle(spark: SparkSession, path: str, pin: str | None = None, revoked: list[dict] | None = None) -> DataFrame:
    """ord, name, status, detail of every check of a bundle."""
    found = run(Bundle(spark, path, pin, revoked), ORDER)
    return spark.createDataFrame([(n, *r) for n, r in enumerate(found)], RESULT)


def passed(checks: DataFrame) -> bool:
    return not checks.where(F.col("status") == FAIL).limit(1).count()


def report(checks: DataFrame) -> str:
    """The checks as text, ending in the verdict."""
    rows = checks.orderBy("ord").collect()
    verdict = "FAIL" if any(r.status == FAIL for r in rows) else "PASS"
    return "\n".join([*(f"{r.status:8}{r.name}: {r.detail}" for r in rows), verdict])


# --- disclosures -------------------------------------------------------------------------


def _disclosure(b: Bundle) -> dict:
    return b.json("disclosure.json") or {}


def check_disclosure_parse(b: Bundle) -> list:
    """Disclosed and withheld positions part 0..n-1, and the signed manifest agrees."""
    d = _disclosure(b)
    try:
        n = d["leafCount"]
        places = [x["index"] for x in d["disclosed"]] + [x["index"] for x in d["withheld"]]
        good = sorted(places) == list(range(n)) and d["merkleRoot"] == b.manifest.get("merkleRoot") and d["bundleId"] == b.manifest.get("bundleId") and n == b.manifest["counts"]["events"]
    except (KeyError, TypeError) as e:
        return [("disclosure-parse", FAIL, f"missing {e}")]
    return [("disclosure-parse", PASS if good else FAIL, f"{len(places)} of {n} positions")]


def _proofs(b: Bundle, kind: str) -> DataFrame:
    d = _disclosure(b)
    n = d["leafCount"]

    def sides(index: int, path: list[str]) -> list[tuple[str, bool]] | None:
        out, own, width, steps = [], index, n, iter(path)
        while width > 1:
            if own ^ 1 < width:
                if (h := next(steps, None)) is None:
                    return None
                out.append((h, own & 1 == 1))
            own, width = own >> 1, (width + 1) >> 1
        return out if next(steps, None) is None else None

    rows = [(x["index"], x.get("eventId"), x.get("chainHash"), sides(x["index"], x["auditPath"])) for x in d[kind]]
    return b.spark.createDataFrame(rows, "idx long, id string, withheld string, path array<struct<hash: string, left: boolean>>")


def check_inclusion(b: Bundle) -> list:
    """Payloads, links from the position before, and audit paths of all positions."""
    shown = _proofs(b, "disclosed").select("idx", "id", "path")
    rows = b.events.drop("idx").join(shown, "id", "full_outer")
    lost = rows.where("idx is null or line is null")
    if bad := _some(lost, "events and proofs do not pair up", "id"):
        return [("disclosure-inclusion", *bad)]
    rows = rows.withColumn("metadata", event_metadata())
    wrong = rows.where(~F.sha2(F.col("payload").cast("binary"), 256).eqNullSafe(F.col("payload_hash")))
    hidden = _proofs(b, "withheld").select("idx", F.col("withheld").alias("chain_hash"), "path")
    every = rows.select("idx", "chain_hash", "path", "payload_hash", "metadata").unionByName(hidden, allowMissingColumns=True).withColumn("all", F.lit(0))
    unproven = every.where(F.col("path").isNull() | (integrity.proven_root(integrity.leaf(F.unhex("chain_hash")), F.col("path")) != b.manifest["merkleRoot"]))
    # withheld rows keep their hash but cannot be recomputed
    breaks = integrity.chain_breaks(every, ["all"], "idx").where("metadata is not null")
    for frame, what in ((wrong, "payloads do not have their hash"), (unproven, "positions are not proven"), (breaks, "events do not follow from the position before")):
        if bad := _some(frame, what, "idx"):
            return [("disclosure-inclusion", *bad)]
    return [("disclosure-inclusion", PASS, "every position is proven")]


def check_consistency(b: Bundle) -> list:
    """Whether the tree grew from the one of an earlier disclosure, where one is named."""
    d = _disclosure(b)
    c = d.get("consistency")
    if c is None:
        return [("tree-consistency", SKIPPED, "no earlier disclosure is named")]
    good = consistent(bytes.fromhex(c["merkleRoot"]), c["leafCount"], bytes.fromhex(d["merkleRoot"]), d["leafCount"], [bytes.fromhex(h) for h in c["proof"]])
    return [("tree-consistency", PASS if good else FAIL, f"from {c['leafCount']} to {d['leafCount']} leaves")]


def check_disclosure_openings(b: Bundle) -> list:
    ((_, status, detail),) = check_commitments(b, complete=False)
    return [("disclosure-commitments", status, detail)]


def check_disclosure_files(b: Bundle) -> list:
    return check_files(b, _disclosure(b).get("includedFiles") or [])


DISCLOSURE_ORDER: tuple[tuple[Check, bool], ...] = (
    (check_schema, True),
    (check_mode, True),
    (check_contract, False),
    (check_identity, False),
    (check_signatures, True),
    (check_disclosure_parse, True),
    (check_inclusion, False),
    (check_disclosure_openings, False),
    (check_disclosure_files, False),
    (check_consistency, False),
    (check_timestamps, False),
    (check_anchor, False),
)


def verify_disclosure(spark: SparkSession, path: str, pin: str | None = None, revoked: list[dict] | None = None) -> DataFrame:
    found = run(Bundle(spark, path, pin, revoked), DISCLOSURE_ORDER)
    return spark.createDataFrame([(n, *r) for n, r in enumerate(found)], RESULT)


def verify_any(spark: SparkSession, path: str, **more) -> DataFrame:
    """A disclosure where there is a disclosure document, else a bundle."""
    return (verify_disclosure if (Path(path) / "disclosure.json").exists() else verify_bundle)(spark, path, **more)


# --- consistency of two trees ------------------------------------------------------------


def _h(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def root_of(hashes: list[bytes]) -> bytes:
    """Root over leaf hashes, on the driver."""
    if not hashes:
        return _h()
    while len(hashes) > 1:
        hashes = [_h(b"\1", *hashes[i : i + 2]) if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
    return hashes[0]


def _split(n: int) -> int:
    return 1 << ((n - 1).bit_length() - 1)


def consistency_proof(hashes: list[bytes], m: int, whole: bool = True) -> list[bytes]:
    """Nodes that show the first m leaves to be a prefix of all of them."""
    n = len(hashes)
    if not 0 < m <= n:
        raise ValueError("no such prefix")
    if m == n:
        return [] if whole else [root_of(hashes)]
    k = _split(n)
    if m <= k:
        return [*consistency_proof(hashes[:k], m, whole), root_of(hashes[k:])]
    return [*consistency_proof(hashes[k:], m - k, False), root_of(hashes[:k])]


def consistent(old_root: bytes, m: int, new_root: bytes, n: int, proof: list[bytes]) -> bool:
    """Whether a tree of n leaves grew from one of m with these roots."""
    if not 0 < m <= n:
        return False
    if m == n:
        return old_root == new_root and not proof
    steps = iter([old_root, *proof] if m & (m - 1) == 0 else proof)
    at, last = m - 1, n - 1
    while at & 1:
        at, last = at >> 1, last >> 1
    try:
        old = new = next(steps)
        while last:
            if at & 1 or at == last:
                node = next(steps)
                old, new = _h(b"\1", node, old), _h(b"\1", node, new)
                while not at & 1 and at:
                    at, last = at >> 1, last >> 1
            else:
                new = _h(b"\1", new, next(steps))
            at, last = at >> 1, last >> 1
    except StopIteration:
        return False
    return old == old_root and new == new_root and next(steps, None) is None


def disclosed_overlap(one: DataFrame, other: DataFrame) -> DataFrame:
    """Positions that two disclosures show with different bytes. Inputs: idx, line."""
    return one.select("idx", F.col("line").alias("a")).join(other.select("idx", F.col("line").alias("b")), "idx").where("a <> b").select("idx")
