"""Bundles on disk: sealing a session, writing its parts, disclosing some of it, exports.

Rows are committed, chained and hashed as DataFrames. Only what is one document by nature
(manifest, signature, narrative) is put together on the driver. The manifest comes last,
so a folder without one is unfinished.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.functions import crypto, jcs
from ledgerline.functions.shapes import STRING, array, struct
from ledgerline.operators import integrity
from ledgerline.sources.events import payload_json

SCHEMA_VERSION = 3
ALGORITHM = "sha256(jcs([salt, path, value]))"
#: Paths that the files map never lists, and what a payload commits by default.
UNMAPPED = ("manifest.json", "attestations/signatures.json", "anchor.json")
UNMAPPED_BELOW = "attestations/rfc3161-timestamps/"
PLACEHOLDER = "$commitment"
COMMITTED = {"prompt": ("text",), "assistant_message": ("content",), "tool_call_intent": ("toolInput",), "tool_result": ("output",), "shell_command_pre": ("argv", "envSubset"), "tool_call_effect": (), "file_diff": ("diff",)}

_SEALED = struct(payload=STRING, payload_hash=STRING, openings=array(struct(path=STRING, salt=STRING, value=STRING)))


def _salt(seed: str, event_id: str, path: str) -> str:
    return hashlib.sha256(f"salt:{seed}:{event_id}:{path}".encode()).hexdigest()


def commit_fields(events: DataFrame, seed: str, fields: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """events with the listed payload fields replaced by commitments, plus `openings`.

    The seed is drawn once per bundle (random in production) and makes every retry equal.
    """
    chosen = COMMITTED if fields is None else fields

    @F.pandas_udf(_SEALED)
    def sealed(ids: pd.Series, kind: pd.Series, payload: pd.Series) -> pd.DataFrame:
        out = []
        for own, t, text in zip(ids, kind, payload, strict=True):
            body, openings = json.loads(text), []
            for name in chosen.get(t, ()):
                if name in body:
                    value, path = jcs.canonical(body[name]), f"/{name}"
                    salt = _salt(seed, own, path)
                    digest = hashlib.sha256(f"[{jcs.canonical(salt)},{jcs.canonical(path)},{value}]".encode("utf-8", "surrogatepass")).hexdigest()
                    body[name] = {PLACEHOLDER: digest}
                    openings.append({"path": path, "salt": salt, "value": value})
            out.append((*payload_json(body), openings))
        return pd.DataFrame(out, columns=["payload", "payload_hash", "openings"])

    made = events.withColumn("_s", sealed("id", "type", "payload"))
    return made.withColumns({"payload": F.col("_s.payload"), "payload_hash": F.col("_s.payload_hash"), "openings": F.col("_s.openings")}).drop("_s")


def event_metadata() -> Column:
    names = {"agentId": "agent", "id": "id", "monoNs": "mono", "parentEventId": "parent", "payloadHash": "payload_hash", "sessionId": "session", "type": "type", "wallTs": "wall_ts"}
    return integrity.metadata_json({k: F.col(v) for k, v in names.items()})


def seal(events: DataFrame) -> DataFrame:
    """events of one or many sessions with metadata and chain_hash, in the order of their ids."""
    return integrity.chain(events.withColumn("metadata", event_metadata()), ["session"], "id")


#: The links of an event line and the columns that hold them.
LINKS = (("linkedEffectId", "linked_effect"), ("linkedIntentId", "linked_intent"), ("linkedShellCommandPreId", "linked_pre"))


def event_line(links: bool = False) -> Column:
    """One event as a line of JSON, keys in the order in which events are written; with links where they were found."""
    text = lambda c: integrity.json_text(F.col(c).cast("string"))
    pairs = (("id", "id"), ("wallTs", "wall_ts"), ("monoNs", "mono"), ("sessionId", "session"), ("agentId", "agent"), ("parentEventId", "parent"), ("type", "type"))
    head = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), text(c)) for k, c in pairs])
    return F.concat(F.lit("{"), head, F.lit(',"payload":'), F.col("payload"), F.lit(',"payloadHash":'), text("payload_hash"), F.lit(',"chainHash":'), text("chain_hash"), _correlation() if links else F.lit(""), F.lit("}"))


def _correlation() -> Column:
    found = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{k}":'), integrity.json_text(F.col(c)))) for k, c in LINKS]
    return F.when(F.coalesce(*[F.col(c) for _, c in LINKS]).isNotNull(), F.concat(F.lit(',"correlation":{'), F.concat_ws(",", *found), F.lit("}"))).otherwise("")


def write_lines(rows: DataFrame, column: str, order: str, path: Path) -> None:
    """A column as one file in order; rows stream through the driver, they are not collected."""
    with path.open("w", encoding="utf-8", newline="") as out:
        for row in rows.select(order, column).orderBy(order).toLocalIterator(prefetchPartitions=True):
            out.write(row[1] + "\n")


def files_map(root: Path) -> dict[str, dict]:
    """path -> sha256, bytes of all files but the unmapped, keys in byte order; links are refused."""
    found = {}
    for file in root.rglob("*"):
        if file.is_symlink():
            raise ValueError(f"a symbolic link in the bundle: {file}")
        name = file.relative_to(root).as_posix()
        if file.is_file() and name not in UNMAPPED and not name.startswith(UNMAPPED_BELOW):
            with file.open("rb") as data:
                found[safe_path(name)] = {"sha256": hashlib.file_digest(data, "sha256").hexdigest(), "bytes": file.stat().st_size}
    return dict(sorted(found.items(), key=lambda x: x[0].encode()))


def safe_path(path: str) -> str:
    """A relative path that stays in the bundle; anything else is an error."""
    if not path or path.startswith("/") or re.match("[A-Za-z]:", path) or "\\" in path or any(p in ("", ".", "..") for p in path.split("/")):
        raise ValueError(f"not a safe relative path: {path!r}")
    return path


def signing_form(manifest: dict) -> str:
    """What is signed: the manifest without signatures, timestamps and anchor status."""
    plain = {k: v for k, v in manifest.items() if k != "anchorStatus"}
    return jcs.canonical(plain | {"signatures": [], "timestamps": []})


def counts(events: DataFrame, destructive: int, attributed: int = 0, excluded: int = 0) -> dict:
    row = events.agg(F.count("*").alias("events"), F.count_if(F.col("type") == "gap").alias("gaps"), F.count_if(F.col("type") == "file_diff").alias("diffs")).first()
    return {"events": row.events, "destructiveOperations": destructive, "gaps": row.gaps, "artifactsPre": row.diffs, "artifactsPost": row.diffs, "capturesAttributed": attributed, "capturesExcluded": excluded}


def leaves(sealed: DataFrame) -> DataFrame:
    """Merkle leaves (session, idx, hash) over the chain hashes as raw bytes."""
    place = F.row_number().over(W.partitionBy("session").orderBy("id")) - 1
    return sealed.select("session", place.alias("idx"), integrity.leaf(F.unhex("chain_hash")).alias("hash"))


def write_bundle(spark: SparkSession, events: DataFrame, root: str, *, bundle_id: str, produced_at: str, seed: str, ruleset: str = "version: 1\nrules: []\n", destructive: int = 0, attributed: int = 0, excluded: int = 0, private: bytes | None = None, public_pem: str | None = None, narrative: dict[str, str] | None = None, raw: dict[str, bytes] | None = None, fields: dict | None = None) -> dict:
    """Seal one session's events into a folder and return the manifest."""
    folder = Path(root)
    for sub in ("attestations", "rules", "raw"):
        (folder / sub).mkdir(parents=True, exist_ok=True)
    committed = commit_fields(events, seed, fields)
    sealed = seal(committed).cache()
    write_lines(sealed.withColumn("_line", event_line({c for _, c in LINKS} <= set(sealed.columns))), "_line", "id", folder / "events.jsonl")
    opened = sealed.select("id", F.explode("openings").alias("o")).orderBy("id", "o.path")
    openings = [{"eventId": r.id, "path": r.o.path, "salt": r.o.salt, "value": json.loads(r.o.value)} for r in opened.toLocalIterator()]
    (folder / "commitments.json").write_text(json.dumps({"schemaVersion": 1, "algorithm": ALGORITHM, "openings": openings}, ensure_ascii=False))
    (folder / "rules/destructive.yaml").write_text(ruleset)
    for name, text in (narrative or {}).items():
        (folder / name).write_text(text)
    for name, data in (raw or {}).items():
        file = folder / "raw" / safe_path(name)
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    last = sealed.agg(F.max_by("chain_hash", "id").alias("root"), F.min_by("session", "id").alias("session"), F.min_by("agent", "id").alias("agent"), F.min("wall_ts").alias("first"), F.max("wall_ts").alias("last")).first()
    tree = integrity.merkle_roots(leaves(sealed), ["session"]).first()
    mapped = files_map(folder)
    signed = private is not None
    manifest = {
        "schemaVersion": SCHEMA_VERSION,
        "bundleId": bundle_id,
        "producedAt": produced_at,
        "producer": {"tool": "ledgerline", "version": "0.1.0", "mode": "signed" if signed else "dev-unsigned", "host": None} | ({"keyFingerprint": crypto.fingerprint(public_pem)} if signed else {}),
        "session": {"agentId": last.agent, "sessionId": last.session, "startedAt": last.first, "endedAt": last.last, "host": None},
        "rootHash": last.root or "",
        "merkleRoot": tree.merkle_root if tree else integrity.EMPTY_ROOT,
        "eventsJsonlSha256": mapped["events.jsonl"]["sha256"],
        "files": mapped,
        "counts": counts(sealed, destructive, attributed, excluded),
        "rulesetHash": hashlib.sha256(ruleset.encode()).hexdigest(),
        "signatures": [],
        "timestamps": [],
    }
    if signed:
        signature = crypto.sign(spark, private, signing_form(manifest).encode())
        manifest["signatures"] = [{"scheme": "ed25519", "publicKey": public_pem, "signature": base64.b64encode(signature).decode(), "signedFields": "manifest.json"}]
        manifest["anchorStatus"] = "pending"
    (folder / "attestations/signatures.json").write_text(json.dumps({"blocks": manifest["signatures"]}))
    (folder / "manifest.json").write_text(jcs.canonical(manifest))
    sealed.unpersist()
    return manifest


def anchor(spark: SparkSession, root: str, token: bytes | None, at: str, private: bytes, public_pem: str, force: bool = False) -> dict:
    """Date a sealed bundle later: a countersigned statement over what was signed.

    An anchored bundle stays as it is unless forced. A token must be over the manifest.
    """
    folder = Path(root)
    if (folder / "anchor.json").exists() and not force:
        return json.loads((folder / "anchor.json").read_text())
    manifest = json.loads((folder / "manifest.json").read_text())
    digest = hashlib.sha256(signing_form(manifest).encode()).hexdigest()
    if token is not None and crypto.timestamp_info(token)["imprint"] != digest:
        raise ValueError("the timestamp is over something else")
    body = {"schemaVersion": 1, "bundleId": manifest["bundleId"], "manifestHash": digest, "anchoredAt": at, "tokenBase64": base64.b64encode(token).decode() if token else None}
    signature = crypto.sign(spark, private, jcs.canonical(body).encode())
    document = body | {"publicKey": public_pem, "signature": base64.b64encode(signature).decode()}
    (folder / "anchor.json").write_text(jcs.canonical(document))
    return document


# --- disclosure --------------------------------------------------------------------------


def selection(spec: str, ids: list[str]) -> list[int]:
    """Positions that `all`, ids, numbers and ranges name: distinct, in order, in range."""
    if spec == "all":
        return list(range(len(ids)))
    place, out = {x: i for i, x in enumerate(ids)}, set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        if part in place:
            out.add(place[part])
        elif m := re.fullmatch(r"(\d+)(?:-(\d+))?", part):
            a, b = int(m[1]), int(m[2] or m[1])
            if a > b or b >= len(ids):
                raise ValueError(f"no such events: {part}")
            out |= set(range(a, b + 1))
        else:
            raise ValueError(f"no such event: {part}")
    return sorted(out)


def field_selection(spec: str) -> str | set[str]:
    """`all`, `none` or a set of pointers to top-level fields."""
    if spec in ("all", "none"):
        return spec
    parts = {p.strip() for p in spec.split(",") if p.strip()}
    if not parts or any(not re.fullmatch("/[^/]+", p) for p in parts):
        raise ValueError(f"fields are all, none or pointers to top-level fields: {spec}")
    return parts


def disclose(spark: SparkSession, bundle: str, target: str, events: str, fields: str = "all", files: tuple[str, ...] = (), produced_at: str = "", earlier: dict | None = None) -> dict:
    """Write the chosen events of a bundle, byte for byte, with proofs for every position.

    earlier: a disclosure document of a shorter tree; the new one proves that it grew from it.
    """
    from ledgerline.plans.verify import consistency_proof, read_bundle, root_of

    source, out = Path(bundle), Path(target)
    manifest = json.loads((source / "manifest.json").read_text())
    rows = read_bundle(spark, bundle).cache()
    places = rows.select("idx", "id", "chain_hash").orderBy("idx").collect()  # one session's ids
    chosen = set(selection(events, [p.id for p in places]))
    shown = field_selection(fields)
    proofs = integrity.inclusion_proofs(rows.select(F.lit(0).alias("session"), "idx", integrity.leaf(F.unhex("chain_hash")).alias("hash")), ["session"])
    path = {r.idx: [s.hash for s in r.path] for r in proofs.select("idx", "path").toLocalIterator()}
    root = integrity.merkle_roots(rows.select(F.lit(0).alias("session"), "idx", integrity.leaf(F.unhex("chain_hash")).alias("hash")), ["session"]).first()
    if (root.merkle_root if root else integrity.EMPTY_ROOT) != manifest["merkleRoot"]:
        raise ValueError("the bundle does not have the Merkle root that its manifest states")
    (out / "attestations").mkdir(parents=True, exist_ok=True)
    picked = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted(chosen)], "idx long")), "idx", "left_semi")
    write_lines(picked, "line", "idx", out / "events.jsonl")
    held = json.loads((source / "commitments.json").read_text()) if (source / "commitments.json").exists() else {"schemaVersion": 1, "algorithm": ALGORITHM, "openings": []}
    own = {places[i].id for i in chosen}
    is_shown = lambda p: shown == "all" or (shown != "none" and p in shown)
    opened = [o for o in held["openings"] if o["eventId"] in own and is_shown(o["path"])]
    withheld = sorted({o["path"] for o in held["openings"] if o["eventId"] in own and not is_shown(o["path"])})
    (out / "commitments.json").write_text(json.dumps(held | {"openings": opened}, ensure_ascii=False))
    for name in files:
        if safe_path(name) not in manifest["files"]:
            raise ValueError(f"not in the bundle's files map: {name}")
        (out / name).parent.mkdir(parents=True, exist_ok=True)
        (out / name).write_bytes((source / name).read_bytes())
    (out / "manifest.json").write_bytes((source / "manifest.json").read_bytes())
    document = {
        "schemaVersion": 1,
        "bundleId": manifest["bundleId"],
        "merkleRoot": manifest["merkleRoot"],
        "leafCount": len(places),
        "producedAt": produced_at,
        "producer": {"tool": "ledgerline", "version": "0.1.0"},
        "disclosed": [{"index": i, "eventId": places[i].id, "auditPath": path[i]} for i in sorted(chosen)],
        "withheld": [{"index": p.idx, "chainHash": p.chain_hash, "auditPath": path[p.idx]} for p in places if p.idx not in chosen],
        "fields": {"disclosed": shown if isinstance(shown, str) else sorted(shown), "withheld": withheld},
        "includedFiles": sorted(files),
        "consistency": None,
    }
    if earlier is not None:
        hashes = [hashlib.sha256(b"\0" + bytes.fromhex(p.chain_hash)).digest() for p in places]
        m = earlier["leafCount"]
        if not 0 < m <= len(hashes) or root_of(hashes[:m]).hex() != earlier["merkleRoot"]:
            raise ValueError("the earlier disclosure is not of a prefix of this bundle")
        document["consistency"] = {"leafCount": m, "merkleRoot": earlier["merkleRoot"], "proof": [h.hex() for h in consistency_proof(hashes, m)]}
    (out / "disclosure.json").write_text(json.dumps(document, indent=2))
    rows.unpersist()
    return document
