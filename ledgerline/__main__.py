"""python -m ledgerline reconstruct|package|verify|disclose|consistency|export|captures|key ..."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerline import keys
from ledgerline.functions import crypto
from ledgerline.operators import rules
from ledgerline.pipeline import load_and_merge
from ledgerline.plans import exports, verify
from ledgerline.plans.merge import commands_of
from ledgerline.sinks import COMMITTED, anchor, disclose, write_bundle
from ledgerline.sources import captures
from ledgerline.sources.files import read_files
from ledgerline.sources.rulesets import load_key_catalog, load_ruleset, parse_disclosable, parse_ruleset, ruleset_text


def _spark() -> SparkSession:
    return SparkSession.builder.appName("ledgerline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _session(spark: SparkSession, a: argparse.Namespace) -> dict:
    return load_and_merge(spark, a.session, agent_a=a.agent_a, agent_b=a.agent_b, shell_history=a.shell_history, reflog=a.reflog, store=a.store, include_unattributed=a.include_unattributed, window_ms=int(a.window * 1000))


def _found(spark: SparkSession, events, ruleset: str | None):
    table = rules.rule_table(spark, load_ruleset(ruleset)["rules"] if ruleset else rules.DEFAULT_RULES)
    return rules.destructive_index(rules.matches(rules.event_commands(commands_of(events)), table))


def reconstruct(spark: SparkSession, a: argparse.Namespace) -> int:
    events = _session(spark, a)["events"].cache()
    print(exports.text_report(events, _found(spark, events, a.rules)), end="")
    return 0


def package(spark: SparkSession, a: argparse.Namespace) -> int:
    session = _session(spark, a)
    events = session["events"].cache()
    n = _found(spark, events, a.rules).count()
    captured = [session[x].agg(F.sum("n")).first()[0] or 0 if x in session else 0 for x in ("inclusions", "exclusions")]
    key = json.loads(Path(a.key).read_text()) if a.key else None
    at = time.strftime("%Y-%m-%dT%H:%M:%S.000Z", time.gmtime())
    import secrets

    signing = {"private": bytes.fromhex(key["private"]), "public_pem": key["public"]} if key else {}
    # what is sealed is what the operations were counted by
    text = Path(a.rules).read_text() if a.rules else ruleset_text(rules.DEFAULT_RULES)
    fields = {k: set(v) for k, v in COMMITTED.items()}
    for kind, names in parse_disclosable(parse_ruleset(text)["disclosable"]).items():
        fields[kind] = fields.get(kind, set()) | names
    fields = {k: tuple(sorted(v)) for k, v in fields.items()}
    write_bundle(spark, events, a.out, bundle_id=a.session, produced_at=at, seed=secrets.token_hex(32), ruleset=text, destructive=n, attributed=captured[0], excluded=captured[1], fields=fields, narrative={"narrative.md": exports.markdown(events, a.session), "narrative.html": exports.html(events, a.session)}, **signing)
    return 0


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    found = verify.verify_any(spark, a.bundle, pin=a.pin, revoked=load_key_catalog(a.revocations) if a.revocations else None)
    print(verify.report(found) if not a.json else json.dumps([r.asDict() for r in found.orderBy("ord").collect()]))
    return 0 if verify.passed(found) else 1


def share(spark: SparkSession, a: argparse.Namespace) -> int:
    disclose(spark, a.bundle, a.out, a.events, a.fields, tuple(a.include or ()), time.strftime("%Y-%m-%dT%H:%M:%S.000Z", time.gmtime()), json.loads(Path(a.earlier).read_text()) if a.earlier else None)
    return 0


def date(spark: SparkSession, a: argparse.Namespace) -> int:
    key = json.loads(Path(a.key).read_text())
    token = Path(a.token).read_bytes() if a.token else None
    anchor(spark, a.bundle, token, time.strftime("%Y-%m-%dT%H:%M:%S.000Z", time.gmtime()), bytes.fromhex(key["private"]), key["public"], a.force)
    return 0


def consistency(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = verify.run(verify.Bundle(spark, a.disclosure), ((verify.check_consistency, False),))
    print("\n".join(f"{status:8}{name}: {detail}" for name, status, detail in rows))
    return int(any(r[1] == verify.FAIL for r in rows))


def catalog(spark: SparkSession, a: argparse.Namespace) -> int:
    at = time.strftime("%Y-%m-%dT%H:%M:%S.000Z", time.gmtime())
    if a.rotate:
        keys.rotated(a.catalog, *a.rotate, at)
    if a.revoke:
        keys.revoked(a.catalog, a.revoke, at, a.reason)
    print(json.dumps(load_key_catalog(a.catalog), indent=2))
    return 0


def export(spark: SparkSession, a: argparse.Namespace) -> int:
    events = verify.read_bundle(spark, a.bundle)
    if a.format == "actions":
        for row in exports.action_records(events, "ledgerline").orderBy("id").toLocalIterator():
            print(row.record)
        return 0
    key = json.loads(Path(a.key).read_text())
    private = bytes.fromhex(key["private"])
    if a.format == "receipts":
        manifest = json.loads((Path(a.bundle) / "manifest.json").read_text())
        print("\n".join(exports.sign_receipts(spark, exports.receipts(events, crypto.did_key(key["public"]), f"sha256:{manifest['rulesetHash']}"), private)))
    else:
        manifest = json.loads((Path(a.bundle) / "manifest.json").read_text())
        sys.stdout.buffer.write(exports.statement(spark, manifest, private, key["public"]))
    return 0


def store(spark: SparkSession, a: argparse.Namespace) -> int:
    files = read_files(spark, a.folder)
    if a.older_than:
        for row in captures.prunable(files, int(time.time() * 1000), captures.duration_ms(a.older_than)).toLocalIterator():
            print(row.path)
            if a.delete:
                Path(row.path.removeprefix("file://")).unlink(missing_ok=True)
        return 0
    print(json.dumps(captures.store_stats(files).first().asDict(), default=str))
    return 0


def new_key(spark: SparkSession, a: argparse.Namespace) -> int:
    public, private = crypto.new_key(spark)
    Path(a.out).write_text(json.dumps({"public": public, "private": private.hex()}))
    Path(a.out).chmod(0o600)
    print(crypto.fingerprint(public), crypto.did_key(public))
    return 0


def main(args: list[str]) -> int:
    top = argparse.ArgumentParser(prog="ledgerline", description=__doc__)
    sub = top.add_subparsers(required=True)
    sources = argparse.ArgumentParser(add_help=False)
    for name in ("--agent-a", "--agent-b", "--shell-history", "--reflog", "--store", "--rules"):
        sources.add_argument(name)
    sources.add_argument("--session", required=True)
    sources.add_argument("--window", type=float, default=5.0)
    sources.add_argument("--include-unattributed", action="store_true")
    one = sub.add_parser("reconstruct", parents=[sources])
    one.set_defaults(run=reconstruct)
    one = sub.add_parser("package", parents=[sources])
    one.add_argument("--out", required=True)
    one.add_argument("--key")
    one.set_defaults(run=package)
    one = sub.add_parser("verify")
    one.add_argument("bundle")
    one.add_argument("--pin")
    one.add_argument("--revocations")
    one.add_argument("--json", action="store_true")
    one.set_defaults(run=check)
    one = sub.add_parser("disclose")
    one.add_argument("bundle")
    one.add_argument("out")
    one.add_argument("--events", default="all")
    one.add_argument("--fields", default="all")
    one.add_argument("--include", nargs="*")
    one.add_argument("--earlier")
    one.set_defaults(run=share)
    one = sub.add_parser("anchor")
    one.add_argument("bundle")
    one.add_argument("--key", required=True)
    one.add_argument("--token")
    one.add_argument("--force", action="store_true")
    one.set_defaults(run=date)
    one = sub.add_parser("consistency")
    one.add_argument("disclosure")
    one.set_defaults(run=consistency)
    one = sub.add_parser("keys")
    one.add_argument("catalog")
    one.add_argument("--rotate", nargs=2, metavar=("OLD", "NEW"))
    one.add_argument("--revoke")
    one.add_argument("--reason")
    one.set_defaults(run=catalog)
    one = sub.add_parser("export")
    one.add_argument("bundle")
    one.add_argument("--format", choices=("actions", "receipts", "statement"), default="actions")
    one.add_argument("--key")
    one.set_defaults(run=export)
    one = sub.add_parser("captures")
    one.add_argument("folder")
    one.add_argument("--older-than")
    one.add_argument("--delete", action="store_true")
    one.set_defaults(run=store)
    one = sub.add_parser("key")
    one.add_argument("out")
    one.set_defaults(run=new_key)
    a = top.parse_args(args)
    if getattr(a, "run", None) in (reconstruct, package) and not (a.agent_a or a.agent_b):
        top.error("--agent-a or --agent-b is needed")
    return a.run(_spark(), a)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
