"""Rulesets and key catalogs: small documents that the driver parses."""

from __future__ import annotations

import json
from pathlib import Path

from ledgerline.operators.rules import SEVERITIES

#: Fixed value: payload fields that may never be committed away.
NEVER_DISCLOSABLE = frozenset(("toolName", "kind", "reason"))


def parse_ruleset(text: str | None) -> dict:
    """rules (in the shape of DEFAULT_RULES), disclosable and tsa; no text gives an empty set.

    A rule without id, severity or matcher is left out; an unknown severity is medium.
    """
    import yaml

    found = yaml.safe_load(text) if text else None
    found = found if isinstance(found, dict) else {}
    rules = []
    for rule in found.get("rules") or []:
        if not isinstance(rule, dict) or not rule.get("id") or not rule.get("severity") or not isinstance(rule.get("matcher"), dict):
            continue
        m = rule["matcher"]
        listed = lambda k: [str(x) for x in m[k]] if isinstance(m.get(k), list) else None  # noqa: B023, E731
        text_of = lambda k: m[k] if isinstance(m.get(k), str) else None  # noqa: B023, E731
        severity = rule["severity"] if rule["severity"] in SEVERITIES else "medium"
        rules.append((rule["id"], severity, listed("argvHead"), listed("argvContainsAny"), text_of("anyArgvRegex"), text_of("stdinRegex")))
    tsa = [t for t in found.get("tsa") or [] if isinstance(t, dict) and t.get("name") and t.get("url")]
    return {"rules": rules, "disclosable": [str(x) for x in found.get("disclosable") or []], "tsa": tsa}


def ruleset_text(rules) -> str:
    """A ruleset that parse_ruleset() reads as these rules (JSON is YAML)."""
    names = ("argvHead", "argvContainsAny", "anyArgvRegex", "stdinRegex")
    listed = [{"id": r[0], "severity": r[1], "matcher": {k: v for k, v in zip(names, r[2:], strict=True) if v is not None}} for r in rules]
    return json.dumps({"version": 1, "rules": listed}, indent=1) + "\n"


def load_ruleset(path: str) -> dict:
    file = Path(path)
    return parse_ruleset(file.read_text() if file.exists() else None)


def parse_disclosable(spec: list[str]) -> dict[str, set[str]]:
    """`type.field` entries by event type; fields that must stay visible are refused."""
    out: dict[str, set[str]] = {}
    for entry in spec:
        kind, dot, name = entry.partition(".")
        if not dot or not kind or not name or name in NEVER_DISCLOSABLE:
            raise ValueError(f"cannot be disclosable: {entry}")
        out.setdefault(kind, set()).add(name)
    return out


def load_key_catalog(path: str) -> list[dict]:
    """Keys with their state; a missing file is an empty catalog, another version an error."""
    file = Path(path)
    if not file.exists():
        return []
    found = json.loads(file.read_text())
    if found.get("schemaVersion") != 1:
        raise ValueError("a key catalog of an unknown version")
    return found.get("keys", [])
