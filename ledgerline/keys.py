"""The lifecycle of signing keys, as a small catalog document."""

from __future__ import annotations

import json
from pathlib import Path

from ledgerline.sources.rulesets import load_key_catalog

ACTIVE, ROTATED, REVOKED = "active", "rotated", "revoked"


def _saved(path: str, keys: list[dict]) -> list[dict]:
    Path(path).write_text(json.dumps({"schemaVersion": 1, "keys": keys}, indent=2))
    return keys


def added(path: str, fingerprint: str, at: str) -> list[dict]:
    """Record a key as active; one that is known already stays as it is."""
    keys = load_key_catalog(path)
    if all(k["fingerprint"] != fingerprint for k in keys):
        keys.append({"fingerprint": fingerprint, "status": ACTIVE, "createdAt": at})
    return _saved(path, keys)


def _changed(path: str, fingerprint: str, status: str, at: str, reason: str | None) -> list[dict]:
    keys = load_key_catalog(path)
    own = [k for k in keys if k["fingerprint"].lower() == fingerprint.lower()]
    if not own:
        raise KeyError(f"no such key: {fingerprint}")
    for key in own:
        if key["status"] != REVOKED:  # a revocation is final
            key |= {"status": status, f"{status}At": at} | ({"reason": reason} if reason else {})
    return _saved(path, keys)


def rotated(path: str, old: str, new: str, at: str) -> list[dict]:
    """Let a new key take over from an old one, which stays valid for what it signed."""
    _changed(path, old, ROTATED, at, None)
    return added(path, new, at)


def revoked(path: str, fingerprint: str, at: str, reason: str | None = None) -> list[dict]:
    return _changed(path, fingerprint, REVOKED, at, reason)
