"""Canonical JSON (RFC 8785): sorted keys, minimal escapes, ECMAScript numbers."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F

from ledgerline.functions.shapes import STRING

_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_ESCAPES |= {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in _ESCAPES}
_TABLE = str.maketrans(_ESCAPES)


def number(x: float | int) -> str:
    """A number as ECMAScript prints it; integers beyond 2**53 lose digits like any double."""
    if isinstance(x, int) and abs(x) <= 2**53:
        return str(x)
    try:
        x = float(x)
    except OverflowError:
        x = math.inf
    if not math.isfinite(x):
        raise ValueError("JSON has no such number")
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0") or "0"
    if len(digits) <= point <= 21:
        out = digits + "0" * (point - len(digits))
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        tail = f".{digits[1:]}" if len(digits) > 1 else ""
        out = f"{digits[0]}{tail}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" + out if x < 0 else out


def _utf16(key: str) -> bytes:
    return key.encode("utf-16-be", "surrogatepass")


def canonical(value: object) -> str:
    """The canonical text of a JSON value."""
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, str):
        return f'"{value.translate(_TABLE)}"'
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=_utf16)) + "}"
    return "[" + ",".join(map(canonical, value)) + "]"


def _refused(name: str) -> float:
    raise ValueError(f"{name} is not JSON")


def parse(text: str) -> object:
    return json.loads(text, parse_constant=_refused)


def canonical_text(text: str | None) -> str | None:
    """Canonical form of JSON text; null where the text is null or no JSON."""
    if text is None:
        return None
    try:
        return canonical(parse(text))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(STRING)
def jcs(text: pd.Series) -> pd.Series:
    return text.map(canonical_text, na_action="ignore")
