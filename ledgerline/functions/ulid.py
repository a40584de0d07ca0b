"""ULIDs in the standard layout: 48 bits of time, then 80 bits, in Crockford's base 32.

Ids are deterministic: the 80 bits come from a digest of what the row is made of. The
expressions are plain columns, so building ids stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Crockford's alphabet.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
PATTERN = f"^[0-7][{ALPHABET}]{{25}}$"


def _digits(value: Column, n: int) -> list[Column]:
    return [F.substring(F.lit(ALPHABET), (F.shiftright(value, 5 * i) % 32 + 1).cast("int"), F.lit(1)) for i in range(n - 1, -1, -1)]


def from_time(wall_ms: Column, *parts: Column) -> Column:
    """The ULID of a time in milliseconds with a tail hashed from parts; a null time counts as 0."""
    seed = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    half = lambda at: F.conv(F.substring(seed, at, 10), 16, 10).cast("long")
    time = F.greatest(F.coalesce(wall_ms.cast("long"), F.lit(0)), F.lit(0)).bitwiseAND(F.lit((1 << 48) - 1))
    return F.concat(*_digits(time, 10), *_digits(half(1), 8), *_digits(half(11), 8))


def is_valid(value: Column) -> Column:
    return F.coalesce(value.rlike(PATTERN), F.lit(False))


def to_time(value: Column) -> Column:
    """Milliseconds since the epoch; null where the text is no ULID."""
    total = F.lit(0).cast("long")
    for i in range(10):
        total = total * 32 + _place(value, i)
    return F.when(is_valid(value), total)


def _place(value: Column, i: int) -> Column:
    return (F.position(F.substring(value, i + 1, 1), F.lit(ALPHABET)) - 1).cast("long")


def encode(ms: int, tail: bytes) -> str:
    """The same on the driver: ms and ten bytes."""
    number = (ms << 80) | int.from_bytes(tail[:10], "big")
    return "".join(ALPHABET[number >> 5 * i & 31] for i in range(25, -1, -1))
