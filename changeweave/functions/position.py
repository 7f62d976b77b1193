"""Log positions: canonical text and unsigned 64-bit numbers of ``HEX/HEX`` positions and decimal ordinals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeweave.functions.scalars import sha

#: Halves are numbers below 2^32, with any number of leading zeros.
HALVES = r"^0*([0-9A-Fa-f]{1,8})/0*([0-9A-Fa-f]{1,8})$"
ORDINAL = r"^[0-9]+$"


def is_position(text: Column) -> Column:
    return text.rlike(HALVES) | text.rlike(ORDINAL)


def canonical(text: Column) -> Column:
    """Upper-case hex without leading zeros, or the ordinal without them; null for anything else."""
    bare = lambda s: F.coalesce(F.nullif(F.ltrim(s, F.lit("0")), F.lit("")), F.lit("0"))
    half = lambda i: bare(F.upper(F.regexp_extract(text, HALVES, i)))
    return F.when(text.rlike(HALVES), F.concat(half(1), F.lit("/"), half(2))).when(text.rlike(ORDINAL), bare(text))


def number(text: Column) -> Column:
    """The position as DECIMAL(20,0): unsigned 64 bits don't fit a BIGINT. Null for anything that isn't a position."""
    half = lambda i: F.conv(F.regexp_extract(text, HALVES, i), 16, 10).cast("decimal(20,0)")
    return F.when(text.rlike(HALVES), (half(1) * F.lit(4294967296).cast("decimal(20,0)") + half(2)).cast("decimal(20,0)")).when(text.rlike(ORDINAL), text.cast("decimal(20,0)"))


def text_of(n: Column) -> Column:
    """``HEX/HEX`` of a number below 2^63."""
    n = n.cast("long")
    return F.concat(F.hex(F.shiftrightunsigned(n, 32)), F.lit("/"), F.hex(n.bitwiseAND(F.lit(0xFFFFFFFF))))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either isn't a position or they are of different kinds."""
    same_kind = a.contains("/") == b.contains("/")
    x, y = number(a), number(b)
    return F.when(same_kind, F.when(x < y, -1).when(x > y, 1).when(x == y, 0))


def canonical_py(text: str) -> str:
    """The same on the driver; raises on anything that isn't a position."""
    parts = text.split("/")
    if len(parts) == 2 and all(p and len(p.lstrip("0")) <= 8 and all(c in "0123456789abcdefABCDEF" for c in p) for p in parts):
        return "/".join((p.lstrip("0") or "0").upper() for p in parts)
    if text.isascii() and text.isdigit():
        return text.lstrip("0") or "0"
    raise ValueError(f"not a log position: {text!r}")


def number_py(text: str) -> int:
    hi, _, lo = canonical_py(text).partition("/")
    return (int(hi, 16) << 32) | int(lo, 16) if lo else int(hi)


def checkpoint_id(entries: dict[str, Column]) -> Column:
    """Id of a checkpoint from its named entries, whatever their order."""
    return F.concat(F.lit("checkpoint:"), sha(*[c for name in sorted(entries) for c in (F.lit(name), entries[name])]))
