"""Keys, weights and their rendering as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TUPLE

MASKS = {"src24": 0xFFFFFF00, "src16": 0xFFFF0000}
KINDS = ("src", "dst", "src24", "src16", "5tuple")


def key(kind: str) -> Column:
    if kind in MASKS:
        return F.col("src").bitwiseAND(F.lit(MASKS[kind]))
    if kind == "5tuple":
        return F.struct(*TUPLE)
    if kind in ("src", "dst"):
        return F.col(kind)
    raise ValueError(f"unknown key {kind!r}")


def weight(kind: str) -> Column:
    return F.col("len").cast("long") if kind == "bytes" else F.lit(1).cast("long")


def ipv4(c: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(c, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def render(c: Column, kind: str) -> Column:
    if kind == "5tuple":
        return F.concat(ipv4(c["src"]), F.lit(":"), c["sport"].cast("string"), F.lit("->"), ipv4(c["dst"]), F.lit(":"), c["dport"].cast("string"), F.lit("/"), c["proto"].cast("string"))
    return F.concat(ipv4(c), F.lit("/" + kind[3:])) if kind in MASKS else ipv4(c)


def parse_ipv4(text: str | int, kind: str = "src") -> int:
    """Dotted quad (strict) to a number, masked as the keys of ``kind`` are."""
    if kind == "5tuple":
        raise ValueError("a single address is no 5-tuple")
    n = text if isinstance(text, int) else int(ipaddress.IPv4Address(text))
    return n & MASKS.get(kind, 0xFFFFFFFF)


def parse_ipv4_column(c: Column) -> Column:
    """Dotted quads of a column to numbers; null where a part is missing or above 255."""
    parts = [F.regexp_extract(c, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})", i + 1) for i in range(4)]
    n = [F.when(p != "", p.cast("long")) for p in parts]
    total = n[0] * 16777216 + n[1] * 65536 + n[2] * 256 + n[3]
    return F.when((n[0] <= 255) & (n[1] <= 255) & (n[2] <= 255) & (n[3] <= 255), total)
