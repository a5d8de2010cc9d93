"""IP address features, written on text and octet arithmetic so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import IP_FLAGS, RISK_FLAGS
from .common import as_int, total
from .text import entropy

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"({_OCTET}\.){{3}}{_OCTET}"
_GROUP = r"[0-9A-Fa-f]{1,4}"


def _v6_pattern() -> str:
    """All spellings of an IPv6 address: eight groups, or fewer around one '::'.

    A dotted IPv4 tail stands for the last two groups.
    """
    forms = [rf"({_GROUP}:){{7}}{_GROUP}", rf"({_GROUP}:){{6}}{_V4}"]
    for left in range(8):
        head = "" if left == 0 else rf"{_GROUP}(:{_GROUP}){{{left - 1}}}"
        right = 7 - left
        if right:
            forms.append(rf"{head}::({_GROUP}(:{_GROUP}){{0,{right - 1}}})?")
        else:
            forms.append(rf"{head}::")
        if right >= 2:
            forms.append(rf"{head}::({_GROUP}:){{0,{right - 2}}}{_V4}")
    return "^(" + "|".join(forms) + r")(%[^%/\s]+)?$"


V4_PATTERN = f"^{_V4}$"
V6_PATTERN = _v6_pattern()

# IANA special-purpose IPv4 blocks that count as private (base, prefix length).
PRIVATE_V4 = [
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("240.0.0.0", 4),
]
# Global exceptions inside 192.0.0.0/24.
PUBLIC_V4 = [("192.0.0.9", 32), ("192.0.0.10", 32)]
# IANA special-purpose IPv6 blocks that count as private.
PRIVATE_V6 = [
    ("::", 128),
    ("::1", 128),
    ("64:ff9b:1::", 48),
    ("100::", 64),
    ("2001::", 23),
    ("2001:db8::", 32),
    ("2002::", 16),
    ("fc00::", 7),
    ("fe80::", 10),
]
# Global exceptions inside 2001::/23.
PUBLIC_V6 = [
    ("2001:1::1", 128),
    ("2001:1::2", 128),
    ("2001:3::", 32),
    ("2001:4:112::", 48),
    ("2001:20::", 28),
    ("2001:30::", 28),
]


def ip_type(ip: Column) -> Column:
    """ipv4 / ipv6 / invalid by the full grammar."""
    return (
        F.when(ip.rlike(V4_PATTERN), "ipv4").when(ip.rlike(V6_PATTERN), "ipv6").otherwise("invalid")
    )


def ip_type_loose(ip: Column) -> Column:
    """ipv6 if it has a colon, else ipv4 if it has a dot, else unknown."""
    return F.when(ip.contains(":"), "ipv6").when(ip.contains("."), "ipv4").otherwise("unknown")


def network_class(ip: Column) -> Column:
    """Classful network letter of an IPv4 address."""
    first = F.when(ip.rlike(V4_PATTERN), F.split_part(ip, F.lit("."), F.lit(1)).cast("int"))
    return (
        F.when(first.isNull(), "Unknown")
        .when(first <= 127, "A")
        .when(first <= 191, "B")
        .when(first <= 223, "C")
        .otherwise("Other")
    )


def _number(ip: str) -> str:
    """SQL of an IPv4 text as a 32-bit number."""
    part = lambda i: f"try_cast(split_part({ip}, '.', {i}) AS BIGINT)"
    return f"(({part(1)} * 256 + {part(2)}) * 256 + {part(3)}) * 256 + {part(4)}"


def _hex(ip: str) -> str:
    """SQL of an IPv6 text as 32 hex digits: '::' filled with zeros, a dotted tail as two groups."""
    bare = f"split_part({ip}, '%', 1)"
    tail = f"regexp_extract({bare}, '([0-9]+[.][0-9.]+)$', 1)"
    low = f"lpad(hex({_number(tail)}), 8, '0')"
    text = (
        f"CASE WHEN {bare} NOT LIKE '%.%' THEN {bare} ELSE "
        f"concat(regexp_replace({bare}, '[0-9]+[.][0-9.]+$', ''), left({low}, 4), ':', right({low}, 4)) END"
    )
    side = lambda n: (
        f"array_join(transform(filter(split(split_part({text}, '::', {n}), ':'), g -> g <> ''), "
        "g -> lpad(lower(g), 4, '0')), '')"
    )
    head, back = side(1), side(2)
    return f"rpad({head}, 32 - length({back}), '0') || {back}"


def _v4_block(base: str, bits: int) -> tuple[int, int]:
    start = 0
    for part in base.split("."):
        start = start * 256 + int(part)
    return start, start + 2 ** (32 - bits) - 1


def _v6_block(base: str, bits: int) -> tuple[str, str]:
    left, _, right = base.partition("::")
    head = [g.zfill(4) for g in left.split(":") if g]
    back = [g.zfill(4) for g in right.split(":") if g]
    digits = "".join(head + ["0000"] * (8 - len(head) - len(back)) + back)
    start = int(digits, 16)
    return digits, f"{start + 2 ** (128 - bits) - 1:032x}"


def _inside(value: str, blocks: list[tuple]) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else f"{x}L"
    return "(" + " OR ".join(f"{value} BETWEEN {quote(a)} AND {quote(b)}" for a, b in blocks) + ")"


def _private_v4(number: str) -> str:
    inside = lambda blocks: _inside(number, [_v4_block(*b) for b in blocks])
    return f"({inside(PRIVATE_V4)} AND NOT {inside(PUBLIC_V4)})"


def add_private(df: DataFrame, ip: str = "ip", kind: str = "ip_type", name: str = "is_private_ip") -> DataFrame:
    """1 for private or reserved addresses of either family, 0 for the rest and for bad text.

    Addresses become numbers or fixed-width hex text first, so a block is one range test.
    """
    parsed = df.withColumns(
        {
            "_number": F.expr(f"CASE WHEN {kind} = 'ipv4' THEN {_number(ip)} END"),
            "_hex": F.expr(f"CASE WHEN {kind} = 'ipv6' THEN {_hex(ip)} END"),
        }
    )
    inside = lambda blocks: _inside("_hex", [_v6_block(*b) for b in blocks])
    mapped = "CAST(conv(right(_hex, 8), 16, 10) AS BIGINT)"
    verdict = f"""CASE WHEN _number IS NOT NULL THEN int({_private_v4('_number')})
        WHEN _hex LIKE '00000000000000000000ffff%' THEN int({_private_v4(mapped)})
        WHEN _hex IS NOT NULL THEN int({inside(PRIVATE_V6)} AND NOT {inside(PUBLIC_V6)}) ELSE 0 END"""
    return parsed.withColumn(name, F.expr(verdict)).drop("_number", "_hex")


def flag_totals() -> dict[str, Column]:
    """Eight-flag total and its share of eight."""
    flags = total(as_int(F.col(c)) for c in IP_FLAGS)
    return {"total_ip_flags": flags, "ip_risk_score": flags / F.lit(float(len(IP_FLAGS)))}


def risk_points() -> Column:
    """Seven-flag count (hosting service left out)."""
    return total(as_int(F.col(c)) for c in RISK_FLAGS)


def add_address(df: DataFrame) -> DataFrame:
    ip = F.col("ip")
    return df.withColumn("ip_type", ip_type(ip)).transform(add_private).withColumns(
        {
            "ip_family": ip_type_loose(ip),
            "ip_network_class": network_class(ip),
            "ip_country_match": F.lit(1),
            "ip_entropy": entropy(ip),
            **flag_totals(),
            "ip_risk_points": risk_points(),
            "is_high_risk_ip": risk_points() >= 2,
        }
    )
