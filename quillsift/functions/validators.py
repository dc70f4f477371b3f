"""Checks that follow a pattern match, in plain Python for the cell kernel and as column expressions."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The dihedral group of the pentagon: products, and the permutation 1 5 7 6 2 8 3 0 9 4 applied i times. Both are built from their rules.
_TURN = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
PRODUCT = [[(a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
PERMUTED = [list(range(10))]
for _ in range(7):
    PERMUTED.append([_TURN[x] for x in PERMUTED[-1]])
_BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn(digits: str) -> bool:
    if not re.fullmatch("[0-9]+", digits):
        return False
    doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def verhoeff(digits: str) -> bool:
    if not re.fullmatch("[0-9]+", digits):
        return False
    c = 0
    for i, d in enumerate(reversed(digits)):
        c = PRODUCT[c][PERMUTED[i % 8][int(d)]]
    return c == 0


def gstin_check(head: str) -> str:
    """The check character of the first 14."""
    total = sum(v // 36 + v % 36 for v in (_BASE36.index(c) * (1 + i % 2) for i, c in enumerate(head)))
    return _BASE36[-total % 36]


def gstin(text: str) -> bool:
    text = text.strip().upper()
    return bool(re.fullmatch("[0-9A-Z]{15}", text)) and gstin_check(text[:14]) == text[14]


def ip(text: str) -> bool:
    """A match with a dot goes the IPv4 way (a port may follow; mapped addresses pass); others must be IPv6 and not mapped."""
    if "." in text:
        host = text.rsplit(":", 1)[0] if text.count(":") == 1 else text
        try:
            return bool(ipaddress.ip_address(host))
        except ValueError:
            return False
    try:
        return "%" not in text and ipaddress.IPv6Address(text).ipv4_mapped is None
    except ValueError:
        return False


def mac(text: str) -> bool:
    """Six to twenty octets by one of : and -, or groups of four by dots."""
    return bool(re.fullmatch(r"[0-9a-f]{2}([:-])(?:[0-9a-f]{2}\1){4}[0-9a-f]{2}|(?:[0-9a-f]{4}\.){2}[0-9a-f]{4}", text, re.I))


# --- as column expressions ---


def luhn_expr(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False)) & digits.rlike("^[0-9]+$")


def _lookup(table: list, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, table)), index + 1)


def verhoeff_expr(digits: Column) -> Column:
    flat = [x for row in PRODUCT for x in row]
    turns = [x for row in PERMUTED for x in row]
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    digit = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
    folded = F.aggregate(places, F.lit(0), lambda c, i: _lookup(flat, c * 10 + _lookup(turns, (i % 8) * 10 + digit(i))))
    return F.when(digits.rlike("^[0-9]+$"), folded == 0).otherwise(F.lit(False))


def gstin_expr(text: Column) -> Column:
    text = F.upper(F.trim(text))
    value = lambda i: F.position(F.substr(text, i + 1, F.lit(1)), F.lit(_BASE36)) - 1
    doubled = lambda i: value(i) * (i % 2 + 1)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(13)), F.lit(0), lambda s, i: s + F.floor(doubled(i) / 36).cast("int") + doubled(i) % 36)
    check = F.substr(F.lit(_BASE36), (36 - total % 36) % 36 + 1, F.lit(1))
    return F.when(text.rlike("^[0-9A-Z]{15}$"), F.substr(text, F.lit(15), F.lit(1)) == check).otherwise(F.lit(False))


def ipv4_expr(text: Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return text.rlike(rf"^{octet}(\.{octet}){{3}}(:[0-9]+)?\z")


def ipv6_expr(text: Column) -> Column:
    """Eight groups of hexadecimal digits, or fewer with one gap; not an IPv4 address mapped into IPv6."""
    sides = F.split(F.lower(text), "::", -1)
    groups = lambda side: F.when(F.coalesce(side, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    n, gap = F.size(left) + F.size(right), F.size(sides) == 2
    hexes = F.forall(F.concat(left, right), lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
    whole = F.concat(left, F.array_repeat(F.lit("0"), 8 - n), right)
    mapped = F.forall(F.slice(whole, 1, 5), lambda g: g.rlike(r"^0+\z")) & (F.get(whole, F.lit(5)) == "ffff")
    return F.coalesce(hexes & (~gap & (F.size(sides) == 1) & (n == 8) | gap & (n <= 7)) & ~mapped, F.lit(False))


def ip_expr(text: Column) -> Column:
    """A match with a dot goes the IPv4 way (a port may follow; mapped addresses pass); others must be IPv6."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.when(F.contains(text, F.lit(".")), ipv4_expr(text) | text.rlike(rf"^::ffff:{octet}(\.{octet}){{3}}\z")).otherwise(ipv6_expr(text))


def mac_expr(text: Column) -> Column:
    return text.rlike(r"^(?i:[0-9a-f]{2}([:-])(?:[0-9a-f]{2}\1){4}[0-9a-f]{2}|(?:[0-9a-f]{4}\.){2}[0-9a-f]{4})\z")
