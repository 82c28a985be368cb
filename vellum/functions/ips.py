"""IP addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
#: Candidates for IPv4 addresses in text: dotted quads that are not part of a longer dotted number.
V4_IN_TEXT = r"(?<![0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9.])"
#: Candidates for IPv6 addresses in text, behind the prefix that mail servers write in brackets.
V6_IN_TEXT = r"(?i)(?:IPv6:)?(?<![0-9A-Za-z_])([0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}(?:\.[0-9]{1,3}){0,3})"


def is_ipv4(c: Column) -> Column:
    """A dotted quad without padded octets."""
    return F.coalesce(c.rlike(rf"\A{V4}\z"), F.lit(False))


def is_ipv6(c: Column) -> Column:
    """Eight groups of up to four digits, or at most seven around one '::'; a dotted quad at the end stands for two groups."""
    tail = F.element_at(F.split(c, ":"), -1)
    dotted = tail.contains(".")
    plain = F.when(dotted, F.concat(F.regexp_replace(c, r"[^:]*\z", ""), F.lit("0"))).otherwise(c)
    double = (F.length(plain) - F.length(F.replace(plain, F.lit("::"), F.lit("")))) / 2
    groups = F.filter(F.split(plain, ":"), lambda g: g != "")
    total = F.size(groups) + F.when(dotted, 1).otherwise(0)
    sound = F.forall(groups, lambda g: g.rlike(r"(?i)\A[0-9a-f]{1,4}\z")) & (~dotted | is_ipv4(tail))
    return F.coalesce(c.contains(":") & sound & (double <= 1) & F.when(double == 1, total <= 7).otherwise(total == 8), F.lit(False))


def is_ip(c: Column) -> Column:
    return is_ipv4(c) | is_ipv6(c)


def _private_v4(c: Column) -> Column:
    a, b = (F.get(F.split(c, r"\."), i).try_cast("int") for i in (0, 1))
    return (
        a.isin(10, 127, 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127)) | (a >= 224)
    )


def is_private(c: Column) -> Column:
    """Private, loopback, link-local, carrier-grade NAT, multicast and reserved addresses; false for what is no address."""
    low, tail = F.lower(c), F.element_at(F.split(c, ":"), -1)
    six = low.isin("::1", "::") | low.rlike(r"\A(?:f[cd]|fe[89ab])") | (tail.contains(".") & _private_v4(tail))
    return F.coalesce(F.when(is_ipv4(c), _private_v4(c)).when(is_ipv6(c), six).otherwise(False), F.lit(False))


def is_routable(c: Column) -> Column:
    return is_ip(c) & ~is_private(c)


def ips_in(text: Column) -> Column:
    """Distinct addresses in a text: IPv4 in order of appearance, then IPv6."""
    four = F.filter(F.regexp_extract_all(text, F.lit(V4_IN_TEXT), F.lit(1)), is_ipv4)
    six = F.filter(F.regexp_extract_all(text, F.lit(V6_IN_TEXT), F.lit(1)), is_ipv6)
    return F.coalesce(F.array_distinct(F.concat(four, six)), F.array().cast("array<string>"))


def sending_ips(received: Column) -> Column:
    """Addresses of a Received header's from-clause, best first: routable before private, observed before claimed by HELO."""
    clause = F.regexp_extract(received, r"(?is)(?<![A-Za-z0-9_])from(?![A-Za-z0-9_])(.*?)(?=(?<![A-Za-z0-9_])by(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])with(?![A-Za-z0-9_])|;|\z)", 1)
    claimed = F.regexp_extract_all(clause, F.lit(r"(?i)(?<![A-Za-z0-9_])(?:helo|ehlo)\s*[=:\s]\s*\[?(?:IPv6:)?([0-9a-f.:]+)\]?"), F.lit(1))
    ranked = F.transform(ips_in(clause), lambda ip, i: F.struct(
        (F.when(is_routable(ip), 0).otherwise(1) + F.when(F.array_contains(claimed, ip), 2).otherwise(0)).alias("rank"), i.alias("at"), ip.alias("ip")
    ))
    return F.transform(F.array_sort(ranked), lambda s: s["ip"])
