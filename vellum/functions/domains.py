"""Hosts, organisational domains and lookalikes as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import fixed


def literals(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def org_domain(domain: Column) -> Column:
    """The registrable domain: two labels, or three under a two-label public suffix; null for none."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(domain), r"\.\z", ""), r"\."), lambda x: x != "")
    n = F.size(parts)
    last = lambda k: F.array_join(F.slice(parts, -k, k), ".")
    short = F.array_join(parts, ".")
    return F.when(n <= 2, F.when(short != "", short)).when(last(2).isin(fixed.SUFFIXES), last(3)).otherwise(last(2))


def authority(url: Column) -> Column:
    """What stands between '//' and the path; null where the text is no absolute URL."""
    found = F.regexp_extract(url, r"\A\s*[A-Za-z][A-Za-z0-9+.\-]*:[/\\]{2}([^/?#\\]*)", 1)
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and 'www.'."""
    host = F.regexp_replace(F.regexp_replace(F.lower(authority(url)), r"\A.*@", ""), r":[0-9]*\z", "")
    return F.when(host != "", F.regexp_replace(host, r"\Awww\.", ""))


def domain_of(address: Column) -> Column:
    """What follows the last @; null where there is none."""
    return F.when(address.contains("@"), F.lower(F.element_at(F.split(address, "@"), -1)))


#: Entries that a worker remembers at most.
MEMO = 100_000
_FOLD = str.maketrans(fixed.CONFUSABLE, fixed.LOOKS_LIKE)
LOOK = "struct<brand:string,kind:string,own:boolean>"


def shape_of(value: str) -> str:
    """The shape that an eye sees: compatibility forms and confusable signs as Latin, 'rn' as 'm', 'vv' as 'w', nothing else."""
    folded = unicodedata.normalize("NFKC", value.lower()).translate(_FOLD)
    return re.sub("[^a-z0-9]", "", folded.replace("rn", "m").replace("vv", "w"))


def skeleton(value: Column) -> Column:
    """shape_of without Python: full-width forms are folded by code point, other compatibility forms drop out."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    plain = "".join(chr(0x21 + i) for i in range(94))
    folded = F.translate(F.translate(F.lower(value), wide, plain), fixed.CONFUSABLE, fixed.LOOKS_LIKE)
    return F.regexp_replace(F.replace(F.replace(F.lower(folded), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w")), "[^a-z0-9]", "")


def org_of(domain: str) -> str:
    """org_domain of one string; empty for none."""
    parts = [p for p in domain.lower().removesuffix(".").split(".") if p]
    two = ".".join(parts[-2:])
    return ".".join(parts[-3:]) if len(parts) > 2 and two in _SUFFIXES else two


_SUFFIXES = set(fixed.SUFFIXES)


def entries(own: list[str] | None = None) -> list[tuple[str, list[str], bool]]:
    """(name, domains, own): the protected domains first, then the brands."""
    return [(org_of(d).split(".")[0], [org_of(d)], True) for d in own or []] + [(n, ds, False) for n, ds in fixed.BRANDS]


def distance(a: str, b: str) -> int:
    """Edits between two short strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def imitation(host: str, listed: list[tuple[str, list[str], bool]]) -> tuple[str, str, bool] | None:
    """(name, kind, own) of the strongest imitation: confusable, tld-swap (own entries), typosquat, contains; the earlier entry wins."""
    h = host.lower().removeprefix("www.")
    org = org_of(h) or h
    if not h or any(org in ds for _, ds, _ in listed):
        return None
    name = org.split(".")[0]
    shape, flat = shape_of(name), shape_of(re.sub(r"\.[a-z.]+$", "", h))
    words = {shape_of(w) for w in re.split(r"[.\-_]", h)}
    tests = [
        ("confusable", lambda n, own: shape == n != name),
        ("tld-swap", lambda n, own: own and name == n),
        ("typosquat", lambda n, own: len(n) >= 5 and abs(len(n) - len(shape)) <= 2 and 0 < distance(shape, n) <= (2 if len(n) >= 8 else 1)),
        ("contains", lambda n, own: len(n) >= 4 and flat != n and n in words),
    ]
    return next(((n, kind, own) for kind, test in tests for n, _, own in listed if test(n, own)), None)


def remembered(values: pd.Series, memo: dict, work) -> list:
    """work(value) of each value, each distinct one worked out once."""
    if len(memo) > MEMO:
        memo.clear()
    for v in values.dropna().unique():
        if v not in memo:
            memo[v] = work(v)
    return [memo.get(v) if v is not None else None for v in values]


def lookalike(host: Column, own: list[str] | None = None) -> Column:
    """struct(brand, kind, own) of the strongest imitation of a brand or protected domain, or null.

    Arrow batches; each distinct host of a worker is judged once, and nothing is shuffled or joined.
    """
    listed = entries(own)

    @F.pandas_udf(LOOK)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for hosts in batches:
            got = remembered(hosts, memo, lambda h: imitation(h, listed))
            yield pd.DataFrame([g or (None, None, None) for g in got], columns=["brand", "kind", "own"])

    found = run(host)
    return F.when(found["brand"].isNotNull(), found)


def named_brand(name: Column, own: list[str] | None = None) -> Column:
    """struct(brand, domains, own) of the first listed brand of four letters or more in a display name, or null."""
    listed = [(n, ds, o) for n, ds, o in entries(own) if len(n) >= 4]

    @F.pandas_udf("struct<brand:string,domains:array<string>,own:boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for names in batches:
            got = remembered(names, memo, lambda v: next((e for s in [shape_of(v)] for e in listed if e[0] in s), None))
            yield pd.DataFrame([g or (None, None, None) for g in got], columns=["brand", "domains", "own"])

    found = run(name)
    return F.when(found["brand"].isNotNull(), found)


def is_mixed_script(label: Column) -> Column:
    """Latin together with Cyrillic or Greek letters."""
    return F.coalesce(label.rlike("[a-zA-Z]") & label.rlike("[Ͱ-ϿЀ-ӿ]"), F.lit(False))


def under(host: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    h = F.regexp_replace(F.lower(host), r"\.\z", "")
    return F.coalesce(h.rlike(r"(?:\A|\.)(?:" + "|".join(d.replace(".", r"\.") for d in domains) + r")\z"), F.lit(False))


#: A domain as people type it: labels and a top level of letters, or of xn--.
TYPED = r"(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:[a-z]{2,63}|xn--[a-z0-9-]{1,59})"


def typed_domains(typed: str | None) -> tuple[list[str], list[str]]:
    """(domains, entries that are none) of a list as people type it, each once: commas, semicolons and lines divide it.

    Blanks divide an entry only where every piece looks like a domain. Schemes, mailboxes, paths, www. and a dot at the end go.
    """
    entries = []
    for chunk in re.split(r"[\n,;]+", typed or ""):
        words = chunk.split()
        entries += words if all(re.search(r"\.[A-Za-z]{2}", w) for w in words) else [chunk.strip()]
    good, bad = [], []
    for entry in entries:
        host = re.split(r"[/?#]", re.sub(r"^[a-z]+://", "", entry.lower()))[0].rpartition("@")[2]
        host = host.removeprefix("www.").removesuffix(".")
        (good if re.fullmatch(TYPED, host) else bad).append(host if re.fullmatch(TYPED, host) else entry)
    return list(dict.fromkeys(good)), bad
