"""The explainable verdict: points per part, weights, floors, tier, attack types and caveats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import fixed

#: Risks that end the question on their own.
HIGH_FLOOR = ["exfil-endpoint", "exfil", "smuggled-file", "rtlo-name", "executable-content", "archive-executable", "remote-template", "remote-object", "dde", "macro-autorun", "pdf-launch", "rtf-equation"]
SUSPICIOUS_FLOOR = ["macros", "pdf-javascript", "archive-password", "login-form", "credential-form"]
#: Strong phrases of a category from which the message is suspicious.
FLOOR_PHRASES = {"bec": 2, "extortion": 2, "advancefee": 3}
#: File risks that make a login page rather than malware.
PAGE_RISKS = ["login-form", "exfil", "hidden-layer"]


def diminishing(n: Column, first: int, rest: int) -> Column:
    """The first one counts in full, up to four more a little."""
    return F.when(n <= 0, 0).otherwise(first + F.least(n - 1, F.lit(4)) * rest)


def has_level(risks: Column, level: str) -> Column:
    return F.exists(risks, lambda r: r["level"] == level)


def has_type(risks: Column, *types: str) -> Column:
    return F.exists(risks, lambda r: r["type"].isin(*types))


def count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def ioc_points(urls: Column, files: Column, hosts: Column, emails: Column, password_form: Column) -> Column:
    """Points of indicators; each argument but the last is an array of risk arrays, one per indicator."""
    return (
        diminishing(count(urls, lambda r: has_level(r, "high")), 25, 12)
        + diminishing(count(urls, lambda r: has_level(r, "medium") & ~has_level(r, "high")), 8, 4)
        + diminishing(count(files, lambda r: has_level(r, "high")), 30, 15)
        + F.when(password_form, 25).otherwise(0)
        + diminishing(count(hosts, lambda r: has_type(r, "punycode")), 20, 10)
        + F.when(F.exists(emails, lambda r: has_type(r, "disposable")), 10).otherwise(0)
    )


def language_points(scores: Column) -> Column:
    """Points of wording; scores: map of category to score."""
    total = F.lit(0.0)
    for name, (_, weight) in fixed.LANGUAGE_WEIGHTS.items():
        total = total + F.coalesce(F.try_element_at(scores, F.lit(name)), F.lit(0)) * weight
    return F.floor(total + 0.5)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(c, F.lit(100)))


def weighted(auth: Column, iocs: Column, language: Column) -> Column:
    """The weighted total of the clamped parts, rounded half up."""
    w = fixed.PART_WEIGHTS
    return F.floor(F.least(clamp(auth) * w["auth"] + clamp(iocs) * w["iocs"] + clamp(language) * w["language"], F.lit(100.0)) + 0.5).cast("long")


def strong(counts: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(counts, F.lit(name)), F.lit(0))


def phrase_floor(counts: Column) -> Column:
    test = F.lit(False)
    for name, n in FLOOR_PHRASES.items():
        test = test | (strong(counts, name) >= n)
    return test


def floored(total: Column, risks: Column, counts: Column, findings: Column, password_form: Column) -> Column:
    """The total after the floors. risks: every risk of urls and files; counts: strong phrases by category; findings: (id, severity)."""
    pressure = (strong(counts, "urgency") > 0) | (strong(counts, "credential") > 0) | (strong(counts, "authority") > 0)
    quishing = has_type(risks, "qr-link") & pressure
    thread = F.exists(findings, lambda f: f["id"].startswith("thread-") & (f["severity"] == "high"))
    suspicious = phrase_floor(counts) | quishing | thread | has_type(risks, *SUSPICIOUS_FLOOR) | password_form
    out = F.when(suspicious, F.greatest(total, F.lit(fixed.SUSPICIOUS))).otherwise(total)
    return F.when(has_type(risks, *HIGH_FLOOR), F.greatest(out, F.lit(fixed.HIGH))).otherwise(out).cast("long")


def tier(total: Column) -> Column:
    return F.when(total >= fixed.HIGH, "High Risk").when(total >= fixed.SUSPICIOUS, "Suspicious").otherwise("Low Risk")


def tier_rank(name: Column) -> Column:
    return F.when(name == "High Risk", 0).when(name == "Suspicious", 1).otherwise(2)


def attack_types(counts: Column, url_risks: Column, file_risks: Column, n_urls: Column, n_files: Column, findings: Column, dmarc: Column, aligned: Column, password_form: Column, callback: Column) -> Column:
    """Kinds of attack in fixed order. url_risks and file_risks: arrays of risk arrays, one per item."""
    urls, files = F.flatten(url_risks), F.flatten(file_risks)
    malware = F.exists(file_risks, lambda r: has_level(r, "high") & ~F.forall(r, lambda x: x["type"].isin(PAGE_RISKS)))
    ids = F.transform(findings, lambda f: f["id"])
    return F.array_compact(F.array(
        F.when((strong(counts, "bec") >= 2) | F.array_contains(ids, "thread-payment"), "BEC / payment fraud"),
        F.when(has_type(urls, "credential-form", "exfil-endpoint") | has_type(files, "login-form", "exfil") | password_form | ((strong(counts, "credential") >= 1) & ((n_urls > 0) | (n_files > 0))), "Credential phishing"),
        F.when(malware | has_type(urls, "direct-download") | has_type(files, "macros", "smuggled-file", "executable-content", "archive-executable"), "Malware delivery"),
        F.when(strong(counts, "extortion") >= 2, "Extortion / sextortion"),
        F.when(strong(counts, "advancefee") >= 3, "Advance-fee scam"),
        F.when(callback & (n_urls == 0), "Callback phishing"),
        F.when(strong(counts, "lure") >= 2, "Prize / reward scam"),
        F.when(has_type(urls, "qr-link"), "QR code phishing"),
        F.when(F.exists(ids, lambda i: i.rlike("lookalike|display-name|own-|mixed-script|thread-impersonation")), "Impersonation"),
        F.when((dmarc == "fail") | F.coalesce(~aligned, F.lit(False)), "Sender spoofing"),
    ))


def caveats(subject: Column, has_auth: Column, has_routing: Column, counts: Column) -> Column:
    """Codes of what limits the verdict."""
    return F.array_compact(F.array(
        F.when(F.coalesce(subject, F.lit("")).rlike(r"(?i)\A\s*(?:fw|fwd)\s*:"), "forwarded"),
        F.when(~has_auth & ~has_routing, "nothing-to-check").when(~has_auth, "no-authentication"),
        F.when(strong(counts, "bec") >= FLOOR_PHRASES["bec"], "confirm-payment-by-phone"),
        F.when(strong(counts, "extortion") >= FLOOR_PHRASES["extortion"], "do-not-pay"),
        F.when(strong(counts, "advancefee") >= FLOOR_PHRASES["advancefee"], "advance-fee"),
    ))


def status_reasons(spf: Column, dkim: Column, dmarc: Column, aligned: Column, reply_elsewhere: Column) -> Column:
    """Codes of the reasons that authentication gives, in the order of the points."""
    code = lambda m, c: F.when(~c.isin("pass", "policy"), F.concat(F.lit(m), c))
    return F.array_compact(F.array(
        code("spf-", spf), code("dkim-", dkim), code("dmarc-", dmarc), F.when(~aligned, "misaligned"), F.when(reply_elsewhere, "reply-to-elsewhere")
    ))


def decisive(types: Column, counts: Column) -> Column:
    """Codes that alone raise the tier: those that make it high first."""
    named = lambda codes: F.filter(F.array(*[F.lit(c) for c in codes]), lambda c: F.array_contains(types, c))
    phrases = F.array_compact(F.array(*[F.when(strong(counts, k) >= n, f"wording-{k}") for k, n in FLOOR_PHRASES.items()]))
    return F.concat(named(HIGH_FLOOR), named(SUSPICIOUS_FLOOR), phrases)


def reasons(*lists: Column) -> Column:
    """Reason codes of all parts, each once, in order of first appearance."""
    return F.array_distinct(F.flatten(F.array(*lists)))
