"""Who a message claims to be from: display names, lookalikes, Reply-To and recipients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import domains, fixed, text

FINDING = "array<struct<id:string,severity:string>>"
MANY_RECIPIENTS = 10


def finding(id_: str | Column, severity: str) -> Column:
    return F.struct((F.lit(id_) if isinstance(id_, str) else id_).alias("id"), F.lit(severity).alias("severity"))


def findings(name: Column, address: Column, reply_to: Column, recipients: Column, own: list[str] | None = None) -> Column:
    """Identity findings in fixed order. recipients: array of addresses."""
    sender = domains.domain_of(address)
    org = domains.org_domain(sender)
    shown = domains.org_domain(domains.domain_of(F.lower(F.regexp_extract(name, text.EMAIL, 0))))
    brand, look = domains.named_brand(name, own), domains.lookalike(sender, own)
    reply = domains.domain_of(reply_to)
    reply_org, reply_look = domains.org_domain(reply), domains.lookalike(reply, own)
    mixed = F.exists(F.split(F.coalesce(sender, F.lit("")), r"\."), domains.is_mixed_script)
    own_look = F.coalesce(look["own"], F.lit(False))
    steered = F.coalesce(reply_look["own"], F.lit(False)) & ~own_look
    to = F.coalesce(recipients, F.array().cast("array<string>"))
    near = F.exists(to, lambda r: imitates(sender, domains.domain_of(r)))
    return F.array_compact(F.array(
        F.when(shown != org, finding("display-name-address", "high")),
        F.when(sender.isNotNull() & brand.isNotNull() & ~F.coalesce(F.array_contains(brand["domains"], org), F.lit(False)),
               finding(F.when(brand["own"], "display-name-own").otherwise("display-name-brand"), "high")),
        F.when(look.isNotNull(), finding(F.concat(F.when(look["own"], "own-lookalike-").otherwise("lookalike-"), look["kind"]), "high")),
        F.when(steered, finding("own-lookalike-replyto", "high")),
        F.when(mixed, finding("mixed-script", "high")),
        F.when((reply_org != org) & reply_org.isin(fixed.FREE_MAIL), finding("replyto-freemail", "medium")),
        F.when(near & ~own_look & ~steered, finding("recipient-lookalike", "high")),
    ))


def imitates(sender: Column, recipient: Column) -> Column:
    """Two organisations, neither of them webmail, with the same name on another ending or one edit apart (from five letters on)."""
    a, b = domains.org_domain(sender), domains.org_domain(recipient)
    x, y = F.substring_index(a, ".", 1), F.substring_index(b, ".", 1)
    near = (x == y) | ((F.length(y) >= 5) & (F.levenshtein(x, y) <= 1))
    return F.coalesce((a != b) & ~a.isin(fixed.FREE_MAIL) & ~b.isin(fixed.FREE_MAIL) & near, F.lit(False))


def recipient_notes(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, notes of rows (sender, to and cc arrays, delivered_to): no-visible-recipient, many, delivered-elsewhere, imitation, same-organisation."""
    none = F.array().cast("array<string>")
    to = F.coalesce("to", none)
    every = F.concat(to, F.coalesce("cc", none))
    at = F.array_compact(F.concat(every, F.array(F.col("delivered_to"))))
    sender = domains.domain_of(F.col("sender"))
    orgs = F.transform(at, lambda r: domains.org_domain(domains.domain_of(r)))
    free = domains.org_domain(sender).isin(fixed.FREE_MAIL)
    notes = F.array_compact(F.array(
        F.when(F.size(to) == 0, "no-visible-recipient"), F.when(F.size(every) >= MANY_RECIPIENTS, "many"),
        F.when(F.col("delivered_to").isNotNull() & (F.size(every) > 0) & ~F.array_contains(every, F.lower("delivered_to")), "delivered-elsewhere"),
        F.when(F.exists(at, lambda r: imitates(sender, domains.domain_of(r))), "imitation"),
        F.when(F.array_contains(orgs, domains.org_domain(sender)) & ~free, "same-organisation"),
    ))
    return rows.select(*key, notes.alias("notes"))


def points(found: Column) -> Column:
    """Points of identity findings."""
    return F.aggregate(found, F.lit(0), lambda a, f: a + F.when(f["severity"] == "high", fixed.FINDING_POINTS["high"]).otherwise(fixed.FINDING_POINTS["medium"]))
