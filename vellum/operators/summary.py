"""Derived readings for summaries: authenticity, relays, policies, reputations, registration age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import domains, ips

#: Days since registration up to which a domain is bad, and worth a warning.
BAD_DAYS, WARN_DAYS = 30, 180
#: Reports of abuse, in per cent, from which an address is malicious or suspicious.
ABUSE_MALICIOUS, ABUSE_SUSPICIOUS = 50, 25


def authenticity(dmarc: Column, aligned: Column) -> Column:
    return F.when((dmarc == "fail") | F.coalesce(~aligned, F.lit(False)), "not verified").when((dmarc == "pass") & aligned, "verified").otherwise("could not be verified")


def replies_elsewhere(reply_to: Column, sender: Column) -> Column:
    """Replies go to another domain than From's, organisations not considered; false without Reply-To."""
    return F.coalesce(~domains.domain_of(reply_to).eqNullSafe(domains.domain_of(sender)) & reply_to.isNotNull(), F.lit(False))


def origin_ip(public: Column, received: Column) -> Column:
    """The public address, or else the first address of the oldest Received header where it is routable. received: values, newest first."""
    oldest = F.get(ips.ips_in(F.try_element_at(received, F.lit(-1))), F.lit(0))
    return F.coalesce(public, F.when(ips.is_routable(oldest), oldest))


def is_forwarded(name: Column, mime: Column) -> Column:
    """An attachment is a message that was passed on."""
    return F.coalesce(F.lower(mime).contains("message/rfc822"), F.lit(False)) | F.coalesce(F.lower(name).endswith(".eml"), F.lit(False))


def component(c: Column) -> Column:
    """A text as a part of a URL: letters, digits and -_.!~*'() stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


#: Pages of public reputation services.
ABUSE_PAGE, REPUTATION_PAGE = "https://www.abuseipdb.com/check/", "https://www.virustotal.com/gui/"


def vendor_url(service: str, kind: Column, value: Column, sha256: Column) -> Column:
    """The page of a service (abuse or reputation) on an indicator; a file is found by its hash where it has one."""
    if service == "abuse":
        return F.concat(F.lit(ABUSE_PAGE), component(value))
    part = (
        F.when(kind == "ip", F.concat(F.lit("ip-address/"), component(value))).when(kind == "domain", F.concat(F.lit("domain/"), component(value)))
        .when((kind == "attachment") & (sha256 != ""), F.concat(F.lit("file/"), component(sha256))).otherwise(F.concat(F.lit("search/"), component(value)))
    )
    return F.concat(F.lit(REPUTATION_PAGE), part)


def suspicious_domain(domain: Column) -> Column:
    return F.coalesce(domain.rlike(r"\A(?:xn--|[0-9])"), F.lit(False))


def last_relay(hops: DataFrame, key: list[str]) -> DataFrame:
    """key, relay_ip: the first hop from the top with an address, unless it is the origin."""
    valid = hops.where(ips.is_ip(F.col("ip")))
    by = valid.groupBy(*key).agg(F.max_by("ip", "hop").alias("relay_ip"), F.min_by("ip", "hop").alias("_origin"))
    return by.where("relay_ip <> _origin").drop("_origin")


def kind_counts(found: DataFrame, key: list[str]) -> DataFrame:
    """key, kind, n, any_high of indicators with risks."""
    return found.groupBy(*key, "kind").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.exists("risks", lambda r: r["level"] == "high")).alias("any_high"))


def top_reasons(reasons: Column) -> Column:
    return F.slice(reasons, 1, 3)


def policy(dmarc_record: Column, spf_record: Column, mx: Column) -> Column:
    """struct(dmarc, spf, receives) of published records: what they do with a message that fails."""
    p = F.lower(F.regexp_extract(dmarc_record, r"(?i)(?:\A|;)\s*p\s*=\s*([a-z]+)", 1))
    end = F.regexp_extract(spf_record, r"(?i)([-~?+]?)all(?:\s|\z)", 1)
    return F.struct(
        F.when(p == "reject", "ok").when(p == "quarantine", "warn").otherwise("bad").alias("dmarc"),
        F.when(spf_record.isNull(), "bad").when(end == "-", "ok").otherwise("warn").alias("spf"), (F.size(mx) > 0).alias("receives"),
    )


def vendor_class(malicious: Column, suspicious: Column) -> Column:
    return F.when(malicious > 0, "malicious").when(suspicious > 0, "suspicious").otherwise("clean")


def abuse_class(score: Column) -> Column:
    return F.when(score >= ABUSE_MALICIOUS, "malicious").when(score >= ABUSE_SUSPICIOUS, "suspicious").otherwise("clean")


def age_class(registered: Column, today: Column) -> Column:
    days = F.datediff(today, registered)
    return F.when(days <= BAD_DAYS, "bad").when(days <= WARN_DAYS, "warn").when(days.isNotNull(), "ok")


def enriched(found: DataFrame, snapshot: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """found with the columns of a snapshot table (value, ...) of one kind of indicator; Spark broadcasts it where its size allows.

    DNS, registration and reputation services are such tables: what a lookup would return, by indicator.
    """
    named = snapshot.withColumnRenamed(value, "_value").withColumn("_kind", F.lit(kind))
    return found.join(named, (F.col("kind") == F.col("_kind")) & (F.lower(value) == F.lower("_value")), "left").drop("_value", "_kind")


def lookup_target(c: Column) -> Column:
    """A bare domain or address that may be looked up; null for anything else."""
    t = F.lower(F.trim(c))
    return F.when(ips.is_routable(t), t).when(t.rlike(r"\A(?=.{1,253}\z)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\z") & domains.org_domain(t).isNotNull(), t)
