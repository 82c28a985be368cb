"""Authentication results, alignment, routing and header trust, as columns and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import domains, fixed, ips, text

HOUR = 3600
#: Seconds that time may run backwards between two hops, and that the Date header may differ from delivery.
BACKWARDS, DATE_GAP = 60, 24 * HOUR


def points(status: Column, table: dict[str, int]) -> Column:
    """Points of a status; statuses that the table does not name have none."""
    out = F.lit(0)
    for name, n in table.items():
        out = F.when(status == name, F.lit(n)).otherwise(out)
    return out


def resolve(clauses: Column, method: str) -> Column:
    """struct(status, props) of a method among the clauses of the topmost header: for DKIM any passing one, else the first."""
    own = F.filter(clauses, lambda c: c["method"] == method)
    if method == "dkim":
        own = F.concat(F.filter(own, lambda c: text.normal_status(c["result"]) == "pass"), own)
    first = F.get(own, F.lit(0))
    return F.when(first.isNotNull(), F.struct(text.normal_status(first["result"]).alias("status"), first["props"].alias("props"), first["raw"].alias("raw")))


def alignment(from_domain: Column, domain: Column) -> Column:
    """strict, relaxed or none; null without a domain."""
    org, own = domains.org_domain(domain), domains.org_domain(from_domain)
    return F.when(domain.isNull(), None).when(F.lower(domain) == F.lower(from_domain), "strict").when(org == own, "relaxed").otherwise("none")


def aligned_entries(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, source, domain, mode, relevant, passed for each identity beside From.

    rows: from_domain, envelope_domain, dkim_domains array, reply_to_domain, spf, dkim.
    """
    entry = lambda source, domain, relevant, passed: F.struct(
        F.lit(source).alias("source"), domain.alias("domain"), alignment(F.col("from_domain"), domain).alias("mode"),
        F.lit(relevant).alias("relevant"), F.coalesce(passed, F.lit(False)).alias("passed"),
    )
    entries = F.concat(
        F.array(entry("Return-Path", F.col("envelope_domain"), True, F.col("spf") == "pass")),
        F.transform(F.array_distinct(F.coalesce("dkim_domains", F.array().cast("array<string>"))), lambda d: entry("DKIM", d, True, F.col("dkim") == "pass")),
        F.array(entry("Reply-To", F.col("reply_to_domain"), False, F.lit(False))),
    )
    return rows.select(*key, F.inline(entries)).where("domain IS NOT NULL")


def dmarc_aligned(entries: Column) -> Column:
    """Whether any DMARC identity is aligned and verified; null where there is none. entries: array of (mode, relevant, passed)."""
    own = F.filter(entries, lambda e: e["relevant"])
    return F.when(F.size(own) > 0, F.exists(own, lambda e: (e["mode"] != "none") & e["passed"]))


def hop_warnings(hops: DataFrame, key: list[str]) -> DataFrame:
    """hops (hop from 1 at the origin, ip, ts in seconds) with next_ts, is_origin, private_origin and backwards."""
    outward = Window.partitionBy(*key).orderBy("hop")
    return hops.withColumns({"next_ts": F.lead("ts").over(outward), "hops": F.count(F.lit(1)).over(Window.partitionBy(*key))}).withColumns({
        "private_origin": (F.col("hop") == 1) & (F.col("hops") > 1) & ips.is_private(F.col("ip")),
        "backwards": F.coalesce(F.col("next_ts") < F.col("ts") - BACKWARDS, F.lit(False)),
    })


def sender_ip(hops: DataFrame, key: list[str]) -> DataFrame:
    """key, public_ip, public_hop, origin_ip, private_skipped: from the origin outward to the first routable address."""
    valid = hops.where(ips.is_ip(F.col("ip"))).withColumn("routable", ips.is_routable(F.col("ip")))
    found = valid.groupBy(*key).agg(
        F.min_by("ip", "hop").alias("origin_ip"), F.min(F.when(F.col("routable"), F.col("hop"))).alias("public_hop"),
        F.min_by("ip", F.when(F.col("routable"), F.col("hop"))).alias("_ip"), F.min("hop").alias("_first"),
        F.collect_list(F.when(~F.col("routable"), F.col("hop"))).alias("_private"),
    )
    before = F.filter("_private", lambda h: (h > F.col("_first")) & (h < F.coalesce("public_hop", F.lit(1 << 30))))
    return found.select(*key, F.when(F.col("public_hop").isNotNull(), F.col("_ip")).alias("public_ip"), "public_hop", "origin_ip", F.size(before).cast("long").alias("private_skipped"))


def trust_conflicts(claims: DataFrame, key: list[str]) -> DataFrame:
    """key, method, claimed, recorded where a lower header claims a pass that the topmost does not record.

    claims: method, pos (0 topmost), result. One aggregation per message and method instead of a self join.
    """
    status = text.normal_status(F.col("result"))
    by = claims.groupBy(*key, "method").agg(
        F.min_by(F.struct(status.alias("status")), F.when(F.col("pos") == 0, F.col("pos")))["status"].alias("recorded"),
        F.count_if((F.col("pos") > 0) & (status == "pass")).alias("lower_passes"), F.count_if(F.col("pos") == 0).alias("_top"),
    )
    return by.where("_top > 0 AND lower_passes > 0 AND recorded <> 'pass'").drop("_top")


def anomalies(date_s: Column, delivered_s: Column, message_id: Column, from_domain: Column, has_reply_headers: Column, subject: Column) -> Column:
    """array of (id, severity): a Date far from delivery, a missing or foreign Message-ID, reply headers on no reply."""
    issued = F.lower(F.regexp_extract(message_id, r"@([^>\s]+)", 1))
    foreign = (issued != "") & (domains.org_domain(issued) != domains.org_domain(from_domain))
    item = lambda i, s: F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"))
    reply = F.coalesce(subject, F.lit("")).rlike(r"(?i)\A\s*(?:re|aw|sv|antw|res)\s*:")
    return F.array_compact(F.array(
        F.when(F.abs(date_s - delivered_s) > DATE_GAP, item("date-gap", "medium")),
        F.when(F.coalesce(message_id, F.lit("")) == "", item("no-message-id", "medium")),
        F.when(foreign, item("foreign-message-id", "low")),
        F.when(has_reply_headers & (F.coalesce(subject, F.lit("")) != "") & ~reply, item("not-a-reply", "medium")),
    ))


def spf_disagreement(first: Column, second: Column) -> Column:
    """Authentication-Results and Received-SPF record different results."""
    return F.coalesce(text.normal_status(first) != text.normal_status(second), F.lit(False)) & first.isNotNull() & second.isNotNull()


def evaluated_ip(props: Column, raw: Column) -> Column:
    """The address that an SPF clause was evaluated for: its property where that is an address, else the first in the clause or its comment."""
    named = [F.try_element_at(props, F.lit(k)) for k in ("smtp.remote-ip", "smtp.client-ip")]
    return F.coalesce(*[F.when(ips.is_ip(c), c) for c in named], F.get(ips.ips_in(raw), F.lit(0)))


def spf_sources(clause: Column, received: Column, received_raw: Column) -> Column:
    """struct(ip, results_agree, ips_agree) of both SPF headers; agreement is null unless both tell.

    clause: struct of resolve; received: struct of the Received-SPF header, received_raw its text.
    """
    first = F.when(clause.isNotNull(), evaluated_ip(clause["props"], clause["raw"]))
    second = F.when(received.isNotNull(), F.coalesce(F.when(ips.is_ip(received["client_ip"]), received["client_ip"]), F.get(ips.ips_in(received_raw), F.lit(0))))
    return F.struct(F.coalesce(first, second).alias("ip"), F.when(clause.isNotNull() & received.isNotNull(), clause["status"] == text.normal_status(received["result"])).alias("results_agree"), (first == second).alias("ips_agree"))


def auth_points(spf: Column, dkim: Column, dmarc: Column, aligned: Column, reply_elsewhere: Column, warnings: Column, anomaly: Column, findings: Column) -> Column:
    """Points for authentication, never under 0. anomaly and findings are points already added up."""
    total = (
        points(spf, fixed.SPF_POINTS) + points(dkim, fixed.DKIM_POINTS) + points(dmarc, fixed.DMARC_POINTS)
        + F.when(~aligned, fixed.MISALIGNED).otherwise(0) + F.when(reply_elsewhere, fixed.REPLY_TO_ELSEWHERE).otherwise(0)
        + warnings * fixed.WARNING + anomaly + findings
        + F.when((spf == "pass") & (dkim == "pass") & (dmarc == "pass") & aligned, fixed.ALL_PASS).otherwise(0)
    )
    return F.greatest(total, F.lit(0))


#: The statuses of each method that raise an issue without being a failure.
SOFT = {"spf": ["softfail", "permerror", "temperror", "none"], "dkim": ["none", "permerror"], "dmarc": ["none"]}


def overall(spf: Column, dkim: Column, dmarc: Column, aligned: Column, reply_elsewhere: Column, warnings: Column) -> Column:
    """struct(level, failures, issues): fail from two failures on, suspicious from one failure or issue on, else pass.

    Failures are results fail and domains that are not aligned (aligned is null where there is nothing to align).
    """
    status = {"spf": spf, "dkim": dkim, "dmarc": dmarc}
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    failures = sum((one(c == "fail") for c in status.values()), one(~aligned))
    issues = sum((one(c.isin(SOFT[m])) for m, c in status.items()), one(reply_elsewhere) + F.coalesce(warnings, F.lit(0)).cast("long")) + failures
    return F.struct(F.when(failures >= 2, "fail").when(issues > 0, "suspicious").otherwise("pass").alias("level"), failures.alias("failures"), issues.alias("issues"))
