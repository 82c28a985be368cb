"""Reports: guarded CSV lines, JSON, STIX 2.1 and MISP, file names and URL groups."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import ips, text

#: Columns of the indicator table, in order.
CSV_COLUMNS = ["type", "value", "source", "risk", "risk_level", "unwrapped_from", "sha256", "reputation"]
BOM, END = "﻿", "\r\n"
#: The name space of deterministic STIX ids.
STIX_SPACE = uuid.UUID("00abedb4-aa42-466c-9c01-fed23315a9b7")


def csv_cell(c: Column) -> Column:
    """A cell that no spreadsheet runs as a formula, quoted where it must be."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(t.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)
    return F.when(safe.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def csv_line(cells: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


def csv_rows(iocs: DataFrame, columns: list[str] = CSV_COLUMNS, key: list[str] = ()) -> DataFrame:
    """One line per indicator (line), after the key; a writer of text files puts the header and the byte-order mark first."""
    return iocs.select(*key, csv_line([F.col(c) if c in iocs.columns else F.lit(None) for c in columns]).alias("line"))


def csv_text(lines: list[str], columns: list[str] = CSV_COLUMNS) -> str:
    """A whole small report."""
    return BOM + END.join([",".join(columns), *lines]) + END


def csv_reports(iocs: DataFrame, key: list[str], columns: list[str] = CSV_COLUMNS) -> DataFrame:
    """key, csv: a message's whole report as a file's text, in the order of ord: byte-order mark, header, a line per indicator."""
    line = csv_line([F.col(c) if c in iocs.columns else F.lit(None) for c in columns])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    return iocs.groupBy(*key).agg(F.concat(F.lit(BOM), F.array_join(F.concat(F.array(F.lit(",".join(columns))), lines), END)).alias("csv"))


def json_report(verdicts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return verdicts.select(F.to_json(F.struct(*(columns or verdicts.columns))).alias("json"))


def pattern(kind: Column, value: Column) -> Column:
    """A STIX pattern of an indicator; null for kinds without one."""
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    of = lambda path: F.concat(F.lit(f"[{path} = '"), quoted, F.lit("']"))
    return (
        F.when(kind == "url", of("url:value")).when(kind == "domain", of("domain-name:value")).when(kind == "email", of("email-addr:value"))
        .when((kind == "ip") & value.contains(":"), of("ipv6-addr:value")).when(kind == "ip", of("ipv4-addr:value"))
        .when(kind == "sha256", of("file:hashes.'SHA-256'")).when(kind == "md5", of("file:hashes.MD5"))
    )


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def uuid5(name: Column, space: uuid.UUID = STIX_SPACE) -> Column:
    """Version 5 UUID of a text, natively."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.hex)), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def stix(iocs: DataFrame, created: str) -> DataFrame:
    """STIX 2.1 objects (object: JSON), one per distinct indicator; ids depend on the pattern alone."""
    p = pattern(F.col("kind"), F.col("value"))
    named = iocs.select("kind", "value", p.alias("pattern")).where("pattern IS NOT NULL").distinct()
    body = F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"),
        F.concat(F.lit("indicator--"), uuid5(F.concat(F.lit('{"pattern":'), F.to_json(F.array("pattern")), F.lit("}")))).alias("id"),
        F.lit(created).alias("created"), F.lit(created).alias("modified"), F.lit(created).alias("valid_from"),
        F.lit("stix").alias("pattern_type"), F.col("pattern"), F.array(F.lit("malicious-activity")).alias("indicator_types"),
    )
    return named.select("kind", "value", F.to_json(body).alias("object"))


def misp(iocs: DataFrame) -> DataFrame:
    """MISP attributes (attribute: JSON)."""
    kind = F.when(F.col("kind") == "email", "email-src").when(F.col("kind") == "ip", "ip-src").otherwise(F.col("kind"))
    group = F.when(F.col("kind").isin("sha256", "md5"), "Payload delivery").otherwise("Network activity")
    return iocs.select(F.to_json(F.struct(kind.alias("type"), group.alias("category"), F.col("value"), F.lit(True).alias("to_ids"))).alias("attribute"))


#: What a verdict's tier is called as a threat level; 4 is undefined.
THREAT_LEVELS = {"High Risk": "1", "Suspicious": "2", "Low Risk": "3"}
#: The type of a MISP attribute for an address by where it stands.
ADDRESS_TYPES = {"From": "email-src", "Reply-To": "email-reply-to", "Return-Path": "email-src"}


def public(found: DataFrame) -> DataFrame:
    """Indicators that mean something outside one network: private addresses go. Null risks are none."""
    risks = F.filter("risks", lambda r: r.isNotNull())
    return found.withColumn("risks", F.coalesce(risks, F.slice(F.array(F.struct(F.lit("").alias("type"), F.lit("").alias("level"))), 1, 0))).where((F.col("kind") != "ip") | F.coalesce(ips.is_routable(F.col("value")), F.lit(False)))


def flags(risks: Column) -> Column:
    return F.transform(risks, lambda r: r["type"])


def is_high(risks: Column) -> Column:
    return F.exists(risks, lambda r: r["level"] == "high")


def observable_type(kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "url", "url").when(kind == "domain", "domain-name").when(kind == "email", "email-addr")
        .when((kind == "ip") & value.contains(":"), "ipv6-addr").when(kind == "ip", "ipv4-addr")
    )


def stix_bundles(found: DataFrame, verdicts: DataFrame, created: str, author: str = "vellum") -> DataFrame:
    """message_id, bundle: a STIX 2.1 bundle (JSON) per verdict, of its author, observables, indicators, message and report.

    found: message_id, kind, value, ord, source, risks; verdicts: message_id, subject, sender, score, tier, reasons, attack_types.
    All ids are of version 5, so that an export repeated gives the same objects. A message's indicators are one row, no more.
    """
    named = lambda kind, name: F.concat(F.lit(f"{kind}--"), uuid5(name))
    maker = named("identity", F.lit(author))
    version = F.lit("2.1").alias("spec_version")
    identity = F.to_json(F.struct(F.lit("identity").alias("type"), version, maker.alias("id"), F.lit(created).alias("created"), F.lit(created).alias("modified"), F.lit(author).alias("name"), F.lit("system").alias("identity_class")))
    kind, value = F.col("kind"), F.col("value")
    shown = F.when(kind == "url", text.defang_url(value)).otherwise(F.replace(value, F.lit("."), F.lit("[.]")))
    label = F.when(kind == "url", "URL ").when(kind == "domain", "Domain ").when(kind == "ip", "IP ").otherwise("Email ")
    typed = public(found).withColumns({"_type": observable_type(kind, value), "_pattern": pattern(kind, value)}).where("_type IS NOT NULL").withColumns({
        "_sco": F.concat("_type", F.lit("--"), uuid5(F.to_json(F.struct("value")))),
        "_ind": named("indicator", F.concat_ws("|", F.col("message_id").cast("string"), "_pattern")),
        "_about": F.concat_ws(". ", F.concat(F.lit("Seen in: "), F.nullif("source", F.lit(""))), F.when(F.size("risks") > 0, F.concat(F.lit("Flags: "), F.array_join(flags(F.col("risks")), "; ")))),
    })
    observable = F.to_json(F.struct(F.col("_type").alias("type"), version, F.col("_sco").alias("id"), "value"))
    indicator = F.to_json(F.struct(
        F.lit("indicator").alias("type"), version, F.col("_ind").alias("id"), maker.alias("created_by_ref"), F.lit(created).alias("created"), F.lit(created).alias("modified"),
        F.concat(label, shown).alias("name"), F.nullif("_about", F.lit("")).alias("description"),
        F.array(F.when(is_high(F.col("risks")), "malicious-activity").otherwise("unknown")).alias("indicator_types"), F.col("_pattern").alias("pattern"),
        F.lit("stix").alias("pattern_type"), F.lit(created).alias("valid_from"), F.array(F.lit("phishing")).alias("labels"),
    ))
    by = typed.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "value", F.col("_sco").alias("sco"), F.col("_ind").alias("ind"), observable.alias("o"), indicator.alias("i")))).alias("_items"))
    none = F.expr("filter(array(struct(0L AS ord, '' AS kind, '' AS value, '' AS sco, '' AS ind, '' AS o, '' AS i)), x -> false)")
    every = verdicts.join(by, "message_id", "left").withColumn("_items", F.coalesce("_items", none))
    sender = F.get(F.filter("_items", lambda x: (x["kind"] == "email") & (F.lower(x["value"]) == F.lower("sender.email"))), F.lit(0))["sco"]
    about = every.withColumn("_from", sender)
    key = F.to_json(F.struct(F.col("_from").alias("from_ref"), "subject"))
    about = about.withColumn("_mail", named("email-message", key))
    message = F.to_json(F.struct(F.lit("email-message").alias("type"), version, F.col("_mail").alias("id"), F.lit(False).alias("is_multipart"), F.col("_from").alias("from_ref"), "subject"))
    subject = F.coalesce(F.nullif("subject", F.lit("")), F.lit("(no subject)"))
    refs = F.array_distinct(F.concat(F.array("_mail"), F.flatten(F.transform("_items", lambda x: F.array(x["sco"], x["ind"])))))
    report = F.to_json(F.struct(
        F.lit("report").alias("type"), version, named("report", F.concat_ws("|", F.col("message_id").cast("string"), F.lit(created))).alias("id"), maker.alias("created_by_ref"),
        F.lit(created).alias("created"), F.lit(created).alias("modified"), F.concat(F.lit("Phishing analysis: "), subject).alias("name"),
        F.concat_ws(" ", F.concat(F.lit("Verdict: "), "tier", F.lit(" ("), F.col("score").cast("string"), F.lit("/100).")), F.slice("reasons", 1, 5)).alias("description"),
        F.array(F.lit("threat-report")).alias("report_types"), F.concat(F.array(F.lit("phishing")), "attack_types").alias("labels"), F.lit(created).alias("published"),
        refs.alias("object_refs"),
    ))
    objects = F.concat(F.array(identity), F.array_distinct(F.flatten(F.transform("_items", lambda x: F.array(x["o"], x["i"])))), F.array(message, report))
    body = F.concat(F.lit('{"type":"bundle","id":"'), named("bundle", F.col("message_id").cast("string")), F.lit('","objects":['), F.array_join(objects, ","), F.lit("]}"))
    return about.select("message_id", body.alias("bundle"))


def misp_events(found: DataFrame, verdicts: DataFrame, date: str, author: str = "vellum") -> DataFrame:
    """message_id, event: a MISP event (JSON) per verdict, unpublished and for the own organisation, with its attributes in order.

    found and verdicts are as in stix_bundles. Private addresses are left out; an attribute is for detection where its risks are high.
    """
    uid = lambda *parts: uuid5(F.concat_ws("|", F.col("message_id").cast("string"), *parts))
    of = lambda kind, group, value, high, comment: F.struct(uid(F.lit(kind) if isinstance(kind, str) else kind, value).alias("uuid"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), group.alias("category"), value.alias("value"), high.alias("to_ids"), comment.alias("comment"))
    kind = F.when(F.col("kind") == "ip", "ip-src").when(F.col("kind") != "email", F.col("kind"))
    for place, name in ADDRESS_TYPES.items():
        kind = kind.when((F.col("kind") == "email") & (F.col("source") == place), name)
    group = F.when(F.col("kind") == "email", "Payload delivery").otherwise("Network activity")
    each = of(kind.otherwise("email"), group, F.col("value"), is_high(F.col("risks")), F.array_join(F.concat(F.array(F.coalesce("source", F.lit(""))), flags(F.col("risks"))), "; "))
    order = F.when(F.col("kind") == "email", 0).when(F.col("kind") == "url", 1).when(F.col("kind") == "domain", 2).otherwise(3)
    by = public(found).where(F.col("kind").isin("email", "url", "domain", "ip")).groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), "ord", each.alias("a")))).alias("_items"))
    head = [("email-subject", F.col("subject"), "Subject"), ("email-src-display-name", F.col("sender.name"), "From display name")]
    first = F.array_compact(F.array(*[F.when(v != "", of(t, F.lit("Payload delivery"), v, F.lit(False), F.lit(c))) for t, v, c in head]))
    attributes = F.when(F.col("_items").isNull(), first).otherwise(F.concat(first, F.transform("_items", lambda x: x["a"])))
    level = F.lit("4")
    for tier, n in THREAT_LEVELS.items():
        level = F.when(F.col("tier") == tier, n).otherwise(level)
    tag = lambda c: F.struct(c.alias("name"))
    tags = F.concat(
        F.array(tag(F.lit("phishing")), tag(F.concat(F.lit(f'{author}:verdict="'), "tier", F.lit('"')))),
        F.transform("attack_types", lambda t: tag(F.concat(F.lit(f'{author}:attack-type="'), t, F.lit('"')))),
    )
    event = F.struct(
        uid().alias("uuid"), F.concat(F.lit("Phishing: "), F.coalesce(F.nullif("subject", F.lit("")), F.lit("(no subject)"))).alias("info"), F.lit(date).alias("date"), level.alias("threat_level_id"),
        F.lit("2").alias("analysis"), F.lit("0").alias("distribution"), F.lit(False).alias("published"), tags.alias("Tag"), attributes.alias("Attribute"),
    )
    return verdicts.join(by, "message_id", "left").select("message_id", F.to_json(F.struct(event.alias("Event"))).alias("event"))


def file_slug(subject: Column, date: Column, ending: str) -> Column:
    """phishing-report_2024-01-15_account-suspended.html"""
    slug = F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(subject, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-")), 1, 40)
    return F.concat(F.concat_ws("_", F.lit("phishing-report"), date, F.when(slug != "", slug)), F.lit(f".{ending}"))


def grouped_urls(urls: DataFrame, key: list[str]) -> DataFrame:
    """Wrapper URLs, each with the destinations unwrapped from it."""
    child = urls.where("unwrapped_from IS NOT NULL").groupBy(*key, F.col("unwrapped_from").alias("value")).agg(F.array_sort(F.collect_list("value")).alias("destinations"))
    top = urls.where("unwrapped_from IS NULL")
    return top.join(child, [*key, "value"], "left").withColumn("destinations", F.coalesce("destinations", F.array().cast("array<string>")))


def ioc_text(iocs: DataFrame, key: list[str]) -> DataFrame:
    """key, text: a message's indicators, a line each, in order."""
    lines = F.array_sort(F.collect_list(F.struct("ord", "value")))
    return iocs.groupBy(*key).agg(F.array_join(F.transform(lines, lambda s: s["value"]), "\n").alias("text"))


def comparison_csv(compared: DataFrame, shared: DataFrame, messages: list, names: dict) -> DataFrame:
    """place, line of a comparison: its header, a line per property, an empty line, and the indicators that the messages share.

    compared: field, m<id>; shared: type, value (made harmless already), members (ids). names: the name of each message.
    """
    spark = compared.sparkSession
    row = lambda place, cells: spark.range(1).select(F.lit(place).alias("place"), csv_line([F.lit(c) for c in cells]).alias("line"))
    named = F.create_map(*[x for m in messages for x in (F.lit(str(m)), F.lit(names[m]))])
    seen = F.array_join(F.transform("members", lambda m: F.try_element_at(named, m.cast("string"))), "; ")
    return (
        row(0, ["property", *[names[m] for m in messages]])
        .unionByName(compared.select(F.lit(1).alias("place"), csv_line([F.col("field"), *[F.col(f"m{m}") for m in messages]]).alias("line")))
        .unionByName(row(2, [""])).unionByName(row(3, ["shared indicator", "type", "seen in"]))
        .unionByName(shared.select(F.lit(4).alias("place"), csv_line([F.col("value"), F.col("type"), seen]).alias("line")))
    )


def comparison_json(rows: DataFrame, key: str, fields: list[str], messages: list) -> DataFrame:
    """key, json: a compared message's properties, nulls kept."""
    body = F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]), {"ignoreNullFields": "false"})
    return rows.where(F.col(key).isin(messages)).select(key, body.alias("json"))
