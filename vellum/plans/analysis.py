"""From raw messages to verdicts: every stage of the analysis as one plan over tables keyed by message_id.

Parsing is one pass over bytes; its result is written once by the caller (or checkpointed) and every layer reads
only the columns it needs. Joins are on message_id alone, so one partitioning serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import domains, ips, text, urls
from vellum.operators import auth, containers, content, identity, iocs, language, pages, score, summary, thread
from vellum.sources import mail

RISK_LISTS = "array<array<struct<type:string,level:string>>>"


def authentication(messages: DataFrame, core: DataFrame) -> DataFrame:
    """message_id, spf, dkim, dmarc, is_aligned, reply_elsewhere, warnings of each message."""
    results = mail.values_of("authentication-results")
    top = messages.select(
        "message_id", mail.auth_clauses(F.get(results, F.lit(0))).alias("top"), F.size(results).alias("n_results"),
        F.transform(results, lambda v: v).alias("results"), mail.received_spf(mail.value_of("received-spf")).alias("rspf"), mail.value_of("received-spf").alias("rspf_raw"),
        F.transform(mail.values_of("dkim-signature"), lambda v: F.lower(mail.dkim_tag(v, "d"))).alias("signed"),
        F.size("parts").alias("n_parts"),
    )
    clauses = F.col("top.clauses")
    resolved = top.withColumns({f"_{m}": auth.resolve(clauses, m) for m in ("spf", "dkim", "dmarc")})
    verified = F.filter(clauses, lambda c: (c["method"] == "dkim"))
    named = F.array_compact(F.transform(verified, lambda c: F.lower(F.coalesce(F.try_element_at(c["props"], F.lit("header.d")), F.regexp_extract(F.try_element_at(c["props"], F.lit("header.i")), "@(.*)", 1)))))
    base = resolved.withColumns({
        "spf": F.coalesce("_spf.status", text.normal_status(F.col("rspf.result")), F.lit("unknown")),
        "dkim": F.coalesce(F.col("_dkim.status"), F.when(F.size("signed") > 0, "unverified").when(F.col("n_results") > 0, "none").otherwise("unknown")),
        "dmarc": F.coalesce("_dmarc.status", F.lit("unknown")),
        "dkim_domains": F.when(F.size(named) > 0, named).otherwise(F.array_compact("signed")),
        "_envelope": F.coalesce(F.try_element_at("_spf.props", F.lit("smtp.mailfrom")), F.try_element_at("_spf.props", F.lit("smtp.helo")), "rspf.envelope_from"),
    })
    joined = base.join(core.select("message_id", "sender", "reply_to", "return_path"), "message_id").withColumns({
        "from_domain": domains.domain_of(F.col("sender.email")),
        "envelope_domain": F.coalesce(F.lower(F.regexp_extract("_envelope", r"([^@<>\s]+)>?\z", 1)), domains.domain_of(F.col("return_path.email"))),
        "reply_to_domain": domains.domain_of(F.col("reply_to.email")),
    })
    entries = auth.aligned_entries(joined, ["message_id"])
    by = entries.groupBy("message_id").agg(F.collect_list(F.struct("mode", "relevant", "passed")).alias("entries"), F.bool_or((F.col("source") == "Reply-To") & (F.col("mode") == "none")).alias("reply_elsewhere"))
    lower = messages.select("message_id", F.posexplode(results).alias("pos", "raw")).select("message_id", "pos", mail.auth_clauses(F.col("raw")).alias("c"))
    claims = lower.select("message_id", "pos", F.inline("c.clauses")).where(F.col("method").isin("spf", "dkim", "dmarc")).select("message_id", "pos", "method", "result")
    conflicts = auth.trust_conflicts(claims, ["message_id"]).groupBy("message_id").agg(F.sum("lower_passes").alias("conflicts"))
    again = mail.duplicated(messages).groupBy("message_id").agg(F.count(F.lit(1)).alias("again"))
    arc = mail.arc(messages).select("message_id", F.coalesce(~F.col("chain_valid"), F.lit(False)).cast("long").alias("broken"))
    base_spf = auth.spf_sources(F.col("_spf"), F.col("rspf"), F.col("rspf_raw"))
    out = joined.withColumn("spf_sources", base_spf).join(by, "message_id", "left").join(conflicts, "message_id", "left").join(again, "message_id", "left").join(arc, "message_id", "left")
    zero = F.lit(0)
    disagree = auth.spf_disagreement(F.col("_spf.status"), F.col("rspf.result")).cast("long") + F.coalesce(~F.col("spf_sources.ips_agree"), F.lit(False)).cast("long")
    return out.select(
        "message_id", "spf", "dkim", "dmarc", "from_domain", auth.dmarc_aligned(F.coalesce("entries", F.array().cast("array<struct<mode:string,relevant:boolean,passed:boolean>>"))).alias("is_aligned"),
        F.coalesce("reply_elsewhere", F.lit(False)).alias("reply_elsewhere"),
        (F.coalesce("conflicts", zero) + F.coalesce("again", zero) + F.coalesce("broken", zero) + disagree).alias("warnings"),
        "spf_sources", (F.col("n_results") > 0).alias("_has_results"), F.col("rspf").isNotNull().alias("_has_spf"),
    ).withColumns({
        "has_auth": F.col("_has_results") | F.col("_has_spf"),
        "auth_overall": auth.overall(F.col("spf"), F.col("dkim"), F.col("dmarc"), F.col("is_aligned"), F.col("reply_elsewhere"), F.col("warnings")),
    }).drop("_has_results", "_has_spf")


def is_page(part: Column) -> Column:
    return part["is_file"] & (F.lower(part["mime"]).contains("html") | content.ending_of(part["filename"]).isin("htm", "html", "shtml", "svg"))


def page_destinations(good: DataFrame, core: DataFrame) -> DataFrame:
    """message_id, value, ord, is_mismatch, source, sending of every URL that an HTML body, an HTML file or a page hidden in one loads or sends to."""
    files = good.select("message_id", F.explode(F.transform(F.filter("parts", is_page), lambda p: F.decode(p["bytes"], "UTF-8"))).alias("page"))
    every = core.select("message_id", F.col("body_html").alias("page")).where("page <> ''").unionByName(files)
    hidden = pages.hidden(every, "message_id", "page").where("is_text").select(F.col("page_key").alias("message_id"), F.decode("content", "UTF-8").alias("page"))
    found = content.destinations(every.unionByName(hidden), ["message_id"], "page")
    return found.select(
        "message_id", F.col("url").alias("value"), F.lit(3_000_000).cast("long").alias("ord"), F.lit(False).alias("is_mismatch"), F.concat(F.lit("page: "), "use").alias("source"),
        F.col("use").isin(content.SENDING).alias("sending"),
    )


def hidden_risks(good: DataFrame, core: DataFrame) -> DataFrame:
    """message_id, page_risks: files and login forms that pages of a message carry encoded."""
    files = good.select("message_id", F.explode(F.transform(F.filter("parts", is_page), lambda p: F.decode(p["bytes"], "UTF-8"))).alias("page"))
    forms = files.where(content.has_password_form(F.col("page"))).select("message_id", iocs.risk("login-form", "high").alias("risk"))
    every = core.select("message_id", F.col("body_html").alias("page")).where("page <> ''").unionByName(files)
    layers = pages.hidden(every, "message_id", "page").select(
        F.col("page_key").alias("message_id"), F.when(~F.col("is_text"), iocs.risk("smuggled-file", "high")).when(F.col("password_form"), iocs.risk("login-form", "high")).alias("risk")
    ).where("risk IS NOT NULL")
    return forms.unionByName(layers).groupBy("message_id").agg(F.array_distinct(F.collect_list("risk")).alias("page_risks"))


def links(core: DataFrame) -> DataFrame:
    """message_id, value, ord, is_mismatch, source, unwrapped_from of every URL in a message."""
    unwrap = urls.decoder("unwrap")
    html = iocs.html_links(core, ["message_id"], "body_html")
    anchors = html.select("message_id", F.col("href").alias("value"), (F.col("ord") + 1_000_000).alias("ord"), iocs.is_deceptive(F.col("text"), F.coalesce(unwrap(F.col("href")), F.col("href"))).alias("is_mismatch"))
    plain = iocs.text_links(core, ["message_id"], "body_text").select("message_id", F.col("href").alias("value"), "ord", F.lit(False).alias("is_mismatch"))
    every = plain.unionByName(anchors).where(F.col("value").rlike(r"(?i)\A\s*(?:[a-z][a-z0-9+.\-]*://|javascript:|vbscript:|data:)"))
    once = every.groupBy("message_id", "value").agg(F.min("ord").alias("ord"), F.bool_or("is_mismatch").alias("is_mismatch")).withColumn("source", F.lit("body"))
    return iocs.unwrapped(once, ["message_id"], unwrap)


#: Links stand behind what the headers name.
AFTER_HEADERS = 1_000_000_000
#: Where an indicator stands, in order; a place is a long of ord, way (below) and source, so that the first one is a minimum.
SOURCES = ["From", "Reply-To", "Return-Path", "body", "X-Originating-IP", "Received", "Message-ID", "unwrapped", *[f"page: {use}" for use, _ in content.USES]]
#: How a value came in: named, linked, behind a link, used by a page (by rank). Of the ways of one URL the first wins.
NAMED, LINKED, UNWRAPPED, USED = 0, 1, 2, 3
ORD_BITS, LOW_BITS = 40, 5


def indicators(messages: DataFrame, core: DataFrame) -> DataFrame:
    """message_id, kind, value, ord, times, source, risks of every URL, address, IP and domain of a message, each once.

    The first place wins: X-Originating-IP before Received before the body. Domains are those of Message-ID, URLs and addresses.
    A core that keeps parts is read once, and all that a message holds is found in its own row; the only shuffle deals what was found by message.
    """
    wide = core if "parts" in core.columns else core.join(messages.select("message_id", "parts"), "message_id")
    none = F.array().cast("array<string>")
    at = {s: i for i, s in enumerate(SOURCES)}
    relays = F.flatten(F.transform(mail.values_of("received"), ips.sending_ips))
    issuer = F.lower(F.regexp_extract("id_header", r"@([^>\s]+)", 1))
    files = F.transform(F.filter("parts", is_page), lambda p: F.coalesce(F.decode(p["bytes"], "UTF-8"), F.lit("")))
    facts = wide.select(
        "message_id", F.col("sender.email").alias("_from"), F.col("reply_to.email").alias("_reply"), F.col("return_path.email").alias("_return"), iocs.emails_in(F.col("read_text")).alias("_emails"),
        ips.ips_in(F.col("originating")).alias("_origin"), relays.alias("_relays"), ips.ips_in(F.col("read_text")).alias("_ips"), issuer.alias("_issuer"),
        F.regexp_extract_all("body_text", F.lit(text.URL), F.lit(0)).alias("_plain"), iocs.links_in(F.col("body_html")).alias("_links"),
        F.concat(F.when(F.col("body_html") != "", F.array("body_html")).otherwise(none), files).alias("_seen"),
    )
    opened = facts.withColumns({
        "_plain_to": urls.each_decoded("unwrap", F.col("_plain")), "_links_to": urls.each_decoded("unwrap", F.transform("_links", lambda x: x["href"])),
        "_pages": F.concat("_seen", pages.hidden_pages(F.col("_seen"))),
    })

    def item(kind: str, value: Column, ord_: Column, way: Column | int, source: Column, mismatch: Column | None = None) -> Column:
        way = way if isinstance(way, Column) else F.lit(way)
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), ord_.cast("long").alias("ord"), way.cast("long").alias("way"), source.cast("long").alias("at"), (F.lit(False) if mismatch is None else mismatch).alias("is_mismatch"))

    def named(kind: str, source: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, none), lambda v: item(kind, v, F.lit(0), NAMED, F.lit(at[source])))

    listed = F.concat(
        named("email", "From", F.array("_from")), named("email", "Reply-To", F.array("_reply")), named("email", "Return-Path", F.array("_return")),
        named("email", "body", F.col("_emails")), named("ip", "X-Originating-IP", F.col("_origin")), named("ip", "Received", F.col("_relays")),
        named("ip", "body", F.col("_ips")), named("domain", "Message-ID", F.array("_issuer")),
    )
    placed = F.transform(listed, lambda x, i: x.withField("ord", i.cast("long")))

    def linked(values: Column, to: Column, first: int, mismatch) -> Column:
        """Links and what is behind them; other schemes are no links."""
        both = F.transform(values, lambda x, i: F.struct(x.alias("x"), F.get(to, i).alias("to"), (i + F.lit(AFTER_HEADERS + first)).alias("ord")))
        href = lambda b: b["x"]["href"]
        good = F.filter(both, lambda b: href(b).rlike(r"(?i)\A\s*(?:[a-z][a-z0-9+.\-]*://|javascript:|vbscript:|data:)"))
        own = F.transform(good, lambda b: item("url", href(b), b["ord"], LINKED, F.lit(at["body"]), mismatch(b)))
        return F.concat(own, F.transform(F.filter(good, lambda b: b["to"] != href(b)), lambda b: item("url", b["to"], b["ord"], UNWRAPPED, F.lit(at["unwrapped"]))))

    deceptive = lambda b: iocs.is_deceptive(iocs.shown_text(b["x"]), F.coalesce(b["to"], b["x"]["href"]))
    plain = linked(F.transform("_plain", lambda u: F.struct(u.alias("href"))), F.col("_plain_to"), 0, lambda b: F.lit(False))
    anchors = linked(F.col("_links"), F.col("_links_to"), 1_000_000, deceptive)
    used = F.flatten(F.transform("_pages", lambda p: F.transform(content.used_in(p), lambda u: item("url", u["url"], F.lit(AFTER_HEADERS + 3_000_000), u["rank"] + USED, u["rank"] + F.lit(at["unwrapped"] + 1)))))
    every = opened.select("message_id", F.inline(F.concat(placed, plain, anchors, used))).where("value <> ''").repartition("message_id")

    way = F.col("way")
    key = ["message_id", "kind", "value"]
    place = F.shiftleft(way, ORD_BITS + LOW_BITS) + F.shiftleft("ord", LOW_BITS) + F.col("at")
    values = every.groupBy(*key).agg(
        F.min(place).alias("place"), F.max("is_mismatch").alias("is_mismatch"),
        (F.sum(F.when(way == NAMED, 1).otherwise(0)) + F.max(F.when(way.isin(LINKED, UNWRAPPED), 1).otherwise(0)) + F.max(F.when(way >= USED, 1).otherwise(0))).alias("times"),
    )
    # among values of one domain the order alone decides
    low = (1 << LOW_BITS) - 1
    ord_ = F.shiftright("place", LOW_BITS).bitwiseAND(F.lit((1 << ORD_BITS) - 1))
    by_ord = F.shiftleft(ord_, 2 * LOW_BITS) + F.shiftleft(F.shiftright("place", ORD_BITS + LOW_BITS), LOW_BITS) + F.col("place").bitwiseAND(F.lit(low))
    own = F.struct(F.col("kind"), F.col("value"), F.col("times"), F.lit(0).alias("derived"))
    domain = F.struct(F.lit("domain").alias("kind"), iocs.domain_behind(F.col("kind"), F.col("value")).alias("value"), F.lit(0).cast("long").alias("times"), F.lit(1).alias("derived"))
    both = values.select("message_id", by_ord.alias("place"), "is_mismatch", F.inline(F.array(own, domain))).where("value <> ''")
    once = both.groupBy(*key).agg(F.min("place").alias("place"), F.max("is_mismatch").alias("is_mismatch"), (F.sum("times") + F.max("derived")).alias("times")).select(
        *key, F.shiftright("place", 2 * LOW_BITS).alias("ord"), "times", F.element_at(domains.literals(SOURCES), (F.col("place").bitwiseAND(F.lit(low)) + 1).cast("int")).alias("source"), "is_mismatch",
    )
    value, kind = F.col("value"), F.col("kind")
    risks = (
        F.when(kind == "url", iocs.url_risks(F.when(kind == "url", value), F.col("is_mismatch"), F.col("source"))).when(kind == "email", iocs.email_risks(value))
        .when(kind == "ip", iocs.ip_risks(value, F.col("source"))).otherwise(iocs.domain_risks(value))
    )
    return once.select(*key, "ord", "times", "source", risks.alias("risks"))


def analyse(messages: DataFrame, dictionary: DataFrame, own_domains: list[str] | None = None) -> DataFrame:
    """One verdict per readable message: scores, tier, attack types, findings, caveats."""
    core = mail.core(messages.where("error IS NULL"))
    good = messages.where("error IS NULL")
    auths = authentication(good, core)
    files = containers.inspect_files(good.select("message_id", "parts").join(core.select("message_id", "read_text"), "message_id"))
    named = F.concat(iocs.file_risks(F.col("name")), F.col("risks"))
    own_files = F.transform(F.filter("parts", lambda p: p["is_file"]), lambda p: content.file_findings(p["filename"], p["mime"], p["bytes"]))
    by_content = good.select("message_id", own_files.alias("content_risks"))
    file_facts = files.groupBy("message_id").agg(
        F.collect_list(named).alias("file_risks"), F.count(F.lit(1)).cast("int").alias("n_files"),
        F.array_join(F.collect_list("text"), "\n").alias("file_text"), F.flatten(F.collect_list("links")).alias("file_links"),
    )
    inner = file_facts.select("message_id", F.explode(F.array_distinct("file_links")).alias("value")).withColumns({"ord": F.lit(2_000_000).cast("long"), "is_mismatch": F.lit(False), "source": F.lit("file")})
    listed = links(core).unionByName(inner, allowMissingColumns=True).unionByName(page_destinations(good, core), allowMissingColumns=True)
    # a URL that a page also sends to is one indicator, flagged as such
    rest = ["is_mismatch", "source", "unwrapped_from"]
    once = listed.groupBy("message_id", "value").agg(F.min_by(F.struct(*rest), "ord").alias("_first"), F.bool_or(F.coalesce("sending", F.lit(False))).alias("sending"))
    every = once.select("message_id", "value", "sending", "_first.*")
    risky = every.withColumn("risks", iocs.url_risks(F.col("value"), F.col("is_mismatch"), F.col("source"), sending=F.col("sending"), own=own_domains))
    url_facts = risky.groupBy("message_id").agg(F.collect_list("risks").alias("url_risks"), F.count(F.lit(1)).cast("int").alias("n_urls"), F.collect_set(domains.host_of(F.col("value"))).alias("hosts"))
    hop = mail.hops(good)
    route = hop.groupBy("message_id").agg(F.max_by("ts", "hop").alias("delivered_s"), F.count(F.lit(1)).alias("n_hops"))
    sender = auth.sender_ip(hop, ["message_id"])
    joined = core.join(auths, "message_id").join(route, "message_id", "left").join(sender, "message_id", "left").join(url_facts, "message_id", "left").join(file_facts, "message_id", "left").join(by_content, "message_id").join(hidden_risks(good, core), "message_id", "left")
    none, empty = F.array().cast(RISK_LISTS), F.array().cast("array<string>")
    words = F.concat_ws("\n", "read_text", F.nullif("file_text", F.lit("")))
    matched = language.match(joined.withColumn("_words", words), "_words", dictionary)
    lines = F.when(F.trim("body_html") != "", text.html_lines(F.col("body_html"))).otherwise(F.col("body_text"))
    scanned = thread.scan(matched.withColumn("_lines", lines), "_lines").withColumns({
        "counts": language.summary(F.col("matches")), "url_risks": F.coalesce("url_risks", none), "file_risks": F.concat(F.coalesce("file_risks", none), F.coalesce("content_risks", none), F.when(F.col("page_risks").isNotNull(), F.array("page_risks")).otherwise(none)),
        "n_urls": F.coalesce("n_urls", F.lit(0)), "n_files": F.coalesce("n_files", F.lit(0)), "hosts": F.coalesce("hosts", empty),
        "anomalies": auth.anomalies(F.col("date_s"), F.col("delivered_s"), F.col("id_header"), F.col("from_domain"), F.col("has_reply_headers"), F.col("subject")),
    })
    found = F.concat(
        identity.findings(F.col("sender.name"), F.col("sender.email"), F.col("reply_to.email"), F.concat("to", "cc"), own_domains),
        thread.findings(F.col("subject"), F.col("has_reply_headers"), F.col("date_s"), F.col("sender.name"), F.col("sender.email"), F.col("quoted"), score.strong(F.col("counts"), "bec")),
        unicode_findings(F.col("subject"), F.col("sender.name"), F.col("read_text")),
    )
    judged = scanned.withColumn("findings", found).withColumn("password_form", content.has_password_form(F.col("body_html")))
    return verdict(judged)


def unicode_findings(subject: Column, name: Column, body: Column) -> Column:
    head = F.concat_ws(" ", subject, name)
    item = lambda i, s: F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"))
    return F.array_compact(F.array(
        F.when(text.has_bidi(head), item("unicode-bidi", "high")),
        F.when((F.size(text.invisible_in_words(head)) > 0) | (F.size(text.invisible_in_words(body)) >= 3), item("unicode-invisible", "medium")),
        F.when((F.size(text.mixed_script_words(head)) > 0) | (F.size(text.mixed_script_words(body)) >= 3), item("unicode-mixed-script", "high")),
    ))


def verdict(judged: DataFrame) -> DataFrame:
    col = F.col
    anomaly = F.aggregate("anomalies", F.lit(0), lambda a, x: a + F.when(x["severity"] == "high", 12).when(x["severity"] == "medium", 6).otherwise(3))
    hosts = F.transform("hosts", iocs.domain_risks)
    emails = F.array(iocs.email_risks(col("sender.email")), iocs.email_risks(col("reply_to.email")))
    parts = judged.withColumns({
        "auth": score.clamp(auth.auth_points(col("spf"), col("dkim"), col("dmarc"), F.coalesce("is_aligned", F.lit(None).cast("boolean")), col("reply_elsewhere"), col("warnings"), anomaly, identity.points(col("findings")))).cast("long"),
        "iocs": score.clamp(score.ioc_points(col("url_risks"), col("file_risks"), hosts, emails, col("password_form"))).cast("long"),
        "language": score.clamp(score.language_points(language.category_scores(col("counts")))).cast("long"),
    })
    risks = F.flatten(F.concat("url_risks", "file_risks"))
    callback = F.exists("matches", lambda m: (m["category"] == "social") & (m["tier"] == "strong") & m["phrase"].rlike(r"\d[\d\s().-]{7,}\d"))
    total = parts.withColumn("score", score.floored(score.weighted(col("auth"), col("iocs"), col("language")), risks, col("counts"), col("findings"), col("password_form")))
    types = F.array_distinct(F.transform(risks, lambda r: r["type"]))
    wording = F.transform(F.map_keys("counts"), lambda k: F.concat(F.lit("wording-"), k))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    why = score.reasons(score.decisive(types, col("counts")), score.status_reasons(col("spf"), col("dkim"), col("dmarc"), col("is_aligned"), col("reply_elsewhere")), ids("anomalies"), ids("findings"), types, wording)
    return total.select(
        "message_id", "name", "subject", "sender", "spf", "dkim", "dmarc", "is_aligned", "auth_overall", "public_ip", col("spf_sources.ip").alias("spf_ip"),
        (col("spf_sources.ip") == col("public_ip")).alias("spf_matches_sender"), why.alias("reasons"), summary.origin_ip(col("public_ip"), mail.values_of("received")).alias("origin_ip"), "auth", "iocs", "language", "score", score.tier(col("score")).alias("tier"),
        score.attack_types(col("counts"), col("url_risks"), col("file_risks"), col("n_urls"), col("n_files"), col("findings"), col("dmarc"), col("is_aligned"), col("password_form"), callback).alias("attack_types"),
        "findings", "anomalies", "counts", score.caveats(col("subject"), col("has_auth"), F.coalesce("n_hops", F.lit(0)) > 0, col("counts")).alias("caveats"),
    )
