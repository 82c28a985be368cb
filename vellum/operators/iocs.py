"""Indicators: extraction from text, HTML and headers, order-preserving de-duplication, risk flags.

A table of indicators has (key columns, kind, ord, value, source); flags are columns computed from a value,
so they need no second pass when more indicators are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import domains, fixed, ips, text

ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
RESOURCE = r"""(?i)<(?:img|script|iframe|embed|source|input|body|table|td)\b[^>]*?\b(?:src|background)\s*=\s*["'](https?://[^"']+)["']"""
#: Services that stolen data is sent to; whether any use of one counts.
EXFIL = [
    (r"api\.telegram\.org/bot", "Telegram bot", True),
    (r"discord(?:app)?\.com/api/webhooks", "Discord webhook", True),
    (r"hooks\.slack\.com/services", "Slack webhook", True),
    (r"formspree\.io", "Formspree", True),
    (r"formsubmit\.co", "FormSubmit", True),
    (r"getform\.io", "Getform", True),
    (r"submit-form\.com", "Submit-Form", True),
    (r"api\.emailjs\.com", "EmailJS", True),
    (r"webhook\.site", "webhook.site", True),
    (r"pipedream\.net", "Pipedream", True),
    (r"requestbin|\.requestcatcher\.com", "request bin", True),
    (r"script\.google\.com/macros", "Google Apps Script", False),
    (r"\.ngrok(?:-free)?\.(?:io|app|dev)", "ngrok tunnel", False),
    (r"\.workers\.dev", "Cloudflare Worker", False),
]
RISK = "array<struct<type:string,level:string>>"


def decode_entities(c: Column) -> Column:
    """The usual named references; &amp; last."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("sol", "/"), ("colon", ":"), ("period", "."), ("commat", "@"), ("quest", "?"), ("equals", "="), ("#39", "'"), ("#x27", "'"), ("amp", "&")):
        c = F.regexp_replace(c, f"(?i)&{name};", sign)
    return c


def links_in(h: Column) -> Column:
    """array of struct(href, text, is_resource) of every anchor and remote resource of a page, anchors first."""
    anchors = F.transform(
        F.arrays_zip(F.regexp_extract_all(h, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(h, F.lit(ANCHOR), F.lit(2)).alias("text")),
        lambda a: F.struct(decode_entities(F.trim(a["href"])).alias("href"), text.strip_html(a["text"]).alias("text"), F.lit(False).alias("is_resource")),
    )
    resources = F.transform(
        F.regexp_extract_all(h, F.lit(RESOURCE), F.lit(1)),
        lambda u: F.struct(decode_entities(F.trim(u)).alias("href"), F.lit("").alias("text"), F.lit(True).alias("is_resource")),
    )
    return F.concat(anchors, resources)


def shown_text(link: Column) -> Column:
    """What a link shows: its text, or where an anchor has none its destination."""
    return F.when((link["text"] == "") & ~link["is_resource"], link["href"]).otherwise(link["text"])


def html_links(rows: DataFrame, key: list[str], html: str) -> DataFrame:
    """key, ord, href, text, is_resource of every anchor and remote resource, anchors first."""
    each = rows.select(*key, F.posexplode(links_in(F.col(html))).alias("ord", "link"))
    return each.select(*key, F.col("ord").cast("long").alias("ord"), F.col("link.href").alias("href"), shown_text(F.col("link")).alias("text"), F.col("link.is_resource").alias("is_resource"))


def text_links(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    return rows.select(*key, F.posexplode(F.regexp_extract_all(column, F.lit(text.URL), F.lit(0))).alias("ord", "href")).withColumn("ord", F.col("ord").cast("long"))


def shown_host(value: Column) -> Column:
    """The host that a text shows, where the text looks like a link."""
    t = F.trim(value)
    bare = t.rlike(r"(?i)\A(www\.)?[a-z0-9-]+(\.[a-z0-9-]+)+(/\S*)?\z")
    return F.when(t.rlike(r"(?i)\Ahttps?://"), domains.host_of(t)).when(bare, domains.host_of(F.concat(F.lit("http://"), t)))


def is_deceptive(shown: Column, href: Column) -> Column:
    """The text looks like a link to another organisation than the destination (pass an unwrapped one)."""
    differs = ~domains.org_domain(shown_host(shown)).eqNullSafe(domains.org_domain(shown_host(href)))
    return F.coalesce(~href.rlike(r"(?i)\A(?:mailto|tel|#)") & shown_host(shown).isNotNull() & shown_host(href).isNotNull() & differs, F.lit(False))


def emails_in(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(text.EMAIL), F.lit(0)), F.lower))


def from_text(rows: DataFrame, key: list[str], column: str, source: str = "body") -> DataFrame:
    """key, kind, ord, value, source of urls, e-mail addresses and IPs in a text, by one pass over it."""
    c = F.col(column)

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("ord"), v.alias("value")))

    urls = F.array_distinct(F.regexp_extract_all(c, F.lit(text.URL), F.lit(0)))
    found = F.concat(named("url", urls), named("email", emails_in(c)), named("ip", ips.ips_in(c)))
    return rows.select(*key, F.inline(found)).withColumn("source", F.lit(source))


def first_wins(rows: DataFrame, key: list[str], value: str = "value", order: str = "ord") -> DataFrame:
    """One row per key and value: the earliest, with how often it was seen and every source in order.

    A partial aggregate, so a value that holds many rows is combined before it is shuffled.
    """
    rest = [c for c in rows.columns if c not in (*key, value, order)]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), order) if rest else None
    aggs = [F.min(order).alias(order), F.count(F.lit(1)).alias("times"), *([first.alias("_first")] if rest else [])]
    out = rows.groupBy(*key, value).agg(*aggs)
    return out.select(*key, value, order, "times", *[F.col(f"_first.{c}").alias(c) for c in rest])


def risk(kind: str, level: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(level).alias("level"))


def url_risks(url: Column, mismatch: Column | None = None, source: Column | None = None, credential: Column | None = None, sending: Column | None = None, own: list[str] | None = None) -> Column:
    """Risks of a URL, in fixed order. Its parts are bound once, as a struct that the tests read."""
    auth = domains.authority(url)
    raw = F.regexp_replace(F.lower(auth), r"\A.*@", "")
    path = F.regexp_extract(url, r"\A\s*[A-Za-z][A-Za-z0-9+.\-]*:[/\\]{2}[^/?#\\]*([^?#]*)", 1)
    given = {"mismatch": mismatch, "source": source, "credential": credential, "sending": sending}
    parts = F.struct(
        url.alias("url"), F.lower(F.regexp_extract(url, r"\A\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("scheme"), auth.alias("auth"),
        F.regexp_replace(raw, r":[0-9]*\z", "").alias("host"), F.regexp_extract(raw, r":([0-9]+)\z", 1).alias("port"),
        F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1)).alias("ending"),
        domains.lookalike(F.regexp_replace(raw, r":[0-9]*\z", ""), own).isNotNull().alias("alike"),
        *[c.alias(name) for name, c in given.items() if c is not None],
    )
    return F.get(F.transform(F.array(parts), lambda u: _judged(u, *[u[n] if c is not None else None for n, c in given.items()])), F.lit(0))


def _judged(u: Column, mismatch: Column | None, source: Column | None, credential: Column | None, sending: Column | None) -> Column:
    url, scheme, auth, host, port, ending, alike = (u[name] for name in ("url", "scheme", "auth", "host", "port", "ending", "alike"))
    web = auth.isNotNull()
    kinds = [
        (F.coalesce(source, F.lit("")).startswith("QR code") if source is not None else None, "qr-link", "medium"),
        (scheme.isin("javascript", "vbscript", "data"), "script-url", "high"),
        (web & auth.rlike(r"\A[^@:]+(:[^@]*)?@"), "credentials-url", "high"),
        (web & (port != "") & ~port.isin("80", "443"), "odd-port", "medium"),
        (web & ending.isin(fixed.PROGRAM_URLS), "direct-download", "high"),
        (web & ending.isin(fixed.ARCHIVE_URLS), "direct-download", "medium"),
        (web & F.element_at(F.split(host, r"\."), -1).isin(fixed.RISKY_TLDS), "risky-tld", "medium"),
        (web & alike, "brand-lookalike", "high"),
        (web & domains.under(host, fixed.SHORTENERS), "url-shortener", "medium"),
        (web & host.contains("xn--"), "punycode", "high"),
        (web & (ips.is_ipv4(host) | ips.is_ip(F.regexp_replace(host, r"\A\[|\]\z", ""))), "ip-url", "high"),
        (web & exfil_service(url, sending).isNotNull(), "exfil-endpoint", "high"),
        (web & credential if credential is not None else None, "credential-form", "high"),
        (web & mismatch if mismatch is not None else None, "mismatch", "high"),
    ]
    flags = [F.when(F.coalesce(test, F.lit(False)), risk(kind, level)) for test, kind, level in kinds if test is not None]
    return F.array_compact(F.array(*flags))


def exfil_service(url: Column, sending: Column | None = None) -> Column:
    """The data-stealing service that a URL belongs to; those with honest uses count only where the page sends to them."""
    sends = F.lit(False) if sending is None else F.coalesce(sending, F.lit(False))
    out = F.lit(None).cast("string")
    for pattern, name, always in reversed(EXFIL):
        hit = url.rlike("(?i)" + pattern)
        out = F.when(hit if always else hit & sends, name).otherwise(out)
    return out


def domain_risks(host: Column) -> Column:
    return F.array_compact(F.array(F.when(host.contains("xn--"), risk("punycode", "high"))))


def email_risks(address: Column) -> Column:
    return F.array_compact(F.array(F.when(domains.under(domains.domain_of(address), fixed.DISPOSABLE), risk("disposable", "medium"))))


def ip_risks(ip: Column, source: Column) -> Column:
    """An address from X-Originating-IP is medium; a private one is only labelled."""
    return F.array_compact(F.array(F.when(F.coalesce(source.contains("X-Originating"), F.lit(False)), risk("x-originating", "medium"))))


def file_risks(name: Column) -> Column:
    """Risks that a file's name shows: a turned name, two endings, a program's ending."""
    real = text.strip_controls(name)
    doubled = "|".join(e.replace(".", r"\.") for e in fixed.DOUBLE_ENDINGS)
    ending = F.lower(F.regexp_extract(real, r"\.([^.]+)\z", 1))
    return F.array_compact(F.array(
        F.when(text.has_bidi(name), risk("rtlo-name", "high")),
        F.when(F.coalesce(real.rlike(rf"(?i)\.(?:{doubled})"), F.lit(False)), risk("double-extension", "high")),
        F.when(F.coalesce(ending.isin(fixed.RISKY_FILES), F.lit(False)), risk("risky-extension", "high")),
    ))


def unwrapped(urls: DataFrame, key: list[str], unwrap, value: str = "value") -> DataFrame:
    """urls with the destinations hidden in redirects appended, where a message does not list them yet."""
    found = urls.withColumn("_to", unwrap(F.col(value))).where(F.col("_to").isNotNull() & (F.col("_to") != F.col(value)))
    new = found.select(*key, F.col("_to").alias(value), F.col(value).alias("unwrapped_from"), "ord").dropDuplicates([*key, value])
    fresh = new.join(urls.select(*key, value), [*key, value], "left_anti")
    return urls.withColumn("unwrapped_from", F.lit(None).cast("string")).unionByName(fresh, allowMissingColumns=True)


def domain_behind(kind: Column, value: Column) -> Column:
    """The domain of a url or an address; null for IPs and names without a dot."""
    host = F.when(kind == "url", domains.host_of(value)).when(kind == "email", domains.domain_of(value))
    return F.get(F.transform(F.array(host), lambda h: F.when(h.contains(".") & ~ips.is_ip(h), h)), F.lit(0))


def collect_domains(iocs: DataFrame, key: list[str]) -> DataFrame:
    """key, value, ord, source of the domains behind urls and addresses; IPs and names without a dot drop out."""
    named = iocs.select(*key, domain_behind(F.col("kind"), F.col("value")).alias("value"), "ord", "source").where("value IS NOT NULL")
    return first_wins(named, key)
