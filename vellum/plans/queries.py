"""The registered queries of the mail engine, each with DuckDB SQL that was written from the operator's definition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import domains, fixed, ips, pasted, text, urls
from vellum.operators import auth, content, correlate, export, identity, iocs, language, pages, score, summary
from vellum.plans import analysis
from vellum.plans import messages as mail
from vellum.plans.messages import ctes
from vellum.sources import mail as source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def in_list(items: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


# --- DuckDB macros as text ------------------------------------------------------------------------

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
QUADS = rf"list_filter(regexp_split_to_array({{0}}, '[^0-9.]+'), lambda x: regexp_full_match(x, '{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}'))"


def sql_quads(column: str) -> str:
    return QUADS.replace("{0}", column)


def sql_private(ip: str) -> str:
    a, b = (f"CAST(split_part({ip}, '.', {i}) AS INT)" for i in (1, 2))
    return f"({a} IN (0, 10, 127) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168) OR ({a} = 169 AND {b} = 254) OR ({a} = 100 AND {b} BETWEEN 64 AND 127) OR {a} >= 224)"


def sql_org(d: str) -> str:
    parts = f"string_split(lower({d}), '.')"
    two = f"array_to_string({parts}[-2:], '.')"
    return f"CASE WHEN len({parts}) <= 2 THEN lower({d}) WHEN {two} IN {in_list(fixed.SUFFIXES)} THEN array_to_string({parts}[-3:], '.') ELSE {two} END"


def sql_host(u: str) -> str:
    raw = rf"regexp_extract({u}, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1)"
    return rf"nullif(regexp_replace(regexp_replace(regexp_replace(lower({raw}), '^.*@', ''), ':[0-9]*$', ''), '^www\.', ''), '')"


def sql_status(c: str) -> str:
    return f"CASE WHEN lower({c}) IN {in_list(fixed.AUTH_STATUSES)} THEN lower({c}) ELSE 'unknown' END"


def sql_points(c: str, table: dict[str, int]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


def sql_skeleton(c: str) -> str:
    return f"regexp_replace(replace(replace(translate(lower({c}), '{fixed.CONFUSABLE}', '{fixed.LOOKS_LIKE}'), 'rn', 'm'), 'vv', 'w'), '[^a-z0-9]', '', 'g')"


BRAND_ROWS = ", ".join(f"({i}, '{n}', ['{"', '".join(ds)}'])" for i, (n, ds) in enumerate(fixed.BRANDS))
GENUINE = in_list(sorted({d for _, ds in fixed.BRANDS for d in ds}))
SQL_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
SQL_ANCHOR = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["''][^>]*>"""

# --- documents ------------------------------------------------------------------------------------


@query("doc_ipv4", f"SELECT doc_id, unnest(list_distinct({sql_quads('text')})) AS ip FROM documents")
def doc_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.filter(F.regexp_extract_all("text", F.lit(ips.V4_IN_TEXT), F.lit(1)), ips.is_ipv4)
    return read(spark, sf_dir, "documents", "doc_id", "text").where(F.col("text").rlike("[0-9][.][0-9]")).select("doc_id", F.explode(F.array_distinct(four)).alias("ip"))


@query("doc_ip_private", f"""WITH q AS (SELECT doc_id, unnest(list_distinct({sql_quads('text')})) AS ip FROM documents)
SELECT ip, {sql_private('ip')} AS is_private, count(*) AS documents FROM q GROUP BY ALL""")
def doc_ip_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_ipv4(spark, sf_dir).groupBy("ip").agg(F.count(F.lit(1)).alias("documents")).withColumn("is_private", ips.is_private(F.col("ip")))


@query("doc_emails", f"SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{SQL_EMAIL}'), lambda x: lower(x)))) AS email FROM documents")
def doc_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").where(F.col("text").contains("@")).select("doc_id", F.explode(iocs.emails_in(F.col("text"))).alias("email"))


@query("doc_shared_ips", f"""WITH q AS (SELECT doc_id, unnest(list_distinct({sql_quads('text')})) AS ip FROM documents)
SELECT 'ip' AS type, ip AS value, count(DISTINCT doc_id) AS n, min(doc_id) AS first_seen, CAST(90 AS BIGINT) AS weight FROM q GROUP BY ip HAVING count(DISTINCT doc_id) > 1""")
def doc_shared_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = doc_ipv4(spark, sf_dir).select("doc_id", F.lit("ip").alias("type"), F.col("ip").alias("value"))
    return correlate.shared(found, "doc_id")


def _lang_sql() -> str:
    shares = [
        f"len(list_filter(w, lambda x: x IN {in_list(listed)})) / greatest(len(w), 1) AS s{i}" for i, (listed, _) in enumerate(fixed.STOP_WORDS.values())
    ]
    over = [f"CASE WHEN s{i} > {least} THEN s{i} ELSE 0 END AS t{i}" for i, (_, least) in enumerate(fixed.STOP_WORDS.values())]
    top = "greatest(t0, t1, t2, t3)"
    cases = " ".join(f"WHEN t{i} = {top} THEN '{lang}'" for i, lang in enumerate(fixed.STOP_WORDS))
    return f"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM documents),
s AS (SELECT *, {', '.join(shares)} FROM w), t AS (SELECT *, {', '.join(over)} FROM s),
detected AS (SELECT doc_id, lang, CASE WHEN len(w) < {fixed.FEWEST_WORDS} OR {top} <= 0 THEN 'unknown' {cases} END AS detected FROM t)"""


@query("doc_lang_detect", _lang_sql() + " SELECT doc_id, detected FROM detected")
def doc_lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return docs.select("doc_id", text.detect_language(F.coalesce("text", F.lit(""))).alias("detected"))


@query("doc_lang_confusion", _lang_sql() + " SELECT lang, detected, count(*) AS n FROM detected GROUP BY ALL")
def doc_lang_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "text", "lang")
    return docs.groupBy("lang", text.detect_language(F.coalesce("text", F.lit(""))).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


@query("doc_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL")
def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", content.hashes(F.col("text").cast("binary")).alias("h")).select("doc_id", "h.*")


# --- pages ----------------------------------------------------------------------------------------

_DECODED = "trim(h)"
for _name, _sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("sol", "/"), ("colon", ":"), ("period", "."), ("commat", "@"), ("quest", "?"), ("equals", "="), ("#39", "''"), ("#x27", "''"), ("amp", "&")):
    _DECODED = f"regexp_replace({_DECODED}, '&{_name};', '{_sign}', 'gi')"
_LINKS = f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{SQL_ANCHOR}', 1)) AS h FROM pages),
links AS (SELECT page_id, url, {_DECODED} AS href FROM l)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iocs.html_links(read(spark, sf_dir, "pages", "page_id", "url", "html"), ["page_id", "url"], "html").where("NOT is_resource")


@query("page_links", _LINKS + " SELECT page_id, href, count(*) AS times FROM links GROUP BY ALL")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("times"))


@query("page_link_counts", _LINKS + " SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM links GROUP BY page_id")
def page_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("href").alias("targets"))


@query("page_shared_links", _LINKS + " SELECT 'url' AS type, lower(href) AS value, count(DISTINCT page_id) AS n, min(page_id) AS first_seen, CAST(80 AS BIGINT) AS weight FROM links WHERE href <> '' GROUP BY ALL HAVING count(DISTINCT page_id) > 1")
def page_shared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.shared(correlate.indicators(_links(spark, sf_dir), "page_id", {"url": F.col("href")}), "page_id")


@query("page_url_parts", rf"""SELECT page_id, regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*):', 1) AS scheme, {sql_host('url')} AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, contains(url, '%') AS is_encoded FROM pages""")
def page_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id", F.regexp_extract(F.lower(u), r"^([a-z][a-z0-9+.\-]*):", 1).alias("scheme"), domains.host_of(u).alias("host"),
        F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1).alias("path"), u.contains("%").alias("is_encoded"),
    )


@query("page_org_domain", f"WITH h AS (SELECT page_id, {sql_host('url')} AS host FROM pages) SELECT {sql_org('host')} AS org, count(*) AS pages, count(DISTINCT host) AS hosts FROM h GROUP BY 1")
def page_org_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = read(spark, sf_dir, "pages", "url").select(domains.host_of(F.col("url")).alias("host"))
    return host.groupBy(domains.org_domain(F.col("host")).alias("org")).agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("hosts"))


@query("page_host_campaign", f"""WITH h AS (SELECT page_id, {sql_host('url')} AS value FROM pages)
SELECT 'urlDomain' AS type, value, count(DISTINCT page_id) AS n, min(page_id) AS first_seen, CAST(70 AS BIGINT) AS weight FROM h WHERE value IS NOT NULL GROUP BY value HAVING count(DISTINCT page_id) > 1""")
def page_host_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    return correlate.shared(correlate.indicators(pages, "page_id", {"urlDomain": domains.host_of(F.col("url"))}), "page_id")


@query("page_text", r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g') AS t FROM pages),
u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&nbsp;', ' ', 'gi'), '&#39;', '''', 'g'), '&#x27;', '''', 'gi'), '&amp;', '&', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '"', 'gi') AS t FROM t),
v AS (SELECT page_id, trim(regexp_replace(t, '[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+', ' ', 'g')) AS t FROM u)
SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM v""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "pages", "page_id", "html").select("page_id", text.strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query("page_defang", r"""SELECT page_id, concat(replace(regexp_extract(lower(url), '^([a-z]+)://', 1), 'http', 'hxxp'), '[://]',
  replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '.', '[.]')) AS defanged FROM pages""")
def page_defang(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = text.defang_url(F.col("url"))
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.regexp_extract(whole, r"^([a-z]+\[://\][^/?#]*)", 1).alias("defanged"))


# --- messages -------------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mail.relation(spark, sf_dir, "messages")
    status = {k: text.normal_status(F.coalesce(k, F.lit("unknown"))) for k in ("spf", "dkim", "dmarc")}
    return m.withColumns(status)


M_SQL = ctes("messages") + f""", m AS (SELECT * REPLACE ({', '.join(f"{sql_status(f'coalesce({k}, {chr(39)}unknown{chr(39)})')} AS {k}" for k in ('spf', 'dkim', 'dmarc'))}) FROM messages)"""
ALIGN = lambda d: f"CASE WHEN {d} IS NULL THEN NULL WHEN {d} = from_domain THEN 'strict' WHEN {sql_org(d)} = {sql_org('from_domain')} THEN 'relaxed' ELSE 'none' END"
A_SQL = M_SQL + f""", a0 AS (SELECT *, {ALIGN('return_path_domain')} AS spf_mode, {ALIGN('from_domain')} AS dkim_mode, {ALIGN('reply_to_domain')} AS reply_mode FROM m),
a AS (SELECT *, coalesce(return_path_domain IS NOT NULL AND spf_mode <> 'none' AND spf = 'pass', FALSE) OR dkim = 'pass' AS is_aligned, coalesce(reply_mode = 'none', FALSE) AS reply_elsewhere FROM a0)"""


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    own = F.col("from_domain")
    mode = {"spf_mode": auth.alignment(own, F.col("return_path_domain")), "dkim_mode": auth.alignment(own, own), "reply_mode": auth.alignment(own, F.col("reply_to_domain"))}
    m = m.withColumns(mode)
    entry = lambda mode, passed: F.struct(F.col(mode).alias("mode"), F.lit(True).alias("relevant"), passed.alias("passed"))
    entries = F.array_compact(F.array(F.when(F.col("return_path_domain").isNotNull(), entry("spf_mode", F.col("spf") == "pass")), entry("dkim_mode", F.col("dkim") == "pass")))
    return m.withColumns({"is_aligned": auth.dmarc_aligned(entries), "reply_elsewhere": F.coalesce(F.col("reply_mode") == "none", F.lit(False))})


@query("msg_auth_status", M_SQL + " SELECT spf, dkim, dmarc, count(*) AS n FROM m GROUP BY ALL")
def msg_auth_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).groupBy("spf", "dkim", "dmarc").agg(F.count(F.lit(1)).alias("n"))


_AUTH_POINTS = f"""greatest(0, {sql_points('spf', fixed.SPF_POINTS)} + {sql_points('dkim', fixed.DKIM_POINTS)} + {sql_points('dmarc', fixed.DMARC_POINTS)}
 + CASE WHEN is_aligned THEN 0 ELSE 30 END + CASE WHEN reply_elsewhere THEN 8 ELSE 0 END - CASE WHEN spf = 'pass' AND dkim = 'pass' AND dmarc = 'pass' AND is_aligned THEN 10 ELSE 0 END)"""


def _points(m: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return m.withColumn("points", auth.auth_points(F.col("spf"), F.col("dkim"), F.col("dmarc"), F.col("is_aligned"), F.col("reply_elsewhere"), zero, zero, zero).cast("long"))


@query("msg_auth_points", A_SQL + f" SELECT message_id, CAST({_AUTH_POINTS} AS BIGINT) AS points FROM a")
def msg_auth_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(_aligned(spark, sf_dir)).select("message_id", "points")


@query("msg_alignment", A_SQL + " SELECT message_id, spf_mode, dkim_mode, reply_mode, is_aligned FROM a")
def msg_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("message_id", "spf_mode", "dkim_mode", "reply_mode", "is_aligned")


@query("msg_alignment_entries", A_SQL + """ SELECT source, mode, relevant, passed, count(*) AS n FROM (
  SELECT 'Return-Path' AS source, spf_mode AS mode, TRUE AS relevant, spf = 'pass' AS passed FROM a WHERE return_path_domain IS NOT NULL
  UNION ALL SELECT 'DKIM', dkim_mode, TRUE, dkim = 'pass' FROM a
  UNION ALL SELECT 'Reply-To', reply_mode, FALSE, FALSE FROM a WHERE reply_to_domain IS NOT NULL) GROUP BY ALL""")
def msg_alignment_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir).withColumns({"envelope_domain": F.col("return_path_domain"), "dkim_domains": F.array("from_domain")})
    return auth.aligned_entries(m, ["message_id"]).groupBy("source", "mode", "relevant", "passed").agg(F.count(F.lit(1)).alias("n"))


@query("msg_hops_backwards", ctes("hops") + f""", h AS (SELECT *, lead(ts) OVER (PARTITION BY message_id ORDER BY hop) AS next_ts, count(*) OVER (PARTITION BY message_id) AS hops FROM hops)
SELECT message_id, hop, coalesce(next_ts < ts - 60, FALSE) AS backwards, hop = 1 AND hops > 1 AND {sql_private('ip')} AS private_origin FROM h
WHERE coalesce(next_ts < ts - 60, FALSE) OR (hop = 1 AND hops > 1 AND {sql_private('ip')})""")
def msg_hops_backwards(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = auth.hop_warnings(mail.relation(spark, sf_dir, "hops"), ["message_id"])
    return h.where("backwards OR private_origin").select("message_id", "hop", "backwards", "private_origin")


@query("msg_sender_ip", ctes("hops") + f""", h AS (SELECT *, NOT {sql_private('ip')} AS routable FROM hops),
g AS (SELECT message_id, arg_min(ip, hop) AS origin_ip, min(hop) FILTER (routable) AS public_hop, arg_min(ip, hop) FILTER (routable) AS public_ip, min(hop) AS f FROM h GROUP BY message_id)
SELECT g.message_id, origin_ip, coalesce(public_hop, 0) AS public_hop, public_ip, (SELECT count(*) FROM h WHERE h.message_id = g.message_id AND NOT routable AND hop > f AND (public_hop IS NULL OR hop < public_hop)) AS private_skipped FROM g""")
def msg_sender_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth.sender_ip(mail.relation(spark, sf_dir, "hops"), ["message_id"]).withColumn("public_hop", F.coalesce("public_hop", F.lit(0)))


@query("msg_trust_conflict", ctes("claims") + f""", c AS (SELECT message_id, pos, method, {sql_status('result')} AS status FROM claims)
SELECT t.message_id, t.method, t.status AS recorded, count(*) AS lower_passes FROM c t JOIN c l ON l.message_id = t.message_id AND l.method = t.method AND l.pos > 0 AND l.status = 'pass'
WHERE t.pos = 0 AND t.status <> 'pass' GROUP BY ALL""")
def msg_trust_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth.trust_conflicts(mail.relation(spark, sf_dir, "claims"), ["message_id"])


_LOOK_SQL = ctes("messages") + f""", hosts AS (SELECT DISTINCT from_domain AS h FROM messages), brand AS (SELECT * FROM (VALUES {BRAND_ROWS}) v(i, name, domains)),
x AS (SELECT h, {sql_org('h')} AS org FROM hosts), y AS (SELECT *, split_part(org, '.', 1) AS n FROM x), z AS (SELECT *, {sql_skeleton('n')} AS s, {sql_skeleton("regexp_replace(h, '[.][a-z.]+$', '')")} AS flat FROM y WHERE org NOT IN {GENUINE}),
hits AS (SELECT h, name, i, CASE WHEN s = name AND n <> name THEN 0
  WHEN length(name) >= 5 AND levenshtein(s, name) BETWEEN 1 AND CASE WHEN length(name) >= 8 THEN 2 ELSE 1 END THEN 1
  WHEN length(name) >= 4 AND flat <> name AND list_contains(list_transform(regexp_split_to_array(h, '[._-]'), lambda w: {sql_skeleton('w')}), name) THEN 2 END AS rank FROM z, brand),
best AS (SELECT h, arg_min(name, rank * 100 + i) AS brand, min(rank) AS rank FROM hits WHERE rank IS NOT NULL GROUP BY h)"""


@query("msg_lookalike", _LOOK_SQL + " SELECT message_id, from_domain, brand, ['confusable', 'typosquat', 'contains'][rank + 1] AS kind FROM messages JOIN best ON from_domain = h")
def msg_lookalike(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mail.relation(spark, sf_dir, "messages").select("message_id", "from_domain", domains.lookalike(F.col("from_domain")).alias("look"))
    return m.where("look IS NOT NULL").select("message_id", "from_domain", "look.brand", "look.kind")


_IDENTITY_SQL = _LOOK_SQL + f""", named AS (SELECT display_name AS d, arg_min(name, i) AS name, arg_min(domains, i) AS domains FROM (SELECT DISTINCT display_name FROM messages WHERE display_name IS NOT NULL), brand
  WHERE length(name) >= 4 AND contains({sql_skeleton('display_name')}, name) GROUP BY display_name),
f AS (SELECT 'display-name-address' AS id, 'high' AS severity FROM messages WHERE contains(display_name, '@') AND {sql_org("split_part(display_name, '@', 2)")} <> {sql_org('from_domain')}
 UNION ALL SELECT 'display-name-brand', 'high' FROM messages JOIN named ON display_name = d WHERE NOT list_contains(domains, {sql_org('from_domain')})
 UNION ALL SELECT concat('lookalike-', ['confusable', 'typosquat', 'contains'][rank + 1]), 'high' FROM messages JOIN best ON from_domain = h
 UNION ALL SELECT 'replyto-freemail', 'medium' FROM messages WHERE {sql_org('reply_to_domain')} IN {in_list(fixed.FREE_MAIL)} AND {sql_org('reply_to_domain')} <> {sql_org('from_domain')})
SELECT id, severity, count(*) AS n FROM f GROUP BY ALL"""


@query("msg_identity_findings", _IDENTITY_SQL)
def msg_identity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identity(mail.relation(spark, sf_dir, "messages")).select("message_id", F.explode("found").alias("f")).groupBy("f.id", "f.severity").agg(F.count(F.lit(1)).alias("n"))


def _identity(m: DataFrame) -> DataFrame:
    address = F.concat("local_part", F.lit("@"), "from_domain")
    reply = F.concat("local_part", F.lit("@"), "reply_to_domain")
    to = F.array(F.concat(F.lit("someone@"), F.col("to_domain")))
    return m.withColumn("found", identity.findings(F.col("display_name"), address, reply, to))


@query("msg_freemail_semi", ctes("messages") + f""" SELECT message_id, reply_to_domain FROM messages
WHERE {sql_org('reply_to_domain')} IN {in_list(fixed.FREE_MAIL)} AND {sql_org('reply_to_domain')} <> {sql_org('from_domain')}""")
def msg_freemail_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mail.relation(spark, sf_dir, "messages").withColumn("org", domains.org_domain(F.col("reply_to_domain")))
    free = spark.createDataFrame([(d,) for d in fixed.FREE_MAIL], "org string")
    return m.where(F.col("org") != domains.org_domain(F.col("from_domain"))).join(F.broadcast(free), "org", "left_semi").select("message_id", "reply_to_domain")


@query("msg_outsider_anti", ctes("messages") + f""", seen AS (SELECT DISTINCT {sql_org('to_domain')} AS org FROM messages)
SELECT {sql_org('from_domain')} AS org, count(*) AS n FROM messages WHERE {sql_org('from_domain')} NOT IN (SELECT org FROM seen) GROUP BY 1""")
def msg_outsider_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mail.relation(spark, sf_dir, "messages").select(domains.org_domain(F.col("from_domain")).alias("org"), domains.org_domain(F.col("to_domain")).alias("to"))
    return m.groupBy("org").agg(F.count(F.lit(1)).alias("n")).join(m.select(F.col("to").alias("org")).distinct(), "org", "left_anti")


@query("msg_ioc_dedup", ctes("urls") + """ SELECT message_id, value, min(ord) AS ord, count(*) AS times FROM urls GROUP BY ALL""")
def msg_ioc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iocs.first_wins(mail.relation(spark, sf_dir, "urls").drop("is_mismatch"), ["message_id"])


_TLD = "split_part(host, '.', -1)"
_URL_SQL = ctes("urls") + rf""", u0 AS (SELECT *, lower(regexp_extract(value, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(value, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1) AS auth FROM urls),
u1 AS (SELECT *, regexp_replace(regexp_replace(lower(auth), '^.*@', ''), ':[0-9]*$', '') AS host, regexp_extract(auth, ':([0-9]+)$', 1) AS port,
  lower(regexp_extract(regexp_extract(value, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '\.([A-Za-z0-9]+)$', 1)) AS ending FROM u0),
u_hosts AS (SELECT DISTINCT host AS h FROM u1 WHERE host <> ''), u_brand AS (SELECT * FROM (VALUES {BRAND_ROWS}) v(i, name, domains)),
u_x AS (SELECT h, {sql_org('h')} AS org FROM u_hosts), u_y AS (SELECT *, split_part(org, '.', 1) AS n FROM u_x), u_z AS (SELECT *, {sql_skeleton('n')} AS s, {sql_skeleton("regexp_replace(h, '[.][a-z.]+$', '')")} AS flat FROM u_y WHERE org NOT IN {GENUINE} AND NOT regexp_full_match(h, '[0-9.]+')),
u_look AS (SELECT DISTINCT h FROM u_z, u_brand WHERE (s = name AND n <> name) OR (length(name) >= 5 AND levenshtein(s, name) BETWEEN 1 AND CASE WHEN length(name) >= 8 THEN 2 ELSE 1 END)
  OR (length(name) >= 4 AND flat <> name AND list_contains(list_transform(regexp_split_to_array(h, '[._-]'), lambda w: {sql_skeleton('w')}), name))),
risks AS (SELECT message_id, ord, is_mismatch, 'script-url' AS type, 'high' AS level FROM u1 WHERE scheme IN ('javascript', 'vbscript', 'data')
 UNION ALL SELECT message_id, ord, is_mismatch, 'credentials-url', 'high' FROM u1 WHERE contains(auth, '@')
 UNION ALL SELECT message_id, ord, is_mismatch, 'odd-port', 'medium' FROM u1 WHERE port NOT IN ('', '80', '443')
 UNION ALL SELECT message_id, ord, is_mismatch, 'direct-download', 'high' FROM u1 WHERE auth <> '' AND ending IN {in_list(fixed.PROGRAM_URLS)}
 UNION ALL SELECT message_id, ord, is_mismatch, 'direct-download', 'medium' FROM u1 WHERE auth <> '' AND ending IN {in_list(fixed.ARCHIVE_URLS)}
 UNION ALL SELECT message_id, ord, is_mismatch, 'risky-tld', 'medium' FROM u1 WHERE auth <> '' AND {_TLD} IN {in_list(fixed.RISKY_TLDS)}
 UNION ALL SELECT message_id, ord, is_mismatch, 'brand-lookalike', 'high' FROM u1 WHERE host IN (SELECT h FROM u_look)
 UNION ALL SELECT message_id, ord, is_mismatch, 'url-shortener', 'medium' FROM u1 WHERE host IN {in_list(fixed.SHORTENERS)}
 UNION ALL SELECT message_id, ord, is_mismatch, 'punycode', 'high' FROM u1 WHERE contains(host, 'xn--')
 UNION ALL SELECT message_id, ord, is_mismatch, 'ip-url', 'high' FROM u1 WHERE regexp_full_match(host, '[0-9.]+') AND auth <> ''
 UNION ALL SELECT message_id, ord, is_mismatch, 'mismatch', 'high' FROM u1 WHERE auth <> '' AND is_mismatch)"""


def _url_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = mail.relation(spark, sf_dir, "urls")
    return u.withColumn("risks", iocs.url_risks(F.col("value"), F.col("is_mismatch")))


@query("msg_url_flags", _URL_SQL + " SELECT type, level, count(*) AS n, count(DISTINCT message_id) AS messages FROM risks GROUP BY ALL")
def msg_url_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _url_risks(spark, sf_dir).select("message_id", F.inline("risks"))
    return each.groupBy("type", "level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("message_id").alias("messages"))


@query("msg_unwrap", ctes("urls") + r""" SELECT message_id, ord, url_decode(regexp_extract(value, '[?&]url=([^&#]*)', 1)) AS destination FROM urls WHERE contains(value, 'safelinks')""")
def msg_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = mail.relation(spark, sf_dir, "urls").select("message_id", "ord", urls.decoder("unwrap")(F.col("value")).alias("destination"))
    return u.where("destination IS NOT NULL")


def _phrase_sql(category: str) -> str:
    alternatives = "|".join(sorted(language.PHRASES[category], key=len, reverse=True))
    return f"len(regexp_extract_all(lower(text), '\\b(?:{alternatives})s?\\b'))"


_LANG_ROWS = " UNION ALL ".join(f"SELECT message_id, '{c}' AS category, CAST({_phrase_sql(c)} AS BIGINT) AS strong FROM bodies" for c in language.PHRASES)
_LANG_WEIGHT = "CASE category " + " ".join(f"WHEN '{c}' THEN {w}" for c, (w, _) in fixed.LANGUAGE_WEIGHTS.items()) + " END"


@query("msg_lang_scores", ctes("bodies") + f""", c AS ({_LANG_ROWS})
SELECT message_id, category, strong, CAST(0 AS BIGINT) AS broad, CAST(floor(least(strong * CAST({_LANG_WEIGHT} AS DOUBLE) * 10, 100) + 0.5) AS BIGINT) AS score FROM c WHERE strong > 0""")
def msg_lang_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = language.match(mail.relation(spark, sf_dir, "bodies"), "text", language.default_dictionary(spark), [])
    return language.scores(matched.select("message_id", "matches"), ["message_id"])


_LANG_ORDER = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(fixed.LANGUAGE_LABELS)) + " END"
_LANG_LABEL = "CASE category " + " ".join(f"WHEN '{c}' THEN '{label.lower()}'" for c, label in fixed.LANGUAGE_LABELS.items()) + " END"


@query("msg_lang_totals", ctes("bodies") + f""", c AS ({_LANG_ROWS}),
s AS (SELECT *, CAST(floor(least(strong * CAST({_LANG_WEIGHT} AS DOUBLE) * 10, 100) + 0.5) AS BIGINT) AS score FROM c)
SELECT message_id, CAST(least(sum(score), 100) AS BIGINT) AS total, CASE WHEN sum(strong) = 0 THEN 'No suspicious phrases detected.' ELSE concat('Detected: ',
  string_agg(CASE WHEN strong > 0 THEN concat(strong, ' ', {_LANG_LABEL}, ' phrase', CASE WHEN strong > 1 THEN 's' ELSE '' END) END, ', ' ORDER BY {_LANG_ORDER}), '.') END AS summary
FROM s GROUP BY message_id""")
def msg_lang_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = language.match(mail.relation(spark, sf_dir, "bodies"), "text", language.default_dictionary(spark), [])
    return matched.select("message_id", language.total(language.summary(F.col("matches"))).alias("total"), language.sentence(F.col("matches")).alias("summary"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id, auth, iocs, language, score, tier, attack_types of the message corpus.

    Every part is keyed by message_id, so the parts meet in joins on one key; within a part nothing is shuffled
    but its own rows.
    """
    m = _points(_aligned(spark, sf_dir)).select("message_id", "points", "dmarc", "is_aligned")
    risky = _url_risks(spark, sf_dir).groupBy("message_id").agg(F.collect_list("risks").alias("url_risks"), F.count(F.lit(1)).cast("int").alias("n_urls"))
    files = mail.relation(spark, sf_dir, "files").groupBy("message_id").agg(F.collect_list(iocs.file_risks(F.col("name"))).alias("file_risks"))
    matched = language.match(mail.relation(spark, sf_dir, "bodies"), "text", language.default_dictionary(spark), [])
    wording = matched.select("message_id", language.summary(F.col("matches")).alias("counts"))
    none = F.array().cast("array<array<struct<type:string,level:string>>>")
    found = F.array().cast(identity.FINDING)
    no = F.lit(False)
    joined = m.join(risky, "message_id", "left").join(files, "message_id", "left").join(wording, "message_id").withColumns({
        "url_risks": F.coalesce("url_risks", none), "file_risks": F.coalesce("file_risks", none), "n_urls": F.coalesce("n_urls", F.lit(0)),
    })
    parts = joined.withColumns({
        "auth": score.clamp(F.col("points")).cast("long"),
        "iocs": score.clamp(score.ioc_points(F.col("url_risks"), F.col("file_risks"), none, none, no)).cast("long"),
        "language": score.clamp(score.language_points(language.category_scores(F.col("counts")))).cast("long"),
    })
    every = F.flatten(F.concat("url_risks", "file_risks"))
    total = parts.withColumn("score", score.floored(score.weighted(F.col("auth"), F.col("iocs"), F.col("language")), every, F.col("counts"), found, no))
    return total.select(
        "message_id", "auth", "iocs", "language", "score", score.tier(F.col("score")).alias("tier"),
        score.attack_types(F.col("counts"), F.col("url_risks"), F.col("file_risks"), F.col("n_urls"), F.size("file_risks"), found, F.col("dmarc"), F.col("is_aligned"), no, no).alias("attack_types"),
    )


_DIM = lambda n, first, rest: f"CASE WHEN {n} <= 0 THEN 0 ELSE {first} + least({n} - 1, 4) * {rest} END"
_V_SQL = (
    "WITH " + A_SQL.removeprefix("WITH ") + ",\n" + _URL_SQL.removeprefix("WITH ") + ",\n" + ctes("files", "bodies").removeprefix("WITH ")
    + f""", lang AS ({_LANG_ROWS}),
lp AS (SELECT message_id, floor(sum(floor(least(strong * CAST({_LANG_WEIGHT} AS DOUBLE) * 10, 100) + 0.5) * CAST(CASE category {' '.join(f"WHEN '{c}' THEN {w}" for c, (_, w) in fixed.LANGUAGE_WEIGHTS.items())} END AS DOUBLE)) + 0.5) AS p,
  sum(strong) FILTER (category = 'bec') AS bec, sum(strong) FILTER (category = 'extortion') AS extortion, sum(strong) FILTER (category = 'advancefee') AS advancefee, sum(strong) FILTER (category = 'lure') AS lure, sum(strong) FILTER (category = 'credential') AS credential
  FROM lang GROUP BY message_id),
ur AS (SELECT message_id, ord, bool_or(level = 'high') AS h, bool_or(level = 'medium') AS md, bool_or(type = 'direct-download') AS dl FROM risks GROUP BY ALL),
up AS (SELECT message_id, count(*) FILTER (h) AS highs, count(*) FILTER (md AND NOT h) AS mediums, bool_or(dl) AS dl FROM ur GROUP BY ALL),
un AS (SELECT message_id, count(*) AS n FROM urls GROUP BY ALL),
fp AS (SELECT message_id, regexp_matches(name, '\\.({'|'.join(fixed.RISKY_FILES)})$') AS risky FROM files),
parts AS (SELECT a.message_id, dmarc, is_aligned, least(100, {_AUTH_POINTS}) AS auth,
  least(100, {_DIM('coalesce(highs, 0)', 25, 12)} + {_DIM('coalesce(mediums, 0)', 8, 4)} + CASE WHEN coalesce(risky, FALSE) THEN 30 ELSE 0 END) AS iocs, least(100, p) AS language,
  bec, extortion, advancefee, lure, credential, coalesce(risky, FALSE) AS risky, coalesce(dl, FALSE) AS dl, coalesce(n, 0) AS n_urls, fp.message_id IS NOT NULL AS has_file
  FROM a LEFT JOIN up USING (message_id) LEFT JOIN un USING (message_id) LEFT JOIN fp USING (message_id) JOIN lp USING (message_id)),
total AS (SELECT *, CAST(floor(least(auth * CAST(0.6 AS DOUBLE) + iocs * CAST(0.25 AS DOUBLE) + language * CAST(0.15 AS DOUBLE), 100) + 0.5) AS BIGINT) AS raw FROM parts),
verdict AS (SELECT *, CASE WHEN bec >= 2 OR extortion >= 2 OR advancefee >= 3 THEN greatest(raw, 30) ELSE raw END AS score FROM total),
tiered AS (SELECT *, CASE WHEN score >= 60 THEN 'High Risk' WHEN score >= 30 THEN 'Suspicious' ELSE 'Low Risk' END AS tier FROM verdict)"""
)


@query("msg_score", _V_SQL + " SELECT message_id, CAST(auth AS BIGINT) AS auth, CAST(iocs AS BIGINT) AS iocs, CAST(language AS BIGINT) AS language, CAST(score AS BIGINT) AS score, tier FROM tiered")
def msg_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).drop("attack_types")


@query("msg_tier_counts", _V_SQL + " SELECT tier, count(*) AS n, CAST(max(score) AS BIGINT) AS most FROM tiered GROUP BY tier")
def msg_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("most"))


@query("msg_attack_types", _V_SQL + """, kinds AS (SELECT message_id, 'BEC / payment fraud' AS attack FROM tiered WHERE bec >= 2
 UNION ALL SELECT message_id, 'Credential phishing' FROM tiered WHERE credential >= 1 AND (n_urls > 0 OR has_file)
 UNION ALL SELECT message_id, 'Malware delivery' FROM tiered WHERE risky OR dl
 UNION ALL SELECT message_id, 'Extortion / sextortion' FROM tiered WHERE extortion >= 2
 UNION ALL SELECT message_id, 'Advance-fee scam' FROM tiered WHERE advancefee >= 3
 UNION ALL SELECT message_id, 'Prize / reward scam' FROM tiered WHERE lure >= 2
 UNION ALL SELECT message_id, 'Sender spoofing' FROM tiered WHERE dmarc = 'fail' OR NOT is_aligned)
SELECT attack, count(*) AS n FROM kinds GROUP BY attack""")
def msg_attack_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select(F.explode("attack_types").alias("attack")).groupBy("attack").agg(F.count(F.lit(1)).alias("n"))


@query("msg_triage_top", _V_SQL + " SELECT message_id, tier, CAST(score AS BIGINT) AS score FROM tiered ORDER BY CASE tier WHEN 'High Risk' THEN 0 WHEN 'Suspicious' THEN 1 ELSE 2 END, score DESC, message_id LIMIT 50")
def msg_triage_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.triage(verdicts(spark, sf_dir), "message_id").limit(50).select("message_id", "tier", "score")


def _indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mail.relation(spark, sf_dir, "messages")
    org = domains.org_domain(F.col("from_domain"))
    base = correlate.indicators(m, "message_id", {
        "from": F.concat("local_part", F.lit("@"), "from_domain"), "domain": [F.col("from_domain"), F.when(org != F.col("from_domain"), org)],
        "displayName": F.col("display_name"), "ip": F.col("sender_ip"), "subject": text.subject_key(F.col("subject")),
    })
    u = mail.relation(spark, sf_dir, "urls")
    return base.unionByName(correlate.indicators(u, "message_id", {"urlDomain": domains.host_of(F.col("value")), "url": F.col("value")}))


_IND_SQL = ctes("messages", "urls") + rf""", ind AS (SELECT message_id, 'from' AS type, concat(local_part, '@', from_domain) AS value FROM messages
 UNION SELECT message_id, 'domain', from_domain FROM messages UNION SELECT message_id, 'domain', {sql_org('from_domain')} FROM messages
 UNION SELECT message_id, 'displayName', lower(display_name) FROM messages WHERE display_name IS NOT NULL UNION SELECT message_id, 'ip', sender_ip FROM messages
 UNION SELECT message_id, 'subject', trim(regexp_replace(regexp_replace(regexp_replace(lower(subject), '^\s*(re|fw|fwd)\s*:\s*', ''), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) FROM messages
 UNION SELECT message_id, 'urlDomain', {sql_host('value')} FROM urls WHERE {sql_host('value')} IS NOT NULL UNION SELECT message_id, 'url', lower(value) FROM urls)"""
_WEIGHTS = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.INDICATOR_WEIGHTS.items()) + " ELSE 10 END"


@query("msg_shared_indicators", _IND_SQL + f" SELECT type, value, count(*) AS n, min(message_id) AS first_seen, CAST({_WEIGHTS} AS BIGINT) AS weight FROM ind GROUP BY type, value HAVING count(*) > 1")
def msg_shared_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.shared(_indicators(spark, sf_dir), "message_id")


@query("msg_compare_pivot", ctes("messages") + """, t AS (SELECT message_id, unnest(['from_domain', 'display_name', 'spf', 'to_domain', 'sender_ip']) AS field, unnest([from_domain, display_name, spf, to_domain, sender_ip]) AS value FROM messages WHERE message_id IN (1, 2, 3)),
w AS (SELECT field, max(value) FILTER (message_id = 1) AS m1, max(value) FILTER (message_id = 2) AS m2, max(value) FILTER (message_id = 3) AS m3 FROM t GROUP BY field)
SELECT *, coalesce(m1 = m2 AND m2 = m3, FALSE) AS identical FROM w""")
def msg_compare_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mail.relation(spark, sf_dir, "messages")
    return correlate.comparison(m, "message_id", ["from_domain", "display_name", "spf", "to_domain", "sender_ip"], [1, 2, 3])


@query("msg_subject_keys", ctes("messages") + r""" SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(subject), '^\s*(re|fw|fwd)\s*:\s*', ''), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS pattern, count(*) AS n FROM messages GROUP BY 1""")
def msg_subject_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.relation(spark, sf_dir, "messages").groupBy(text.subject_key(F.col("subject")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query("msg_ioc_csv", ctes("urls") + r""", f AS (SELECT message_id, value, regexp_replace(regexp_replace(lower(regexp_extract(value, '^([A-Za-z]+):', 1)), '^http', 'hxxp'), '^ftp', 'fxp') AS s FROM urls WHERE regexp_matches(value, '^https?://[^/?#@]+/[a-z]+$'))
SELECT DISTINCT message_id, concat('url,', s, '[://]', replace(regexp_extract(value, '^[a-z]+://([^/?#]*)', 1), '.', '[.]'), regexp_extract(value, '^[a-z]+://[^/?#]*(.*)$', 1)) AS line FROM f""")
def msg_ioc_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = mail.relation(spark, sf_dir, "urls").where(F.col("value").rlike(r"\Ahttps?://[^/?#@]+/[a-z]+\z"))
    return u.select("message_id", export.csv_line([F.lit("url"), text.defang_url(F.col("value"))]).alias("line")).distinct()


@query("msg_ioc_csv_all")
def msg_ioc_csv_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of every message, unwrapped ones too, with all columns; a test holds it against plain Python."""
    once = mail.relation(spark, sf_dir, "urls").groupBy("message_id", "value").agg(F.min("ord").alias("ord"), F.bool_or("is_mismatch").alias("is_mismatch"))
    u = iocs.unwrapped(once.withColumn("source", F.lit("body")), ["message_id"], urls.decoder("unwrap"))
    u = u.withColumn("risks", iocs.url_risks(F.col("value"), mismatch=F.coalesce("is_mismatch", F.lit(False))))
    levels = F.col("risks.level")
    cells = {
        "type": F.lit("url"), "value": text.defang_url(F.col("value")), "source": F.coalesce("source", F.lit("unwrapped")), "risk": F.array_join("risks.type", "; "),
        "risk_level": F.when(F.array_contains(levels, "high"), "high").when(F.array_contains(levels, "medium"), "medium"), "unwrapped_from": text.defang_url(F.col("unwrapped_from")),
    }
    return export.csv_rows(u.select("message_id", *[c.alias(n) for n, c in cells.items()]), key=["message_id"])


@query("msg_mixed_script", r"""WITH s AS (SELECT o_orderkey AS k, concat(['invoice', 'pаypal', 'αpple', 'Москва', 'héllo'][o_orderkey % 5 + 1], ' ', ['due', 'a​b', 'ok'][o_orderkey % 3 + 1]) AS t FROM orders)
SELECT CAST(len(list_filter(regexp_extract_all(t, '[\p{L}\p{M}]{3,}'), lambda w: regexp_matches(w, '\p{Latin}') AND regexp_matches(w, '[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]'))) AS BIGINT) AS mixed,
  CAST(len(regexp_extract_all(t, '[\p{L}\p{N}][\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}\x{180E}]+[\p{L}\p{N}]')) AS BIGINT) AS hidden, count(*) AS n FROM s GROUP BY ALL""")
def msg_mixed_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    word = lambda items: F.element_at(domains.literals(items), (k % len(items) + 1).cast("int"))
    t = read(spark, sf_dir, "orders", "o_orderkey").select(F.concat(word(["invoice", "pаypal", "αpple", "Москва", "héllo"]), F.lit(" "), word(["due", "a​b", "ok"])).alias("t"))
    counted = t.select(F.size(text.mixed_script_words(F.col("t"))).cast("long").alias("mixed"), F.size(text.invisible_in_words(F.col("t"))).cast("long").alias("hidden"))
    return counted.groupBy("mixed", "hidden").agg(F.count(F.lit(1)).alias("n"))


_SMUGGLE = ["<script>new Blob([1]); x.click();</script>", '<a download="a.zip">x</a>', "<p>atob(1) createObjectURL</p>", "<p>plain</p>"]


@query("html_smuggling", "WITH p AS (SELECT [" + ", ".join("'" + s.replace("'", "''") + "'" for s in _SMUGGLE) + r"""][o_orderkey % 4 + 1] AS t FROM orders),
h AS (SELECT CAST(regexp_matches(t, '(?i)new\s+Blob\s*\(|msSaveOrOpenBlob|createObjectURL') AS INT) + CAST(regexp_matches(t, '(?i)download\s*=|\.click\s*\(\)') AS INT) + CAST(regexp_matches(t, '(?i)base64,[A-Za-z0-9+/=]{500,}|atob\s*\(') AS INT) AS marks FROM p)
SELECT CAST(marks AS BIGINT) AS marks, marks >= 2 AS smuggles, count(*) AS n FROM h GROUP BY ALL""")
def html_smuggling(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.element_at(domains.literals(_SMUGGLE), (F.col("o_orderkey") % len(_SMUGGLE) + 1).cast("int"))
    marks = read(spark, sf_dir, "orders", "o_orderkey").select(F.size(content.smuggling(page)).cast("long").alias("marks"))
    return marks.groupBy("marks").agg(F.count(F.lit(1)).alias("n")).withColumn("smuggles", F.col("marks") >= 2)


@query("msg_spf_running", ctes("messages") + f""", s AS (SELECT cust, message_id, {sql_status("coalesce(spf, 'unknown')")} AS spf FROM messages)
SELECT cust, count(*) AS n, count(*) FILTER (spf = 'fail') AS fails, arg_max(spf, message_id) AS latest FROM s GROUP BY cust""")
def msg_spf_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return m.groupBy("cust").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("spf") == "fail").alias("fails"), F.max_by("spf", "message_id").alias("latest"))


@query("msg_sender_authenticity", A_SQL + """ SELECT CASE WHEN dmarc = 'fail' OR NOT is_aligned THEN 'not verified' WHEN dmarc = 'pass' AND is_aligned THEN 'verified' ELSE 'could not be verified' END AS authenticity,
 regexp_matches(from_domain, '^(xn--|[0-9])') AS suspicious, count(*) AS n FROM a GROUP BY ALL""")
def msg_sender_authenticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _aligned(spark, sf_dir)
    return m.groupBy(summary.authenticity(F.col("dmarc"), F.col("is_aligned")).alias("authenticity"), summary.suspicious_domain(F.col("from_domain")).alias("suspicious")).agg(F.count(F.lit(1)).alias("n"))


@query("msg_last_relay", ctes("hops") + """, g AS (SELECT message_id, arg_max(ip, hop) AS relay_ip, arg_min(ip, hop) AS origin FROM hops GROUP BY message_id) SELECT message_id, relay_ip FROM g WHERE relay_ip <> origin""")
def msg_last_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.last_relay(mail.relation(spark, sf_dir, "hops"), ["message_id"])


@query("msg_file_flags", ctes("files") + rf""", f AS (SELECT 'double-extension' AS type FROM files WHERE regexp_matches(name, '\.({'|'.join(e.replace('.', '[.]') for e in fixed.DOUBLE_ENDINGS)})')
 UNION ALL SELECT 'risky-extension' FROM files WHERE regexp_matches(name, '\.({'|'.join(fixed.RISKY_FILES)})$')) SELECT type, count(*) AS n FROM f GROUP BY type""")
def msg_file_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = mail.relation(spark, sf_dir, "files").select(F.explode(iocs.file_risks(F.col("name"))).alias("r"))
    return f.groupBy("r.type").agg(F.count(F.lit(1)).alias("n"))


@query("msg_recipient_notes", ctes("messages") + f""", o AS (SELECT message_id, {sql_org('from_domain')} AS a, {sql_org('return_path_domain')} AS b FROM messages WHERE return_path_domain IS NOT NULL), x AS (SELECT *, split_part(a, '.', 1) AS n, split_part(b, '.', 1) AS t FROM o),
notes AS (SELECT message_id, 'imitation' AS note FROM x WHERE a <> b AND a NOT IN {in_list(fixed.FREE_MAIL)} AND b NOT IN {in_list(fixed.FREE_MAIL)} AND (n = t OR (length(t) >= 5 AND levenshtein(n, t) <= 1))
 UNION ALL SELECT message_id, 'same-organisation' FROM x WHERE a = b AND a NOT IN {in_list(fixed.FREE_MAIL)})
SELECT note, count(*) AS n FROM notes GROUP BY note""")
def msg_recipient_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    m = mail.relation(spark, sf_dir, "messages").where("return_path_domain IS NOT NULL").select(
        "message_id", F.concat("local_part", F.lit("@"), "from_domain").alias("sender"), F.array(F.concat(F.lit("someone@"), F.col("return_path_domain"))).alias("to"), none.alias("cc"), F.lit(None).cast("string").alias("delivered_to")
    )
    return identity.recipient_notes(m, ["message_id"]).select(F.explode("notes").alias("note")).groupBy("note").agg(F.count(F.lit(1)).alias("n"))


@query("msg_stix_patterns", ctes("urls") + """ SELECT DISTINCT value, concat('[url:value = ''', value, ''']') AS pattern FROM urls""")
def msg_stix_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = mail.relation(spark, sf_dir, "urls").withColumn("kind", F.lit("url"))
    return export.stix(u, "2024-01-01T00:00:00.000Z").select("value", F.get_json_object("object", "$.pattern").alias("pattern"))


@query("msg_misp_attributes", ctes("messages") + """ SELECT sender_ip AS value, 'ip-src' AS type, count(*) AS n FROM messages GROUP BY ALL""")
def msg_misp_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mail.relation(spark, sf_dir, "messages").select(F.lit("ip").alias("kind"), F.col("sender_ip").alias("value"))
    a = export.misp(m).select(F.get_json_object("attribute", "$.value").alias("value"), F.get_json_object("attribute", "$.type").alias("type"))
    return a.groupBy("value", "type").agg(F.count(F.lit(1)).alias("n"))


_TIERS = list(export.THREAT_LEVELS)
_TIER_SQL = f"CASE message_id % 3 WHEN 0 THEN '{_TIERS[0]}' WHEN 1 THEN '{_TIERS[1]}' ELSE '{_TIERS[2]}' END"


def _exported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """URLs and sender addresses of the message corpus as indicators, and a verdict for every message."""
    u = mail.relation(spark, sf_dir, "urls").select("message_id", F.lit("url").alias("kind"), "value", "ord", F.lit("body").alias("source"), iocs.url_risks(F.col("value"), F.lit(False), F.lit("body")).alias("risks"))
    m = mail.relation(spark, sf_dir, "messages")
    address = F.concat("local_part", F.lit("@"), "from_domain")
    sent = m.select("message_id", F.lit("email").alias("kind"), address.alias("value"), F.lit(-1).cast("long").alias("ord"), F.lit("From").alias("source"), iocs.email_risks(address).alias("risks"))
    verdict = m.select(
        "message_id", "subject", F.struct(F.col("display_name").alias("name"), address.alias("email")).alias("sender"), (F.col("message_id") % 100).alias("score"), F.expr(_TIER_SQL).alias("tier"),
        F.array(F.concat(F.lit("spf-"), F.coalesce("spf", F.lit("unknown")))).alias("reasons"), F.array(F.lit("Sender spoofing")).alias("attack_types"),
    )
    return u.unionByName(sent), verdict


@query("msg_stix_bundles", ctes("messages", "urls") + f""", u AS (SELECT message_id, count(DISTINCT value) AS n FROM urls GROUP BY ALL)
SELECT m.message_id, concat('Phishing analysis: ', subject) AS name, concat('Verdict: ', {_TIER_SQL.replace('message_id', 'm.message_id')}, ' (', m.message_id % 100, '/100). spf-', coalesce(spf, 'unknown')) AS description,
  concat('[email-addr:value = ''', local_part, '@', from_domain, ''']') AS first_pattern, CAST(5 + 2 * (coalesce(n, 0)) AS BIGINT) AS objects, CAST(3 + 2 * coalesce(n, 0) AS BIGINT) AS refs
FROM messages m LEFT JOIN u ON m.message_id = u.message_id""")
def msg_stix_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, verdict = _exported(spark, sf_dir)
    parsed = export.stix_bundles(found, verdict, "2024-01-01T00:00:00.000Z").select(
        "message_id", F.from_json("bundle", "objects array<struct<type:string,id:string,name:string,description:string,pattern:string,object_refs:array<string>>>")["objects"].alias("o")
    )
    report = F.try_element_at("o", F.lit(-1))
    return parsed.select(
        "message_id", report["name"].alias("name"), report["description"].alias("description"), F.get("o", F.lit(2))["pattern"].alias("first_pattern"),
        F.size("o").cast("long").alias("objects"), F.size(report["object_refs"]).cast("long").alias("refs"),
    )


@query("msg_misp_events", ctes("messages", "urls") + """, u AS (SELECT message_id, count(*) AS n, count(*) FILTER (WHERE contains(value, '://xn--')) AS puny FROM urls GROUP BY ALL)
SELECT m.message_id, concat('Phishing: ', subject) AS info, CAST(m.message_id % 3 + 1 AS VARCHAR) AS level, CAST(2 + CASE WHEN display_name IS NULL THEN 0 ELSE 1 END + coalesce(n, 0) AS BIGINT) AS attributes,
  CAST(coalesce(puny, 0) AS BIGINT) AS punycode FROM messages m LEFT JOIN u ON m.message_id = u.message_id""")
def msg_misp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, verdict = _exported(spark, sf_dir)
    parsed = export.misp_events(found, verdict, "2024-01-01").select(
        "message_id", F.from_json("event", "Event struct<info:string,threat_level_id:string,Attribute:array<struct<type:string,value:string,to_ids:boolean,comment:string>>>")["Event"].alias("e")
    )
    punycode = F.filter("e.Attribute", lambda a: (a["type"] == "url") & a["to_ids"] & a["comment"].contains("punycode"))
    return parsed.select("message_id", F.col("e.info").alias("info"), F.col("e.threat_level_id").alias("level"), F.size("e.Attribute").cast("long").alias("attributes"), F.size(punycode).cast("long").alias("punycode"))


_PHRASES = " UNION ALL ".join(f"SELECT unnest(regexp_extract_all(lower(text), '\\b(?:{'|'.join(sorted(ps, key=len, reverse=True))})s?\\b')) AS phrase FROM bodies" for ps in language.PHRASES.values())


@query("msg_phrase_counts", ctes("bodies") + f", p AS ({_PHRASES}) SELECT phrase, count(*) AS n FROM p GROUP BY phrase")
def msg_phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.phrase_counts(language.match(mail.relation(spark, sf_dir, "bodies"), "text", language.default_dictionary(spark), []))


@query("msg_anomalies", ctes("messages") + f""", x AS (SELECT message_id, {sql_org('from_domain')} <> {sql_org('return_path_domain')} AS foreign_id, return_path_domain IS NULL AS missing, regexp_matches(lower(subject), '^re:') AS reply FROM messages),
y AS (SELECT 'foreign-message-id' AS id FROM x WHERE foreign_id UNION ALL SELECT 'no-message-id' FROM x WHERE missing UNION ALL SELECT 'not-a-reply' FROM x WHERE message_id % 2 = 0 AND NOT reply UNION ALL SELECT 'date-gap' FROM x WHERE message_id % 5 = 0)
SELECT id, count(*) AS n FROM y GROUP BY id""")
def msg_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("message_id")
    date, delivered = F.when(k % 5 == 0, k * 3600).otherwise(k * 3600 + 100000), k * 3600 + 100000
    found = auth.anomalies(date, delivered, F.concat(F.lit("<1@"), F.col("return_path_domain"), F.lit(">")), F.col("from_domain"), k % 2 == 0, F.col("subject"))
    return mail.relation(spark, sf_dir, "messages").select(F.explode(found).alias("a")).groupBy("a.id").agg(F.count(F.lit(1)).alias("n"))


@query("page_preview_counts", r"""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<img\b[^>]*src\s*=\s*["'']?https?:')) AS BIGINT) AS remote_images, CAST(len(regexp_extract_all(html, '(?i)<img\b[^>]*src\s*=\s*["'']?(?:cid|data):')) AS BIGINT) AS embedded_images,
 CAST(len(regexp_extract_all(html, '(?i)<a\b[^>]*href')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '(?i)<(?:script|iframe|object|embed|form|link|meta|base)\b')) AS BIGINT) AS removed FROM pages""")
def page_preview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.preview_counts(read(spark, sf_dir, "pages", "page_id", "html"), ["page_id"], "html")


@query("msg_auth_overall", A_SQL + f""", i AS (SELECT *, CAST(spf = 'fail' AS INT) + CAST(dkim = 'fail' AS INT) + CAST(dmarc = 'fail' AS INT) + CAST(NOT is_aligned AS INT) AS failures,
  CAST(spf IN {in_list(auth.SOFT['spf'])} AS INT) + CAST(dkim IN {in_list(auth.SOFT['dkim'])} AS INT) + CAST(dmarc IN {in_list(auth.SOFT['dmarc'])} AS INT) + CAST(reply_elsewhere AS INT) AS soft FROM a)
SELECT CASE WHEN failures >= 2 THEN 'fail' WHEN failures + soft > 0 THEN 'suspicious' ELSE 'pass' END AS level, CAST(failures AS BIGINT) AS failures, CAST(failures + soft AS BIGINT) AS issues, count(*) AS n FROM i GROUP BY ALL""")
def msg_auth_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = auth.overall(F.col("spf"), F.col("dkim"), F.col("dmarc"), F.col("is_aligned"), F.col("reply_elsewhere"), F.lit(0))
    return _aligned(spark, sf_dir).select(level.alias("o")).groupBy("o.level", "o.failures", "o.issues").agg(F.count(F.lit(1)).alias("n"))


# --- raw messages ---------------------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str, bodies: bool = True) -> DataFrame:
    return source.read_messages(mail.raw(spark, sf_dir), bodies=bodies)


_RAW_SQL = ctes("messages") + """, r AS (SELECT *, concat('/mail/', message_id, '.eml#0') AS id, 1699920000 + (message_id % 24) * 3600 + (message_id % 60) * 60 AS ts FROM messages)"""


@query("raw_core", _RAW_SQL + """ SELECT id AS message_id, subject, CASE WHEN lower(display_name) <> concat(local_part, '@', from_domain) THEN display_name END AS sender_name, concat(local_part, '@', from_domain) AS sender,
 local_part || '@' || reply_to_domain AS reply_to, 'bounce@' || return_path_domain AS return_path, concat('jane@', to_domain, ' bob@', to_domain) AS recipients, ts AS date_s,
 concat('<', message_id, '@', from_domain, '>') AS id_header, CASE WHEN message_id % 3 = 0 THEN concat('Mailer ', message_id % 5) END AS mailer,
 CASE WHEN message_id % 5 = 1 THEN concat('[', sender_ip, ']') END AS originating, concat('Hello ', to_domain, chr(10), 'See https://files.example.com/setup.exe now') AS body FROM r""")
def raw_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, encoded words, addresses, dates and bodies of raw messages."""
    c = source.core(_raw(spark, sf_dir))
    body = F.rtrim(F.regexp_replace(F.replace(F.col("body_text"), F.lit("\r"), F.lit("")), r"\n\z", ""))
    return c.select(
        "message_id", "subject", F.col("sender.name").alias("sender_name"), F.col("sender.email").alias("sender"), F.col("reply_to.email").alias("reply_to"), F.col("return_path.email").alias("return_path"),
        F.array_join("to", " ").alias("recipients"), "date_s", "id_header", "mailer", "originating", body.alias("body"),
    )


@query("raw_headers", _RAW_SQL + """, h AS (SELECT unnest(list_filter(['received', 'received', 'authentication-results', CASE WHEN message_id % 4 = 0 THEN 'received-spf' END, CASE WHEN dkim IS NOT NULL THEN 'dkim-signature' END,
 CASE WHEN return_path_domain IS NOT NULL THEN 'return-path' END, 'from', CASE WHEN reply_to_domain IS NOT NULL THEN 'reply-to' END, 'to', 'subject', 'date', 'message-id', CASE WHEN message_id % 3 = 0 THEN 'x-mailer' END,
 CASE WHEN message_id % 5 = 1 THEN 'x-originating-ip' END, 'mime-version', 'content-type'], lambda x: x IS NOT NULL)) AS name_lc FROM r) SELECT name_lc, count(*) AS n FROM h GROUP BY 1""")
def raw_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.headers(_raw(spark, sf_dir)).groupBy("name_lc").agg(F.count(F.lit(1)).alias("n"))


@query("raw_x_headers", _RAW_SQL + """ SELECT id AS message_id, 'x-mailer' AS name_lc, concat('Mailer ', message_id % 5) AS value FROM r WHERE message_id % 3 = 0
 UNION ALL SELECT id, 'x-originating-ip', concat('[', sender_ip, ']') FROM r WHERE message_id % 5 = 1""")
def raw_x_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.x_headers(_raw(spark, sf_dir, bodies=False)).select("message_id", "name_lc", "value")


@query("raw_parts", _RAW_SQL + """, p AS (SELECT 0 AS place, 'text/plain' AS mime, 'utf-8' AS charset, NULL AS disposition, NULL AS filename, FALSE AS is_file FROM r
 UNION ALL SELECT 1, 'text/html', 'utf-8', NULL, NULL, FALSE FROM r
 UNION ALL SELECT 2, 'application/octet-stream', NULL, 'attachment', concat('file', message_id % 4, '.bin'), TRUE FROM r WHERE message_id % 3 = 0)
SELECT CAST(place AS BIGINT) AS place, mime, charset, disposition, filename, is_file, count(*) AS n FROM p GROUP BY ALL""")
def raw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source.parts(_raw(spark, sf_dir)).withColumn("place", F.get("path", F.lit(0)).cast("long"))
    return p.groupBy("place", "mime", "charset", "disposition", "filename", "is_file").agg(F.count(F.lit(1)).alias("n"))


@query("raw_files", _RAW_SQL + """, f AS (SELECT id AS message_id, concat('file', message_id % 4, '.bin') AS name, repeat('MZ', CAST(message_id % 9 + 1 AS INT)) AS body FROM r WHERE message_id % 3 = 0)
SELECT message_id, name, CAST(length(body) AS BIGINT) AS size, sha256(body) AS sha256, 'Windows executable (PE)' AS kind FROM f""")
def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments by content: their names, sizes, hashes and types."""
    p = source.parts(_raw(spark, sf_dir)).where("is_file")
    return p.select("message_id", F.col("filename").alias("name"), "size", content.hashes(F.col("bytes"))["sha256"].alias("sha256"), content.sniff(F.col("bytes"))["label"].alias("kind"))


@query("raw_hops", _RAW_SQL + """ SELECT id AS message_id, CAST(2 AS BIGINT) AS hop, concat('relay', message_id % 7, '.example.net') AS from_host, 'mx.contoso.com' AS by_host, sender_ip AS ip, ts FROM r
 UNION ALL SELECT id, 1, 'desk', 'relay.example.net', concat('10.0.0.', message_id % 200), ts FROM r""")
def raw_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.hops(_raw(spark, sf_dir)).select("message_id", "hop", "from_host", "by_host", "ip", "ts")


@query("raw_auth_clauses", _RAW_SQL + """, c AS (SELECT 'spf' AS method, spf AS result, coalesce(return_path_domain, from_domain) AS domain FROM r WHERE spf IS NOT NULL
 UNION ALL SELECT 'dkim', dkim, from_domain FROM r WHERE dkim IS NOT NULL UNION ALL SELECT 'dmarc', dmarc, from_domain FROM r WHERE dmarc IS NOT NULL)
SELECT 'mx.contoso.com' AS server, method, result, domain, count(*) AS n FROM c GROUP BY ALL""")
def raw_auth_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of Authentication-Results, semicolons in comments included."""
    a = _raw(spark, sf_dir).select(source.auth_clauses(source.value_of("authentication-results")).alias("a")).select("a.server", F.inline("a.clauses"))
    domain = F.coalesce(F.try_element_at("props", F.lit("smtp.mailfrom")), F.try_element_at("props", F.lit("header.d")), F.try_element_at("props", F.lit("header.from")))
    return a.groupBy("server", "method", "result", domain.alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("raw_received_spf", _RAW_SQL + f""" SELECT id AS message_id, coalesce(spf, 'none') AS result, sender_ip AS client_ip, concat('bounce@', from_domain) AS envelope_from, 'desk' AS helo FROM r WHERE message_id % 4 = 0""")
def raw_received_spf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("message_id", source.received_spf(source.value_of("received-spf")).alias("s")).where("s IS NOT NULL").select("message_id", "s.*")


@query("raw_dkim_tags", _RAW_SQL + """ SELECT id AS message_id, from_domain AS d, 's1' AS s, 'rsa-sha256' AS a FROM r WHERE dkim IS NOT NULL""")
def raw_dkim_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = _raw(spark, sf_dir).select("message_id", source.value_of("dkim-signature").alias("v")).where("v IS NOT NULL")
    return signed.select("message_id", *[source.dkim_tag(F.col("v"), t).alias(t) for t in ("d", "s", "a")])


@query("raw_header_domains", _RAW_SQL + """, d AS (SELECT 'From' AS source, from_domain AS domain FROM r UNION ALL SELECT 'Reply-To', reply_to_domain FROM r UNION ALL SELECT 'Return-Path', return_path_domain FROM r
 UNION ALL SELECT 'DKIM', from_domain FROM r WHERE dkim IS NOT NULL) SELECT source, domain, count(*) AS n FROM d WHERE domain IS NOT NULL GROUP BY ALL""")
def raw_header_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.header_domains(_raw(spark, sf_dir)).groupBy("source", "domain").agg(F.count(F.lit(1)).alias("n"))


@query("raw_links", _RAW_SQL + f""" SELECT id AS message_id, concat('http://', from_domain, '/x') AS href, 'www.contoso.com' AS shown, {sql_org('from_domain')} <> 'contoso.com' AS deceptive FROM r""")
def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of HTML bodies with the texts that they show."""
    found = iocs.html_links(source.core(_raw(spark, sf_dir)), ["message_id"], "body_html")
    return found.select("message_id", "href", F.col("text").alias("shown"), iocs.is_deceptive(F.col("text"), F.col("href")).alias("deceptive"))


@query("raw_header_view", _RAW_SQL + f""", h AS (SELECT id, unnest(list_filter(['received:2', 'received:1', 'authentication-results', CASE WHEN message_id % 4 = 0 THEN 'received-spf' END, CASE WHEN dkim IS NOT NULL THEN 'dkim-signature' END,
 CASE WHEN return_path_domain IS NOT NULL THEN 'return-path' END, 'from', CASE WHEN reply_to_domain IS NOT NULL THEN 'reply-to' END, 'to', 'subject', 'date', 'message-id', CASE WHEN message_id % 3 = 0 THEN 'x-mailer' END,
 CASE WHEN message_id % 5 = 1 THEN 'x-originating-ip' END, 'mime-version', 'content-type'], lambda x: x IS NOT NULL)) AS t FROM r), v AS (SELECT split_part(t, ':', 1) AS name_lc, coalesce(TRY_CAST(split_part(t, ':', 2) AS BIGINT), 0) AS hop FROM h)
SELECT name_lc, hop, CAST(coalesce(list_position({source.KEY_HEADERS}, name_lc), {len(source.KEY_HEADERS) + 1}) AS BIGINT) AS rank, CASE WHEN name_lc = 'received' THEN 'received' WHEN name_lc IN ('authentication-results', 'received-spf', 'dkim-signature') THEN 'auth' END AS kind, count(*) AS n FROM v GROUP BY ALL""")
def raw_header_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers by how much they matter, Received ones with their hops."""
    return source.header_view(_raw(spark, sf_dir)).groupBy("name_lc", F.coalesce("hop", F.lit(0)).alias("hop"), "rank", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("raw_recipients", _RAW_SQL + """ SELECT id AS message_id, 'Doe, Jane' AS name, concat('jane@', to_domain) AS email FROM r UNION ALL SELECT id, NULL, concat('bob@', to_domain) FROM r""")
def raw_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address lists with names; commas in quotes divide nothing."""
    return _raw(spark, sf_dir).select("message_id", F.inline(source.addresses(source.values_of("to"))))


@query("raw_spf_sources", _RAW_SQL + """ SELECT id AS message_id, CASE WHEN message_id % 4 = 0 THEN sender_ip END AS ip, CASE WHEN spf IS NOT NULL AND message_id % 4 = 0 THEN 'true' ELSE 'unknown' END AS results_agree, 'unknown' AS ips_agree FROM r""")
def raw_spf_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both SPF headers say of one message."""
    raw = source.value_of("received-spf")
    top = _raw(spark, sf_dir).select("message_id", source.auth_clauses(source.value_of("authentication-results")).alias("top"), source.received_spf(raw).alias("rspf"), raw.alias("raw"))
    named = top.withColumn("spf", auth.resolve(F.col("top.clauses"), "spf"))
    return named.select("message_id", auth.spf_sources(F.col("spf"), F.col("rspf"), F.col("raw")).alias("s")).select("message_id", "s.ip", *[F.coalesce(F.col(f"s.{c}").cast("string"), F.lit("unknown")).alias(c) for c in ("results_agree", "ips_agree")])


@query("raw_indicators", _RAW_SQL + f""", x AS (SELECT id, 'email' AS kind, 'From' AS source, 0 AS rank, concat(local_part, '@', from_domain) AS value FROM r
 UNION ALL SELECT id, 'email', 'Reply-To', 1, local_part || '@' || reply_to_domain FROM r UNION ALL SELECT id, 'email', 'Return-Path', 2, 'bounce@' || return_path_domain FROM r
 UNION ALL SELECT id, 'ip', 'X-Originating-IP', 0, sender_ip FROM r WHERE message_id % 5 = 1 UNION ALL SELECT id, 'ip', 'Received', 1, sender_ip FROM r UNION ALL SELECT id, 'ip', 'Received', 1, concat('10.0.0.', message_id % 200) FROM r
 UNION ALL SELECT id, 'url', 'body', 0, 'https://files.example.com/setup.exe' FROM r UNION ALL SELECT id, 'url', 'body', 0, concat('http://', from_domain, '/x') FROM r
 UNION ALL SELECT id, 'domain', 'Message-ID', 9, from_domain FROM r UNION ALL SELECT id, 'domain', 'From', 0, from_domain FROM r UNION ALL SELECT id, 'domain', 'Reply-To', 1, reply_to_domain FROM r
 UNION ALL SELECT id, 'domain', 'Return-Path', 2, return_path_domain FROM r UNION ALL SELECT id, 'domain', 'body', 10, 'files.example.com' FROM r)
SELECT id AS message_id, kind, value, arg_min(source, rank) AS source, CASE WHEN kind = 'url' AND value LIKE '%.exe' THEN 'direct-download' WHEN kind = 'ip' AND arg_min(source, rank) LIKE 'X-%' THEN 'x-originating' END AS risk FROM x WHERE value IS NOT NULL GROUP BY id, kind, value""")
def raw_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indicator of raw messages with where it stands first; of its risks, downloads and X-Originating-IP."""
    messages = _raw(spark, sf_dir)
    found = analysis.indicators(messages, source.core(messages, "parts"))
    shown = F.array_intersect(F.transform("risks", lambda r: r["type"]), F.array(F.lit("direct-download"), F.lit("x-originating")))
    return found.select("message_id", "kind", "value", "source", F.get(shown, F.lit(0)).alias("risk"))


@query("raw_has_body", ctes("messages") + """ SELECT message_id, message_id % 2 = 0 AS has_body FROM messages""")
def raw_has_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole messages against headers alone: of odd ones, only the headers are looked at."""
    text_of = F.decode("content", "UTF-8")
    m = mail.raw(spark, sf_dir).withColumn("message_id", F.regexp_extract("path", r"(\d+)\.eml", 1).cast("long"))
    pasted_text = F.when(F.col("message_id") % 2 == 0, text_of).otherwise(F.substring_index(text_of, "\r\n\r\n", 1))
    return m.select("message_id", pasted.has_body(pasted_text).alias("has_body"))


@query("msg_reply_elsewhere", ctes("messages") + " SELECT message_id, coalesce(reply_to_domain <> from_domain, FALSE) AS elsewhere FROM messages")
def msg_reply_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.concat(F.lit("x@"), c)
    return mail.relation(spark, sf_dir, "messages").select("message_id", summary.replies_elsewhere(at(F.col("reply_to_domain")), at(F.col("from_domain"))).alias("elsewhere"))


@query("msg_lang_groups", ctes("bodies") + f""", c AS ({_LANG_ROWS}), g AS (SELECT message_id, category, strong, row_number() OVER (PARTITION BY message_id ORDER BY strong DESC, category) AS place, bool_or(category IN {in_list(language.BAD)}) OVER (PARTITION BY message_id) AS bad FROM c WHERE strong > 0)
SELECT message_id, CAST(place AS BIGINT) AS place, category, strong, CASE WHEN bad THEN 'high' ELSE 'medium' END AS risk FROM g""")
def msg_lang_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wording by category, the strongest first, with the risk of the whole."""
    matched = language.match(mail.relation(spark, sf_dir, "bodies"), "text", language.default_dictionary(spark), [])
    grouped = matched.select("message_id", language.groups(F.col("matches")).alias("g"))
    each = grouped.select("message_id", language.groups_risk(F.col("g")).alias("risk"), F.posexplode("g").alias("at", "c"))
    return each.select("message_id", (F.col("at") + 1).cast("long").alias("place"), "c.category", "c.strong", "risk")


_COMPONENT = "replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*')"


@query("msg_vendor_links", ctes("messages", "urls") + f""", x AS (SELECT DISTINCT 'url' AS kind, value FROM urls UNION SELECT 'ip', sender_ip FROM messages UNION SELECT 'domain', from_domain FROM messages)
SELECT kind, value, concat('{summary.REPUTATION_PAGE}', CASE kind WHEN 'ip' THEN 'ip-address/' WHEN 'domain' THEN 'domain/' ELSE 'search/' END, {_COMPONENT.format('value')}) AS reputation, concat('{summary.ABUSE_PAGE}', {_COMPONENT.format('value')}) AS abuse FROM x""")
def msg_vendor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mail.relation(spark, sf_dir, "messages").select(F.inline(F.array(F.struct(F.lit("ip").alias("kind"), F.col("sender_ip").alias("value")), F.struct(F.lit("domain").alias("kind"), F.col("from_domain").alias("value")))))
    every = m.unionByName(mail.relation(spark, sf_dir, "urls").select(F.lit("url").alias("kind"), "value")).distinct()
    kind, value, none = F.col("kind"), F.col("value"), F.lit(None).cast("string")
    return every.select(kind, value, summary.vendor_url("reputation", kind, value, none).alias("reputation"), summary.vendor_url("abuse", kind, value, none).alias("abuse"))


_COMPARED = ["from_domain", "display_name", "spf", "to_domain", "sender_ip"]
_CELL = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN concat('\"', replace({0}, '\"', '\"\"'), '\"') ELSE coalesce({0}, '') END"


@query("msg_compare_csv", _IND_SQL + f""", t AS (SELECT message_id, unnest({_COMPARED}) AS field, unnest([{', '.join(_COMPARED)}]) AS value FROM messages WHERE message_id IN (1, 2, 3)),
w AS (SELECT field, max(value) FILTER (message_id = 1) AS m1, max(value) FILTER (message_id = 2) AS m2, max(value) FILTER (message_id = 3) AS m3 FROM t GROUP BY field),
s AS (SELECT type, value, string_agg(concat('message ', message_id), '; ' ORDER BY message_id) AS seen FROM ind WHERE message_id IN (1, 2, 3) AND type IN ('domain', 'ip') GROUP BY ALL HAVING count(*) > 1)
SELECT 0 AS place, 'property,message 1,message 2,message 3' AS line UNION ALL SELECT 1, concat(field, ',', {_CELL.format('m1')}, ',', {_CELL.format('m2')}, ',', {_CELL.format('m3')}) FROM w
UNION ALL SELECT 2, '' UNION ALL SELECT 3, 'shared indicator,type,seen in' UNION ALL SELECT 4, concat(replace(value, '.', '[.]'), ',', type, ',', seen) FROM s""")
def msg_compare_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three messages side by side as CSV, with the domains and IPs that they share."""
    ids = [1, 2, 3]
    compared = correlate.comparison(mail.relation(spark, sf_dir, "messages"), "message_id", _COMPARED, ids)
    found = _indicators(spark, sf_dir).where(F.col("message_id").isin(ids) & F.col("type").isin("domain", "ip"))
    common = correlate.shared(found, "message_id", len(ids)).withColumn("value", text.defang_domain(F.col("value")))
    return export.comparison_csv(compared, common, ids, {i: f"message {i}" for i in ids})


@query("msg_compare_json", ctes("messages") + f""" SELECT message_id, CAST(json_object({', '.join(f"'{f}', {f}" for f in _COMPARED)}) AS VARCHAR) AS json FROM messages WHERE message_id IN (1, 2, 3)""")
def msg_compare_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.comparison_json(mail.relation(spark, sf_dir, "messages"), "message_id", _COMPARED, [1, 2, 3])


# --- pages and documents, whole -------------------------------------------------------------------

_SQL_USES = " UNION ALL ".join(
    f"SELECT page_id, {k} AS rank, '{use}' AS use, unnest(regexp_extract_all(html, '{pattern.replace(chr(39), chr(39) * 2)}', 1)) AS u FROM pages" for k, (use, pattern) in enumerate(content.USES)
)


@query("page_destinations", f"""WITH d AS ({_SQL_USES}), c AS (SELECT page_id, rank, use, replace(trim(u), '&amp;', '&') AS u FROM d),
w AS (SELECT page_id, rank, use, CASE WHEN u LIKE '//%' THEN concat('https:', u) ELSE u END AS url FROM c WHERE regexp_matches(u, '(?i)^((https?:)?//|wss?://)'))
SELECT page_id, url, arg_min(use, rank) AS use FROM w GROUP BY ALL""")
def page_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL that a page loads or sends to, with its most specific use."""
    return content.destinations(read(spark, sf_dir, "pages", "page_id", "html"), ["page_id"], "html").drop("exfil")


_MARKS = [r"(?i)new\s+Blob\s*\(|msSaveOrOpenBlob|createObjectURL", r"(?i)download\s*=|\.click\s*\(\)", r"(?i)base64,[A-Za-z0-9+/=]{500,}|atob\s*\("]


@query("page_smuggling", "SELECT page_id, CAST(" + " + ".join(f"CAST(regexp_matches(substr(html, 1, {content.SMUGGLING_CHARS}), '{m}') AS INT)" for m in _MARKS) + " AS BIGINT) AS marks FROM pages WHERE html IS NOT NULL")
def page_smuggling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", "page_id", "html").where("html IS NOT NULL").select("page_id", F.size(content.smuggling(F.col("html"))).cast("long").alias("marks"))


@query("page_resources", r"""SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:img|script|iframe|embed|source|input|body|table|td)\b[^>]*?\b(?:src|background)\s*=\s*["''](https?://[^"'']+)["'']', 1)) AS u FROM pages) GROUP BY page_id""")
def page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = iocs.html_links(read(spark, sf_dir, "pages", "page_id", "html"), ["page_id"], "html")
    return found.where("is_resource").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("doc_text_links", r"""WITH u AS (SELECT doc_id, regexp_extract_all(text, '(?i)https?://[^\s<>"]+') AS us FROM documents) SELECT doc_id, CAST(i - 1 AS BIGINT) AS ord, us[i] AS href FROM (SELECT doc_id, us, unnest(range(1, len(us) + 1)) AS i FROM u)""")
def doc_text_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iocs.text_links(read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"], "text")


@query("doc_ioc_kinds", f"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '(?i)https?://[^\\s<>"]+')) AS us, list_distinct(list_transform(regexp_extract_all(text, '{SQL_EMAIL}'), lambda x: lower(x))) AS es, list_distinct({sql_quads('text')}) AS ips FROM documents WHERE text IS NOT NULL)
SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'url' AS kind, len(us) AS n FROM t UNION ALL SELECT 'email', len(es) FROM t UNION ALL SELECT 'ip', len(ips) FROM t) GROUP BY kind HAVING sum(n) > 0""")
def doc_ioc_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iocs.from_text(read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"], "text").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
