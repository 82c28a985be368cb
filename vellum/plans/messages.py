"""A deterministic message corpus derived from the orders table, the same in Spark SQL and DuckDB.

The driver's tables hold no mail, so authentication, identity, indicator and scoring queries run on relations
whose every value follows from o_orderkey and o_custkey by arithmetic. Each relation is a view of one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FROM = ["paypal.com", "paypa1.com", "micros0ft-security.com", "github.com", "contoso.com", "c0ntoso.com", "contoso.co", "gmail.com", "mail.example.co.uk", "example.co.uk", "paypol.com", "login-paypal.net"]
NAMES = ["PayPal Support", "Accounts Team", None, "Microsoft Account Team", "Jane Doe", "help@paypal.com"]
REPLY = [None, None, "gmail.com", "contoso.com", None, "paypal.com", "example.co.uk"]
RETURN = ["contoso.com", "mailer.test", "paypal.com", "bounce.example.co.uk", None]
SPF = ["pass", "pass", "fail", "softfail", None, "none", "pass", "permerror", "neutral"]
DKIM = ["pass", "none", "fail", "pass", None]
DMARC = ["pass", "fail", "none", None, "pass", "fail", "pass"]
TO = ["contoso.com", "example.co.uk", "hotmail.com"]
SUBJECTS = ["RE: Invoice ", "Password expires in ", "Security alert ", "Fwd: Payment "]
ORIGINS = ["10.0.0.7", "192.168.1.20", "198.51.100.9", "203.0.113.80", "172.20.4.4"]
URLS = [
    "https://www.paypal.com/signin", "http://paypa1.com/verify", "https://bit.ly/3xYz", "http://203.0.113.7/login",
    "https://accounts.google.com@evil.example/session", "http://xn--pypal-4ve.com/", "https://files.example.com/setup.exe",
    "https://files.example.com/archive.zip", "https://deals.example.top/win", "http://intranet.example.com:8081/a",
    "javascript:alert(1)", "data:text/html,hello", "https://docs.example.com/read?id=7", "https://login-paypal.net/a",
    "https://nam02.safelinks.protection.outlook.com/?url=https%3A%2F%2Fevil.example%2Fa&data=1", "https://contoso.com/help",
]
SENTENCES = [
    "Please act now to keep your account.", "We look forward to seeing you at lunch.", "Your account has been suspended by the team.",
    "Kindly process a wire transfer today.", "The report is attached for your review.", "Confirm your password on the page.",
    "You have won a prize in the draw.", "I am in a meeting and cannot talk.", "Send the gift cards and keep this confidential.",
    "I recorded you through your webcam.", "The weather was kind on the coast.", "A processing fee is due before release.",
]
FILES = ["report.pdf", "invoice.pdf.exe", "photo.jpg", "setup.msi", "notes.txt", "macro.docm", "run.ps1"]

#: SQL of each relation over orders; {pick}, {div} and {list} are filled in by dialect.
SPARK, DUCK = "spark", "duck"


def text(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("'", "''") + "'"


def pick(items: list, at: str, dialect: str) -> str:
    listed = ", ".join(text(x) for x in items)
    if dialect == SPARK:
        return f"element_at(array({listed}), CAST(({at}) % {len(items)} AS INT) + 1)"
    return f"([{listed}])[({at}) % {len(items)} + 1]"


def div(n: int, dialect: str, of: str = "k") -> str:
    return f"({of} div {n})" if dialect == SPARK else f"({of} // {n})"


def sql(name: str, dialect: str) -> str:
    """SQL of the relation messages, hops, urls, bodies, files or claims over a view named orders."""
    d = lambda n: div(n, dialect)
    p = lambda items, at: pick(items, at, dialect)
    keys = "(SELECT o_orderkey AS k, o_custkey AS c FROM orders)"
    expand = lambda upto: (
        f"(SELECT k, c, n, CAST(i AS BIGINT) AS i FROM (SELECT k, c, {upto} AS n, " + (f"explode(CASE WHEN {upto} > 0 THEN sequence(0L, {upto} - 1) ELSE CAST(array() AS ARRAY<BIGINT>) END) AS i" if dialect == SPARK else f"unnest(range({upto})) AS i") + f" FROM {keys}))"
    )
    if name == "messages":
        return f"""SELECT k AS message_id, c AS cust, {p(FROM, 'k')} AS from_domain, {p(NAMES, d(5))} AS display_name,
  {p(REPLY, d(3))} AS reply_to_domain, {p(RETURN, d(7))} AS return_path_domain, {p(SPF, d(2))} AS spf, {p(DKIM, d(11))} AS dkim,
  {p(DMARC, d(13))} AS dmarc, {p(TO, d(4))} AS to_domain, concat({p(SUBJECTS, d(6))}, CAST(k AS STRING)) AS subject,
  concat('203.0.113.', CAST(c % 250 AS STRING)) AS sender_ip, concat('user', CAST(c % 40 AS STRING)) AS local_part FROM {keys}"""
    if name == "hops":
        return f"""SELECT k AS message_id, CAST(n - i AS BIGINT) AS hop, CASE WHEN i = n - 1 THEN {p(ORIGINS, d(3))}
    ELSE concat('198.51.', CAST(i AS STRING), '.', CAST(k % 200 + 1 AS STRING)) END AS ip,
  1700000000 + k * 3600 + (n - i) * 120 - CASE WHEN k % 17 = 0 AND i = 0 THEN 7200 ELSE 0 END AS ts FROM {expand('(1 + k % 4)')}"""
    if name == "urls":
        return f"""SELECT k AS message_id, i AS ord, {p(URLS, 'k * 7 + i * i * 3 + ' + d(16))} AS value,
  (k + i) % 9 = 0 AS is_mismatch FROM {expand('(k % 4)')}"""
    if name == "bodies":
        return f"""SELECT k AS message_id, concat_ws(' ', {p(SENTENCES, 'k')}, {p(SENTENCES, d(2) + ' + 5')}, {p(SENTENCES, d(7))}) AS text FROM {keys}"""
    if name == "files":
        return f"""SELECT k AS message_id, {p(FILES, d(3))} AS name FROM {keys} WHERE k % 3 = 0"""
    if name == "claims":
        rows = " UNION ALL ".join(
            f"SELECT message_id, 0 AS pos, '{m}' AS method, {m} AS result FROM m UNION ALL SELECT message_id, 1, '{m}', 'pass' FROM m WHERE message_id % 3 = 0"
            for m in ("spf", "dkim", "dmarc")
        )
        return f"WITH m AS ({sql('messages', dialect)}) SELECT * FROM ({rows}) WHERE result IS NOT NULL"
    raise ValueError(name)


def relation(spark: SparkSession, sf_dir: str, name: str, a_task: int | None = None) -> DataFrame:
    """A relation of the corpus; a_task deals its orders to tasks of so many, before they grow."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    if a_task:
        orders = orders.repartition(-(-max(1, orders.count()) // a_task), "o_orderkey")
    return spark.sql(sql(name, SPARK).replace("FROM orders", "FROM {orders}"), orders=orders)


#: The message corpus as raw mail: every header and part follows from the relation messages by arithmetic.
BOUNDARY = "=_part"
RAW = r"""SELECT concat('/mail/', CAST(message_id AS STRING), '.eml') AS path, encode(concat_ws('\r\n',
  concat('Received: from relay', CAST(message_id % 7 AS STRING), '.example.net ([', sender_ip, ']) by mx.contoso.com; ', at),
  concat('Received: from desk (desk.local [10.0.0.', CAST(message_id % 200 AS STRING), ']) by relay.example.net; ', at),
  concat('Authentication-Results: mx.contoso.com (a; comment)', coalesce(concat('; spf=', spf, ' smtp.mailfrom=', coalesce(return_path_domain, from_domain)), ''), coalesce(concat('; dkim=', dkim, ' header.d=', from_domain), ''), coalesce(concat('; dmarc=', dmarc, ' (p=none) header.from=', from_domain), '')),
  CASE WHEN message_id % 4 = 0 THEN concat('Received-SPF: ', coalesce(spf, 'none'), ' (mx: ok) client-ip=', sender_ip, '; envelope-from=bounce@', from_domain, '; helo=desk') END,
  CASE WHEN dkim IS NOT NULL THEN concat('DKIM-Signature: v=1; a=rsa-sha256;\r\n\td=', from_domain, '; s=s1; h=from:to') END,
  concat('Return-Path: <bounce@', return_path_domain, '>'),
  concat('From: ', coalesce(concat('"', display_name, '" '), ''), '<', local_part, '@', from_domain, '>'),
  concat('Reply-To: <', local_part, '@', reply_to_domain, '>'),
  concat('To: "Doe, Jane" <Jane@', to_domain, '>, bob@', to_domain),
  concat('Subject: ', CASE WHEN message_id % 5 = 0 THEN concat('=?utf-8?B?', base64(encode(subject, 'utf-8')), '?=') ELSE subject END),
  concat('Date: ', at), concat('Message-ID: <', CAST(message_id AS STRING), '@', from_domain, '>'),
  CASE WHEN message_id % 3 = 0 THEN concat('X-Mailer: Mailer ', CAST(message_id % 5 AS STRING)) END,
  CASE WHEN message_id % 5 = 1 THEN concat('X-Originating-IP: [', sender_ip, ']') END,
  'MIME-Version: 1.0', 'Content-Type: multipart/mixed; boundary="{boundary}"', '',
  '--{boundary}', 'Content-Type: text/plain; charset=utf-8', '', concat('Hello ', to_domain), 'See https://files.example.com/setup.exe now',
  '--{boundary}', 'Content-Type: text/html; charset=utf-8', 'Content-Transfer-Encoding: quoted-printable', '', concat('<p>a=3Db <a href=3D"http://', from_domain, '/x">www.contoso.com</a></p>'),
  CASE WHEN message_id % 3 = 0 THEN concat_ws('\r\n', '--{boundary}', 'Content-Type: application/octet-stream', 'Content-Transfer-Encoding: base64', concat('Content-Disposition: attachment; filename="file', CAST(message_id % 4 AS STRING), '.bin"'), '', base64(encode(repeat('MZ', CAST(message_id % 9 + 1 AS INT)), 'utf-8'))) END,
  '--{boundary}--', ''), 'utf-8') AS content
FROM (SELECT *, concat('14 Nov 2023 ', lpad(CAST(message_id % 24 AS STRING), 2, '0'), ':', lpad(CAST(message_id % 60 AS STRING), 2, '0'), ':00 +0000') AS at FROM {messages})"""


#: Messages that one task parses: orders are so small that a file of them may be a single partition.
PARSED_A_TASK = 8192


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of the corpus as raw messages."""
    messages = relation(spark, sf_dir, "messages", PARSED_A_TASK)
    return spark.sql(RAW.replace("{boundary}", BOUNDARY), messages=messages)


def ctes(*names: str) -> str:
    """DuckDB WITH clauses of relations."""
    return "WITH " + ",\n".join(f"{n} AS ({sql(n, DUCK)})" for n in names)
