import pytest
from pyspark.sql import functions as F

from vellum.functions import domains, ips, pasted, text, urls
from vellum.operators import auth, content, export, iocs, score, summary
from vellum.sources import mail


def value(spark, column, **inputs):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]).select(column).first()[0]


@pytest.mark.parametrize("ip, valid, private", [
    ("10.0.0.1", True, True), ("8.8.8.8", True, False), ("010.1.1.1", False, False), ("256.1.1.1", False, False), ("1.2.3", False, False),
    ("172.31.0.1", True, True), ("172.32.0.1", True, False), ("100.64.0.1", True, True), ("224.0.0.1", True, True),
    ("::1", True, True), ("::", True, True), ("fe80::1", True, True), ("fd00::1", True, True), ("2001:db8::1", True, False),
    ("::ffff:192.168.0.1", True, True), ("::ffff:8.8.8.8", True, False), ("1::2::3", False, False), ("1:2:3:4:5:6:7:8", True, False),
    ("1:2:3:4:5:6:7", False, False), ("12345::", False, False), ("", False, False),
])
def test_ips(spark, ip, valid, private):
    c = F.col("x")
    assert value(spark, ips.is_ip(c), x=ip) is valid
    assert value(spark, ips.is_private(c), x=ip) is private


def test_ips_in_text(spark):
    c = F.col("x")
    assert value(spark, ips.ips_in(c), x="from 1.2.3.4 and 1.2.3.4.5, v6 [IPv6:2001:db8::1] 9.9.9.9") == ["1.2.3.4", "9.9.9.9", "2001:db8::1"]
    assert value(spark, ips.sending_ips(c), x="from [192.168.1.23] (dsl.example [203.0.113.7]) by mx (5.6.7.8); date") == ["203.0.113.7", "192.168.1.23"]
    assert value(spark, ips.sending_ips(c), x="from a (helo=[9.9.9.9] [10.0.0.1]) by b")[0] == "10.0.0.1"


@pytest.mark.parametrize("domain, org", [
    ("mail.example.com", "example.com"), ("a.b.example.co.uk", "example.co.uk"), ("co.uk", "co.uk"), ("EXAMPLE.com.", "example.com"), ("x", "x"), ("", None),
])
def test_org_domain(spark, domain, org):
    assert value(spark, domains.org_domain(F.col("x")), x=domain) == org
    assert domains.org_of(domain) == (org or "")


@pytest.mark.parametrize("host, kind", [
    ("paypal.com", None), ("www.paypal.com", None), ("paypa1.com", "confusable"), ("pаypal.com", "confusable"), ("paypol.com", "typosquat"),
    ("login-paypal.net", "contains"), ("secure.apple.evil.test", "contains"), ("pineapple.test", None), ("rnicrosoft.com", "confusable"), ("", None),
])
def test_lookalike(spark, host, kind):
    got = value(spark, domains.lookalike(F.col("x")), x=host)
    assert (got["kind"] if got else None) == kind


def test_own_domains(spark):
    got = value(spark, domains.lookalike(F.col("x"), ["contoso.com"]), x="contoso.co")
    assert (got["kind"], got["own"]) == ("tld-swap", True)
    assert value(spark, domains.lookalike(F.col("x"), ["contoso.com"]), x="mail.contoso.com") is None


def test_host_and_defang(spark):
    c = F.col("x")
    assert value(spark, domains.host_of(c), x="https://user:p@WWW.Example.com:8443/a?b") == "example.com"
    assert value(spark, domains.host_of(c), x="mailto:a@b.c") is None
    assert value(spark, text.defang_url(c), x="https://evil.test/p?url=http%3A%2F%2Fbad.test") == "hxxps[://]evil[.]test/p?url=http%3A%2F%2Fbad[.]test"
    assert value(spark, text.defang_text(c), x="see http://a.test and b@c.test, file x.pdf") == "see hxxp[://]a[.]test and b[@]c[.]test, file x.pdf"
    assert value(spark, text.defang_ip(c), x="2001:db8::1") == "2001[:]db8[:][:]1"


def test_subject_key(spark):
    assert value(spark, text.subject_key(F.col("x")), x="RE: Invoice  12345 due") == "invoice # due"


def test_unicode(spark):
    c = F.col("x")
    assert value(spark, text.reveal_controls(c), x="invoice‮fdp.exe") == "invoice[U+202E RLO]fdp.exe"
    assert value(spark, text.mixed_script_words(c), x="pаypal Москва hello") == ["pаypal"]
    assert value(spark, text.invisible_in_words(c), x="pass​word") == ["s​w"]


@pytest.mark.parametrize("url, want", [
    ("https://eu.safelinks.protection.outlook.com/?url=https%3A%2F%2Fevil.test%2Fa&data=x", "https://evil.test/a"),
    ("https://urldefense.proofpoint.com/v2/url?u=http-3A__evil.test_a&d=x", "http://evil.test/a"),
    ("https://www.google.com/url?q=https://evil.test/&sa=D", "https://evil.test/"),
    ("https://urldefense.com/v3/__https://evil.test/a*b__;Iw!!x", "https://evil.test/a#b"),
    ("https://plain.test/", None), ("not a url", None),
])
def test_unwrap(url, want):
    assert urls.unwrap(url) == want


def test_decoders():
    assert urls.percent_decode("a%2520b") == "a b"
    assert urls.percent_decode("plain") is None
    assert urls.base64_decode("https://x.test/#dmljdGltQGNvbXBhbnkuY29t") == "victim@company.com"
    assert urls.hex_decode("https://x.test/76696374696d40782e7465") == "victim@x.te"
    assert urls.entity_decode("a&#x2F;b&amp;c&bogus;") == "a/b&c&bogus;"
    assert urls.escape_decode(r"hi\x21\u{1F600}") == "hi!\U0001F600"
    assert urls.punycode_decode("http://xn--pypal-4ve.com/") == "pаypal.com"
    assert urls.decode_all("a%26%2347%3Bb") == "a/b"


def test_url_risks(spark):
    def kinds(u, mismatch=False):
        return [r["type"] for r in value(spark, iocs.url_risks(F.col("x"), F.col("m")), x=u, m=mismatch)]

    assert kinds("https://accounts.google.com@evil.test/") == ["credentials-url"]
    assert kinds("http://203.0.113.9:8080/x.exe") == ["odd-port", "direct-download", "ip-url"]
    assert kinds("javascript:alert(1)") == ["script-url"]
    assert kinds("https://api.telegram.org/bot1/send") == ["exfil-endpoint"]
    assert kinds("https://microsoft.com/", True) == ["mismatch"]
    assert kinds("https://bit.ly/x") == ["url-shortener"]


def test_deceptive_link(spark):
    c = iocs.is_deceptive(F.col("t"), F.col("h"))
    assert value(spark, c, t="www.paypal.com", h="https://evil.test/") is True
    assert value(spark, c, t="View invoice", h="https://evil.test/") is False
    assert value(spark, c, t="paypal.com", h="https://www.paypal.com/a") is False


def test_files(spark):
    c, n = F.col("b"), F.col("n")
    def kinds(name, raw, mime="x"):
        return [r["type"] for r in value(spark, content.file_findings(n, F.lit(mime), c), n=name, b=bytearray(raw))]

    assert kinds("a.pdf", b"MZ\x90\x00") == ["executable-content"]
    assert kinds("a.pdf", b"%PDF-1.4") == []
    assert kinds("a.doc", b"PK\x03\x04") == ["content"]
    assert kinds("p.html", b"<script>new Blob([atob('x')]); a.click()</script>") == ["html-smuggling", "scripted"]
    assert value(spark, content.passwords(F.col("x")), x="The password is: 7731. Password reset required") == ["7731", "7731."]
    assert [r["type"] for r in value(spark, iocs.file_risks(F.col("x")), x="report.pdf.exe")] == ["double-extension", "risky-extension"]


def test_points(spark):
    assert [value(spark, score.diminishing(F.col("x"), 25, 12), x=n) for n in (0, 1, 3, 9)] == [0, 25, 49, 73]


def test_csv_and_uuid(spark):
    import uuid

    assert value(spark, export.csv_cell(F.col("x")), x='=SUM(A1,"b")') == '"\'=SUM(A1,""b"")"'
    assert value(spark, export.uuid5(F.col("x")), x="abc") == str(uuid.uuid5(export.STIX_SPACE, "abc"))


def test_pasted(spark):
    from vellum.functions import pasted

    c = F.col("x")
    got = lambda x: value(spark, pasted.to_bytes(c), x=x)
    assert [bytes(got(x)["bytes"]) for x in ("4d 5a 90 00", "0x4d,0x5a", r"\x4d\x5a", "4d:5a")] == [b"MZ\x90\0", b"MZ", b"MZ", b"MZ"]
    assert bytes(got("00000000  4d 5a 90 00  |MZ..|")["bytes"]) == b"MZ\x90\0"
    assert bytes(got("aGVsbG8gd29ybGQ")["bytes"]) == b"hello world" and bytes(got("data:text/plain;base64,aGVsbG8=")["bytes"]) == b"hello"
    assert got("abc")["error"] and got("")["error"] and got("not base64!")["error"]


def test_summary(spark):
    from vellum.operators import summary

    c = F.col("x")
    assert [value(spark, summary.lookup_target(c), x=x) for x in ("Example.com", "8.8.8.8", "10.0.0.1", "http://a.b", "-bad.com")] == ["example.com", "8.8.8.8", None, None, None]
    got = value(spark, summary.policy(F.lit("v=DMARC1; p=reject"), F.lit("v=spf1 mx ~all"), F.array(F.lit("mx.a.test"))), x=1)
    assert tuple(got) == ("ok", "warn", True)
    assert [value(spark, summary.abuse_class(F.col("x")), x=n) for n in (50, 25, 0)] == ["malicious", "suspicious", "clean"]


def test_hidden_layers(spark):
    import base64

    from vellum.operators import pages

    inner = base64.b64encode(b"<form action='https://x.test'><input type=password>" + b" " * 80).decode()
    file = base64.b64encode(bytes(range(128)) * 2).decode()
    page = f'<a download="inv.zip">x</a><script>atob("{inner}"); atob("{file}")</script>'
    got = spark.createDataFrame([(1, page), (2, "<p>plain</p>"), (3, None)], "id long, html string")
    rows = pages.hidden(got, "id", "html").orderBy("ord").collect()
    assert [(r["is_text"], r["password_form"], r["name"]) for r in rows] == [(True, True, None), (False, False, "inv.zip")]


def test_typed_domains():
    good, bad = domains.typed_domains("https://www.Contoso.com/a, jane@example.co.uk; not a domain\na.test b.test\n,contoso.com.")
    assert good == ["contoso.com", "example.co.uk", "a.test", "b.test"] and bad == ["not a domain"]
    assert domains.typed_domains(None) == ([], [])


def test_address_lists(spark):
    rows = [('"Doe, Jane" <J@x.test>, bob@y.test, "Other" <j@x.test>',), ("undisclosed-recipients:;",), ('"open, a@b.test',), ("<a,b@c.test>, d@e.test",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(mail.addresses(F.array("v"))).collect()]
    assert [[tuple(a) for a in x] for x in got] == [[("Doe, Jane", "j@x.test"), (None, "bob@y.test")], [], [("open, a@b.test", "a@b.test")], [(None, "a,b@c.test"), (None, "d@e.test")], []]
    long = spark.createDataFrame([('"a" ' * 50_000 + "<z@x.test>",)], "v string").select(mail.addresses(F.array("v"))).first()[0]
    assert [a["email"] for a in long] == ["z@x.test"]


def test_whole_messages(spark):
    rows = [("From: a\r\n\r\nhello",), ("From: a\nTo: b",), ("x" * 60,), ("From: a\n" + " " + "y" * 60,), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(pasted.has_body(F.col("t"))).collect()]
    assert got == [True, False, True, False, False, False]


def test_spf_of_both_headers(spark):
    row = spark.range(1).select(
        F.struct(F.lit("pass").alias("status"), F.create_map(F.lit("smtp.mailfrom"), F.lit("x.test")).alias("props"), F.lit("spf=pass (designates 203.0.113.9 as permitted sender)").alias("raw")).alias("c"),
        F.struct(F.lit("Pass").alias("result"), F.lit("198.51.100.1").alias("client_ip")).alias("r"),
    )
    got = row.select(auth.spf_sources(F.col("c"), F.col("r"), F.lit("")).alias("s")).first()["s"]
    assert (got["ip"], got["results_agree"], got["ips_agree"]) == ("203.0.113.9", True, False)


def test_summary_of_origin_and_files(spark):
    row = spark.range(1).select(
        summary.origin_ip(F.lit(None).cast("string"), F.array(F.lit("from a ([10.0.0.1])"), F.lit("by x (203.0.113.5)"))).alias("origin"),
        summary.is_forwarded(F.lit("note.EML"), F.lit(None).cast("string")).alias("eml"), summary.is_forwarded(F.lit("a.pdf"), F.lit("application/pdf")).alias("pdf"),
        summary.vendor_url("reputation", F.lit("attachment"), F.lit("a b.pdf"), F.lit("ab12")).alias("hash"), summary.vendor_url("reputation", F.lit("attachment"), F.lit("a b.pdf"), F.lit("")).alias("name"),
    ).first()
    assert (row["origin"], row["eml"], row["pdf"]) == ("203.0.113.5", True, False)
    assert row["hash"].endswith("/file/ab12") and row["name"].endswith("/search/a%20b.pdf")


def test_bundles_and_events(spark):
    import json
    import uuid

    found = spark.createDataFrame(
        [
            (1, "email", "a@b.test", 0, "From", []), (1, "ip", "10.0.0.1", 1, "Received", []), (1, "ip", "203.0.114.7", 2, "Received", []),
            (1, "url", "http://b.test/x'y", 3, "body", [("punycode", "high")]), (1, "domain", "b.test", 4, "body", None),
        ],
        "message_id long, kind string, value string, ord long, source string, risks array<struct<type:string,level:string>>",
    )
    verdicts = spark.createDataFrame(
        [(1, 'Pay "now"', ("Ann", "A@b.test"), 70, "High Risk", ["dmarc-fail"], ["Sender spoofing"]), (2, None, (None, None), 5, "Low Risk", [], [])],
        "message_id long, subject string, sender struct<name:string,email:string>, score long, tier string, reasons array<string>, attack_types array<string>",
    )
    at = "2024-01-01T00:00:00.000Z"
    bundles = {r["message_id"]: json.loads(r["bundle"]) for r in export.stix_bundles(found, verdicts, at).collect()}
    objects = bundles[1]["objects"]
    assert [o["type"] for o in objects] == ["identity", "email-addr", "indicator", "ipv4-addr", "indicator", "url", "indicator", "domain-name", "indicator", "email-message", "report"]
    ids = [o["id"] for o in objects]
    assert len(set(ids)) == len(ids) and set(objects[-1]["object_refs"]) == set(ids[1:-1])
    assert objects[1]["id"] == "email-addr--" + str(uuid.uuid5(export.STIX_SPACE, '{"value":"a@b.test"}')) == objects[-2]["from_ref"]
    assert objects[6]["pattern"] == "[url:value = 'http://b.test/x\\'y']" and objects[6]["indicator_types"] == ["malicious-activity"]
    assert objects[6]["description"] == "Seen in: body. Flags: punycode" and objects[8]["indicator_types"] == ["unknown"]
    assert objects[-1]["description"] == "Verdict: High Risk (70/100). dmarc-fail" and objects[-1]["labels"] == ["phishing", "Sender spoofing"]
    assert [o["type"] for o in bundles[2]["objects"]] == ["identity", "email-message", "report"]
    assert bundles[2]["objects"][-1]["name"] == "Phishing analysis: (no subject)"
    events = {r["message_id"]: json.loads(r["event"])["Event"] for r in export.misp_events(found, verdicts, "2024-01-01").collect()}
    got = [(a["type"], a["value"], a["to_ids"], a["comment"]) for a in events[1]["Attribute"]]
    assert got == [
        ("email-subject", 'Pay "now"', False, "Subject"), ("email-src-display-name", "Ann", False, "From display name"), ("email-src", "a@b.test", False, "From"),
        ("url", "http://b.test/x'y", True, "body; punycode"), ("domain", "b.test", False, "body"), ("ip-src", "203.0.114.7", False, "Received"),
    ]
    assert events[1]["threat_level_id"] == "1" and [t["name"] for t in events[1]["Tag"]] == ["phishing", 'vellum:verdict="High Risk"', 'vellum:attack-type="Sender spoofing"']
    assert events[2]["Attribute"] == [] and events[2]["info"] == "Phishing: (no subject)" and events[2]["published"] is False


def test_csv_reports(spark):
    rows = spark.createDataFrame([(1, 2, "url", "=x,y"), (1, 1, "ip", "10.0.0.1"), (2, 1, "email", None)], "id long, ord long, type string, value string")
    got = {r["id"]: r["csv"] for r in export.csv_reports(rows, ["id"], ["type", "value", "source"]).collect()}
    head = export.BOM + "type,value,source" + export.END
    assert got == {1: head + "ip,10.0.0.1," + export.END + "url,\"'=x,y\",", 2: head + "email,,"}


def test_described_files(spark):
    import math

    png = bytes.fromhex("89504E470D0A1A0A") + b"see http://a.test/x1 and http://a.test/x1 or bob@b.test \x00 at 10.1.2.3 short"
    rows = spark.createDataFrame(
        [(1, "a.png", png), (2, "a.exe", png), (3, "noending", png), (4, "t.txt", b"hello world"), (5, None, None), (6, "r.bin", bytes(range(256)) * 4)],
        "id long, filename string, bytes binary",
    )
    got = {r["id"]: r["details"] for r in content.described(rows).collect()}
    assert [got[i]["name_agrees"] for i in (1, 2, 3, 4)] == [True, False, False, None]
    assert got[1]["detected"] == "PNG image" and got[1]["urls"] == ["http://a.test/x1"] and got[1]["emails"] == ["bob@b.test"] and got[1]["ips"] == ["10.1.2.3"]
    assert got[1]["n_strings"] == 2 and got[1]["head_hex"].startswith("89504E47") and len(got[1]["head_hex"]) == 128 and got[1]["head_text"].startswith(".PNG....see")
    assert (got[5]["size"], got[5]["entropy"], got[5]["entropy_note"], got[5]["head_hex"], got[5]["urls"]) == (0, 0.0, "low", "", [])
    assert math.isclose(got[6]["entropy"], 8.0) and got[6]["entropy_note"] == "very high"


def test_names_of_unnamed_parts():
    from vellum.sources import mail

    def names(*heads):
        return [p[4] for h in heads for p in mail.parse(f"{h}\r\n\r\nx\r\n".encode())[1]]

    assert names(
        "Content-Type: image/png\r\nContent-ID: <pic@1>", "Content-Type: text/calendar\r\nContent-Disposition: attachment",
        "Content-Type: application/vnd.ms-excel", "Content-Type: application/pdf; name=a.pdf", "Content-Type: text/plain",
    ) == ["inline-pic@1", "invite.ics", "unnamed-part.vndmsexcel", "a.pdf", None]
