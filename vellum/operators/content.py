"""What files and pages hold: types by signature, HTML destinations, smuggling, entropy, documents, passwords."""

from __future__ import annotations

import math
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.iocs import exfil_service, risk

#: First bytes (hexadecimal), type and the endings that fit it, in order of precedence.
SIGNATURES = [
    ("4D5A", "Windows executable (PE)", "exe dll scr sys cpl ocx msi"),
    ("7F454C46", "ELF executable", "elf so bin"),
    ("CFFAEDFE", "Mach-O executable", "dylib bin app"),
    ("25504446", "PDF document", "pdf"),
    ("504B", "ZIP archive or Office/OpenDocument file", "zip docx xlsx pptx odt ods odp jar apk epub vsdx xlsm docm pptm"),
    ("52617221", "RAR archive", "rar"),
    ("377ABCAF271C", "7-Zip archive", "7z"),
    ("1F8B", "gzip archive", "gz tgz"),
    ("D0CF11E0", "Legacy Office document (OLE2)", "doc xls ppt msg vsd"),
    ("7B5C727466", "RTF document", "rtf doc"),
    ("89504E47", "PNG image", "png"),
    ("FFD8FF", "JPEG image", "jpg jpeg"),
    ("47494638", "GIF image", "gif"),
    ("424D", "BMP image", "bmp"),
    ("00000100", "ICO icon", "ico"),
    ("4C000000", "Windows shortcut (.lnk)", "lnk"),
    ("CAFEBABE", "Class file", "class"),
]
ISO = ("ISO disk image", "iso")
PROGRAMS = ["Windows executable (PE)", "ELF executable", "Mach-O executable", "Windows shortcut (.lnk)", "Class file"]
ARCHIVES = ["RAR archive", "7-Zip archive", "gzip archive"]
#: Code points of a page that are searched for smuggling code, for script, and at all.
SMUGGLING_CHARS, SCRIPT_CHARS, PAGE_CHARS = 200_000, 20_000, 3_000_000
ENTROPY_BYTES = 8 << 20

#: How a page uses a URL, the most specific use first, and the pattern that finds it.
USES = [
    ("form target", r"""(?i)<form\b[^>]*\baction\s*=\s*["']([^"']+)["']"""),
    ("fetch", r"""(?i)\bfetch\s*\(\s*["'`]([^"'`]+)["'`]"""),
    ("XMLHttpRequest", r"""(?i)\.open\s*\(\s*["'`](?:GET|POST|PUT)["'`]\s*,\s*["'`]([^"'`]+)["'`]"""),
    ("jQuery request", r"""(?i)\$\.(?:ajax|post|get)\s*\(\s*(?:\{[^}]*?url\s*:\s*)?["'`]([^"'`]+)["'`]"""),
    ("beacon", r"""(?i)sendBeacon\s*\(\s*["'`]([^"'`]+)["'`]"""),
    ("WebSocket", r"""(?i)new\s+WebSocket\s*\(\s*["'`]([^"'`]+)["'`]"""),
    ("request URL", r"""(?i)\burl\s*:\s*["'`](https?://[^"'`]+)["'`]"""),
    ("redirect", r"""(?i)location(?:(?:\.href)?\s*=|\.(?:replace|assign)\s*\()\s*["'`]([^"'`]+)["'`]"""),
    ("meta refresh", r"""(?i)<meta\b[^>]*http-equiv\s*=\s*["']?refresh[^>]*content\s*=\s*["'][^"']*url\s*=\s*([^"'>\s]+)"""),
    ("external script", r"""(?i)<script\b[^>]*\bsrc\s*=\s*["']([^"']+)["']"""),
    ("embedded frame", r"""(?i)<iframe\b[^>]*\bsrc\s*=\s*["']([^"']+)["']"""),
    ("URL in script", r"""(?i)["'`](https?://[^\s"'`<>]{4,})["'`]"""),
    ("stylesheet or resource", r"""(?i)<link\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""),
    ("image", r"""(?i)<img\b[^>]*\bsrc\s*=\s*["']([^"']+)["']"""),
    ("link", r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""),
]
SENDING = ["form target", "fetch", "XMLHttpRequest", "jQuery request", "beacon", "WebSocket", "request URL"]
#: Words that follow "password" without being one.
NOT_PASSWORDS = "is the your a an to for of protected required below above attached reset reminder expired expires expiry policy change changed update manager field here this that will be has have was".split()
PASSWORD = r"""(?iu)(?<![\p{L}\p{N}_])(?:password|passcode|passphrase|pass\s*code|pwd|pw|kennwort|passwort|mot\s+de\s+passe|contrase[ñn]a|senha|parola|wachtwoord|пароль)(?![\p{L}\p{N}_])\s*(?:for\s+the\s+(?:file|archive|attachment|zip|document)\s*)?(?:is|:|=|-|–|—)?\s*(?:is\s*)?[:\s]*["'“‘«]?([^\s"'”’»<>]{3,40})"""
MOST_PASSWORDS = 10


def ending_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\z", 1))


def sniff(content: Column) -> Column:
    """struct(label, endings) of a file's type by its first bytes, or null."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("struct<label:string,endings:array<string>>")
    kind = lambda label, endings: F.struct(F.lit(label).alias("label"), F.array(*[F.lit(e) for e in endings.split()]).alias("endings"))
    out = F.when(F.hex(F.substring(content, 0x8002, 5)) == "4344303031", kind(*ISO)).otherwise(out)
    for sign, label, endings in reversed(SIGNATURES):
        out = F.when(head.startswith(sign), kind(label, endings)).otherwise(out)
    return F.when(F.length(content) >= 2, out)


def smuggling(page: Column) -> Column:
    """Which of three marks of HTML smuggling a page has; two make a finding."""
    text = F.substring(page, 1, SMUGGLING_CHARS)
    return F.array_compact(F.array(
        F.when(text.rlike(r"(?i)new\s+Blob\s*\(|msSaveOrOpenBlob|createObjectURL"), "builds-file"),
        F.when(text.rlike(r"(?i)download\s*=|\.click\s*\(\)"), "triggers-download"),
        F.when(text.rlike(r"(?i)base64,[A-Za-z0-9+/=]{500,}|atob\s*\("), "large-payload"),
    ))


def file_findings(name: Column, content_type: Column, content: Column) -> Column:
    """Risks of a file by its content."""
    ending, kind = ending_of(name), sniff(content)
    program, fits = kind["label"].isin(PROGRAMS), (ending == "") | F.array_contains(kind["endings"], ending)
    page = F.coalesce(content_type.rlike("(?i)html"), F.lit(False)) | ending.isin("htm", "html", "shtml", "svg")
    text = F.decode(F.substring(content, 1, SMUGGLING_CHARS), "ISO-8859-1")
    return F.array_compact(F.array(
        F.when(program, risk("executable-content", "high")).when(~fits, risk("content", "medium")),
        F.when(page & (F.size(smuggling(text)) >= 2), risk("html-smuggling", "high")),
        F.when(page & F.substring(text, 1, SCRIPT_CHARS).rlike("(?i)<script"), risk("scripted", "medium")),
        F.when(kind["label"].isin(ARCHIVES), risk("archive", "medium")),
    ))


def hashes(content: Column) -> Column:
    return F.struct(F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"), F.sha1(content).alias("sha1"))


def used_in(page: Column) -> Column:
    """array of struct(url, rank, use) of every URL that a page loads or sends to, each use by itself."""
    text = F.substring(page, 1, PAGE_CHARS)
    clean = lambda u: F.replace(F.trim(u), F.lit("&amp;"), F.lit("&"))
    absolute = lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)

    def used(rank: int, use: str, pattern: str) -> Column:
        urls = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), clean), lambda u: u.rlike(r"(?i)\A(?:(?:https?:)?//|wss?://)"))
        return F.transform(urls, lambda u: F.struct(absolute(u).alias("url"), F.lit(rank).alias("rank"), F.lit(use).alias("use")))

    return F.concat(*[used(k, use, pattern) for k, (use, pattern) in enumerate(USES)])


def destinations(rows: DataFrame, key: list[str], page: str) -> DataFrame:
    """key, url, use (most specific), exfil of every URL that a page loads or sends to."""
    best = rows.select(*key, F.inline(used_in(F.col(page)))).groupBy(*key, "url").agg(F.min_by("use", "rank").alias("use"))
    return best.withColumn("exfil", exfil_service(F.col("url"), F.col("use").isin(SENDING)))


def looks_like_html(text: Column) -> Column:
    """HTML whatever its label says: a document tag, or four usual tags, near the beginning."""
    head = F.substring(text, 1, 4000)
    tags = F.regexp_count(head, F.lit(r"(?i)</?(?:div|table|p|a|span|td|tr|img|br)\b"))
    return F.coalesce(head.rlike(r"(?i)<(?:!doctype\s+html|html|body)(?![A-Za-z0-9_])") | (tags >= 4), F.lit(False))


def has_password_form(page: Column) -> Column:
    return F.coalesce(page.rlike(r"""(?i)<input\b[^>]*type\s*=\s*["']?password"""), F.lit(False))


def passwords(text: Column) -> Column:
    """Candidate passwords that a text names, each without and with the signs after it; ten at most."""
    found = F.regexp_extract_all(text, F.lit(PASSWORD), F.lit(1))
    bare = lambda p: F.regexp_replace(p, r"[.,;:!?)\]]+\z", "")
    good = F.filter(found, lambda p: (F.length(bare(p)) >= 3) & ~F.lower(bare(p)).isin(NOT_PASSWORDS))
    return F.slice(F.array_distinct(F.flatten(F.transform(good, lambda p: F.array(bare(p), p)))), 1, MOST_PASSWORDS)


def byte_entropy(raw: bytes | None) -> float | None:
    """Bits per byte of the first 8 MB."""
    if raw is None:
        return None
    n = np.bincount(np.frombuffer(raw[:ENTROPY_BYTES], dtype=np.uint8), minlength=256)
    p = n[n > 0] / max(1, n.sum())
    return float(-(p * np.log2(p)).sum()) if len(p) else 0.0


def entropy(content: Column) -> Column:
    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(byte_entropy)

    return run(content)


def pe_info(raw: bytes) -> dict | None:
    """Machine, build time and section count of a Windows program."""
    if len(raw) < 64 or raw[:2] != b"MZ":
        return None
    at = struct.unpack_from("<I", raw, 60)[0]
    if at + 12 > len(raw) or raw[at : at + 4] != b"PE\0\0":
        return None
    machine, sections, built = struct.unpack_from("<HHI", raw, at + 4)
    return {"machine": {0x14C: "x86", 0x8664: "x64", 0xAA64: "ARM64"}.get(machine, f"0x{machine:x}"), "sections": sections, "built": built}


def strings(raw: bytes, least: int = 6, most: int = 4 << 20) -> list[str]:
    """Printable ASCII runs."""
    return [m.decode("ascii") for m in re.findall(rb"[\x20-\x7e]{%d,}" % least, raw[:most])]


#: Addresses in the strings of a file, and what its entropy says.
FILE_URL = re.compile(r"\bhttps?://[^\s\"'<>()\\]{4,}", re.A | re.I)
FILE_EMAIL = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", re.A)
FILE_IP = re.compile(r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", re.A)
ENTROPY_NOTES = [(7.5, "very high"), (6.0, "high"), (3.5, "typical of text")]
DETAILS = "struct<entropy:double,n_strings:long,urls:array<string>,emails:array<string>,ips:array<string>>"
HEAD_BYTES = 64


def described(files: DataFrame, name: str = "filename", content: str = "bytes", most_urls: int = 15, most_others: int = 10) -> DataFrame:
    """files with details: what a file is by its bytes, whether its name agrees (null where nothing is known), how random it is, its first bytes
    as hexadecimal and as text, and the first addresses in its strings. A null content is an empty file."""
    firsts = lambda pattern, text, most: list(dict.fromkeys(m[0] for m in pattern.finditer(text)))[:most]

    def one(raw: bytes | None) -> dict:
        found = strings(bytes(raw or b""))
        text = "\n".join(found)
        return {
            "entropy": byte_entropy(bytes(raw or b"")), "n_strings": len(found), "urls": firsts(FILE_URL, text, most_urls),
            "emails": firsts(FILE_EMAIL, text, most_others), "ips": firsts(FILE_IP, text, most_others),
        }

    @F.pandas_udf(DETAILS)
    def read(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in values], columns=["entropy", "n_strings", "urls", "emails", "ips"])

    raw = F.coalesce(F.col(content), F.lit(b""))
    kind, ending = sniff(raw), ending_of(F.coalesce(F.col(name), F.lit("")))
    agrees = F.when(kind.isNull(), F.lit(None).cast("boolean")).otherwise((ending != "") & F.array_contains(kind["endings"], ending))
    head = F.substring(raw, 1, HEAD_BYTES)
    with_details = files.withColumn("_details", read(raw))
    level = F.lit("low")
    for least, note in reversed(ENTROPY_NOTES):
        level = F.when(F.col("_details.entropy") >= least, note).otherwise(level)
    shown = F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^\x20-\x7e]", ".")
    return with_details.withColumn("details", F.struct(
        F.length(raw).cast("long").alias("size"), kind["label"].alias("detected"), agrees.alias("name_agrees"), "_details.*", level.alias("entropy_note"),
        F.hex(head).alias("head_hex"), shown.alias("head_text"),
    )).drop("_details")


def rtf_risks(raw: bytes) -> list[tuple[str, str]]:
    text = raw.decode("latin-1")
    out = []
    if re.search(r"\\objclass\s*Equation|4571756174696f6e2e33", text, re.I):
        out.append(("rtf-equation", "high"))
    if re.search(r"\\objupdate", text, re.I):
        out.append(("rtf-objupdate", "high"))
    if re.search(r"\\object(?![a-z])|\\objdata", text, re.I):
        out.append(("embedded-object", "medium"))
    return out


#: Most deflated streams of a PDF that are opened, and most bytes that they give together.
PDF_STREAMS, PDF_BYTES = 80, 8 << 20
PDF_STREAM = re.compile(rb"(?<!end)stream\r?\n")
PDF_NAME = re.compile(r"/[^\s()<>\[\]{}/%]+")
PDF_MARKS = [("pdf-javascript", "high", r"/(?:JavaScript|JS)(?![A-Za-z])"), ("pdf-launch", "high", r"/Launch(?![A-Za-z])"), ("pdf-autoaction", "medium", r"/(?:OpenAction|AA)(?![A-Za-z])"), ("pdf-embedded", "medium", r"/EmbeddedFile(?![A-Za-z])"), ("pdf-submit", "high", r"/SubmitForm(?![A-Za-z])"), ("pdf-richmedia", "medium", r"/RichMedia(?![A-Za-z])")]


def pdf_text(raw: bytes, streams: int = PDF_STREAMS, most: int = PDF_BYTES) -> str:
    """A PDF with the #xx of its names written out and what its deflated streams hold appended."""
    parts, room, opened = [raw], most, 0
    for m in PDF_STREAM.finditer(raw):
        if opened == streams or not room:
            break
        end = raw.find(b"endstream", m.end())
        if end < 0:
            break
        head = raw[max(0, m.start() - 400) : m.start()]
        if b"Fl" not in head[head.rfind(b"obj") + 1 :]:  # /FlateDecode or /Fl among the filters of its own dictionary
            continue
        opened += 1
        try:
            parts.append(zlib.decompressobj().decompress(raw[m.end() : end], room))
        except zlib.error:
            continue
        room -= len(parts[-1])
    text = b"\n".join(parts).decode("latin-1")
    return PDF_NAME.sub(lambda n: re.sub(r"#([0-9A-Fa-f]{2})", lambda h: chr(int(h[1], 16)), n[0]), text)


def pdf_risks(raw: bytes) -> tuple[list[tuple[str, str]], list[str]]:
    """(risks, URIs) of a PDF."""
    text = pdf_text(raw)
    links = [m.replace("\\(", "(").replace("\\)", ")") for m in re.findall(r"/URI\s*\(((?:\\.|[^\\)])*)\)", text)]
    return [(kind, level) for kind, level, mark in PDF_MARKS if re.search(mark, text)], list(dict.fromkeys(links))


def ole_risks(raw: bytes) -> list[tuple[str, str]]:
    wide = lambda s: s.encode("utf-16-le")
    out = []
    if b"_VBA_PROJECT" in raw or wide("_VBA_PROJECT") in raw or wide("VBA") in raw:
        out.append(("macros", "high"))
        if re.search(rb"AutoOpen|Auto_Open|Document_Open|Workbook_Open|AutoExec", raw, re.I):
            out.append(("macro-autorun", "high"))
    if re.search(rb"DDEAUTO|\x13\s*DDE\s", raw):
        out.append(("dde", "high"))
    return out


def ooxml_risks(entries: dict[str, bytes]) -> tuple[list[tuple[str, str]], list[str]]:
    """(risks, links) of an Office file from its parts."""
    names = list(entries)
    out, links = [], []
    macros = [n for n in names if n.lower().endswith("vbaproject.bin")]
    if macros:
        out.append(("macros", "high"))
        if any(re.search(rb"AutoOpen|Auto_Open|Document_Open|Workbook_Open|AutoExec|Shell", entries[n], re.I) for n in macros):
            out.append(("macro-autorun", "high"))
    if any("/activex/" in n.lower() for n in names):
        out.append(("activex", "medium"))
    if any("/embeddings/" in n.lower() for n in names):
        out.append(("embedded-object", "medium"))
    for n in names:
        if n.endswith(".rels"):
            body = entries[n].decode("utf-8", "replace")
            for rel in re.findall(r"<Relationship\b[^>]*>", body):
                target = re.search(r'Target="([^"]*)"', rel)
                if 'TargetMode="External"' in rel and target and re.match(r"(?:https?:)?[\\/]{2}|https?:", target[1], re.I):
                    links.append(target[1])
                    if "/attachedTemplate" in rel:
                        out.append(("remote-template", "high"))
                    elif re.search(r"/(?:oleObject|frame|externalLink)", rel):
                        out.append(("remote-object", "high"))
        elif n.endswith(".xml") and re.search(rb"DDEAUTO|<w:instrText[^>]*>\s*DDE", entries[n]):
            out.append(("dde", "high"))
    return list(dict.fromkeys(out)), list(dict.fromkeys(links))


def calendar_text(raw: bytes) -> tuple[str, list[str]]:
    """(summary, description, place and organiser in lines; links) of an iCalendar file."""
    lines = re.sub(r"\r?\n[ \t]", "", raw.decode("utf-8", "replace")).splitlines()
    kept = []
    for line in lines:
        m = re.match(r"(SUMMARY|DESCRIPTION|LOCATION|ORGANIZER|DTSTART|URL)(?:;[^:]*)?:(.*)", line, re.I)
        if m:
            kept.append(m[2].replace("\\n", "\n").replace("\\N", "\n").replace("\\,", ",").replace("\\;", ";"))
    text = "\n".join(kept)
    return text, list(dict.fromkeys(re.findall(r"https?://[^\s<>\"]+", text)))


def human_size(n: int) -> str:
    if not n:
        return "0 B"
    i = min(int(math.log(n, 1024)), 3)
    return f"{n / 1024**i:.{1 if i else 0}f} {('B', 'KB', 'MB', 'GB')[i]}"
