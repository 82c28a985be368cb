"""Attachments opened: archives, Office files, PDF, RTF, calendars and Outlook items, breadth first under a budget per message.

One row per message goes through one Arrow pass, because the budget is shared by all files of a message. Rows of
the result are files (also those found inside others) with their risks, links and text.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import content
from vellum.sources import archives, msg, sevenzip

#: Bounds of what is opened per message.
LISTED, EXTRACTED, ENTRY_BYTES, TOTAL_BYTES, DEPTH = 500, 40, 25 << 20, 60 << 20, 2
PROGRAMS = set("exe com scr pif bat cmd ps1 psm1 vbs vbe js jse wsf wsh hta msi msp dll cpl ocx lnk reg jar apk sh bash command iso img vhd vhdx one url chm".split())
ARCHIVES = set("zip rar 7z gz tgz tar cab ace arj lzh xz bz2 zst".split())
MACROS = set("docm dotm xlsm xltm xlam xlsb pptm potm ppsm sldm".split())
DISGUISED = re.compile(r"\.[a-z0-9]{2,4}\.(?:exe|scr|js|vbs|bat|cmd|lnk|hta)$", re.I)
RISKS = "array<struct<type:string,level:string>>"
FILES = f"message_id string, ord int, name string, inside string, depth int, size long, sha256 string, risks {RISKS}, links array<string>, text string, error string"


def ending(name: str) -> str:
    m = re.search(r"\.([A-Za-z0-9]+)$", name)
    return m[1].lower() if m else ""


def listing_risks(names: list[str]) -> list[tuple[str, str]]:
    out = []
    if any(ending(n) in PROGRAMS or DISGUISED.search(n) for n in names):
        out.append(("archive-executable", "high"))
    if any(ending(n) in ARCHIVES for n in names):
        out.append(("nested-archive", "medium"))
    return out


class Findings:
    """What one file holds."""

    def __init__(self) -> None:
        self.risks: list[tuple[str, str]] = []
        self.links: list[str] = []
        self.text: str | None = None
        self.children: list[tuple[str, bytes]] = []


def locked_risk(passwords: list[str]) -> tuple[str, str]:
    return ("archive-password", "high") if passwords else ("archive-encrypted", "medium")


def open_zip(raw: bytes, passwords: list[str], budget: int, out: Findings) -> None:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        files = [i for i in z.infolist() if not i.is_dir()][:LISTED]
        names = [i.filename for i in files]
        out.risks += listing_risks(names)
        if "[Content_Types].xml" in names:
            parts = {}
            for i in files[:EXTRACTED * 4]:
                if re.search(r"\.(?:rels|xml|bin)$|activex|embeddings", i.filename, re.I) and i.file_size <= min(ENTRY_BYTES, budget):
                    parts[i.filename] = z.read(i) if i.filename.lower().endswith((".rels", ".xml", ".bin")) else b""
                    budget -= len(parts[i.filename])
            risks, out.links = content.ooxml_risks(parts)
            out.risks += risks
            return
        secret = [i for i in files if i.flag_bits & 1]
        password = None
        if secret:
            out.risks.append(locked_risk(passwords))
            for p in [*passwords, "infected"]:
                try:
                    archives.zip_entry(z, secret[0], p)
                    password = p
                    break
                except archives.Locked:
                    continue
        for i in files:
            if len(out.children) >= EXTRACTED or budget <= 0:
                break
            if i.flag_bits & 1 and password is None:
                continue
            try:
                got = archives.zip_entry(z, i, password, min(ENTRY_BYTES, budget))
            except (ValueError, NotImplementedError, zipfile.BadZipFile, zlib.error, RuntimeError):
                continue
            budget -= len(got)
            out.children.append((i.filename.rsplit("/", 1)[-1] or i.filename, got))


def open_7z(raw: bytes, passwords: list[str], budget: int, out: Findings) -> None:
    files, password, locked = None, None, False
    for p in [None, *passwords, "infected"]:
        try:
            files, password = sevenzip.read(raw, p, most=max(0, budget)), p
            break
        except sevenzip.Locked:
            locked = True
    if files is None:
        try:
            files = sevenzip.read(raw, None, lambda n: False)
        except sevenzip.Locked:
            files = []
    out.risks += listing_risks([n for n, _ in files])
    if locked and (passwords or password is None):
        out.risks.append(locked_risk(passwords))
    for name, got in files:
        if got and len(out.children) < EXTRACTED and budget > 0:
            budget -= len(got)
            out.children.append((re.split(r"[\\/]", name)[-1] or name, got))


def inspect(name: str, mime: str, raw: bytes, passwords: list[str], budget: int) -> Findings:
    out = Findings()
    end = ending(name)
    if end in MACROS:
        out.risks.append(("macros", "high"))
    if raw[:2] == b"PK":
        open_zip(raw, passwords, budget, out)
    elif raw[:6] == sevenzip.MAGIC:
        open_7z(raw, passwords, budget, out)
    elif b"%PDF-" in raw[:1024]:
        risks, out.links = content.pdf_risks(raw)
        out.risks += risks
    elif raw[:5] == b"{\\rtf":
        out.risks += content.rtf_risks(raw)
    elif raw[:4] == msg.MAGIC[:4] and (end == "msg" or b"_\x00_\x00p\x00r\x00o\x00p\x00e\x00r\x00t\x00i\x00e\x00s" in raw):
        out.children.append((re.sub(r"(?i)\.msg$", "", name) + ".eml", msg.to_eml(raw)))
    elif raw[:4] == msg.MAGIC[:4]:
        out.risks += content.ole_risks(raw)
    elif end == "ics" or "calendar" in (mime or "").lower() or b"BEGIN:VCALENDAR" in raw[:200]:
        out.text, out.links = content.calendar_text(raw)
        if out.links:
            out.risks.append(("calendar-links", "medium"))
    return out


def walk(files: list[tuple[str, str, bytes]], passwords: list[str]) -> Iterator[tuple]:
    """(name, inside, depth, raw, findings, error) of the files and all found in them."""
    queue = deque((n, None, 0, m, raw) for n, m, raw in files)
    budget = TOTAL_BYTES
    while queue:
        name, inside, depth, mime, raw = queue.popleft()
        found, error = Findings(), None
        if raw and depth <= DEPTH:
            try:
                found = inspect(name, mime, raw, passwords, budget)
            except (ValueError, zipfile.BadZipFile, zlib.error, struct.error, EOFError, NotImplementedError, IndexError, RuntimeError, KeyError, StopIteration) as e:
                error = f"{type(e).__name__}: {e}"
        for child, got in found.children:
            budget -= len(got)
            queue.append((child, name, depth + 1, "", got))
        yield name, inside, depth, raw, found, error


def inspect_files(messages: DataFrame) -> DataFrame:
    """A row per file of messages (message_id, parts, read_text): FILES. Passwords come from the message's own text."""
    import hashlib

    own = F.transform(F.filter("parts", lambda p: p["is_file"]), lambda p: F.struct(p["filename"].alias("name"), p["mime"].alias("mime"), p["bytes"].alias("bytes")))
    rows = messages.select(F.col("message_id").cast("string").alias("message_id"), own.alias("files"), F.coalesce(content.passwords(F.col("read_text")), F.array().cast("array<string>")).alias("passwords")).where(F.size("files") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, files, passwords in zip(batch["message_id"], batch["files"], batch["passwords"]):
                listed = [(f["name"] or "attachment", f["mime"], bytes(f["bytes"] or b"")) for f in files]
                for i, (name, inside, depth, raw, found, error) in enumerate(walk(listed, list(passwords))):
                    yield pd.DataFrame([{
                        "message_id": key, "ord": i, "name": name, "inside": inside, "depth": depth, "size": len(raw), "sha256": hashlib.sha256(raw).hexdigest(),
                        "risks": [{"type": t, "level": v} for t, v in dict.fromkeys(found.risks)], "links": found.links, "text": found.text, "error": error,
                    }])

    return rows.mapInPandas(run, FILES)
