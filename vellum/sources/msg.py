"""Outlook items: the compound file (allocation tables, directory, small streams) and the message rebuilt from its properties."""

from __future__ import annotations

import re
import struct
from datetime import datetime, timedelta, timezone
from email.header import Header
from email.message import EmailMessage
from email.utils import format_datetime

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END = 0xFFFFFFFA
#: Most attachments and recipients of a message, and depth of items in items.
ATTACHMENTS, RECIPIENTS, DEPTH = 200, 500, 3
PAGES = {65001: "utf-8", 932: "shift_jis", 936: "gbk", 949: "euc_kr", 950: "big5", 28591: "latin-1", 28592: "iso8859_2", 20127: "ascii", 50220: "iso2022_jp", 51932: "euc_jp", 20866: "koi8_r"}
DROPPED = ("content-type", "content-transfer-encoding", "mime-version", "content-disposition")


class Compound:
    """Storages and streams by place in the directory."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC or len(raw) < 512:
            raise ValueError("not an Outlook item")
        self.raw = raw
        self.size = 1 << struct.unpack_from("<H", raw, 30)[0]
        self.mini = 1 << struct.unpack_from("<H", raw, 32)[0]
        if self.size not in (512, 4096) or self.mini > self.size:
            raise ValueError("compound file: unknown sector size")
        first_dir, self.cutoff, first_mini = (struct.unpack_from("<I", raw, at)[0] for at in (48, 56, 60))
        tables = [s for s in struct.unpack_from("<109I", raw, 76) if s < END]
        at, seen = struct.unpack_from("<I", raw, 68)[0], set()
        while at < END and at not in seen:
            seen.add(at)
            words = self.words(self.sector(at))
            tables += [s for s in words[:-1] if s < END]
            at = words[-1] if words else END
        self.fat = [w for t in tables for w in self.words(self.sector(t))]
        self.mini_fat = self.words(self.chain(first_mini, self.fat, self.sector))
        listed = self.chain(first_dir, self.fat, self.sector)
        self.entries = []
        for i in range(0, len(listed) - 127, 128):
            e = listed[i : i + 128]
            n = max(0, min(64, struct.unpack_from("<H", e, 64)[0]) - 2)
            left, right, child = struct.unpack_from("<3I", e, 68)
            start, length = struct.unpack_from("<IQ", e, 116)
            self.entries.append((e[:n].decode("utf-16-le", "replace"), e[66], left, right, child, start, length & 0xFFFFFFFF if self.size == 512 else length))
        root = self.entries[0]
        self.small = self.chain(root[5], self.fat, self.sector)

    @staticmethod
    def words(raw: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    def sector(self, n: int) -> bytes:
        return self.raw[(n + 1) * self.size : (n + 2) * self.size]

    def chain(self, start: int, table, read) -> bytes:
        out, seen = [], set()
        while start < END and start not in seen and start < len(table) + 1:
            seen.add(start)
            out.append(read(start))
            start = table[start] if start < len(table) else END
        return b"".join(out)

    def stream(self, entry: tuple) -> bytes:
        start, length = entry[5], entry[6]
        if length < self.cutoff:
            return self.chain(start, self.mini_fat, lambda n: self.small[n * self.mini : (n + 1) * self.mini])[:length]
        return self.chain(start, self.fat, self.sector)[:length]

    def children(self, entry: tuple) -> list[tuple]:
        out, stack, seen = [], [entry[4]], set()
        while stack:
            i = stack.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            out.append(self.entries[i])
            stack += [self.entries[i][2], self.entries[i][3]]
        return out


def properties(c: Compound, storage: tuple, head: int) -> tuple[dict, list[tuple]]:
    """({id: bytes, number or time}, sub-storages) of a storage; head: bytes before the fixed-size values."""
    props: dict = {}
    children = c.children(storage)
    for e in children:
        m = re.fullmatch(r"__substg1\.0_([0-9A-F]{4})([0-9A-F]{4})", e[0], re.I)
        if e[1] == 2 and m:
            props[int(m[1], 16)] = (int(m[2], 16), c.stream(e))
    for e in children:
        if e[1] == 2 and e[0] == "__properties_version1.0":
            raw = c.stream(e)
            for at in range(head, len(raw) - 15, 16):
                kind, name = struct.unpack_from("<HH", raw, at)
                if kind == 3:
                    props.setdefault(name, (3, struct.unpack_from("<i", raw, at + 8)[0]))
                elif kind == 0x40:
                    ticks = struct.unpack_from("<Q", raw, at + 8)[0]
                    if ticks < 1 << 60:
                        props.setdefault(name, (0x40, datetime(1601, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=ticks // 10)))
    return props, [e for e in children if e[1] == 1]


def text_of(props: dict, name: int, page: int) -> str:
    kind, value = props.get(name, (0, None))
    if kind == 0x1F:
        out = value.decode("utf-16-le", "replace")
    elif kind in (0x1E, 0x102):
        try:
            out = value.decode(PAGES.get(page, f"cp{page}"), "replace")
        except LookupError:
            out = value.decode("cp1252", "replace")
    else:
        return ""
    return out.rstrip("\0")


def clean(value: str) -> str:
    """A value without the signs that could begin a header of its own."""
    return re.sub(r"[\x00-\x1f\x7f<>]", "", value)


def mailbox(name: str, address: str) -> str:
    name = re.sub(r'[\r\n"\\]', "_", name)
    shown = name if name.isascii() else Header(name, "utf-8").encode()
    return f'"{shown}" <{address}>' if name and name != address else f"<{address}>"


def header_lines(c: Compound, props: dict, storages: list[tuple], page: int) -> list[str]:
    original = text_of(props, 0x007D, page)
    if original:
        unfolded = re.sub(r"\r?\n[ \t]+", " ", original).splitlines()
        return [x for x in unfolded if x.strip() and x.split(":")[0].strip().lower() not in DROPPED]
    sender = clean(text_of(props, 0x5D01, page) or text_of(props, 0x0C1F, page) or text_of(props, 0x0065, page))
    out = [f"From: {mailbox(text_of(props, 0x0C1A, page) or text_of(props, 0x0042, page), sender)}"] if sender else []
    to = []
    for s in [s for s in storages if s[0].lower().startswith("__recip_version1.0_")][:RECIPIENTS]:
        own = properties(c, s, 8)[0]
        address = clean(text_of(own, 0x39FE, page) or text_of(own, 0x3003, page))
        if address:
            to.append(mailbox(text_of(own, 0x3001, page), address))
    if to:
        out.append("To: " + ", ".join(to))
    subject = clean(text_of(props, 0x0037, page))
    out.append("Subject: " + (subject if subject.isascii() else Header(subject, "utf-8").encode().replace("\n", "")))
    date = next((props[n][1] for n in (0x0039, 0x0E06) if n in props and props[n][0] == 0x40), None)
    if date:
        out.append("Date: " + format_datetime(date))
    if identity := clean(text_of(props, 0x1035, page)):
        out.append(f"Message-ID: <{identity}>")
    return [*out, "X-Converted-From: Outlook item without Internet headers"]


def rebuilt(c: Compound, storage: tuple, head: int, depth: int) -> bytes:
    props, storages = properties(c, storage, head)
    page = next((props[n][1] for n in (0x3FDE, 0x3FFD) if n in props and props[n][0] == 3), 1252)
    body = EmailMessage()
    plain, html = text_of(props, 0x1000, page), text_of(props, 0x1013, page)
    if plain or not html:
        body.set_content(plain)
        if html:
            body.add_alternative(html, subtype="html")
    else:
        body.set_content(html, subtype="html")
    for s in [s for s in storages if s[0].lower().startswith("__attach_version1.0_")][:ATTACHMENTS]:
        own, inner = properties(c, s, 8)
        name = next((t for n in (0x3707, 0x3704, 0x3001) if (t := text_of(own, n, page))), "attachment")
        mime = text_of(own, 0x370E, page)
        cid = text_of(own, 0x3712, page).strip("<>")
        data = own[0x3701][1] if 0x3701 in own and isinstance(own[0x3701][1], bytes) else None
        item = next((x for x in inner if x[0] == "__substg1.0_3701000D"), None)
        if item is not None and depth < DEPTH:
            data, mime = rebuilt(c, item, 24, depth + 1), "application/x-message"
            name = name if name.lower().endswith(".eml") else re.sub(r"(?i)\.msg$", "", name) + ".eml"
        if data is None:
            continue
        main, _, sub = (mime if re.fullmatch(r"[\w.+-]+/[\w.+-]+", mime) else "application/octet-stream").partition("/")
        if main in ("text", "multipart", "message"):
            main, sub = "application", "octet-stream"
        body.add_attachment(data, maintype=main, subtype=sub, filename=clean(name), disposition="inline" if cid else "attachment", **({"cid": f"<{clean(cid)}>"} if cid else {}))
    return "\r\n".join(header_lines(c, props, storages, page)).encode("utf-8", "replace") + b"\r\n" + body.as_bytes()


def to_eml(raw: bytes) -> bytes:
    """The message of an Outlook item in RFC 822 form."""
    c = Compound(raw)
    return rebuilt(c, c.entries[0], 32, 0)
