"""Uploads to messages: gzip, ZIP and 7z archives opened to a bounded depth, Outlook items converted, other files refused.

The bounds are part of the semantics: they decide what an archive bomb costs an executor.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

from vellum.sources import aes, msg, sevenzip

#: Depth of archives in archives, files of one, bytes of one file and of a gzip stream.
DEPTH, ENTRIES = 2, 200
ENTRY_BYTES, GZIP_BYTES = 25 << 20, 100 << 20
WANTED = (".eml", ".msg", ".txt", ".zip", ".7z", ".gz")
#: Bytes that are searched for a NUL, the mark of a binary file.
SNIFFED = 4096


class Locked(ValueError):
    """No password opens the archive."""


def gunzip(raw: bytes, most: int = GZIP_BYTES) -> bytes:
    out = zlib.decompressobj(31).decompress(raw, most + 1)
    if len(out) > most:
        raise ValueError("gzip: content is too large")
    return out


def zip_entry(archive: zipfile.ZipFile, info: zipfile.ZipInfo, password: str | None, most: int = ENTRY_BYTES) -> bytes:
    """An entry's bytes: stored, deflated, ZipCrypto or WinZip AES."""
    if info.file_size > most:
        raise ValueError("zip: entry is too large")
    if not info.flag_bits & 1:
        return archive.read(info)
    if password is None:
        raise Locked("zip: a password is needed")
    if info.compress_type != 99:
        try:
            return archive.read(info, password.encode())
        except (RuntimeError, zipfile.BadZipFile, zlib.error) as e:
            raise Locked("zip: wrong password") from e
    extra, strength, method = info.extra, 3, 8
    while len(extra) >= 4:
        kind, size = struct.unpack_from("<HH", extra)
        if kind == 0x9901 and size >= 7:
            strength, method = extra[8], struct.unpack_from("<H", extra, 9)[0]
        extra = extra[4 + size :]
    source = archive.fp
    source.seek(info.header_offset)
    head = source.read(30)
    source.seek(info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    data = aes.winzip_decrypt(source.read(info.compress_size), password, strength)
    if data is None:
        raise Locked("zip: wrong password")
    return data if method == 0 else zlib.decompressobj(-15).decompress(data, most)


def trial(passwords: list[str | None], attempt: Callable[[str | None], list]) -> list:
    """attempt with each password in turn, none first; Locked when none opens it."""
    for p in passwords:
        try:
            return attempt(p)
        except (Locked, sevenzip.Locked):
            continue
    raise Locked("password-protected: no password opens it")


def entries(raw: bytes, passwords: list[str | None], wanted: Callable[[str], bool] = lambda n: True, most: int = ENTRIES) -> list[tuple[str, bytes]]:
    """(name, bytes) of an archive's files."""
    if raw[:6] == sevenzip.MAGIC:
        found = trial(passwords, lambda p: sevenzip.read(raw, p, wanted))
        return [(n, b) for n, b in found if b is not None][:most]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        chosen = [i for i in z.infolist() if not i.is_dir() and wanted(i.filename)][:most]
        return trial(passwords, lambda p: [(i.filename, zip_entry(z, i, p)) for i in chosen])


def messages(name: str, raw: bytes, passwords: list[str | None], depth: int = 0, archive: str | None = None) -> Iterator[tuple[str, str | None, bytes, str | None]]:
    """(name, archive, message, error) of every message in a file."""
    label = f"{archive} › {name}" if archive else name
    try:
        if raw[:2] == b"\x1f\x8b" and depth < DEPTH:
            yield from messages(name.removesuffix(".gz"), gunzip(raw), passwords, depth + 1, label)
        elif (raw[:4] in (b"PK\x03\x04", b"PK\x05\x06") or raw[:6] == sevenzip.MAGIC) and depth < DEPTH:
            for inner, content in entries(raw, passwords, lambda n: n.lower().endswith(WANTED)):
                yield from messages(inner.rsplit("/", 1)[-1], content, passwords, depth + 1, label)
        elif raw[:8] == msg.MAGIC:
            yield name, archive, msg.to_eml(raw), None
        elif b"\0" in raw[:SNIFFED]:
            yield name, archive, b"", "not an email: binary content"
        else:
            yield name, archive, raw, None
    except (ValueError, zipfile.BadZipFile, zlib.error, struct.error, EOFError, NotImplementedError, IndexError, OSError, RuntimeError, StopIteration) as e:
        yield name, archive, b"", f"{type(e).__name__}: {e}"
