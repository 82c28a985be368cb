"""7z archives: header, LZMA, LZMA2, copy, deflate and bzip2 coders through the standard library, AES-256."""

from __future__ import annotations

import bz2
import hashlib
import lzma
import struct
import zlib
from dataclasses import dataclass, field

from vellum.sources.aes import cbc_decrypt

MAGIC = b"7z\xbc\xaf\x27\x1c"
MOST_OUTPUT = 200 << 20
MOST_ITEMS = 100_000


class Locked(ValueError):
    """A password is needed, or the one given is wrong."""


@dataclass
class Folder:
    coders: list = field(default_factory=list)  # (method, properties)
    binds: list = field(default_factory=list)
    sizes: list = field(default_factory=list)
    crc: int | None = None
    streams: list = field(default_factory=list)  # (size, crc)
    packed: int = 1


class Reader:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("7z: header ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        first, value = self.byte(), 0
        for i in range(8):
            if not first & (0x80 >> i):
                return value | ((first & ((0x80 >> i) - 1)) << (8 * i))
            value |= self.byte() << (8 * i)
        return value

    def count(self) -> int:
        n = self.number()
        if n > MOST_ITEMS:
            raise ValueError("7z: too many items")
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.take(-(-n // 8))
        return [bool(raw[i // 8] & (0x80 >> (i % 8))) for i in range(n)]

    def crcs(self, n: int) -> list[int | None]:
        defined = [True] * n if self.byte() else self.bits(n)
        return [struct.unpack("<I", self.take(4))[0] if d else None for d in defined]


def read_folder(r: Reader) -> Folder:
    f, ins, outs = Folder(), 0, 0
    for _ in range(r.count()):
        flags = r.byte()
        method = r.take(flags & 15)
        n_in, n_out = (r.number(), r.number()) if flags & 0x10 else (1, 1)
        f.coders.append((method, r.take(r.number()) if flags & 0x20 else b""))
        ins, outs = ins + n_in, outs + n_out
    f.binds = [(r.number(), r.number()) for _ in range(outs - 1)]
    f.packed = ins - len(f.binds)
    if ins != outs:
        raise ValueError("7z: coders with several inputs are not supported")
    if f.packed > 1:
        [r.number() for _ in range(f.packed)]
    f.sizes = [0] * outs
    return f


def read_streams(r: Reader) -> tuple[int, list[int], list[Folder]]:
    """(position of the packed data, packed sizes, folders)."""
    position, sizes, folders = 0, [], []
    while (kind := r.byte()) != 0:
        if kind == 6:
            position, n = r.number(), r.count()
            while (part := r.byte()) != 0:
                if part == 9:
                    sizes = [r.number() for _ in range(n)]
                elif part == 10:
                    r.crcs(n)
        elif kind == 7:
            r.byte()  # 11: folders
            n = r.count()
            if r.byte():
                raise ValueError("7z: external folders")
            folders = [read_folder(r) for _ in range(n)]
            while (part := r.byte()) != 0:
                if part == 12:
                    for f in folders:
                        f.sizes = [r.number() for _ in f.sizes]
                elif part == 10:
                    for f, crc in zip(folders, r.crcs(n)):
                        f.crc = crc
        elif kind == 8:
            counts = [1] * len(folders)
            part = r.byte()
            if part == 13:
                counts, part = [r.count() for _ in folders], r.byte()
            lengths = []
            for f, n in zip(folders, counts):
                own = [r.number() for _ in range(n - 1)] if part == 9 else [0] * max(0, n - 1)
                lengths.append([*own, main_size(f) - sum(own)] if n else [])
            if part == 9:
                part = r.byte()
            unknown = [(i, j) for i, (f, ls) in enumerate(zip(folders, lengths)) for j in range(len(ls)) if not (len(ls) == 1 and f.crc is not None)]
            found = {}
            while part != 0:
                if part == 10:
                    found = dict(zip(unknown, r.crcs(len(unknown))))
                part = r.byte()
            for i, (f, ls) in enumerate(zip(folders, lengths)):
                f.streams = [(n, f.crc if len(ls) == 1 and f.crc is not None else found.get((i, j))) for j, n in enumerate(ls)]
    for f in folders:
        if not f.streams and f.sizes:
            f.streams = [(main_size(f), f.crc)]
    return position, sizes, folders


def main_size(f: Folder) -> int:
    bound = {o for _, o in f.binds}
    return next(s for i, s in enumerate(f.sizes) if i not in bound)


def key_of(properties: bytes, password: str) -> tuple[bytes, bytes]:
    """(key, vector) of the AES coder."""
    first = properties[0]
    second = properties[1] if first & 0xC0 else 0
    salt_size, iv_size = (first >> 7 & 1) + (second >> 4), (first >> 6 & 1) + (second & 15)
    salt, iv = properties[2 : 2 + salt_size], properties[2 + salt_size : 2 + salt_size + iv_size]
    power, secret = first & 63, password.encode("utf-16-le")
    if power > 24 and power != 63:
        raise ValueError("7z: too many key rounds")
    if power == 63:
        return (salt + secret)[:32].ljust(32, b"\0"), iv.ljust(16, b"\0")
    digest, block = hashlib.sha256(), []
    for i in range(1 << power):
        block.append(salt + secret + i.to_bytes(8, "little"))
        if len(block) == 4096:
            digest.update(b"".join(block))
            block = []
    digest.update(b"".join(block))
    return digest.digest(), iv.ljust(16, b"\0")


def raw_filters(method: bytes, properties: bytes) -> list | None:
    if method == b"\x03\x01\x01":
        d, size = properties[0], struct.unpack("<I", properties[1:5])[0]
        return [{"id": lzma.FILTER_LZMA1, "lc": d % 9, "lp": d // 9 % 5, "pb": d // 45, "dict_size": max(4096, size)}]
    if method == b"\x21":
        bits = properties[0]
        size = 0xFFFFFFFF if bits == 40 else (2 | bits & 1) << (bits // 2 + 11)
        return [{"id": lzma.FILTER_LZMA2, "dict_size": size}]
    if method == b"\x03":
        return [{"id": lzma.FILTER_DELTA, "dist": properties[0] + 1}]
    if method == b"\x03\x03\x01\x03":
        return [{"id": lzma.FILTER_X86}]
    return None


def decode(f: Folder, packed: bytes, password: str | None, most: int) -> bytes:
    """A folder's content; coders are undone from the packed stream outward."""
    if main_size(f) > most:
        raise ValueError("7z: content is too large")
    data, later = packed, []
    source = dict(f.binds)  # input of a coder: whose output
    order = []
    now = next(i for i in range(len(f.coders)) if i not in {o for _, o in f.binds})
    while True:
        order.append(now)
        if now not in source:
            break
        now = source[now]
    for i in reversed(order):
        method, properties = f.coders[i]
        size = f.sizes[i]
        if method == b"\x00":
            data = data[:size]
        elif method == b"\x06\xf1\x07\x01":
            if password is None:
                raise Locked("7z: a password is needed")
            data = cbc_decrypt(data, *key_of(properties, password))[:size]
        elif method == b"\x04\x01\x08":
            data = zlib.decompressobj(-15).decompress(data, size)
        elif method == b"\x04\x02\x02":
            data = bz2.BZ2Decompressor().decompress(data, size)
        elif (filters := raw_filters(method, properties)) is not None and filters[0]["id"] in (lzma.FILTER_LZMA1, lzma.FILTER_LZMA2):
            try:
                data = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[*later, *filters]).decompress(data, size)
            except lzma.LZMAError as e:
                raise (Locked if password is not None else ValueError)(f"7z: {e}") from e
        else:
            raise ValueError(f"7z: coder {method.hex()} is not supported")
    if f.crc is not None and zlib.crc32(data) != f.crc:
        raise (Locked if password is not None else ValueError)("7z: checksum differs")
    return data


def header_of(raw: bytes, password: str | None) -> Reader:
    if raw[:6] != MAGIC or len(raw) < 32:
        raise ValueError("not a 7z archive")
    offset, size, _ = struct.unpack_from("<QQI", raw, 12)
    r = Reader(raw[32 + offset : 32 + offset + size])
    if not size:
        return Reader(b"\0")
    kind = r.byte()
    while kind == 23:
        position, sizes, folders = read_streams(r)
        begin = 32 + position
        r = Reader(decode(folders[0], raw[begin : begin + sizes[0]], password, MOST_OUTPUT))
        kind = r.byte()
    if kind != 1:
        raise Locked("7z: the header cannot be read") if password is not None else ValueError("7z: no header")
    return r


def read(raw: bytes, password: str | None = None, wanted=lambda name: True, most: int = MOST_OUTPUT) -> list[tuple[str, bytes | None]]:
    """(name, content) of the files; content is None for those not wanted."""
    r = header_of(raw, password)
    position, sizes, folders, names, empty = 0, [], [], [], None
    while r.at < len(r.raw) and (kind := r.byte()) != 0:
        if kind == 4:
            position, sizes, folders = read_streams(r)
        elif kind == 5:
            n = r.count()
            while (part := r.byte()) != 0:
                body = Reader(r.take(r.number()))
                if part == 17 and not body.byte():
                    names = body.raw[1:].decode("utf-16-le", "replace").split("\0")[:n]
                elif part == 14:
                    empty = body.bits(n)
        elif kind == 2:
            while (r.byte()) != 0:
                r.take(r.number())
    filled = [n for i, n in enumerate(names) if not (empty and empty[i])]
    out, at, begin, stream = [], 0, 32 + position, 0
    for f in folders:
        own = filled[at : at + len(f.streams)]
        length = sum(sizes[stream : stream + f.packed])
        content = decode(f, raw[begin : begin + length], password, most) if any(map(wanted, own)) else None
        begin, stream, cut = begin + length, stream + f.packed, 0
        for name, (size, crc) in zip(own, f.streams):
            piece = content[cut : cut + size] if content is not None else None
            if piece is not None and crc is not None and zlib.crc32(piece) != crc:
                raise (Locked if password is not None else ValueError)("7z: checksum differs")
            out.append((name, piece if wanted(name) else None))
            cut += size
        at += len(own)
    return out
