"""HTML read statically: embedded payloads and hidden layers, to a bounded depth."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers that are opened, bytes that make a payload, and code points of a page that are read.
DEPTH, LEAST_BYTES, MOST_CHARS = 2, 64, 3_000_000
DATA_URI = re.compile(r"data:([a-z0-9.+/-]+)?(?:;[a-z0-9=._-]+)*;base64,([A-Za-z0-9+/=\s]{120,})", re.I)
ATOB = re.compile(r"atob\s*\(\s*[\"'`]([A-Za-z0-9+/=_-]{100,})[\"'`]\s*\)")
LITERAL = re.compile(r"[\"'`]([A-Za-z0-9+/]{800,}={0,2})[\"'`]")
ESCAPED = re.compile(r"(?:unescape|decodeURIComponent|decodeURI)\s*\(\s*[\"'`]([^\"'`]{100,})[\"'`]\s*\)", re.I)
LAYER = re.compile(r"<(?:html|form|input|script|body|div)\b|fetch\s*\(|XMLHttpRequest|location\b", re.I)
NAMES = [r"\bdownload\s*=\s*[\"']([^\"']+\.[a-z0-9]{2,5})[\"']", r"\.download\s*=\s*[\"'`]([^\"'`]+)[\"'`]", r"msSaveOrOpenBlob\s*\([^,]+,\s*[\"'`]([^\"'`]+)[\"'`]", r"saveAs\s*\([^,]+,\s*[\"'`]([^\"'`]+)[\"'`]"]
PASSWORD = re.compile(r"<input\b[^>]*\btype\s*=\s*[\"']?password", re.I)
LAYERS = "page_key string, ord int, depth int, how string, is_text boolean, size long, name string, password_form boolean, content binary"


def unbase64(value: str) -> bytes | None:
    clean = re.sub(r"\s+", "", value).replace("-", "+").replace("_", "/").rstrip("=")
    if len(clean) < 16 or len(clean) % 4 == 1:
        return None
    try:
        return base64.b64decode(clean + "=" * (-len(clean) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_text(raw: bytes) -> bool:
    head = raw[:2048]
    return bool(head) and sum(c in (9, 10, 13) or 32 <= c < 127 or c >= 0xC2 for c in head) > 0.9 * len(head)


def blobs(page: str) -> list[tuple[str, bytes]]:
    """(how, bytes) of the encoded payloads of a page, each once; raster images are content."""
    found: list[tuple[str, bytes | None]] = [("data: URI", unbase64(m[2])) for m in DATA_URI.finditer(page) if not re.match(r"image/(?!svg)", m[1] or "", re.I)]
    found += [("atob() call", unbase64(m[1])) for m in ATOB.finditer(page)] + [("base64 string", unbase64(m[1])) for m in LITERAL.finditer(page)]
    for m in ESCAPED.finditer(page):
        escapes = len(re.findall("%[0-9a-f]{2}", m[1], re.I))
        if escapes >= 10 and escapes * 3 >= 0.15 * len(m[1]):
            found.append(("percent-encoded string", re.sub(r"%([0-9a-fA-F]{2})", lambda h: chr(int(h[1], 16)), m[1]).encode("latin-1", "replace")))
    once = {(len(b), b[:32]): (how, b) for how, b in reversed(found) if b and len(b) >= LEAST_BYTES}
    return list(reversed(once.values()))


def saved_names(page: str) -> list[str]:
    return list(dict.fromkeys(m for p in NAMES for m in re.findall(p, page, re.I) if len(m) < 200))


def layers(page: str, depth: int = 0) -> Iterator[tuple]:
    """(depth, how, is_text, bytes, name, password_form) of what a page carries, hidden layers included."""
    names = saved_names(page)
    number = 0
    for how, raw in blobs(page[:MOST_CHARS]):
        text = raw.decode("utf-8", "replace") if is_text(raw) else None
        if text is None:
            name = names[number] if number < len(names) else names[0] if names else f"embedded-{number + 1}.bin"
            number += 1
            yield depth, how, False, raw, name, False
        elif depth < DEPTH and LAYER.search(text):
            yield depth, how, True, raw, None, bool(PASSWORD.search(text))
            yield from layers(text, depth + 1)


#: Pages without one of these carry nothing.
CARRIES = r"(?i)base64,|atob\s*\(|unescape|decodeURI|[A-Za-z0-9+/]{800}"


def hidden_pages(pages: Column) -> Column:
    """The texts of the pages hidden in an array of pages; Python runs only where a page may carry one."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda ps: [x[3].decode("utf-8", "replace") for p in ps for x in layers(p) if x[2]] if ps is not None else None)

    found = F.filter(pages, lambda p: p.rlike(CARRIES))
    return F.when(F.size(found) > 0, run(F.when(F.size(found) > 0, found))).otherwise(F.array().cast("array<string>"))


def hidden(rows: DataFrame, key: str, page: str) -> DataFrame:
    """LAYERS of each page; content holds what the caller hands to the file and HTML operators."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, html in zip(batch["page_key"], batch["html"]):
                got = [(k, i, d, how, text, len(raw), name, form, raw) for i, (d, how, text, raw, name, form) in enumerate(layers(html))]
                if got:
                    yield pd.DataFrame(got, columns=[c.strip().split(" ")[0] for c in LAYERS.split(",")])

    wanted = rows.where(F.col(page).rlike(CARRIES))
    return wanted.select(F.col(key).cast("string").alias("page_key"), F.col(page).alias("html")).mapInPandas(run, LAYERS)


def preview_counts(rows: DataFrame, key: list[str], page: str) -> DataFrame:
    """key, remote_images, embedded_images, links, removed: what a safe preview of a page would leave out."""
    n = lambda p: F.regexp_count(F.col(page), F.lit(p)).cast("long")
    return rows.select(
        *key, n(r"""(?i)<img\b[^>]*src\s*=\s*["']?https?:""").alias("remote_images"), n(r"""(?i)<img\b[^>]*src\s*=\s*["']?(?:cid|data):""").alias("embedded_images"),
        n(r"(?i)<a\b[^>]*href").alias("links"), n(r"(?i)<(?:script|iframe|object|embed|form|link|meta|base)\b").alias("removed"),
    )
