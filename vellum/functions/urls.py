"""URL decoders: percent, gateways and redirects, base64, hex, references, escapes, punycode.

Each decoder is a plain function of one string that returns the decoded text or None, and a Pandas UDF made from
it; columns that cannot match skip Python by a cheap test before the UDF.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable
from urllib.parse import parse_qsl, unquote, unquote_to_bytes, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most layers that are undone.
LAYERS = 5
#: Run lengths of the third gateway format, from 2 on.
RUN_KEYS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "sol": "/", "colon": ":", "period": ".", "commat": "@", "quest": "?", "equals": "="}
HEX = re.compile("%[0-9a-fA-F]{2}")


def percent_decode(value: str | None) -> str | None:
    """Up to five layers of percent-encoding; malformed UTF-8 is read byte by byte."""
    now, layers = value or "", 0
    while layers < LAYERS and HEX.search(now):
        try:
            after = unquote(now, errors="strict")
        except UnicodeDecodeError:
            after = unquote_to_bytes(now).decode("latin-1") if now.isascii() else HEX.sub(lambda m: chr(int(m[0][1:], 16)), now)
        if after == now:
            break
        now, layers = after, layers + 1
    return now if layers else None


def _lenient(value: str) -> str:
    try:
        return unquote(value, errors="strict")
    except UnicodeDecodeError:
        return value


def _third_format(url: str) -> str | None:
    """A link whose unsafe characters are stars and follow, in order, behind '__;'."""
    found = re.search(r"v3/__(.+?)__;(.*?)!", url)
    if not found:
        return None
    raw = _decoded_token(found[2]) if found[2] else b""
    if raw is None:
        return None
    rest = iter(raw.decode("utf-8", "replace"))

    def fill(m: re.Match) -> str:
        n = RUN_KEYS.find(m[1]) + 2 if m[1] is not None else 1
        got = "".join(c for _, c in zip(range(n), rest))
        return got if got or m[1] is not None else "*"

    return re.sub(r"\*\*(.)|\*", fill, _lenient(found[1]))


def _params(query: str) -> list[tuple[str, str]]:
    return parse_qsl(query, keep_blank_values=True, errors="replace")


def unwrap_once(url: str) -> tuple[str, bool] | None:
    """(destination, whether it is final although unknown) of one wrapper, or None."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return None
    if not parts.scheme or not host:
        return None
    params = _params(parts.query)
    value = lambda *names: next((v for n in names for k, v in params if k == n and v), None)
    path = parts.path
    if host.endswith("safelinks.protection.outlook.com") and value("url"):
        return value("url"), False
    if host == "urldefense.com" and path.startswith("/v3/__") and (got := _third_format(url)):
        return got, False
    if host.endswith("urldefense.proofpoint.com") and value("u"):
        if path.startswith("/v2/"):
            return _lenient(value("u").replace("-", "%").replace("_", "/")), False
        if path.startswith("/v1/"):
            return _lenient(value("u")), False
    if re.search(r"(?:^|\.)google\.[a-z.]+$", host) and path == "/url" and value("q", "url"):
        return value("q", "url"), False
    if host in ("l.facebook.com", "lm.facebook.com") and path == "/l.php" and value("u"):
        return value("u"), False
    if host == "linkprotect.cudasvc.com" and value("a"):
        return value("a"), False
    if host == "secure-web.cisco.com" and re.match("https?://", last := _lenient(path.rsplit("/", 1)[-1]), re.I):
        return last, False
    if re.search(r"(?:^|\.)mimecast\.com$", host) and "/s/" in path:
        return url, True
    for _, v in params:
        if re.match(r"(?:https?://|www\.)", v.strip(), re.I) and v.strip() != url:
            return v.strip(), False
    return None


def unwrap(value: str | None) -> str | None:
    """The destination behind up to five wrappers; None where nothing is wrapped."""
    now, seen = value or "", False
    for _ in range(LAYERS):
        step = unwrap_once(now)
        if step is None:
            break
        seen = True
        if step[1] or step[0] == now:
            break
        now = step[0]
    return now if seen else None


def _decoded_token(token: str) -> bytes | None:
    plain = token.replace("-", "+").replace("_", "/").rstrip("=")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def readable(raw: bytes) -> str | None:
    """UTF-8 text that is nearly all printable and holds a word."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    good = sum(c >= " " and c != "\x7f" and not "\x80" <= c < "\xa0" for c in text)
    return text if len(text) >= 4 and good / len(text) >= 0.95 and re.search("[A-Za-z]{3}", text) else None


def base64_decode(value: str | None) -> str | None:
    """Readable base64 tokens of a URL, a line each."""
    source = percent_decode(value) or value or ""
    tokens = [t for t in re.split(r"[/?&=#;,:.]+", source) if len(t) >= 8 and re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", t)]
    mixed = [t for t in dict.fromkeys(tokens) if re.search(r"\d", t) or (t.upper() != t and t.lower() != t)]
    found = [text for t in mixed if (raw := _decoded_token(t)) is not None and (text := readable(raw))]
    return "\n".join(found) or None


def hex_decode(value: str | None) -> str | None:
    runs = dict.fromkeys(re.findall(r"(?:[0-9a-fA-F]{2}){6,}", percent_decode(value) or value or ""))
    return "\n".join(t for r in runs if (t := readable(bytes.fromhex(r)))) or None


def entity_decode(value: str | None) -> str | None:
    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] == "#":
            n = int(e[2:], 16) if e[1] in "xX" else int(e[1:])
            return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else m[0]
        return NAMED.get(e.lower(), m[0])

    out = re.sub(r"&(#x[0-9a-fA-F]{1,8}|#[0-9]{1,9}|[A-Za-z]+);", one, value or "")
    return out if out != (value or "") else None


def escape_decode(value: str | None) -> str | None:
    at = lambda m: chr(n) if (n := int(m[1] or m[2] or m[3], 16)) <= 0x10FFFF and not 0xD800 <= n < 0xE000 else m[0]
    out = re.sub(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", at, value or "")
    return out if out != (value or "") else None


def punycode_decode(value: str | None) -> str | None:
    """The host with its xn-- labels as Unicode."""
    try:
        host = (urlsplit(value or "").hostname or "").lower()
    except ValueError:
        return None
    if "xn--" not in host:
        return None
    out = []
    for label in host.split("."):
        try:
            out.append(label[4:].encode("ascii").decode("punycode") if label.startswith("xn--") else label)
        except (UnicodeError, IndexError, ValueError, OverflowError):
            out.append(label)
    return ".".join(out)


def decode_all(value: str | None) -> str | None:
    """Entities, escapes, percent and wrappers undone until nothing changes, at most five times."""
    now = value or ""
    for _ in range(LAYERS):
        after = now
        for step in (entity_decode, escape_decode, percent_decode, unwrap):
            after = step(after) or after
        if after == now:
            break
        now = after
    return now if now != (value or "") else None


#: Every decoder by name: the function, and a pattern without which it cannot match.
DECODERS: dict[str, tuple[Callable[[str | None], str | None], str]] = {
    "percent": (percent_decode, "%[0-9a-fA-F]{2}"),
    "unwrap": (unwrap, r"(?i)[?&/](?:.*=)?"),
    "base64": (base64_decode, "[A-Za-z0-9+/_%-]{8}"),
    "hex": (hex_decode, "[0-9a-fA-F]{12}|%"),
    "entities": (entity_decode, "&[#A-Za-z]"),
    "escapes": (escape_decode, r"\\[ux]"),
    "punycode": (punycode_decode, "(?i)xn--"),
    "all": (decode_all, "."),
}


def register(name: str, function: Callable[[str | None], str | None], hint: str = ".") -> None:
    """Adds a decoder."""
    DECODERS[name] = (function, hint)


def safely(function: Callable[[str | None], str | None], value: str | None) -> str | None:
    try:
        return function(value) if value is not None else None
    except (ValueError, IndexError, OverflowError):
        return None


def decoder(name: str) -> Callable[[Column], Column]:
    """A column function of a decoder."""
    function, hint = DECODERS[name]

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: safely(function, v))

    return lambda c: F.when(c.rlike(hint), run(F.when(c.rlike(hint), c)))


def each_decoded(name: str, values: Column) -> Column:
    """What a decoder makes of each string of an array, null where it finds nothing."""
    function, hint = DECODERS[name]

    @F.pandas_udf("array<string>")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda vs: [safely(function, v) for v in vs] if vs is not None else None)

    able = F.exists(values, lambda v: v.rlike(hint))
    return F.when(able, run(F.when(able, F.transform(values, lambda v: F.when(v.rlike(hint), v)))))


def encodings(c: Column) -> Column:
    """Names of the decoders that find something, in one pass."""
    kinds = [(n, f) for n, (f, _) in DECODERS.items() if n != "all"]

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [n for n, f in kinds if safely(f, v) is not None])

    return run(c)


def native_unwrap(c: Column) -> Column:
    """The url parameter of Safe-Links and like wrappers, without Python: enough for links with one plain layer."""
    raw = F.regexp_extract(c, r"[?&](?:url|u|q|a)=((?i:https?%3A%2F%2F|https?://|www\.)[^&#]*)", 1)
    return F.when(raw != "", F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))
