"""Raw messages to tables: headers, parts, bodies, authentication clauses, hops.

Bytes are read once, in one Arrow-batched pass that returns every message's headers and parts as nested arrays; all
tables are projections of that one frame. File contents are a column of their own that other plans never read.
"""

from __future__ import annotations

import email
import email.parser
import email.policy
import re
from collections.abc import Iterator
from email.header import decode_header
from email.message import Message
from functools import lru_cache
from itertools import accumulate
from urllib.parse import unquote_to_bytes

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import domains, ips, text
from vellum.sources import archives

#: Headers of which one makes a text a message, and those that a message has once.
KNOWN = ["from", "to", "subject", "date", "received", "message-id", "return-path", "reply-to", "authentication-results", "dkim-signature", "received-spf", "mime-version", "content-type"]
SINGLE = ["from", "to", "subject", "date", "message-id", "reply-to", "return-path", "sender"]
#: Headers that a reader wants first, in order.
KEY_HEADERS = ["from", "reply-to", "return-path", "to", "subject", "date", "message-id", "authentication-results", "received-spf", "dkim-signature", "content-type", "x-mailer", "x-originating-ip"]
DEPTH = 60
#: Messages and bytes of their parts that go back to Spark together.
HELD_ROWS, HELD_BYTES = 512, 8 << 20

HEADER = "pos:int,name:string,value:string"
PART = "path:array<int>,mime:string,charset:string,disposition:string,filename:string,content_id:string,is_file:boolean,size:bigint,text:string,bytes:binary"
PARSED = f"name string, archive string, error string, headers array<struct<{HEADER}>>, parts array<struct<{PART}>>, message_id string"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
HEADERS_ARROW, PARTS_ARROW = (pa.list_(pa.struct([(f.split(":")[0], _KINDS[f.split(":")[1]]) for f in fields.split(",")])) for fields in (HEADER, PART))
CLAUSE = "array<struct<method:string,result:string,props:map<string,string>,raw:string>>"


def words_decoded(value: str) -> str:
    """RFC 2047 words as text; what cannot be decoded stays."""
    if "=?" not in value:
        return value
    try:
        return "".join(p.decode(c or "latin-1", "replace") if isinstance(p, bytes) else p for p, c in decode_header(value))
    except (LookupError, ValueError, email.errors.HeaderParseError):
        return value


def text_of(raw: bytes, charset: str | None) -> str:
    for name in (charset, "utf-8"):
        try:
            return raw.decode(name or "utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("cp1252", "replace")


def file_name(part: Message) -> str | None:
    """The name of a part, RFC 2231 and encoded words decoded; null where it has none."""
    value = part.get_param("filename", None, "content-disposition") or part.get_param("name", None)
    if isinstance(value, tuple):
        return text_of(unquote_to_bytes(value[2]) if "%" in value[2] else value[2].encode("latin-1", "replace"), value[0])
    return words_decoded(str(value)) if value else None


def inferred_name(mime: str, cid: str | None) -> str:
    """A name for a file that has none, by its Content-ID or type."""
    if cid:
        return f"inline-{cid}"
    if mime == "message/rfc822":
        return "message.eml"
    ending = re.sub(r"[^A-Za-z0-9]", "", mime.partition("/")[2] or "bin")
    return "invite.ics" if mime == "text/calendar" else f"unnamed-part.{ending}"


def declared(content_type: str | None, disposition: str | None, default: str) -> tuple[str, str | None, str | None, str | None, str | None]:
    """(type, boundary, charset, disposition, file name) that the headers of a part declare."""
    part = Message(policy=email.policy.compat32)
    part.set_default_type(default)
    for name, value in (("content-type", content_type), ("content-disposition", disposition)):
        if value is not None:
            part.set_raw(name, value)
    return part.get_content_type(), part.get_boundary(), part.get_content_charset(), (part.get_content_disposition() or "").lower() or None, file_name(part)


#: Headers of parts repeat; long ones are not kept.
_DECLARED = lru_cache(2048)(declared)
KEPT_CHARS = 500


def declared_by(message: Message) -> tuple[str, str | None, str | None, str | None, str | None]:
    first: dict[str, str] = {}
    for name, value in message.raw_items():
        first.setdefault(name.lower(), value)
    one, two = first.get("content-type"), first.get("content-disposition")
    return (_DECLARED if len(one or "") + len(two or "") <= KEPT_CHARS else declared)(one, two, message.get_default_type())


def parts_of(message: Message, path: tuple[int, ...] = ()) -> Iterator[tuple]:
    """The leaves of a MIME tree in order, each with its path; attached messages are files."""
    inner = message.get_payload()
    mime, _, charset, shown, name = declared_by(message)
    if mime.startswith("multipart/") and isinstance(inner, list) and len(path) < DEPTH:
        for i, child in enumerate(inner):
            yield from parts_of(child, (*path, i))
        return
    if isinstance(inner, list):
        raw = b"".join(x.as_bytes() for x in inner)
    else:
        raw = message.get_payload(decode=True) or b""
    cid = str(message.get("content-id") or "").strip("<> \t\r\n") or None
    is_file = shown == "attachment" or mime == "message/rfc822" or (bool(name) and shown != "inline" and not mime.startswith("text/")) or not mime.startswith(("text/", "multipart/"))
    if is_file and not name:
        name = inferred_name(mime, cid)
    yield (list(path), mime, charset, shown, name, cid, is_file, len(raw), None if is_file else text_of(raw, charset), raw if is_file else None)


#: A regular head: fields of printable ASCII, folded or not, and the empty line behind them. Possessive, so that it takes linear time.
HEAD = re.compile(rb"(?:[!-9;-~]++:[\t -~]*+\r?\n(?:[\t ][\t -~]*+\r?\n)*+)++\r?\n")
FIELD = re.compile(r"([!-9;-~]+):([\t -~]*(?:\r?\n[\t ][\t -~]*)*)\r?\n")
FOLD = re.compile(r"\r?\n[ \t]+")
EOL = re.compile(rb"\r?\n\Z")


class Irregular(ValueError):
    """A message that only the general parser reads."""


def regular(raw: bytes, depth: int = 0, inside: bool = False) -> Message:
    """What email.message_from_bytes makes of a message with regular heads, closed boundaries and no attached messages."""
    head = HEAD.match(raw)
    if not head or depth > DEPTH:
        raise Irregular
    message = Message(policy=email.policy.compat32)
    for name, value in FIELD.findall(head[0].decode("ascii")):
        message.set_raw(name, value.lstrip(" \t").rstrip("\r\n"))
    mime, boundary, *_ = declared_by(message)
    if not mime.startswith(("multipart/", "message/")):
        body = raw[head.end() :]
        message.set_payload((EOL.sub(b"", body) if inside else body).decode("ascii", "surrogateescape"))
        return message
    if mime.startswith("message/") or mime == "multipart/digest" or not boundary or not boundary.isascii():
        raise Irregular
    start, closed = None, False
    for line in re.finditer(rb"^--%s(--)?[ \t]*(?:\r?\n|\Z)" % re.escape(boundary.encode()), raw[head.end() :], re.M):
        at = head.end() + line.start()
        if start is not None:
            message.attach(regular(raw[start:at], depth + 1, True))
        start, closed = head.end() + line.end(), bool(line[1])
        if closed:
            break
    if not closed or not message.is_multipart():
        raise Irregular
    return message


def flat_headers(fields: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    return [(i, name, (FOLD.sub(" ", value) if "\n" in value else value).strip()) for i, (name, value) in enumerate(fields)]


def parse_headers(raw: bytes) -> list[tuple[int, str, str]]:
    """The headers of one message, as parse gives them; of a regular head nothing else is read."""
    head = HEAD.match(raw)
    if head:
        return flat_headers(FIELD.findall(head[0].decode("ascii")))
    return headers_of(email.parser.BytesParser(policy=email.policy.compat32).parsebytes(raw, headersonly=True))


def message_of(raw: bytes) -> Message:
    """email.message_from_bytes, by a shorter way where the message is regular."""
    try:
        if raw.count(b"\r") == raw.count(b"\r\n"):
            return regular(raw)
    except Irregular:
        pass
    return email.message_from_bytes(raw, policy=email.policy.compat32)


def headers_of(message: Message) -> list[tuple[int, str, str]]:
    headers = []
    for i, (name, value) in enumerate(message.items()):
        flat = FOLD.sub(" ", str(value)).strip()
        if not flat.isascii():
            flat = flat.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        headers.append((i, name, flat))
    return headers


def parse(raw: bytes) -> tuple[list[tuple], list[tuple]]:
    """(headers, parts) of one message."""
    message = message_of(raw)
    return headers_of(message), list(parts_of(message))


def nested(rows: tuple[list[tuple], ...], kind: pa.ListType) -> pa.Array:
    """Lists of tuples as an Arrow array of lists of structs, made field by field."""
    each = [x for xs in rows for x in xs]
    fields = list(kind.value_type)
    values = [pa.array(column, f.type) for column, f in zip(zip(*each), fields)] if each else [pa.array([], f.type) for f in fields]
    offsets = pa.array([0, *accumulate(len(xs) for xs in rows)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, fields=fields), type=kind)


def read_messages(files: DataFrame, passwords: list[str] | None = None, bodies: bool = True) -> DataFrame:
    """One row per message of files (path, content): archives are opened, each failure is a row with its error.

    Without bodies there is no column parts, and what follows a message's head is not parsed.
    message_id is the file's path and the message's number in it, the same at every run; what a file holds stays together in one task.
    """
    tried = [None, "infected", *(passwords or [])]
    size_at = PARTS_ARROW.value_type.get_field_index("size")

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        for number, (name, archive, raw, error) in enumerate(archives.messages(path.rsplit("/", 1)[-1], content or b"", tried)):
            headers, parts = ([], []) if error else parse(raw) if bodies else (parse_headers(raw), [])
            known = any(x[1].lower() in KNOWN for x in headers)
            yield name, archive, error or (None if known else "no known header"), headers, parts, f"{path}#{number}"

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        *texts, headers, parts, message_id = zip(*held)
        columns = {c: pa.array(values, pa.string()) for c, values in zip(("name", "archive", "error"), texts)}
        columns["headers"] = nested(headers, HEADERS_ARROW)
        if bodies:
            columns["parts"] = nested(parts, PARTS_ARROW)
        return pa.RecordBatch.from_pydict(columns | {"message_id": pa.array(message_id, pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for row in rows(path.as_py(), content.as_py()):
                    held.append(row)
                    size += sum(x[size_at] for x in row[4])
                    if size > HELD_BYTES or len(held) >= HELD_ROWS:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    return files.select("path", "content").mapInArrow(run, PARSED if bodies else PARSED.replace(f" parts array<struct<{PART}>>,", ""))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content of every file under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


# --- projections ----------------------------------------------------------------------------------


def headers(messages: DataFrame) -> DataFrame:
    return messages.select("message_id", F.inline("headers")).withColumn("name_lc", F.lower("name"))


def parts(messages: DataFrame) -> DataFrame:
    return messages.select("message_id", F.inline("parts"))


def values_of(name: str, column: str = "headers") -> Column:
    """Values of a header in order, as an array."""
    return F.transform(F.filter(column, lambda h: F.lower(h["name"]) == name), lambda h: h["value"])


def value_of(name: str, column: str = "headers") -> Column:
    """The first value of a header that is not empty, or null."""
    return F.get(F.filter(values_of(name, column), lambda v: v != ""), F.lit(0))


def x_headers(messages: DataFrame) -> DataFrame:
    """message_id, pos, name, name_lc, value of the headers that begin with X-."""
    return headers(messages).where(F.col("name_lc").startswith("x-"))


def duplicated(messages: DataFrame) -> DataFrame:
    """message_id, name, n of headers that a message has more than once but should not."""
    return headers(messages).where(F.col("name_lc").isin(SINGLE)).groupBy("message_id", F.col("name_lc").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def decoded(c: Column) -> Column:
    """Encoded words as text; Python runs only for values that have them."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else words_decoded(v))

    return F.when(c.contains("=?"), run(F.when(c.contains("=?"), c))).otherwise(c)


ADDRESS = r"(?i)[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"


def address(c: Column) -> Column:
    """struct(name, email) of a written address."""
    inside = F.regexp_extract(c, r"<\s*([^<>\s]+@[^<>\s]+)\s*>", 1)
    found = F.lower(F.when(inside != "", inside).otherwise(F.regexp_extract(c, ADDRESS, 0)))
    name = F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"""^\s*["']|["']\s*$""", ""))
    name = F.trim(F.regexp_replace(name, r"^\"|\"$", ""))
    return F.struct(F.when((name != "") & (F.lower(name) != found), name).alias("name"), F.when(found != "", found).alias("email"))


#: One entry of an address list: commas inside quotes and angle brackets divide nothing. Possessive, so that long values need no stack.
ENTRY = r'(?:"[^"]*+(?:"|\z)|<(?:"[^"]*+(?:"|\z)|[^>"]++)*+(?:>|\z)|[^,"<]++)++'


def addresses(values: Column) -> Column:
    """array of struct(name, email) of a header's values: each address once, in order, with the name that came first.

    Groups without members ("undisclosed-recipients:;") give nothing.
    """
    entries = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(ENTRY), F.lit(0))))
    found = F.filter(F.transform(entries, lambda e: address(F.trim(e))), lambda a: a["email"].isNotNull())
    return F.coalesce(F.filter(found, lambda a, i: F.array_position(found["email"], a["email"]) == i + 1), F.array().cast("array<struct<name:string,email:string>>"))


def address_list(values: Column) -> Column:
    """The addresses of a header's values, without names."""
    return addresses(values)["email"]


def core(messages: DataFrame, *keep: str) -> DataFrame:
    """One row of typed columns per message, with the columns of messages that are to be kept."""
    m = messages.select("message_id", "name", "archive", "error", "headers", *keep, F.filter("parts", lambda p: ~p["is_file"]).alias("texts"))
    body = lambda mime: F.array_join(F.transform(F.filter("texts", lambda p: p["mime"] == mime), lambda p: p["text"]), "\n")
    with_fields = m.withColumns({
        "sender": address(decoded(value_of("from"))), "reply_to": address(value_of("reply-to")), "return_path": address(value_of("return-path")),
        "to": address_list(values_of("to")), "cc": address_list(values_of("cc")),
        "delivered_to": F.get(address_list(values_of("delivered-to")), F.lit(0)), "subject": decoded(value_of("subject")),
        "date_s": date_seconds(value_of("date")), "id_header": value_of("message-id"), "mailer": value_of("x-mailer"), "originating": value_of("x-originating-ip"),
        "has_reply_headers": value_of("in-reply-to").isNotNull() | value_of("references").isNotNull(),
        "body_text": body("text/plain"), "body_html": body("text/html"),
    })
    shown = F.when(F.trim("body_text") != "", F.col("body_text")).otherwise(text.strip_html(F.col("body_html")))
    return with_fields.withColumn("read_text", shown).drop("texts")


def date_seconds(c: Column) -> Column:
    """Seconds of an RFC 822 date; null where it cannot be read."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s*[A-Za-z]{2,9},\s*", ""), r"\([^)]*\)", ""), r"\s+", " "))
    zoned = F.regexp_replace(F.regexp_replace(bare, r"(?i) (?:GMT|UTC|UT|Z)$", " +0000"), r"^(\d) ", "0$1 ")
    timed = F.regexp_replace(zoned, r"^(\S+ \S+ \S+ \d{1,2}:\d{2}) ([+-])", "$1:00 $2")
    return F.unix_seconds(F.try_to_timestamp(timed, F.lit("dd MMM yyyy HH:mm:ss Z")))


def without_comments(value: str) -> str:
    out, depth = [], 0
    for c in value:
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= depth > 0
        elif not depth:
            out.append(c)
    return "".join(out)


def clauses(value: str | None) -> tuple[str | None, list[dict]]:
    """(server, clauses) of an Authentication-Results value; semicolons in comments and quotes divide nothing."""
    segments, now, depth, quoted, last = [], [], 0, False, ""
    for c in value or "":
        if quoted:
            quoted = not (c == '"' and last != "\\")
        elif c == '"':
            quoted = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= depth > 0
        elif c == ";" and not depth:
            segments.append("".join(now))
            now, last = [], c
            continue
        now.append(c)
        last = c
    segments.append("".join(now))
    server = None
    if not re.match(r"[a-z][a-z0-9-]*\s*=", without_comments(segments[0]).strip(), re.I):
        server = (segments.pop(0).split() or [None])[0]
    out = []
    for s in segments:
        clean = without_comments(s).strip()
        m = re.match(r"([a-z][a-z0-9-]*)\s*=\s*([a-z]+)", clean, re.I)
        if m:
            props = {f"{a}.{b}".lower(): v.strip('"') for a, b, v in re.findall(r'\b([a-z]+)\.([a-z0-9-]+)\s*=\s*("[^"]*"|[^\s;]+)', clean, re.I)}
            out.append({"method": m[1].lower(), "result": m[2].lower(), "props": props, "raw": s.strip()})
    return server, out


def auth_clauses(c: Column) -> Column:
    """struct(server, clauses) of an Authentication-Results value."""

    @F.pandas_udf(f"struct<server:string,clauses:{CLAUSE}>")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clauses(v) for v in values], columns=["server", "clauses"])

    return run(F.coalesce(c, F.lit("")))


def dkim_tag(c: Column, tag: str) -> Column:
    """The value of a DKIM-Signature's tag, or null."""
    found = F.trim(F.regexp_extract(c, rf"(?is)(?:\A|;)\s*{tag}\s*=([^;]*)", 1))
    return F.when(found != "", found)


def received_spf(c: Column) -> Column:
    """struct(result, client_ip, envelope_from, helo) of a Received-SPF value; null without a known result."""
    clean = F.regexp_replace(c, r"\([^()]*\)", "")
    known = "pass|fail|softfail|neutral|none|temperror|permerror"
    result = F.lower(F.coalesce(F.nullif(F.regexp_extract(c, rf"(?i)\A\s*({known})(?![A-Za-z])", 1), F.lit("")), F.regexp_extract(clean, rf'(?i)(?<![A-Za-z0-9_])result\s*=\s*"?({known})(?![A-Za-z])', 1)))
    field = lambda n: F.nullif(F.regexp_extract(clean, rf'(?i){n}\s*=\s*"?([^\s;"]+)', 1), F.lit(""))
    return F.when(result != "", F.struct(result.alias("result"), field("client-ip").alias("client_ip"), field("envelope-from").alias("envelope_from"), field("helo").alias("helo")))


def hops(messages: DataFrame) -> DataFrame:
    """message_id, hop (1 is the origin), from_host, by_host, ip, ips, ts of every Received header."""
    each = messages.select("message_id", values_of("received").alias("all")).select("message_id", F.size("all").alias("n"), F.posexplode("all").alias("pos", "raw"))
    name = lambda word: F.nullif(F.regexp_extract("raw", rf"(?i)(?<![A-Za-z0-9_]){word}\s+([^\s;()\[\]]+)", 1), F.lit(""))
    found = ips.sending_ips(F.col("raw"))
    return each.select(
        "message_id", (F.col("n") - F.col("pos")).cast("long").alias("hop"), name("from").alias("from_host"), name("by").alias("by_host"),
        F.get(found, F.lit(0)).alias("ip"), found.alias("ips"), date_seconds(F.regexp_extract("raw", r"(?s);([^;]*)\z", 1)).alias("ts"),
    )


def arc(messages: DataFrame) -> DataFrame:
    """message_id, sets, chain_valid, oldest (clauses of the set i=1) of messages with ARC headers."""
    results, seals = values_of("arc-authentication-results"), values_of("arc-seal")
    number = lambda v: F.coalesce(F.regexp_extract(v, r"(?<![A-Za-z0-9_])i\s*=\s*(\d{1,4})", 1).try_cast("int"), F.lit(0))
    oldest = F.get(F.array_sort(F.transform(results, lambda v: F.struct(number(v).alias("i"), F.regexp_replace(v, r"\A\s*i\s*=\s*\d+\s*;", "").alias("raw")))), F.lit(0))["raw"]
    broken = F.exists(seals, lambda s: F.lower(F.regexp_extract(s, r"(?i)(?<![A-Za-z0-9_])cv\s*=\s*([a-z]+)", 1)) == "fail")
    m = messages.select("message_id", results.alias("results"), seals.alias("seals"), oldest.alias("_raw"), broken.alias("_broken")).where("size(results) + size(seals) > 0")
    return m.select(
        "message_id", F.greatest(F.size("results"), F.size("seals")).cast("long").alias("sets"), F.when(F.size("seals") > 0, ~F.col("_broken")).alias("chain_valid"),
        F.when(F.col("_raw").isNotNull(), auth_clauses(F.col("_raw"))).alias("oldest"),
    )


def header_view(messages: DataFrame) -> DataFrame:
    """message_id, pos, name, name_lc, value, rank, hop, kind: headers as a reader wants them.

    By rank and pos the headers that matter come first; by pos alone they stand as the message has them. hop numbers the
    Received headers from the origin, 1; kind is received, auth or null.
    """
    path = F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == "received"), lambda h: h["pos"])
    known = F.array(*[F.lit(n) for n in KEY_HEADERS])
    each = messages.select("message_id", path.alias("_path"), F.inline("headers")).withColumn("name_lc", F.lower("name"))
    place = F.nullif(F.array_position(known, F.col("name_lc")), F.lit(0).cast("long"))
    return each.withColumns({
        "rank": F.coalesce(place, F.lit(len(KEY_HEADERS) + 1).cast("long")),
        "hop": F.when(F.col("name_lc") == "received", F.size("_path") - F.array_position("_path", F.col("pos")) + 1).cast("long"),
        "kind": F.when(F.col("name_lc") == "received", "received").when(F.col("name_lc").rlike(r"\A(?:authentication-results|received-spf|dkim-signature|arc-)"), "auth"),
    }).drop("_path")


def header_domains(messages: DataFrame) -> DataFrame:
    """message_id, source, domain from From, Reply-To, Return-Path and DKIM signatures."""
    of = lambda source, a: F.struct(F.lit(source).alias("source"), domains.domain_of(a["email"]).alias("domain"))
    signed = F.transform(values_of("dkim-signature"), lambda v: F.struct(F.lit("DKIM").alias("source"), F.lower(F.regexp_extract(v, r"(?:\A|;)\s*d\s*=\s*([^;\s]+)", 1)).alias("domain")))
    every = F.concat(F.array(of("From", address(value_of("from"))), of("Reply-To", address(value_of("reply-to"))), of("Return-Path", address(value_of("return-path")))), signed)
    return messages.select("message_id", F.inline(every)).where("domain <> ''")
