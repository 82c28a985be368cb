"""Bytes from pasted text: hexadecimal in the forms that people paste, base64, data URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_digits(c: Column) -> Column:
    """The digits of pasted hexadecimal (dump lines, 0x, commas, colons), or null."""
    dump = F.regexp_replace(c, r"(?im)^[ \t]*[0-9a-f]{4,16}[:\s][ \t]*((?:[0-9a-f]{2}[ \t]{1,2}){1,32}).*$", "$1")
    bare = F.regexp_replace(F.regexp_replace(dump, r"(?i)0x|\\x|%", " "), r"[\s,:;-]+", "")
    return F.when(bare.rlike(r"(?i)\A[0-9a-f]+\z"), bare)


def base64_text(c: Column) -> Column:
    inner = F.regexp_replace(c, r"(?is)\A\s*data:[^,]*;base64,", "")
    bare = F.regexp_replace(F.translate(F.regexp_replace(inner, r"\s+", ""), "-_", "+/"), r"=+\z", "")
    good = bare.rlike(r"\A[A-Za-z0-9+/]*\z") & (F.length(bare) % 4 != 1)
    return F.when(good, F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("=")))


def to_bytes(c: Column) -> Column:
    """struct(bytes, mode, error) of pasted text; hexadecimal where every sign fits it, else base64."""
    t = F.trim(c)
    digits, b64 = hex_digits(t), base64_text(t)
    uri = t.rlike(r"(?i)\Adata:[^,]*;base64,")
    mode = F.when(F.coalesce(t, F.lit("")) == "", "empty").when(uri, "base64").when(digits.isNotNull(), "hex").otherwise("base64")
    error = (
        F.when(mode == "empty", "nothing to decode").when((mode == "hex") & (F.length(digits) % 2 == 1), "hexadecimal needs pairs of digits")
        .when((mode == "base64") & b64.isNull(), "neither hexadecimal nor base64")
    )
    raw = F.when((mode == "hex") & (F.length(digits) % 2 == 0), F.unhex(digits)).when(mode == "base64", F.try_to_binary(b64, F.lit("base64")))
    return F.struct(raw.alias("bytes"), F.when(error.isNull(), mode).alias("mode"), error.alias("error"))


def has_body(c: Column) -> Column:
    """Whether pasted text is a whole message: it has an empty line, or more long lines of prose than header lines."""
    lines = F.split(c, r"\r?\n")
    is_header = lambda x: x.rlike(r"\A[A-Za-z0-9_-]+:")
    heads = F.size(F.filter(lines, is_header))
    prose = F.size(F.filter(lines, lambda x: ~is_header(x) & (F.length(x) > 50) & ~x.rlike(r"\A\s")))
    return F.coalesce(c.contains("\r\n\r\n") | c.contains("\n\n") | (prose > heads), F.lit(False))
