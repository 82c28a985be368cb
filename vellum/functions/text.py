"""Text: HTML to text, defanging, subject patterns, control characters, statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import fixed

#: White space as mail readers see it, no-break space and byte-order mark included.
SPACE = "[\\s ﻿ -     　]"
WORD = "[A-Za-z0-9_]"
#: Direction controls, and their names.
BIDI = "‪‫‬‭‮⁦⁧⁨⁩‎‏؜"
BIDI_NAMES = "LRE RLE PDF LRO RLO LRI RLI FSI PDI LRM RLM ALM".split()
#: Characters that hide inside words.
INVISIBLE = "​-‍⁠﻿­᠎"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
URL = r"""(?i)https?://[^\s<>"]+"""


def strip_html(html: Column) -> Column:
    """The text of a page: scripts and styles out, tags to blanks, usual references decoded, white space squeezed."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, sign in (("(?i)&nbsp;", " "), ("&#39;", "'"), ("(?i)&#x27;", "'"), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"')):
        out = F.regexp_replace(out, name, sign)
    return F.trim(F.regexp_replace(out, SPACE + "+", " "))


def html_lines(html: Column) -> Column:
    """HTML to text that keeps the ends of blocks as line breaks."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6]|blockquote|table|pre)>|<hr(?![A-Za-z0-9_])[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for name, sign in (("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("(?i)&amp;", "&")):
        out = F.regexp_replace(out, name, sign)
    return out


def subject_key(subject: Column) -> Column:
    """What subjects of one campaign share: one reply mark gone, numbers as #, white space squeezed."""
    out = F.regexp_replace(F.lower(F.coalesce(subject, F.lit(""))), rf"\A{SPACE}*(?:re|fw|fwd){SPACE}*:{SPACE}*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[0-9]+", "#"), SPACE + "+", " "))


def defang_domain(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("[.]"))


def defang_ip(c: Column) -> Column:
    return F.when(c.contains(":"), F.replace(c, F.lit(":"), F.lit("[:]"))).otherwise(defang_domain(c))


def defang_text(c: Column) -> Column:
    """Every URL, address and domain in free text made harmless.

    Dots between a label and letters, or inside dotted quads, are bracketed; schemes become hxxp; file names and the
    property names of authentication results stay as they are.
    """
    extensions = "exe|pdf|doc|docx|docm|xls|xlsx|xlsm|ppt|pptx|rar|7z|gz|tar|cab|js|vbs|vbe|wsf|hta|html|htm|iso|img|lnk|scr|bat|cmd|ps1|dll|jar|msi|txt|csv|png|jpg|jpeg|gif|svg|eml|msg|ics|json|xml|py|sh"
    token = r"(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"
    keep = rf"(?i)\A(?:(?:header|smtp|policy|body)\.[a-z\-]+|.*\.(?:{extensions}))\z"
    pattern = rf"(?i)[A-Za-z0-9._%+\-]*@?(?:{token}|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}})"
    found, between = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    safe = F.transform(found, lambda m: F.when(m.rlike(keep) & ~m.contains("@"), m).otherwise(F.replace(F.replace(m, F.lit("."), F.lit("[.]")), F.lit("@"), F.lit("[@]"))))
    joined = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(safe, i), F.lit("")))), "")
    return F.regexp_replace(F.regexp_replace(joined, r"(?i)\bhttp(s?)://", r"hxxp$1[://]"), r"(?i)\bftp://", "fxp[://]")


def defang_url(c: Column) -> Column:
    """hxxps[://]host[.]tld/path; the path and query are made harmless as well."""
    shape = r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)(.*)\z"
    scheme = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(c, shape, 1)), r"\Ahttp", "hxxp"), r"\Aftp", "fxp")
    host = F.replace(F.replace(F.regexp_extract(c, shape, 2), F.lit("@"), F.lit("[@]")), F.lit("."), F.lit("[.]"))
    return F.when(c.rlike(shape), F.concat(scheme, F.lit("[://]"), host, defang_text(F.regexp_extract(c, shape, 3)))).otherwise(defang_text(c))


def defang_email(c: Column) -> Column:
    local, domain = F.regexp_extract(c, r"(?s)\A(.*)@([^@]*)\z", 1), F.regexp_extract(c, r"(?s)\A(.*)@([^@]*)\z", 2)
    return F.when(c.contains("@"), F.concat(local, F.lit("[@]"), defang_domain(domain))).otherwise(defang_text(c))


def normal_status(c: Column) -> Column:
    """One of the known statuses, or unknown."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(fixed.AUTH_STATUSES), low).otherwise("unknown")


def reveal_controls(c: Column) -> Column:
    """Direction controls written out: [U+202E RLO]."""
    for sign, name in zip(BIDI, BIDI_NAMES):
        c = F.replace(c, F.lit(sign), F.lit(f"[U+{ord(sign):04X} {name}]"))
    return c


def strip_controls(c: Column) -> Column:
    return F.translate(c, BIDI, "")


def has_bidi(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[{BIDI}]"), F.lit(False))


def mixed_script_words(c: Column) -> Column:
    """Words of three letters or more that mix Latin with Cyrillic, Greek, Armenian or Cherokee."""
    words = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}]{3,}"), F.lit(0))
    return F.filter(words, lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}]"))


def invisible_in_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"[\p{{L}}\p{{N}}][{INVISIBLE}]+[\p{{L}}\p{{N}}]"), F.lit(0))


def detect_language(text: Column) -> Column:
    """en, es, fr, de by their share of stop words among ASCII words; unknown under ten words or below every threshold.

    The text is cut into words once, and one pass over them counts all languages.
    """
    rules = [(lang, [w for w in listed if w.isascii()], least) for lang, (listed, least) in fixed.STOP_WORDS.items()]
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))
    zero = F.struct(F.lit(0).alias("n"), *[F.lit(0).alias(lang) for lang, _, _ in rules])

    def add(acc: Column, w: Column) -> Column:
        return F.struct((acc["n"] + 1).alias("n"), *[(acc[lang] + w.isin(listed).cast("int")).alias(lang) for lang, listed, _ in rules])

    def judge(acc: Column) -> Column:
        shares = [acc[lang] / F.greatest(acc["n"], F.lit(1)) for lang, _, _ in rules]
        entries = [F.struct(F.when(x > least, x).otherwise(F.lit(0.0)).alias("share"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")) for i, (x, (lang, _, least)) in enumerate(zip(shares, rules))]
        best = F.array_max(F.array(*entries))
        return F.when((acc["n"] < fixed.FEWEST_WORDS) | (best["share"] <= 0), "unknown").otherwise(best["lang"])

    return F.coalesce(F.aggregate(words, zero, add, judge), F.lit("unknown"))
