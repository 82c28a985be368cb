"""Main text of web pages by tag-path ratios.

A page is read once by a tolerant tokenizer into text blocks, each with the path of tags from the root to
it (with class, id and role words, which tell a notice from an article). For every distinct path the
text length, the punctuation and the text inside links are summed; two ratios follow - text per block and
punctuation per block - each smoothed along the order in which paths appear, fused by their product
and damped by the share of link text; a heading counts at least as what it heads. Paths whose fused value,
times a weight, reaches a share of the page's weighted mean are content. The weight is 1 unless the page
marks its article (article, main or such a role) and the mark holds at least half of the text outside links:
then it is MARK inside the deepest such mark, 1 around it and 1 / MARK outside every mark. Two things are decided before the
ratios, because no ratio can see them: subtrees that are never prose (scripts, styles, forms, menus ...) and
subtrees whose tag, role, class or id names page furniture.

Defined results: null and empty pages give an empty text; markup without a closing tag is read as browsers
do; unknown references stay as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import table

#: Elements whose content is never text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements that never have content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are page furniture with all they hold.
FURNITURE = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "fieldset", "footer", "form", "head", "iframe", "label", "legend",
    "map", "menu", "nav", "noscript", "object", "optgroup", "option", "script", "select", "style", "svg", "template", "textarea", "title", "video",
}
#: Elements that stand inside a line of text.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
#: Roles of page furniture.
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "note", "search", "status", "tablist", "toolbar"}
#: Words in class or id that name page furniture.
NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|adverts?|alerts?|disclaimers?|notices?|warnings?|advert(?:isement|ising)?|adsense|adslot|banner|breadcrumbs?|byline-links|captcha|comments?|commentlist|consent|cookies?|copyright|"
    r"disqus|footer|footnav|form|gdpr|hidden|legal|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|pager|pagination|"
    r"popup|popover|privacy|promo|promoted|promotion|recommend(?:ed|ations)?|related|replies|reply|respond|search|share|sharing|sidebar|signup|site-?header|"
    r"skip|skyscraper|social|sponsor(?:ed|s)?|subscribe|subscription|tags?-?(?:cloud|list)?|toc|toolbar|topbar|tracking|widget|widgets)(?:$|[-_ 0-9])",
    re.I,
)
#: The same for articles and whole pages, whose names say more about the site than about them.
INNER_NAMES = re.compile(r"(?:^|[-_ ])(?:ads?|adverts?|comments?|promo|promoted|related|replies|reply|sponsored|teasers?)(?:$|[-_ 0-9])", re.I)
OUTER_NAMES = re.compile(r"(?:^|[-_ ])(?:header|top-?bar|masthead)(?:$|[-_ 0-9])", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements that a start tag closes when they are open, up to the nearest scope.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
P_ONLY = frozenset({"p"})
SCOPE = {"table", "ul", "ol", "dl", "select", "article", "body", "html"}
#: Share of the weighted mean of the fused ratio from which a path is content.
SHARE = 0.2
#: Weight of the paths inside a marked article.
MARK = 2
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Weights of a path's neighbours and its own when ratios are smoothed.
SMOOTH = (1, 2, 1)

_OTHER = r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
#: A tag ends at the first > outside quotes. One that has none up to the page's end (a quote is open) is read up to its first >,
#: and so are all tags behind it, which keeps reading linear.
TOKEN = re.compile(_OTHER + r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)", re.S)
PLAIN = re.compile(_OTHER + r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
#: Signs that prose ends and divides sentences with.
PUNCTUATION = re.compile(r"[.,;:!?…。，？！،؟]")


class Node:
    """An open element: its tag, whether it is furniture, the number of its path, and its nearest block."""

    __slots__ = ("tag", "off", "path", "article", "inline", "block")

    def __init__(self, tag: str, off: bool, path: int, article: int, above: Node | None) -> None:
        self.tag, self.off, self.path, self.article, self.inline = tag, off, path, article, tag in INLINE
        self.block = above.block if self.inline and above is not None else self


class Stack:
    """The open elements, with a count of each tag so that absent ones are not searched for."""

    def __init__(self) -> None:
        self.open, self.count = [Node("", False, 0, 0, None)], {}

    def has(self, tag: str) -> bool:
        return self.count.get(tag, 0) > 0

    def push(self, node: Node) -> None:
        self.open.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def cut(self, at: int, to: int | None = None) -> None:
        for n in self.open[at:to]:
            self.count[n.tag] -= 1
        del self.open[at:to]

    def end(self, tag: str) -> None:
        """An end tag; one of an inline element does not close the blocks in it."""
        if not self.has(tag):
            return
        k = len(self.open) - 1
        block = False
        while self.open[k].tag != tag:
            block |= not self.open[k].inline
            k -= 1
        self.cut(k, k + 1 if block and tag in INLINE else None)

    def make_room(self, tag: str) -> None:
        """Closes what a start tag closes."""
        also = CLOSED_BY.get(tag, frozenset()) | (P_ONLY if tag in CLOSES_P else frozenset())
        if not any(self.has(t) for t in also):
            return
        for k in range(len(self.open) - 1, 0, -1):
            n = self.open[k]
            if n.tag in also:
                self.cut(k)
                return
            if n.tag in SCOPE or (not n.inline and n.tag not in also and tag in CLOSED_BY):
                return


def opened(tag: str, rest: str, above: Node, paths: dict) -> Node:
    off, label, article = above.off or tag in FURNITURE, tag, above.article
    if rest and not off:
        if HIDDEN.search(rest):
            off = True
        else:
            named = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
            words = CAMEL.sub("-", " ".join(named[k] for k in ("class", "id") if k in named))
            role = named.get("role", "").lower()
            if tag in ("html", "body", "main", "article"):
                off = tag == "article" and bool(INNER_NAMES.search(words))
            else:
                off = role in ROLES or bool(NAMES.search(words)) or (not article and bool(OUTER_NAMES.search(words)))
            if words:
                label = f"{tag}.{words}"
            if role in ("main", "article"):
                article = article or 1
    if tag == "header" and not above.article:
        off = True  # a site's header; an article's own header holds its title
    if tag == "main":
        article = max(article, 1)
    elif tag == "article":
        off = off or above.article >= 2  # articles inside an article are its comments or teasers
        article = 2
    return Node(tag, off, paths.setdefault((above.path, label), len(paths) + 1), article, above)


def text_blocks(page: str) -> list[tuple[int, str, int, int, bool]]:
    """(path number, text, characters inside links, article level, is a heading) of each block outside furniture, in order."""
    stack, paths = Stack(), {}
    out: list[tuple[int, str, int, int, bool]] = []
    piece: list[str] = []
    place: Node | None = None
    linked, at = 0, 0

    def flush() -> None:
        nonlocal place, linked
        if piece:
            text = SPACE.sub(" ", "".join(piece)).strip()
            if text and place is not None:
                out.append((place.path, text, min(linked, len(text)), place.article, place.tag in HEADINGS))
            piece.clear()
        place, linked = None, 0

    def add(raw: str) -> None:
        nonlocal place, linked
        top = stack.open[-1]
        if top.off or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        place = place or top.block
        if stack.has("a"):
            linked += len(text.strip())
        piece.append(text)

    pattern = TOKEN
    while m := pattern.search(page, at):
        if pattern is TOKEN and m.group(2) and not m.group(4):
            pattern = PLAIN
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m.group(1):
            stack.end(tag)
            continue
        stack.make_room(tag)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID:
            if tag == "a":
                stack.end("a")
            stack.push(opened(tag, m.group(3), stack.open[-1], paths))
    add(page[at:])
    flush()
    return out


def smoothed(x: np.ndarray) -> np.ndarray:
    a, b, c = SMOOTH
    side = np.pad(x, 1, mode="edge")
    return (a * side[:-2] + b * side[1:-1] + c * side[2:]) / (a + b + c)


def main_text(page: str | None) -> str:
    """The blocks of the content paths, one a line."""
    if not page:
        return ""
    blocks = text_blocks(page)
    if not blocks:
        return ""
    names: dict[int, int] = {}
    where = [names.setdefault(b[0], len(names)) for b in blocks]
    n = len(names)
    count, length, signs, link, level = (np.zeros(n) for _ in range(5))
    heads: dict[int, int] = {}
    for i, (k, (_, text, inside, marked, heading)) in enumerate(zip(where, blocks)):
        count[k] += 1
        length[k] += len(text)
        signs[k] += len(PUNCTUATION.findall(text))
        link[k] += inside
        level[k] = marked
        if heading and i + 1 < len(where):
            heads.setdefault(k, where[i + 1])
    text_ratio, sign_ratio = length / count, (signs + 0.5) / count
    own = 1 - link / np.maximum(length, 1)
    fused = smoothed(np.sqrt(text_ratio)) * np.sqrt(smoothed(sign_ratio)) * own
    mean = float((fused * length).sum() / length.sum())
    for k in sorted(heads, reverse=True):
        fused[k] = max(fused[k], fused[heads[k]] * own[k])
    prose = length - link
    trusted = max((m for m in (1, 2) if prose[level >= m].sum() * 2 >= prose.sum() and (level >= m).any()), default=0)
    if trusted:
        fused *= np.where(level >= trusted, MARK, np.where(level > 0, 1, 1 / MARK))
    content = fused >= SHARE * mean
    return "\n".join(b[1] for k, b in zip(where, blocks) if content[k])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars in place of the html; pages repeated are each extracted."""
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return column.map(lambda p: main_text(p))

    out = pages.select(*[f"`{f.name}`" for f in kept], text_of(F.col(html_col).cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
