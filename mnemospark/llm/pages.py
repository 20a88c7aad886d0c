"""Main text of web pages by the distribution of text over lines.

A page's markup is stripped to lines, one for each block. Lines of menus, forms, adverts and the
like, told by their elements and names, count no text, and links count none either. The text
lengths of a sliding window of lines then surge where the main text begins and dive where it
ends. The heaviest such stretch names the element that holds the article; where the page marks
one (article, main, or a division so named), all its lines are the text, else the stretch is,
from the heading before it on.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Lines of a window, and the characters in it at which main text surges.
WINDOW, SURGE = 3, 86

#: Names of HTML elements and the words that sites name their parts by.
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "textarea", "title", "xmp"}
NOISE_TAGS = {"nav", "footer", "aside", "form", "svg", "canvas", "object", "select", "button", "menu", "dialog", "audio", "video", "map", "head"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
NOISE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent",
    "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "sidenav", "widget", "widgets", "footer", "header", "masthead", "topbar", "toolbar", "share", "sharing",
    "social", "related", "recommended", "recommendations", "trending", "comment", "comments", "commentlist", "disqus", "respond", "replies", "pagination", "pager",
    "copyright", "disclaimer", "search", "skip", "byline", "metadata", "tags",
}
COMMENT_NAMES = {"comment", "comments", "reply", "replies"}
MAIN_NAMES = {"article", "content", "post", "entry", "story", "main", "articlebody"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "tfoot", "thead", "title", "tr", "ul",
}
#: Elements that end an open element of their own kind.
ALONE = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
#: A tag with a quote that never ends.
PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([A-Za-z][\w:-]*+)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")


class Line(NamedTuple):
    text: str
    weight: int  #: characters outside links, 0 for noise
    noise: bool
    heading: bool
    within: tuple[int, ...]  #: numbers of the elements marked as main text that hold it, outermost first


class Element(NamedTuple):
    tag: str
    noise: bool
    mark: int  #: number of an element marked as main text, else 0


def named(attributes: dict[str, str]) -> list[str]:
    """Class names and id of an element."""
    return f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()


def is_noise(tag: str, attributes: dict[str, str], inside: bool, by_name: bool) -> bool:
    """Whether an element's kind, role or names say that it holds no main text; inside an article or not."""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in NOISE_TAGS or attributes.get("role", "").lower() in NOISE_ROLES or (tag == "header" and not inside):
        return True
    if not by_name or tag in {"html", "body", *HEADINGS}:
        return False
    names = [re.split(r"[-_]+", n) for n in named(attributes)]
    if tag in {"article", "main"}:
        return any(n[0] in COMMENT_NAMES for n in names)
    return any(x in NOISE_NAMES and not (x == "header" and inside) for n in names for x in {n[0], n[-1]})


def marks(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element is marked as the one that holds main text."""
    if tag in {"article", "main"} or attributes.get("role") in {"main", "article"} or attributes.get("itemprop") == "articleBody":
        return True
    return tag in {"div", "section", "td"} and any(x in MAIN_NAMES for n in named(attributes) for x in re.split(r"[-_]+", n))


def pieces(page: str):
    """(text, tag, closing, attributes) of a page: text before each tag; the last one has no tag."""
    at, pattern, lower = 0, TOKEN, None
    while True:
        start = page.find("<", at)
        m = pattern.match(page, start) if start >= 0 else None
        text = page[at:start] if start >= 0 else page[at:]
        if start < 0:
            yield text, None, False, ""
            return
        if m is None:
            if pattern is TOKEN and page[start + 1 : start + 2].strip("/").isalpha() and ("'" in page[start:] or '"' in page[start:]):
                pattern = PLAIN  # a quote that never ends; from here on tags end at the next >
                yield text, None, False, ""
                at = start
                continue
            yield text + "<", None, False, ""
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            yield text, "!", False, ""
            continue
        tag, closing = m[2].lower(), bool(m[1])
        yield text, tag, closing, m[3]
        if tag in RAW and not closing:  # its content is no markup
            lower = lower or page.lower()
            lower = lower if len(lower) == len(page) else re.sub("[A-Z]", lambda x: x[0].lower(), page)
            end = lower.find(f"</{tag}", at)
            at = len(page) if end < 0 else end


def lines(page: str, by_name: bool = True) -> list[Line]:
    """The blocks of a page that have text."""
    out: list[Line] = []
    stack: list[Element] = []
    words: list[tuple[str, bool]] = []
    count = breaks = 0

    def end_line(heading: bool = False):
        nonlocal breaks
        text = " ".join(html.unescape("".join(w for w, _ in words)).split())
        if text:
            noise = any(e.noise for e in stack)
            linked = len(" ".join(html.unescape("".join(w for w, a in words if a)).split()))
            out.append(Line(text, 0 if noise else len(text) - linked, noise, heading, tuple(e.mark for e in stack if e.mark)))
        words.clear()
        breaks = 0

    def close(at: int):
        if any(e.tag in BLOCKS for e in stack[at:]):
            end_line(any(e.tag in HEADINGS for e in stack[at:]))
        del stack[at:]

    for text, tag, closing, rest in pieces(page):
        if text and not (stack and stack[-1].tag in RAW):
            breaks = breaks if text.isspace() else 0
            words.append((text, any(e.tag == "a" for e in stack)))
        if tag is None or tag == "!":
            continue
        if tag == "br":
            breaks += 1
            words.append((" ", False))
            if breaks > 1:
                end_line()
            continue
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if at is not None:
                close(at)
            elif tag in BLOCKS:
                end_line()
            continue
        if tag in ("article", "main") and any(e.tag in NOISE_TAGS and e.tag != "aside" or e.tag == "header" for e in stack):
            close(next(i for i, e in enumerate(stack) if e.tag in NOISE_TAGS or e.tag == "header"))  # one left open
        if tag in BLOCKS:
            end_line()
        if tag in ("td", "th", "img"):
            words.append((" ", False))
        if tag in ALONE:  # unless a list or table lies between
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "blockquote"):
                    break
        if tag in VOID:
            continue
        attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)} if rest else {}
        inside = any(e.mark for e in stack)
        noise = is_noise(tag, attributes, inside, by_name)
        byline = tag != "body" and bool(stack) and stack[-1].tag == "header" and inside and tag not in HEADINGS and tag not in ("hgroup", "div")
        mark = 0
        if not noise and marks(tag, attributes):
            count += 1
            mark = count
        stack.append(Element(tag, noise or byline, mark))
    close(0)
    end_line()
    return out


def stretches(weights: list[int]) -> list[tuple[int, int]]:
    """(first, past the last) line of each stretch: where a window's text surges to where it dives to none."""
    n = len(weights)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    surge, found, i = min(SURGE, max(sums, default=0) / 2), [], 0
    while i < n:
        if weights[i] and sums[i] > surge:
            j = i
            while j < n and sums[j]:
                j += 1
            found.append((i, j))
            i = j
        i += 1
    return found


def main_text(page: str) -> str:
    """The blocks of a page's main text, joined by line feeds; empty if there are none."""
    all_lines = lines(page)
    marked = any(x.within for x in all_lines)
    if not marked and not any(x.weight for x in all_lines):  # names that mislead: elements and roles alone
        all_lines = lines(page, by_name=False)
    weights = [x.weight for x in all_lines]
    found = stretches(weights)
    if not found:
        within = [x for x in all_lines if x.within and not x.noise]
        return "\n".join(x.text for x in within)
    a, b = max(found, key=lambda s: sum(weights[s[0] : s[1]]))
    held: dict[int, int] = {}
    for x in all_lines[a:b]:
        for mark in x.within:
            held[mark] = held.get(mark, 0) + x.weight
    enough = [m for m, w in held.items() if 2 * w >= sum(weights[a:b])]
    if enough:  # the outermost of the marked elements with most of it: numbers go by their places
        return "\n".join(x.text for x in all_lines if min(enough) in x.within and not x.noise)
    while a and not all_lines[a - 1].noise and all_lines[a - 1].heading:
        a -= 1
    return "\n".join(x.text for x in all_lines[a:b] if not x.noise)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; text is the main text of its html, whole.

    A null html counts as empty; a page without main text has the empty text. Null ids and urls
    are kept, repeated rows give repeated rows, other columns are ignored, an empty table gives
    an empty table. Of stretches with equal text the first is taken. Unclosed elements, comments
    and quotes end where browsers end them or at the page's end.
    """
    common.prepare(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = rows.drop("html").schema.add("text", kinds["html"]).add("n_chars", "long")
    return rows.mapInArrow(common.frugal(run), schema)
