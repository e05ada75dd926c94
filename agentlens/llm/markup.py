"""Blocks of text of an HTML page, in one pass over its characters.

A page is scanned from one `<` to the next. A start tag ends at the first `>`
outside a quoted attribute value; quotes count only right after `=`, as in
browsers, so a stray quote is part of a value, and a value whose quote is never
closed ends with its tag. Every character is looked at a bounded number of
times, so an odd page costs no more than a tidy one.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+")
CLASS = re.compile(r"(?:\A|[\s\"'/])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
SPACE = re.compile(r"\s+")
# fixed values: element and class names of HTML pages
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OUTSIDE = {"nav", "header", "footer", "aside", "menu", "dialog", "button", "select", "svg", "math", "object", "canvas", "audio", "video", "head"} | RAW
WRAPPERS = {"form"}  # some sites put the whole page into one
OUTSIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc",
    "header", "masthead", "footer", "sidebar", "aside", "widget", "related", "recommended", "share", "sharing", "social",
    "notice", "notices", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup",
    "comment", "comments", "disqus", "replies", "respond", "form", "search", "login", "copyright", "complementary", "contentinfo",
}
OUTSIDE_ARTICLES = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "comment", "comments", "reply", "replies", "related", "teaser"}
LAYOUT_WORDS = {"with", "has", "no", "without"}  # `with-sidebar` names a layout, not a sidebar
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "aside", "menu", "dialog", "legend", "optgroup", "option",
}
CLOSES_P = BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend", "option", "optgroup"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table", "select", "menu"}
CONTENT = {"article", "main"}

NO, MAYBE, YES = 0, 1, 2
DEEPEST = 512  # elements within each other, as in browsers; what is deeper belongs to the deepest of them


@lru_cache(maxsize=4096)
def element(name: str, attributes: str) -> tuple[str, int]:
    """Its label in paths, and whether its name puts it outside the main text.

    YES for elements such as `nav` and for names that are one such word (`comments`); MAYBE where the word
    is part of a longer name (`related-work`, `cookie-notice`), which may as well be about the content.
    """
    told = " ".join(next(filter(None, m.groups()), "") for m in CLASS.finditer(attributes)) if "=" in attributes else ""
    outside = YES if name in OUTSIDE else MAYBE if name in WRAPPERS else NO
    if told and name not in ("html", "body"):
        known = OUTSIDE_ARTICLES if name in CONTENT else OUTSIDE_WORDS
        for one in told.split():
            words = re.split("[_-]+", re.sub("(?<=[a-z])(?=[A-Z])", "-", one).lower())
            if words[0] not in LAYOUT_WORDS and known.intersection(words):
                outside = max(outside, YES if len(words) == 1 else MAYBE)
    return (f"{name}.{'.'.join(told.split())}" if told else name), outside


@dataclass
class Block:
    """Text at a path of labels; `doubts` are the places of MAYBE elements around it."""

    path: str
    text: str
    content: bool  # inside article or main
    outside: bool
    doubts: tuple[int, ...]


@dataclass
class Open:
    name: str
    path: str
    content: bool
    outside: bool
    doubts: tuple[int, ...]


@dataclass
class Page:
    """Blocks in page order, and at each path the labels of what its elements hold, in order."""

    blocks: list[Block] = field(default_factory=list)
    styles: dict[str, list[str]] = field(default_factory=dict)


def parsed(page: str) -> Page:
    found = Page()
    open_ = [Open("", "", False, False, ())]
    pieces: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        if pieces:
            text = SPACE.sub(" ", "".join(map(references.unescape, pieces))).strip()  # no reference reaches over a tag
            pieces.clear()
            if text:
                top = open_[-1]
                found.blocks.append(Block(top.path, text, top.content, top.outside, top.doubts))

    def close_to(names: set[str], stop: set[str]) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].name in names:
                del open_[k:]
                return
            if open_[k].name in stop:
                return

    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            pieces.append(page[at:])
            break
        if tag > at:
            pieces.append(page[at:tag])
        at = tag + 1
        mark = page[at : at + 1]
        if mark in ("!", "?"):
            if page.startswith("!--", at):
                close = page.find("-->", at + 1)
                at = close + 3 if close >= 0 else end
            elif page.startswith("![CDATA[", at):
                close = page.find("]]>", at)
                pieces.append(page[at + 8 : close if close >= 0 else end])
                at = close + 3 if close >= 0 else end
            else:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else end
            continue
        ending = mark == "/"
        m = NAME.match(page, at + ending)
        if m is None:
            if ending:  # `</` and no name is a comment of the browsers' kind
                close = page.find(">", at)
                at = close + 1 if close >= 0 else end
            else:
                pieces.append("<")
            continue
        name = m[0].lower()
        rest = ATTRIBUTES.match(page, m.end())
        attributes, at = rest[0], rest.end() + 1  # beyond `>`, or beyond a page that ends within the tag
        if rest.end() >= end:
            break
        if ending:
            if name in BLOCKS:
                flush()
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name == name:
                    if any(o.name in BLOCKS or o.path != open_[k - 1].path for o in open_[k:]):
                        flush()
                    del open_[k:]
                    break
                if name not in BLOCKS and open_[k].name in BLOCKS:
                    break  # an inline end tag doesn't close blocks
            continue
        label, outside = element(name, attributes)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in BLOCKS or outside:
            flush()
        if name in CLOSES_P:
            close_to({"p"}, BLOCKS)
        if name in SAME_ENDS:
            close_to(SAME_ENDS[name], LISTS)
        top = open_[-1]
        found.styles.setdefault(top.path, []).append(label)
        if name in VOID:
            if name == "br":
                pieces.append(" ")
            continue
        if len(open_) < DEEPEST and (not attributes.rstrip().endswith("/") or name in BLOCKS):
            own = name in BLOCKS or outside != NO
            path = f"{top.path}/{label}" if own else top.path
            open_.append(Open(name, path, top.content or name in CONTENT, top.outside or outside == YES, (*top.doubts, tag) if outside == MAYBE else top.doubts))
            if own:
                found.styles.setdefault(path, []).append("|")  # parts the elements of a path
    flush()
    # a MAYBE element is a layout around the content if it holds over three quarters of what isn't outside for sure, and the article if there is one
    size = sum(len(b.text) for b in found.blocks if not b.outside)
    held: Counter[int] = Counter()
    around: set[int] = set()
    for b in found.blocks:
        if not b.outside:
            for d in b.doubts:
                held[d] += len(b.text)
            if b.content:
                around.update(b.doubts)
    articles = any(b.content and not b.outside for b in found.blocks)
    for b in found.blocks:
        b.outside = b.outside or any(4 * held[d] <= 3 * size or (articles and d not in around) for d in b.doubts)
    return found
