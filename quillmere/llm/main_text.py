"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block. A line's length counts its characters outside links, and tags give hints
to it: what they mark as boilerplate (menus, headers, footers, side bars, notices, adverts, forms, reader comments) counts
nothing and keeps lines before and after it apart; where a page marks an article, lines outside it count an eighth. Lengths
are summed over sliding windows of lines; where the sum rises from nothing is a surge, where it falls back to nothing is a
dive. The text between them is kept where the sums rise high enough, as is short text between such stretches that the page
does not mark otherwise. Hints by class name that would leave no text at all are not believed.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame

from quillmere.llm.common import mapped

WINDOW, RISE, OUTSIDE, SHARE = 3, 80, 8, 8
# No part of a pattern can cross "<", so a page is read in one pass however broken its markup is.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*'|["'])*+)>|<[!?][^<>]*>?|<""")
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
DEAD = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|title|textarea|select)\b[^<>]*>.*?(?:</\1\s*>|\Z)")
# Names that mark boilerplate, alone or with words around them that only say where or what for a box is.
BOILER = (
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus foot footer form "
    "forms gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications alert alerts overlay pagination pager paywall popup promo promos "
    "promoted promotion recommended recommendations related reply replies respond responses search share sharing sidebar side skip social sponsor sponsored sponsors subscribe subscription signup "
    "toolbar widget widgets feedback adbox adblock adslot adunit adbanner adspace adsense adsbygoogle leftbar rightbar topbar bottombar sidenav topnav subnav mainnav leftcol rightcol leftrail rightrail"
).split()
PLAIN = (
    "a about above after and area article articles bar before below block blog body bottom box by button buttons card cards center col column container content cta desktop dialog element entry fixed for global "
    "google group head heading horizontal icon icons img in info inline inner item items js law leaderboard left link links list main media message meta mini mobile module more mpu my news of on out "
    "outer page pane panel part policy post posts primary reader readers right row section secondary single site slot small sticky stories story strip tag tags text the this title to top trail ul "
    "unit user vertical view wide wrap wrapper x zone"
).split()
BOILER, PLAIN = frozenset(BOILER), frozenset(PLAIN)
TEASERS = {"comment", "comments", "reply", "replies", "related", "ad", "ads", "promo", "promos", "teaser", "teasers"}  # names that make an article or main element one of these
PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])")
TITLED = re.compile(r"(?:article|entry|post|story)[_-]?header", re.I)  # holds the article's title
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog", "status", "toolbar"}
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "button", "label", "fieldset", "dialog", "menu", "head", "object", "canvas", "audio", "video"}
MAIN_TAGS = {"article", "main"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "tbody", "thead", "tfoot"}  # need no end tag


def named(value: str, tag: str) -> bool:
    """Whether one of the names in a class or id marks boilerplate: "site-footer" and "comments2" do, "search-algorithms" does not."""
    for name in TITLED.sub("", value).split():
        parts = [p.lower() for p in PARTS.split(name) if p and not p.isdigit()]
        if tag in MAIN_TAGS:
            if any(p in TEASERS for p in parts):
                return True
        elif any(p in BOILER for p in parts) and all(p in BOILER or p in PLAIN for p in parts):
            return True
    return False


def boilerplate(tag: str, attributes: str, believe: bool = True) -> bool:
    """Whether a tag's name, role or class says that its text is not the page's. Classes count only if they are believed."""
    if tag in BOILER_TAGS:
        return True
    if tag in ("html", "body") or not attributes:
        return False
    for k, a, b, c in NAMED.findall(attributes):
        k, v = k.lower(), a or b or c
        if k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "role" and v.lower() in ROLES and tag not in MAIN_TAGS or k in ("class", "id") and believe and named(v, tag):
            return True
    return False


def lines(page: str, believe: bool = True) -> list[tuple[str, int, bool]]:
    """(text, characters in links, inside a marked article) for each line in page order. Boilerplate gives empty lines."""
    page = DEAD.sub("", page)
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, boilerplate, article
    text: list[str] = []
    linked = links = 0

    def end() -> None:
        nonlocal linked
        s = " ".join(html.unescape("".join(text)).split())
        text.clear()
        out.append((s, min(linked, len(s)), bool(stack) and stack[-1][2]))
        linked = 0

    def boiler() -> bool:
        return bool(stack) and stack[-1][1]

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at and not boiler():
            s = page[at : m.start()]
            text.append(s)
            linked += len(s) * bool(links)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0] == "<" and not boiler():
                text.append("<")
            continue
        if tag == "a":
            links = 0 if m[1] else 1
        if tag not in INLINE and not boiler():
            end()
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if k >= 0:
                was = stack[k][1]
                del stack[k:]
                if was and not boiler() and tag not in INLINE:
                    out.extend([("", 0, bool(stack) and stack[-1][2])] * WINDOW)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in LOOSE:
            while stack and stack[-1][0] in LOOSE and (stack[-1][0] == tag or tag == "p"):
                stack.pop()
        elif tag not in INLINE and stack and stack[-1][0] == "p":
            stack.pop()
        bad = boiler() or boilerplate(tag, m[3], believe)
        if tag in INLINE and not bad:
            continue
        # inside boilerplate all tags are followed, so that an advert ends where it does
        stack.append((tag, bad, not bad and (tag in MAIN_TAGS or bool(stack) and stack[-1][2])))
    if at < len(page) and not boiler():
        text.append(page[at:])
    end()
    return out


def stretches(length: np.ndarray) -> list[tuple[int, int, int]]:
    """(surge, dive, peak): the lines between which windowed sums are above nothing, and the highest sum."""
    sums = np.convolve(length, np.ones(WINDOW, np.int64))[WINDOW - 1 :] if len(length) else length
    up = np.flatnonzero(np.diff(np.r_[0, (sums > 0).astype(np.int8), 0]))
    out = []
    for a, b in zip(up[::2], up[1::2], strict=True):
        on = np.flatnonzero(length[a : min(b + WINDOW, len(length))])
        out.append((int(a + on[0]), int(a + on[-1] + 1), int(sums[a:b].max())))
    return out


def between(got: list[tuple[str, int, bool]]) -> str:
    """The text between the surges and dives that count."""
    size = np.array([len(t) for t, _, _ in got], np.int64)
    own = size - np.array([n for _, n, _ in got], np.int64)
    own[own * 2 < size] = 0  # mostly links
    inside = np.array([a for _, _, a in got], bool)
    own = np.where(inside, size, own)
    marked = bool(own[inside].any())
    weight = np.where(inside, OUTSIDE * own, own) if marked else OUTSIDE * own  # in eighths of a character
    found = stretches(weight)
    if not found:
        return ""
    top = max(peak for _, _, peak in found)
    least = min(OUTSIDE * RISE, top)
    kept = [k for k, (_, _, peak) in enumerate(found) if peak >= least and peak * SHARE >= top]
    first, last = kept[0], kept[-1]
    if marked:  # short text of the article before or after an advert in it
        held = [k for k, (a, b, _) in enumerate(found) if inside[a:b].any()]
        first, last = min(first, held[0]), max(last, held[-1])
    out = []
    for k in range(first, last + 1):
        a, b, _ = found[k]
        if k in kept or not marked or inside[a:b].any():
            # a stretch may run over the article's edge: what is outside it must rise high enough by itself
            edge = marked and inside[a:b].any() and not inside[a:b].all() and int(own[a:b][~inside[a:b]].sum()) < OUTSIDE * RISE
            out += [got[i][0] for i in range(a, b) if got[i][0] and (inside[i] or not edge)]
    return " ".join(out)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return between(lines(page)) or between(lines(page, False))


def extract(pages: DataFrame, page_html: str = "html") -> DataFrame:
    """pages' other columns as they are, then text and n_chars. A null page is empty; a page without text gives an empty text.

    Rows are independent: repeats and ties are each extracted; columns named text or n_chars are replaced.
    """
    kept = [c for c in pages.columns if c not in (page_html, "text", "n_chars")]

    def reader():
        def read(values) -> list:
            texts = [main_text(p) for p in values.to_pylist()]
            return [texts, [len(t) for t in texts]]

        return read

    return mapped(pages, kept, [page_html], "text string, n_chars long", reader)
