"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element; what stands in menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments leaves an empty line. The lengths of
lines (without link text) are summed over sliding windows; a surge, where the sum rises from nothing,
and the next dive, where it falls back, bound a stretch of text. This decides on every page: lines in
article or main elements only weigh more (four times, and one character at least). The stretch with
most weight is kept (of equal ones the first), with neighbours that are near and not mostly links,
however small; two stretches in one such element are near at any distance. All lines between the
outermost surge and dive stay, but for those of other article elements than the one with most weight.

Tags are read as the HTML standard says, in time that grows as the page: attribute values may hold any
character (quoted) or end at white space (unquoted), a raw element without an end tag takes the rest of
the page, and so does a tag or comment that never ends.

Cases: null, empty and text-free pages give an empty text. Pages of any length are read whole. Repeated
rows give equal texts. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame

from . import common

WINDOW = 3
#: Weight of a character in an article or main element.
INSIDE = 4
_TAG = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
#: What stands in a tag after its name: values after = may be quoted, and a lone quote is a character like any other.
_REST = re.compile(r"""((?>[^=>]++|=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_RAW = {"script", "style", "template", "noscript", "textarea", "title", "svg", "iframe"}
_BOILER = {
    "nav", "aside", "form", "footer", "head", "menu", "button", "select", "dialog", "canvas", "object", "audio", "video", "fieldset", *_RAW,
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Words of class, id and role values that mark boilerplate.
_MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "promo", "promotion", "sponsor", "sponsored", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "cookie", "cookies", "consent", "notice", "popup", "modal", "overlay", "comment", "comments",
    "disqus", "replies", "share", "sharing", "social", "related", "newsletter", "subscribe", "signup", "login", "widget", "pagination", "pager", "toolbar",
    "complementary", "contentinfo", "search",
}
_WORDS = re.compile(r"[^a-z]+")


def _marked(attributes: str) -> bool:
    """Whether class, id or role name boilerplate, or the element is not shown."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            if _MARKS.intersection(_WORDS.split(value.lower())):
                return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _NOT_SHOWN.search(value)):
            return True
    return False


class Reader:
    """Lines of a page: (text, characters of it in links, the article or main element that holds it, 0 for none); boilerplate is an empty line."""

    def __init__(self):
        self.out: list[tuple[str, int, int]] = []
        self.stack: list[str] = []
        self.open: Counter = Counter()
        self.articles: list[int] = []  # of the open article and main elements, innermost last
        self.count = 0
        self.boiler = 0  # depth of the outermost boilerplate element, 0 for none
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.parts and (text := " ".join(html.unescape("".join(self.parts)).split())):
            self.out.append((text, self.linked, self.articles[-1] if self.articles else 0))
        self.parts, self.linked = [], 0

    def text(self, piece: str) -> None:
        if not self.boiler:
            self.parts.append(piece)
            if self.open["a"]:
                self.linked += len(piece)

    def close(self, name: str) -> None:
        """Closes the innermost open element of this name and all that stand in it."""
        while True:
            last = self.stack.pop()
            self.open[last] -= 1
            if last in ("article", "main"):
                self.articles.pop()
            if self.boiler > len(self.stack):
                self.boiler = 0
            if last == name:
                return

    def end_tag(self, name: str) -> None:
        if self.open[name]:
            if name in _BLOCK:
                self.flush()
            self.close(name)
        elif name in ("p", "br"):
            self.flush()

    def start_tag(self, name: str, attributes: str) -> None:
        if name in _VOID:
            if name == "hr":
                self.flush()
            elif name in ("br", "img"):
                self.text(" ")
            return
        if name in _BLOCK:
            self.flush()
            if self.open["p"]:
                self.close("p")
            if name in ("li", "td", "th", "tr", "dt", "dd") and self.stack and self.stack[-1] == name:
                self.close(name)
        if attributes.endswith("/") and name not in _BLOCK:
            return
        self.stack.append(name)
        self.open[name] += 1
        outer = name == "header" and not self.articles
        if name in ("article", "main"):
            self.count += 1
            self.articles.append(self.count)
        if not self.boiler and name not in ("html", "body", "main") and (name in _BOILER or outer or (attributes and _marked(attributes))):
            self.boiler = len(self.stack)
            self.flush()
            self.out.append(("", 0, 0))


def lines(page: str) -> list[tuple[str, int, int]]:
    reader = Reader()
    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if (start := m.start() if m else end) > at:
            reader.text(page[at:start])
        if not m:
            break
        if m[3] is None:  # a comment, a document type or an instruction
            stop = page.find("-->" if m[1] else ">", start + 2)
            at = end if stop < 0 else stop + (3 if m[1] else 1)
            continue
        rest = _REST.match(page, m.end())
        if not rest:
            break
        at, name = rest.end(), m[3].lower()
        if m[2]:
            reader.end_tag(name)
        elif name in _RAW:
            if name in _BLOCK:
                reader.flush()
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(page, at)
            at = stop.end() if stop else end
        else:
            reader.start_tag(name, rest[1])
    reader.flush()
    return reader.out


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(surge, dive, sum): stretches of lines over which the sum of each window of lines stays above zero; no empty line at either end."""
    out, start = [], None
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            lo, hi = start, i
            while not weights[lo]:
                lo += 1
            while not weights[hi - 1]:
                hi -= 1
            out.append((lo, hi, sum(weights[lo:hi])))
            start = None
    return out


def extract(page: str | None) -> str:
    found = lines(page or "")
    weights = [max(len(text) - linked, 0) for text, linked, _ in found]
    weights = [max(INSIDE * w, 1) if inside and text else w for w, (text, _, inside) in zip(weights, found, strict=True)]
    runs = stretches(weights)
    if not runs:
        return ""
    best = max(range(len(runs)), key=lambda i: (runs[i][2], -i))
    lo, hi = runs[best][:2]
    held: Counter = Counter()
    for i in range(lo, hi):
        held[found[i][2]] += weights[i]
    own = max(held, key=lambda e: (held[e], -e))
    for order, step in ((range(best - 1, -1, -1), -1), (range(best + 1, len(runs)), 1)):
        for i in order:
            a, b, _ = runs[i]
            gap = lo - b if step < 0 else a - hi
            same = own and any(found[j][2] == own for j in range(a, b))
            if not same:
                if gap > 2 * WINDOW:
                    continue  # a stretch of the same article may follow
                if 2 * sum(linked for _, linked, _ in found[a:b]) > sum(len(text) for text, _, _ in found[a:b]):
                    continue
            lo, hi = min(lo, a), max(hi, b)
    return "\n\n".join(text for text, _, inside in found[lo:hi] if text and (inside in (0, own) or not own))


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def start():
        def work(columns):
            texts = [extract(p) for p in columns[2]]
            return [columns[0], columns[1], texts, [len(t) for t in texts]]

        return work

    return common.map_text(pages, ["page_id", "url", "html"], "page_id bigint, url string, text string, n_chars bigint", start, text="html")
