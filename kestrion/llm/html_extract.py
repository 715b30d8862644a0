"""Main-text extraction from streamed standard-library parser events.

The parser's events are folded into lines (blocks between block-level tags) with their text, their number of tags, their
link characters and their region: an outermost article, else main, else the block container nearest to the line. A line's text-to-tag ratio is
its characters by its tags; links' characters don't count, and neither does what the page's structure marks as no content (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments), which is a region of its own. The ratios are smoothed with
a Gaussian over the lines that have any (within an article by themselves), and the regions that hold a line whose smoothed ratio is above one standard deviation of the page's are the content, taken
whole, short lines too. Scripts, styles, other elements that show no text, and hidden ones give no lines at all.

An element is told by its tag, its role, or by the class names and id that it has, each matched as a whole: `site-footer` is made of known words,
`has-sidebar` and `social-science` aren't. What only a name or a form marks is content nevertheless where it contains an article or
main and the page has no longer text outside.

One pass, no shuffle; a page costs time in proportion to its length, however deep it is. Defined results: null html gives the empty text; a
page without content too. Pages are parsed whole. Malformed markup is repaired as far as a stack of open elements can. Repeated rows
are extracted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kestrion.llm.common import sub_batches, trimmed

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("applet audio canvas datalist embed head iframe map noscript object script style svg template title video".split())
NO_CONTENT = frozenset("aside button dialog footer input menu nav select textarea".split())
REGION = frozenset(("article", "main"))
CONTAINER = frozenset("body div section td blockquote".split())
CLOSED_BY = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SKIP_NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination paywall popup promo promoted promotion related respond share sharing sidebar sidebars skyscraper social sponsor sponsored subscribe subscription toolbar widget widgets".split())
HEADERS = frozenset(("header", "masthead"))  # inside an article they hold its own title
#: Words that go with those in a compound name without changing what it says.
BESIDE = frozenset("a and area bar bottom box block buttons container content custom cta element email form global google group holder inner item items left links list local main mobile outer page panel policy post posts primary privacy reader right row secondary section signup site slot space top unit user website wrap wrapper".split())
REPLIES = frozenset("comment comments reply replies".split())
SKIP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SIGMA, RADIUS, DEVIATIONS = 1.0, 2, 1.0
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[-_\d]+")
_KERNEL = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
SHOWN, NAMED, MARKED, GONE = range(4)


def _says(attrs: dict, names: frozenset) -> bool:
    """Whether a class name or the id, as a whole, is one of the names or made of them."""
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = [x for x in _PARTS.split(_CAMEL.sub("-", name).lower()) if x]
        if parts and any(x in names for x in parts) and all(x in names or x in BESIDE for x in parts):
            return True
    return False


def judge(tag: str, attrs: dict, inside: bool) -> int:
    """What an element is by itself: SHOWN, no content by a NAME that it or a form bears, no content as its tag or role MARKS it, or GONE from the page."""
    if tag in SILENT:
        return GONE
    if tag in ("html", "body"):
        return SHOWN
    style = (attrs.get("style") or "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return GONE
    if tag in REGION:
        return MARKED if _says(attrs, REPLIES) else SHOWN
    if tag in NO_CONTENT or (attrs.get("role") or "").strip().lower() in SKIP_ROLES - {"form"}:
        return MARKED
    if tag == "form" or (tag == "header" and not inside) or _says(attrs, SKIP_NAMES - HEADERS if inside else SKIP_NAMES):
        return NAMED
    return SHOWN


class Open(NamedTuple):
    """An open element with all that it hands on to what it contains, so that nothing scans the stack."""

    tag: str
    block: int  # index of the nearest block-level element, itself included; -1 for none
    link: bool
    gone: bool
    marked: int  # number of the outermost element that is no content; 0 for none
    named: int  # the same for elements that a name marks, since the outermost article
    under: bool  # whether an article or main lies in such an element
    article: int
    main: int
    container: int


class Line(NamedTuple):
    text: str
    tags: int
    links: int
    marked: int
    under: bool
    article: int
    main: int
    container: int


_ROOT = Open("", -1, False, False, 0, 0, False, 0, 0, 0)


class Lines(HTMLParser):
    """Events folded into lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.at: dict[str, list[int]] = {}  # places in the stack by tag
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.links = self.number = 0

    def top(self) -> Open:
        return self.open[-1] if self.open else _ROOT

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            x = self.top()
            self.lines.append(Line(text, self.tags, min(self.links, len(text)), x.marked or x.named, x.under, x.article, x.main, x.container))
            self.tags = 0
        self.text.clear()
        self.links = 0

    def cut(self, to: int) -> None:
        while len(self.open) > to:
            self.at[self.open.pop().tag].pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        block = self.top().block
        if block >= 0 and tag in CLOSED_BY.get(self.open[block].tag, ()):
            self.cut(block)
        x = self.top()
        self.number += 1
        verdict = judge(tag, dict(attrs), bool(x.article or x.main))
        gone, marked, named, under = x.gone or verdict == GONE, x.marked, x.named, x.under
        if verdict == MARKED and not marked:
            marked = self.number
        if verdict == NAMED and not named:
            named = self.number
        if tag in REGION and named and not x.article and verdict == SHOWN:
            named, under = 0, True
        own = self.number if tag in CONTAINER or tag in REGION or verdict != SHOWN else x.container
        article = x.article or (self.number if tag == "article" else 0)
        main = x.main or (self.number if tag == "main" else 0)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(Open(tag, len(self.open) if tag in BLOCK else x.block, x.link or tag == "a", gone, marked, named, under, article, main, own))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        place = self.at.get(tag)
        if place and (tag in BLOCK or place[-1] > self.top().block):  # a stray inline end tag closes no block
            self.cut(place[-1])

    def handle_data(self, data: str) -> None:
        x = self.top()
        if x.gone:
            return
        self.text.append(data)
        if x.link:
            self.links += len(data.strip())


def regions(lines: list[Line]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's region, the article or main that it lies in (0 for none), and whether it is marked as no content."""
    outside = sum(len(x.text) - x.links for x in lines if not x.marked and not x.under)
    under = sum(len(x.text) - x.links for x in lines if not x.marked and x.under)
    with_articles = {x.main for x in lines if x.article}
    key, within, marked = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64), np.zeros(len(lines), bool)
    for i, x in enumerate(lines):
        marked[i] = x.marked > 0 or (x.under and under <= outside)
        within[i] = x.article or (x.main if x.main not in with_articles else 0)
        key[i] = x.marked or within[i] or x.container
    return key, within, marked


def ratios(lines: list[Line], marked: np.ndarray) -> np.ndarray:
    """Characters that count, by tag."""
    return np.array([0 if m else (len(x.text) - x.links) / max(1, x.tags) for x, m in zip(lines, marked)], float)


def smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over the lines with a ratio; the others stay 0 and don't weigh down their neighbours."""
    there = values > 0
    near, weight = (np.convolve(np.pad(v, RADIUS), _KERNEL, "valid") for v in (values, there.astype(float)))
    return np.where(there, near / np.maximum(weight, 1e-9), 0.0)


def main_text(html: str | None) -> str:
    """The page's content blocks in order, joined by an empty line."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    key, within, marked = regions(lines)
    ratio = ratios(lines, marked)
    for part in set(within.tolist()):  # an article's text doesn't lend weight to what stands beside it
        here = within == part
        ratio[here] = smoothed(ratio[here])
    chosen = set(key[ratio > DEVIATIONS * ratio.std()].tolist())
    return "\n\n".join(x.text for x, k in zip(lines, key.tolist()) if k in chosen)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep`'s columns with text and n_chars of every page."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, html in sub_batches(batches, "__html"):
            texts = [main_text(h) for h in html]
            out = part.drop_columns(["__html"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*out.schema.names, "text", "n_chars"])

    return pages.select(*keep, F.col("html").alias("__html")).mapInArrow(trimmed(tell), f"{fields}, text string, n_chars long")
