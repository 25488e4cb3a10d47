"""Operator 8: main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events into lines, one for each block of text, with
the number of tags met since the line before. Lines in menus, headers, footers, sidebars, notices, adverts, forms and reader
comments never count, wherever they stand; scripts, styles and markup aren't text. A line's ratio is that of its
characters outside links to its tags. The ratios' logarithms are smoothed by a Gaussian and cut at a
share of their level, which is their mean by characters: runs of lines over it are the clusters of content. Lines whose own
ratio is under the threshold are taken by the run, at the mean of their smoothed ratios, so no end of a list joins its neighbours; headings are runs of their own.

What the clusters choose is a region: where article or main elements hold clusters, all of these with what is inside them and
what is around them in such elements; in pages with neither, the stretch from the first cluster, and the headings right before
it, to the last. In a region every run of lines under the threshold is judged as a whole: it stays where most of its
characters are text (short paragraphs, headings, dialogue) and goes where most are in links (lists of links).

A class or id marks what isn't the article by one of ``HINTS``, alone or joined to words of ``PLACES`` only, so
``related-posts`` does and ``related-work`` doesn't. It marks nothing on an element around the main element, nor
on one around an article in pages that have no text in other articles; words after has- and with- tell of layout only.

A null page counts as empty; a page without text gives the empty text; an empty table gives an empty one. Unclosed and cut-off markup is
read as far as it goes: list items, cells and paragraphs end where the next begins. Repeated rows give repeated results; of the input only
the named columns are read, and a kept column may be named like any other but ``text``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SILENT = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "head"}
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "fieldset"}
ROOMS = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input",
    "ins", "kbd", "label", "mark", "meter", "output", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr", "br",
}
#: Words in class, id or role that mark what isn't the article.
HINTS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "pagination", "popup", "promo", "related", "respond", "share", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget", "contentinfo", "complementary", "search",
}
#: Those of reader comments, which aren't articles even in article elements.
REPLIES = {"comment", "comments"}
#: Words that are joined to these in class names: parts and places of a page.
PLACES = {
    "area", "bar", "block", "body", "bottom", "box", "buttons", "card", "cards", "center", "col", "column", "container", "content", "entry",
    "form", "global", "group", "header", "head", "icons", "inner", "item", "items", "item", "left", "line", "link", "links", "list", "main", "message",
    "meta", "mobile", "outer", "page", "panel", "post", "posts", "articles", "stories", "primary", "right", "row", "secondary", "section", "site", "slot", "text", "thread",
    "title", "top", "unit", "wrap", "wrapper", "media",
}
#: Lines to each side and width of the Gaussian; share of the level that is the threshold.
REACH, SIGMA, SHARE = 2, 1.0, 0.4
#: An opened element of the first kinds ends those of the second, if none of the third is between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

#: Beginnings of class names that tell what a page has or lacks.
LAYOUT = ("has-", "has_", "with-", "with_", "no-", "without-")

_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall


class Open(NamedTuple):
    """An open element: whether it or one around it is apart, and the innermost room and marked element there; so a line needs only the last one."""

    tag: str
    apart: bool
    room: int
    mark: int


class Lines(HTMLParser):
    """Feeds on a page; lines holds [text, tags, apart, room, mark, linked, heading] of its blocks, outer the room around each.

    Work for a tag doesn't grow with the number of open elements: what is asked of those around is kept with the last one, and places of
    open elements are kept by tag.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open = [Open("", False, 0, 0)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.outer = [0]
        self.holds = [0]  # of each marked element: 2 around a main, 1 around an article
        self.above = [0]  # of each marked element: the next around it
        self.articles: list[int] = []  # marked elements that are outermost articles
        self.parts: list[str] = []
        self.tags = 0
        self.silent = 0
        self.anchor = False
        self.linked = 0
        self.heading = False

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.open[-1]
            self.lines.append([text, self.tags, at.apart, at.room, at.mark, min(self.linked, len(text)), self.heading])
            self.tags = 0
        self.parts.clear()
        self.anchor, self.linked = False, 0

    def _push(self, tag: str, apart: bool = False, room: int = 0, mark: int = 0) -> None:
        at = self.open[-1]
        self.places[tag].append(len(self.open))
        self.open.append(Open(tag, apart or at.apart, room or at.room, mark or at.mark))

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag == "hr":
            self._end_line()
        if tag == "a":
            self.anchor = any(k == "href" for k, _ in attrs)
        if tag in VOID:
            return
        if tag in SILENT:
            self._end_line()
            self.silent += 1
            self._push(tag)
            return
        if tag in INLINE:
            return
        self._end_line()
        self.heading = re.fullmatch("h[1-6]", tag) is not None
        self._close("p")
        if tag in IMPLIED:
            self._imply(*IMPLIED[tag])
        if tag in ("body", "html", "p") or self.heading:
            if tag == "body":  # the head may lack its end
                self._close("head")
            if tag == "p" and self._marked(attrs):
                self._push(tag, True)
            return
        within = self.open[-1].room
        apart = tag in APART or (tag == "header" and not within)
        marked = not apart and tag != "main" and self._marked(attrs)
        if tag == "article" and not within:
            marked = self._marked(attrs, REPLIES)
        room = mark = 0
        if tag in ROOMS:
            room = len(self.outer)
            self.outer.append(within)
            if not marked:  # kept() hands it on to those around
                self.holds[self.open[-1].mark] = max(self.holds[self.open[-1].mark], 1 + (tag == "main"))
        if marked:
            mark = len(self.holds)
            self.above.append(self.open[-1].mark)
            self.holds.append(0)
            if tag == "article" and not within:
                self.articles.append(mark)
        self._push(tag, apart, room, mark)

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.handle_starttag(tag, attrs)
            return
        self.tags += 1
        if tag not in INLINE:
            self._end_line()

    @staticmethod
    def _marked(attrs, hints: set[str] = HINTS) -> bool:
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                for name in v.split():
                    words = {x.lower() for x in _words(name)} if not name.lower().startswith(LAYOUT) else set()
                    if not hints.isdisjoint(words) and words <= HINTS | PLACES:
                        return True
        return False

    def kept(self) -> list[list]:
        """The lines that aren't apart."""
        holds = self.holds[:]
        for mark in range(len(holds) - 1, 0, -1):
            holds[self.above[mark]] = max(holds[self.above[mark]], holds[mark])
        for mark in self.articles:
            holds[mark] = max(holds[mark], 1)
        for least in (2, 1):
            fine = [True]
            for mark in range(1, len(holds)):
                fine.append(holds[mark] >= least and fine[self.above[mark]])
            lines = [x for x in self.lines if not x[2] and fine[x[4]]]
            if any(x[3] for x in lines):
                return lines
        return lines

    def around(self, rooms: set[int]) -> set[int]:
        """The rooms and those around them."""
        out: set[int] = set()
        for room in rooms:
            while room and room not in out:
                out.add(room)
                room = self.outer[room]
        return out

    def inside(self, rooms: set[int]) -> set[int]:
        """The rooms and those in them."""
        out = set(rooms)
        for room in range(1, len(self.outer)):
            if self.outer[room] in out:
                out.add(room)
        return out

    def _close(self, tag: str) -> None:
        if self.places[tag]:
            at = self.places[tag][-1]
            for x in reversed(self.open[at:]):
                self.places[x.tag].pop()
                self.silent -= x.tag in SILENT
            del self.open[at:]

    def _imply(self, ended: set[str], within: set[str]) -> None:
        last = lambda tags: max((self.places[t][-1] for t in tags if self.places[t]), default=0)
        while (at := last(ended)) > last(within):
            self._close(self.open[at].tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.anchor = False
        if tag in INLINE:
            return
        self._end_line()
        self.heading = False
        self._close(tag)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.anchor:
                self.linked += len(" ".join(data.split()))


def ratios(lines: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of characters outside links for each tag, as they are and smoothed by a Gaussian."""
    raw = np.log1p([(len(t) - linked) / max(1, n) for t, n, _, _, _, linked, _ in lines])
    kernel = np.exp(-np.square(np.arange(-REACH, REACH + 1)) / (2 * SIGMA**2))
    return raw, np.convolve(np.pad(raw, REACH, mode="edge"), kernel / kernel.sum(), mode="valid")


def clusters(lines: list[list]) -> np.ndarray:
    """Whether each line is content: by its smoothed ratio, or where its own is under the threshold by the mean of its run of such lines."""
    raw, smooth = ratios(lines)
    threshold = SHARE * np.average(smooth, weights=[len(x[0]) for x in lines])
    chosen = smooth >= threshold
    for (low, _), run in groupby(range(len(lines)), key=lambda i: (bool(raw[i] < threshold), lines[i][6])):
        if low:
            run = list(run)
            chosen[run] = smooth[run].mean() >= threshold
    return chosen


def region(lines: list[list], chosen: np.ndarray, page: Lines) -> list[int]:
    """Places of the lines in the region that the clusters choose."""
    held = {x[3] for x, take in zip(lines, chosen, strict=True) if x[3] and take}
    if held:
        rooms = page.around(held) | page.inside(held)
        return [i for i, x in enumerate(lines) if x[3] in rooms]
    at = np.flatnonzero(chosen)
    if not len(at):
        return []
    first = at[0]
    while first and lines[first - 1][6]:
        first -= 1
    return list(range(first, at[-1] + 1))


def extract(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page._end_line()
    lines = page.kept()
    if not lines:
        return ""
    chosen = clusters(lines)
    at = region(lines, chosen, page)
    out: list[str] = []
    for (content, _), run in groupby(at, key=lambda i: (bool(chosen[i]), lines[i][6])):
        texts = [lines[i] for i in run]
        if content or 2 * sum(x[5] for x in texts) <= sum(len(x[0]) for x in texts):
            out += [x[0] for x in texts]
    return " ".join(out)


def extract_pages(pages: DataFrame, html_column: str = "html", *keep: str) -> DataFrame:
    """The columns ``keep`` and text of each page."""
    rows = pages.select(*keep, F.col(html_column).alias("_html"))
    kept = [f for f in rows.schema.fields if f.name != "_html"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "_html"):
            yield part[[f.name for f in kept]].assign(text=[extract(h) for h in part["_html"]])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string"])
    return rows.mapInPandas(run, schema)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"), "html", "page_id", "url")
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_main_text": op8_main_text}
ORACLES: dict[str, str] = {}
