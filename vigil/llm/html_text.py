"""Main text of web pages: parser events become lines, and lines with much text for few tags tell where the article stands."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line; all others stand inside one.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre"
    " search section summary table tbody tfoot thead tr ul".split()
)
#: Their contents are no text of the page.
SKIPPED = frozenset("audio button canvas datalist iframe label noembed noframes noscript object script select style svg template textarea title video".split())
#: An end tag does not reach through these to an element outside.
SCOPES = frozenset("caption html table".split())
#: What a start tag ends, when it is open and no list or table stands between.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"})}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements in which an article may stand.
CONTAINERS = frozenset("html body div section center article main table tbody tr form fieldset blockquote".split())
#: Never part of the article.
ASIDE = frozenset("nav aside footer menu dialog search".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
#: Words of a class or id that name what is no article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead topbar footer colophon copyright"
    " sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related recommended login signup search searchform skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: A header of these is the article's own.
OWN = frozenset("article post entry content story".split())
CUT_TAG = re.compile(r"<[A-Za-z/!?]")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

SIGMA, RADIUS = 1.5, 3
KERNEL = np.exp(-np.arange(-RADIUS, RADIUS + 1) ** 2 / (2 * SIGMA**2))
#: A line counts as text where its smoothed ratio is above so many standard deviations of all lines' ratios.
DEVIATIONS = 1.0
#: An element with so much of the text of a page is not left out because of its class.
MOST = 0.6
#: The article's element is the innermost with so much of the clustered text.
COVER = 0.75
OUT_BYTES = 4 << 20


class Lines(HTMLParser):
    """Events of the parser, gathered into lines: text, tags before and in it, characters inside links, element.

    Elements are numbered as they open; parent, tag and own (why an element is no article: 'never', 'named', 'comment')
    are lists by number. Only blocks, and what is left out, are elements here.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.own = [-1], ["html"], [""]
        self.stack, self.open = [0], Counter({"html": 1})
        self.lines: list[tuple[str, int, int, int]] = []
        self.held: list[str] = []
        self.tags = self.linked = self.dropped = 0
        self.in_link = False
        self.skips: list[str] = []

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i + 3)  # a comment in HTML
        return end + 1 or -1

    def close(self) -> None:
        if CUT_TAG.match(self.rawdata):
            self.rawdata = ""  # the page ends in a tag or a comment
        super().close()
        self.flush()

    def why(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """Why an element is no part of an article, or ''."""
        if not attrs:
            return "never" if tag in ASIDE else "named" if tag == "form" or tag == "header" and not self.within() else ""
        found = {k: v or "" for k, v in attrs}
        if tag in ASIDE or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
            return "never"
        if tag in ("html", "body", "main"):
            return ""
        words = {w.lower() for w in NAME_WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
        if words & COMMENTS:
            return "comment"
        if tag == "article":
            return ""
        if words & NAMES or found.get("role", "").lower() in ROLES or tag == "form":
            return "named"
        return "named" if (tag == "header" or "header" in words and not words & OWN) and not self.within() else ""

    def within(self) -> bool:
        return bool(self.open["article"] or self.open["main"])

    def flush(self) -> None:
        if not self.held:
            return
        text = " ".join("".join(self.held).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.stack[-1]))
            self.tags = 0
        self.held, self.linked = [], 0

    def push(self, tag: str, own: str) -> None:
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.own.append(own)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1

    def pop_to(self, at: int) -> None:
        """Closes the element at a place of the stack, and what is open in it."""
        for node in self.stack[at:]:
            self.open[self.tag[node]] -= 1
            if self.tag[node] not in BLOCKS:
                self.dropped -= 1
        del self.stack[at:]

    def close_open(self, tags: set[str], scopes: set[str] | frozenset[str]) -> None:
        for tag in tags:
            if self.open[tag]:
                break
        else:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if (tag := self.tag[self.stack[at]]) in tags:
                self.pop_to(at)
                return
            if tag in scopes:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in ("article", "main", "body"):
            self.skips.clear()  # one that nobody closed
        if self.skips or tag in SKIPPED:
            if tag in SKIPPED:
                self.skips.append(tag)
        elif tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.held.append(" ")
        elif tag in BLOCKS:
            self.flush()
            if self.open["p"]:
                self.close_open({"p"}, SCOPES)
            if tag in IMPLIED:
                self.close_open(*IMPLIED[tag])
            if tag not in ("html", "head", "body"):
                self.push(tag, self.why(tag, attrs))
        elif tag in ("td", "th"):
            self.held.append(" ")
        elif tag == "a":
            self.in_link = True
        elif own := self.why(tag, attrs):
            self.push(tag, own)
            self.dropped += 1
        elif self.open[tag]:  # inside one that is left out: its end tag is not the outer one's
            self.push(tag, "")
            self.dropped += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SKIPPED:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.skips:
            if tag in self.skips:
                del self.skips[len(self.skips) - 1 - self.skips[::-1].index(tag) :]
        elif tag in BLOCKS:
            self.flush()
            if tag not in ("html", "head", "body"):
                self.close_open(HEADINGS if tag in HEADINGS else {tag}, SCOPES - {tag})
        elif tag == "br":
            self.held.append(" ")
        elif tag == "a":
            self.in_link = False
        elif self.open[tag]:
            self.close_open({tag}, BLOCKS)

    def handle_data(self, data: str) -> None:
        if not self.skips and not self.dropped:
            self.held.append(data)
            if self.in_link:
                self.linked += len(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian means of a line and its neighbours; beyond the ends there are none."""
    weights = np.convolve(np.ones(len(ratios)), KERNEL)[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, KERNEL)[RADIUS : RADIUS + len(ratios)] / weights


def clustered(ratios: np.ndarray) -> np.ndarray:
    """Which lines have a smoothed ratio above the threshold."""
    level = smoothed(ratios)
    return (level > 0) & (level >= DEVIATIONS * min(level.std(), level.max(initial=0)))


def sums_below(own: np.ndarray, parent: list[int]) -> list[float]:
    """Sums of an element and all in it; children have higher numbers than parents."""
    total = own.tolist()
    for node in range(len(total) - 1, 0, -1):
        total[parent[node]] += total[node]
    return total


def left_out(page: Lines, sizes: np.ndarray) -> list[bool]:
    """By element: is it, or what it stands in, no part of an article?

    A class or role counts for nothing where the element holds an article, or most of the page's text.
    """
    n = len(page.tag)
    comment, holds = [False] * n, [False] * n
    for i in range(1, n):
        comment[i] = comment[page.parent[i]] or page.own[i] == "comment"
        if page.tag[i] in ("article", "main") and not comment[i]:
            above = page.parent[i]
            while above >= 0 and not holds[above]:
                holds[above] = True
                above = page.parent[above]
    total = sums_below(np.bincount([x[3] for x in page.lines], sizes, n), page.parent)
    out = [False] * n
    for i in range(1, n):
        own = page.own[i]
        out[i] = out[page.parent[i]] or own in ("never", "comment") or own == "named" and not holds[i] and total[i] <= MOST * total[0]
    return out


def chosen(page: Lines, sizes: np.ndarray, out: list[bool], seeds: np.ndarray) -> list[bool]:
    """By element: is it, or what it stands in, the article's element?

    Outermost article and main elements with clustered lines; if those have none, the one with most text; if the page
    has neither, the innermost container of most of the clustered text.
    """
    n = len(page.tag)
    nodes = np.array([x[3] for x in page.lines])
    usable = sizes * ~np.array(out)[nodes]
    by_seed = sums_below(np.bincount(nodes, usable * seeds, n), page.parent)
    by_text = sums_below(np.bincount(nodes, usable, n), page.parent)
    inside, roots = [False] * n, []
    for i in range(1, n):
        inside[i] = inside[page.parent[i]]
        if page.tag[i] in ("article", "main") and not out[i] and not inside[i] and by_text[i]:
            inside[i] = True
            roots.append(i)
    if roots:
        taken = {i for i in roots if by_seed[i]} or {max(roots, key=lambda i: (by_text[i], -i))}
    else:
        best = list(range(n))  # of each element its child with most of the clustered text
        for i in range(n - 1, 0, -1):
            above = page.parent[i]
            if page.tag[i] in CONTAINERS and (best[above] == above or by_seed[i] >= by_seed[best[above]]):
                best[above] = i
        at = 0
        while best[at] != at and by_seed[best[at]] >= COVER * by_seed[at] > 0:
            at = best[at]
        taken = {at}
    within = [i in taken for i in range(n)]
    for i in range(1, n):
        within[i] = within[i] or within[page.parent[i]]
    return within


def main_text(html: str | None) -> str:
    """The article of a page as blocks of text, joined by two line ends; '' where there is none.

    A block is what stands between the start and end tags of BLOCKS; a line break or a table cell in it is a space.
    Left out are navigation, asides, footers, forms, scripts and the like, hidden elements, comments of readers, elements
    whose class, id or role says so, and runs of list items that are links and nothing else.
    """
    page = Lines()
    page.feed(html or "")
    page.close()
    if not page.lines:
        return ""
    sizes = np.array([len(x[0]) for x in page.lines], float)
    out = left_out(page, sizes)
    dropped = np.array([out[x[3]] for x in page.lines])
    plain = np.array([max(0, len(x[0]) - x[2]) for x in page.lines], float)
    seeds = clustered(np.where(dropped, 0, plain / np.array([max(1, x[1]) for x in page.lines]))) & ~dropped
    within = chosen(page, sizes, out, seeds)
    take = np.array([within[x[3]] for x in page.lines]) & ~dropped
    if take.any():
        first = int(take.argmax())
        title = [page.tag[x[3]] == "h1" for x in page.lines[:first]]
        take[:first] |= np.array(title, bool) & ~dropped[:first]
    links = np.array([page.tag[x[3]] == "li" and x[2] > 0 and x[2] >= len(x[0]) for x in page.lines])
    menu = links & (np.append(links[1:], False) | np.insert(links[:-1], 0, False))
    return "\n\n".join(page.lines[i][0] for i in np.flatnonzero(take & ~menu))


def extracted(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages.

    A page without html, or without an article, has an empty text. Repeated rows give repeated rows; other columns are
    left out. Pages are parsed one by one, whole; a task holds a batch of pages and OUT_BYTES of texts.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for i, x in enumerate(batch.column(2)):
                held.append(main_text(x.as_py()))
                size += len(held[-1])
                if size >= OUT_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(first, len(held))
                    yield pa.record_batch([part.column(0), part.column(1), pa.array(held, pa.string()), pa.array(map(len, held), pa.int64())], ["page_id", "url", "text", "n_chars"])
                    first, held, size = i + 1, [], 0

    kind = pages.schema[id].dataType.simpleString()
    return pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(parse, f"page_id {kind}, url string, text string, n_chars long")
