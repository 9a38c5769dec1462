"""Main text of web pages by text-to-tag ratios.

Every page is one row; a task reads pages one after another, so pages are never shuffled.

1. Events of the standard library's HTML parser cut a page into lines: a line ends where a block element starts or ends. A line has its text (character
   references decoded, white space as one space), its number of tags, and the element that it stands in.
2. The text-to-tag ratios of a page's lines are smoothed by a Gaussian kernel, and lines at or above the threshold (SPREAD
   standard deviations of the smoothed ratios) form the content cluster.
3. The cluster votes for its region: the deepest element that holds most of the cluster's text, widened to the article or main element around it. Of that
   region all lines are taken, short ones too; outside of such elements the lines from the first to the last of the cluster are, with the
   heading before them, but for lines that are mostly links.

What is never part of a region: menus, page headers, footers, sidebars, notices, adverts, forms and reader comments, told by their element, role or
class (FURNITURE); and scripts, styles and other elements without text of their own. A header inside an article belongs to it.

Defined results: null and empty pages have empty text; pages without marked furniture, unclosed or stray tags, and plain text are read as browsers would, as far as
blocks go; br and no-break spaces are white space; pages of any length are taken whole; equal rows get equal results; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import text_batches

#: Standard deviation of the Gaussian kernel, in lines, and its reach.
SIGMA, REACH = 1.0, 2
#: The cluster starts at so many standard deviations of the smoothed ratios.
SPREAD = 1.0
#: The region holds at least this share of the cluster's characters.
MOST = 0.6
#: Lines outside an article with more than this share of their characters in links are menus.
LINKED = 0.5

# fixed values: elements of HTML
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no text of the article.
SILENT = frozenset("script style head title noscript template svg math iframe object canvas audio video button select textarea datalist noframes applet map".split())
#: Elements, roles and words of class and id that mark what is not the article.
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer masthead topbar banner cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe subscription signup login signin comment comments disqus respond replies reply share sharing social related recommended recommendations widget pagination pager toolbar searchbox searchform form copyright".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open element of the same kind.
ENDS_SELF = frozenset("p li dt dd tr td th option".split())
#: An implied end stops at these.
SCOPE = frozenset("table ul ol dl article section div body html td th blockquote main nav aside header footer form".split())

#: Of these words, those that mark an article element, too.
NOT_THE_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())
#: A class that says that a page has (or lacks) a sidebar is not a sidebar.
_HAS = re.compile(r"(?i)(?<![a-z])(?:has|have|with|no|without|hide|show)[-_]?[a-z]+(?:[-_][a-z]+)?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Line:
    __slots__ = ("text", "tags", "node", "furniture", "linked", "heading")

    def __init__(self, text: str, tags: int, node: int, furniture: bool, linked: int, heading: bool):
        self.text, self.tags, self.node, self.furniture, self.linked, self.heading = text, tags, node, furniture, linked, heading


class _Lines(HTMLParser):
    """Cuts a page into lines; nodes are the block elements, by number, with their parent and whether they are an article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents, self.articles = [-1], [False]
        self.open: list[tuple[str, int, bool, bool]] = []  # element, its node, furniture, silent
        self.pieces: list[str] = []
        self.tags = self.linked = self.in_link = 0
        self.heading = False

    def cut(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            _, node, furniture, _ = self.open[-1] if self.open else ("", 0, False, False)
            self.lines.append(Line(text, self.tags, node, furniture, min(self.linked, len(text)), self.heading))
        self.pieces, self.tags, self.linked = [], 0, 0

    def _marked(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in FURNITURE_TAGS:
            return True
        if tag == "header" and not any(self.articles[node] for _, node, _, _ in self.open):
            return True
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            if value and name == "role" and value.strip().lower() in FURNITURE_ROLES:
                return True
            if value and name in ("class", "id"):
                marks = NOT_THE_ARTICLE if tag == "article" else FURNITURE_WORDS
                if any(w.lower() in marks for w in _WORD.findall(value)) and any(w.lower() in marks for w in _WORD.findall(_HAS.sub(" ", value))):
                    return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        block = tag in BLOCKS
        if block:
            self.cut()
            self.tags = 1
            if tag in ENDS_SELF:
                self._end_open(tag, SCOPE - {tag})
            elif any(o[0] == "p" for o in self.open):
                self._end_open("p", SCOPE)
        elif tag == "br":
            self.pieces.append(" ")
        elif tag == "a":
            self.in_link += 1
        if tag in VOID:
            return
        _, node, furniture, silent = self.open[-1] if self.open else ("", 0, False, False)
        mute, marked = tag in SILENT, self._marked(tag, attrs)
        if not (block or mute or marked):
            return
        if block:
            self.parents.append(node)
            self.articles.append(tag in ("article", "main"))
            node = len(self.parents) - 1
            self.heading = tag in HEADINGS
        # what is marked within a line is left out of that line
        self.open.append((tag, node, furniture or (block and marked), silent or mute or (marked and not block)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an element of HTML, but for those of drawings
        if tag in ("svg", "math"):
            self.handle_endtag(tag)

    def _end_open(self, tag: str, stop: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
            self.heading = False
        if any(o[0] == tag for o in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][3]:
            return
        self.pieces.append(data)
        if self.in_link:
            self.linked += len(data)

    def unknown_decl(self, data: str) -> None:
        """Sections like CDATA are no text."""


def lines_of(html: str) -> tuple[list[Line], list[int], list[bool]]:
    """The lines of a page; the parent of every node; whether it is an article or main element."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    return parser.lines, parser.parents, parser.articles


def smoothed(values: list[float], sigma: float = SIGMA, reach: int = REACH) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and its weights sum to one again."""
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[k + reach], values[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def cluster(lines: list[Line]) -> list[bool]:
    """Which lines belong to the content cluster."""
    ratios = smoothed([len(x.text) / max(1, x.tags) for x in lines])
    mean = sum(ratios) / len(ratios)
    threshold = SPREAD * math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return [r >= threshold for r in ratios]


def region(lines: list[Line], chosen: list[bool], parents: list[int], articles: list[bool]) -> int:
    """The node that the chosen lines vote for."""
    votes: dict[int, int] = {}
    total = 0
    for x, take in zip(lines, chosen):
        if take:
            total += len(x.text)
            node = x.node
            while node >= 0:
                votes[node] = votes.get(node, 0) + len(x.text)
                node = parents[node]
    node = max((k for k, v in votes.items() if v >= MOST * total), default=0)  # of nested elements the inner has the larger number
    outer, up = node, node
    while up >= 0:
        if articles[up]:
            outer = up
        up = parents[up]
    return outer


def _inside(node: int, top: int, parents: list[int]) -> bool:
    while node > top:
        node = parents[node]
    return node == top


def main_text(html: str | None) -> str:
    """The text of a page's article, its blocks joined by newlines."""
    if not html:
        return ""
    lines, parents, articles = lines_of(html)
    if not lines:
        return ""
    in_cluster, own = cluster(lines), [not x.furniture for x in lines]
    if not any(own):
        return ""
    chosen = [a and b for a, b in zip(in_cluster, own)]
    if not any(chosen):
        chosen = own
    top = region(lines, chosen, parents, articles)
    held = [free and _inside(x.node, top, parents) for x, free in zip(lines, own)]
    if not articles[top]:
        at = [k for k, (h, c) in enumerate(zip(held, chosen)) if h and c]
        first, last = (at[0], at[-1]) if at else (0, len(lines) - 1)
        while first > 0 and own[first - 1] and lines[first - 1].heading:
            first -= 1
        held = [own[k] and first <= k <= last and x.linked <= LINKED * len(x.text) for k, x in enumerate(lines)]
    return "\n".join(x.text for x, h in zip(lines, held) if h)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page."""
    text_batches(pages)
    src = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("text"))

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[main_text(x if isinstance(x, str) else None) for x in b["text"]])

    found = src.mapInPandas(texts, src.schema)
    return found.withColumn("n_chars", F.length("text").cast("long"))


#: For pages whose article is marked as such and holds paragraphs and headings, as all given pages do.
ORACLE_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article>|<footer|$)', 1, 's') as body from pages),
b as (select page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(p|h[1-6]|div|ul|li)[^>]*>', chr(1), 'g'), '<[^>]*>', ' ', 'g'), chr(1)) as parts from a),
c as (select page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from b)
select page_id, url, text, length(text) as n_chars from c
"""
