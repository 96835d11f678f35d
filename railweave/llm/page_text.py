"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams events.  Text is cut into lines at block
elements; each line has its characters, its tags and the characters inside links.
The line's ratio is its unlinked characters over its tags.  Ratios are smoothed
with a Gaussian along the page and clustered at a threshold (a share of their
standard deviation, as CETR does).  Regions over it are content, wherever they lie.
`article` and `main` elements only add to them: one that holds a line of a region
is completed, and so are its siblings with unlinked text if the line's own ratio
reaches the threshold; if no line of the page does, all such elements count.

Never content: script, style, template and other machine elements, forms and
their controls, nav, header, footer and aside outside an article's own heading,
and elements whose role, or whose class or id, names a menu, an advert, a notice, a
sidebar, a comment section or the like (FIXED VALUES below).  A class or id token
does so if a furniture name leads it (behind words of place) and only furniture
names, words of form and numbers follow: "ad-slot-2" and "site-footer", not
"has-sidebar" or "copyright-law".  No class or id drops `main`, the elements around
the only article with text (of several, the one with most), or, without articles,
the elements that hold both the highest smoothed ratio and half of the unlinked text.

Defined results: null or empty html and pages without content lines give "";
character references are decoded; white space inside a block becomes one space;
blocks are joined in page order by one newline; nothing is cut off.  Unclosed and
stray tags are handled as browsers mostly do: a block start closes an open
paragraph, an end tag closes down to its start or is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: HTML element names by role, and the names that mark page furniture.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style template noscript head title nav footer aside form button select option input textarea iframe object svg canvas math dialog menu search audio video map noframes".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "select", "button", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "title"}
SELF_CLOSING = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
SCOPES = frozenset("ul ol dl table article section div main body nav aside footer header form".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense banner banners sponsor sponsored sponsors promo promos promotion promoted"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars sidenav aside footer masthead topbar toolbar pagination pager toc"
    " comment comments commentlist disqus respond replies reply discussion"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer"
    " related recommended recommendations share sharing social widget widgets login search searchbox skip hidden copyright".split()
)
# Furniture names that are also subjects: inside an article, one alone marks nothing.
SUBJECTS = frozenset("advertising promotion navigation respond replies reply discussion cookie cookies consent gdpr notice notices notification alert subscription disclaimer social sharing search copyright".split())
# Words of place that may stand before a furniture name, and words of form that may follow it.
PLACES = frozenset("site page main global primary secondary left right top bottom post entry article".split())
FORMS = PLACES | frozenset("area bar block box btn button buttons col column container form group header holder icon icons inner item items link links list outer panel placeholder posts row section slot stories title unit wrap wrapper".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog toolbar".split())
SPACE = re.compile(r"[\s ]+")

JOINTS = re.compile("[_-]+")

_P, _P_SCOPES, _HEAD = frozenset({"p"}), SCOPES | {"button"}, frozenset({"head"})
_LISTS, _TABLES = frozenset({"ul", "ol"}), frozenset({"table", "dl", "select"})


def _names_furniture(value: str, in_article: bool) -> bool:
    """Whether a class or id value holds a token made of a furniture name (with words of place and form)."""
    for token in value.lower().split():
        words = [w for w in JOINTS.split(token) if w]
        while len(words) > 1 and words[0] in PLACES:
            del words[0]
        if words and words[0] in FURNITURE and all(w in FURNITURE or w in FORMS or w.isdigit() for w in words):
            if not in_article or words[0] not in SUBJECTS or any(w in FURNITURE for w in words[1:]):
                return True
    return False


class _Lines(HTMLParser):
    """Lines of a page outside dropped elements: pieces of text with their marks, tags, number of the article around (0: none).

    A mark is an element whose class or id names furniture; whether it is left out
    is known at the end of the page only.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, bool, int]], int, int]] = []  # pieces (text, in link, mark), tags, article
        self.open: list[tuple[str, bool, int, bool, int, int]] = []  # name, dropped, which article, in link, mark, serial number
        self.parents: list[int] = []  # serial number of the element around each article
        self.marked: list[bool] = []  # whether each article is itself a mark
        self.around: list[int] = [0]  # the mark around each mark
        self.serial = 0
        self.parts: list[tuple[str, bool, int]] = []
        self.tags = 0

    def state(self) -> tuple[bool, int, bool, int]:
        return self.open[-1][1:5] if self.open else (False, 0, False, 0)

    def cut(self) -> None:
        if self.parts:
            self.lines.append((self.parts, self.tags, self.state()[1]))
        self.parts, self.tags = [], 0

    def chain(self, mark: int) -> set[int]:
        """A mark and those around it."""
        out = set()
        while mark:
            out.add(mark)
            mark = self.around[mark]
        return out

    def kept(self, lifted: set[int]) -> list[tuple[str, int, int, int]]:
        """Lines (text, tags, linked characters, article) of what lies in no mark but lifted ones."""
        out = []
        for parts, tags, article in self.lines:
            parts = [p for p in parts if not p[2] or self.chain(p[2]) <= lifted]
            text = SPACE.sub(" ", "".join(p[0] for p in parts)).strip()
            if text:
                out.append((text, tags, sum(len(p[0]) for p in parts if p[1]), article))
        return out

    def shut(self, names: frozenset[str], stop: frozenset[str]) -> None:
        """Closes the nearest open element of these names, unless one of stop comes first."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                self.cut()
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self.shut(_P, _P_SCOPES)
        if tag in SELF_CLOSING:
            self.shut(SELF_CLOSING[tag], _LISTS if tag == "li" else _TABLES)
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append((" ", False, self.state()[3]))
            return
        if tag == "body":
            self.shut(_HEAD, frozenset())
        dropped, article, link, mark = self.state()
        root = tag in ("article", "main")
        named = False
        if not dropped:
            dropped = tag in DROPPED or tag == "header" and not article
            for name, value in attrs:
                value = value or ""
                if name in ("class", "id") and tag not in ("body", "html", "main"):
                    named = named or _names_furniture(value, article > 0)
                elif name == "role":
                    dropped = dropped or value.lower() in FURNITURE_ROLES
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                    dropped = True
        if named and not dropped:
            self.around.append(mark)
            mark = len(self.around) - 1
        if root and not article and not dropped:
            self.parents.append(self.open[-1][5] if self.open else 0)
            self.marked.append(named)
            article = len(self.parents)
        self.serial += 1
        self.open.append((tag, dropped, article, link or tag == "a", mark, self.serial))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if tag not in BLOCKS and self.open[i][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        dropped, _, link, mark = self.state()
        if not dropped:
            self.parts.append((data, link, mark))


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-((np.arange(-reach, reach + 1) / sigma) ** 2) / 2)
    padded = np.pad(x, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _lifted(page: _Lines, sigma: float) -> set[int]:
    """Marks that hold the page's main text, which their names cannot drop."""
    if len(page.around) == 1:
        return set()
    if any(a and len(t) > linked for t, _, linked, a in page.kept(set())):
        return set()
    every = set(range(1, len(page.around)))
    size, marks = np.zeros(len(page.parents) + 1), {}
    free, ratio, chains = [], [], []
    for parts, tags, article in page.lines:
        n = sum(len(SPACE.sub(" ", t).strip()) for t, link, _ in parts if not link)
        inner = min((page.chain(m) for *_, m in parts), key=len)
        free.append(n)
        ratio.append(n / max(1, tags))
        chains.append(inner)
        if article and not page.marked[article - 1]:
            size[article] += n
            # The marks around the article: those that all its lines share.
            marks[article] = marks.get(article, every) & inner
    if size.any():
        return marks[int(size.argmax())]
    if not any(free):
        return set()
    peak = chains[int(_smooth(np.array(ratio), sigma).argmax())]
    return {m for m in peak if 2 * sum(n for n, c in zip(free, chains, strict=True) if m in c) >= sum(free)}


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5) -> str:
    """Content lines of one page, joined by newlines."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.cut()
    lines = page.kept(_lifted(page, sigma))
    if not lines:
        return ""
    ratio = np.array([max(0, len(t) - linked) / max(1, tags) for t, tags, linked, _ in lines])
    article = np.array([a for *_, a in lines])
    floor = share * ratio.std()
    region = (_smooth(ratio, sigma) >= floor) & (ratio > 0)
    inside = article > 0
    if region.any():
        hit = set(article[region & inside].tolist())
        # Siblings of an article that reaches the threshold by itself are completed as well.
        beside = {page.parents[a - 1] for a in set(article[region & inside & (ratio >= floor)].tolist())}
        hit |= {a for a in set(article[inside & (ratio > 0)].tolist()) if page.parents[a - 1] in beside}
        region |= np.isin(article, list(hit))
    else:
        region = inside
    return "\n".join(t for (t, *_), k in zip(lines, region, strict=True) if k)


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h.as_py()) for h in batch.column(batch.schema.get_field_index("html"))]
            ids, urls = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url"))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
