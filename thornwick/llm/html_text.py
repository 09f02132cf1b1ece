"""Main text of web pages by text-to-tag ratios.

Events of the standard library's streaming parser are cut into lines, one a block of the page. A line's ratio is its
characters over its tags; ratios are smoothed by a Gaussian over neighbouring lines, and lines above a threshold (a share
of the spread of the smoothed ratios) form clusters. Those clusters select the content region: the innermost sectioning
element that holds nearly all their weight, grown to the article or main element around it. Without one it grows to the whole
page, as the lines beside it (headings, leads, closing blocks) are short; only blocks of links there are left out. An article
or main element with half of their weight (if it is the only one, three tenths) is the region too, whatever stands beside it. All lines
of the region are the text, short ones too, but for parts that markup says are no content:

Elements and roles for navigation, forms, dialogs and the like, and hidden elements, drop what they hold. Names (of class and
id) only weigh: a part whose name is made of words for adverts, comments, menus ... alone has `named` of its ratios,
smoothed apart from the text around it, and its lines stay where that reaches the mean ratio of the other clusters; but names
that mark comments, adverts and notices drop, like forms. A form, or such a part, around nearly all the page's text is a
wrapper and drops nothing. A header within an article or main element is its title.

White space, no-break spaces among it, becomes one space within a line; a <br> is white space. Defined results: a null or
empty page, or one without text, gives an empty text; markup that ends early or never closes is read as far as it goes; an
element that closes itself holds nothing; unknown references stay as written; repeated rows are each extracted; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title script style noscript template iframe object svg canvas math nav header footer aside form button select option textarea label fieldset dialog menu audio video map datalist".split())
SECTIONS = frozenset("html body main article section div td center table tbody tr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus respond reply replies widget pagination pager toolbar copyright skiplink skiplinks".split()
)
#: Those of NAMES that mark reader comments, adverts and notices: their parts drop, unless one holds nearly all the text.
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice popup newsletter comment comments disqus respond reply replies".split())
#: Words that say nothing beside one of NAMES.
BESIDE = frozenset(
    "site page main top bottom left right global primary secondary box block wrapper wrap container list lists section area item items inner outer bar link links post posts article articles story stories group row col column panel unit slot thread form button buttons icon icons body sub mobile sticky".split()
)
#: Names that weigh on an article or main element: reader comments, adverts, teasers.
ARTICLE_NAMES = frozenset("ad ads advert adverts advertisement sponsored promo related recommended comment comments disqus reply replies".split())
#: Within an article the head of a part is its title.
INNER_NAMES = NAMES - {"header", "masthead", "banner"}
_LAYOUT = re.compile(r"(?:^|[-_])(?:with|without|has|no|not|is)[-_]", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _names(word: str, names: frozenset[str]) -> bool:
    """Whether a name is made of words of names and words that say nothing beside them."""
    if _LAYOUT.search(word):  # a layout's name (has-sidebar, no-ads) says what is beside the content
        return False
    parts = [x.lower() for x in _NAME.findall(word) if not x.isdigit()]
    if "header" in parts and not {"post", "article", "story", "section", "body"}.isdisjoint(parts):
        return False  # the title of what it names
    return any(x in names for x in parts) and all(x in NAMES or x in BESIDE for x in parts)


def _says_drop(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a class or id is made of DROPPED_NAMES and words beside them alone."""
    for key, value in attrs:
        for word in (value or "").split() if key in ("class", "id") else ():
            parts = [x.lower() for x in _NAME.findall(word) if not x.isdigit()]
            if not _LAYOUT.search(word) and not DROPPED_NAMES.isdisjoint(parts) and DROPPED_NAMES.union(BESIDE).issuperset(parts):
                return True
    return False


def _sort(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
    """2 for what drops its content, 1 for a part whose name weighs, else 0; inside an article or main element or not."""
    if tag in DROPPED and not (inside and tag == "header"):
        return 2
    if tag in ("html", "body"):
        return 0
    names = ARTICLE_NAMES if tag in ("main", "article") else INNER_NAMES if inside else NAMES
    named = 0
    for key, value in attrs:
        if key == "hidden":
            return 2
        value = value or ""
        if key == "role" and value.strip().lower() in ROLES or key == "aria-hidden" and value.strip().lower() == "true":
            return 2
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
        if key in ("class", "id") and any(_names(word, names) for word in value.split()):
            named = 1
    return named


class Line(NamedTuple):
    text: str
    tags: int
    section: int  # id of the innermost sectioning element around it or 0
    dropped: bool
    form: int  # the form, or part whose name says that it drops, around it or 0
    linked: bool  # mostly a link
    part: int  # the named part it is in or 0


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.tag_of = [""]  # of each section, by id
        self.around = [0]  # the section around each; its id is the smaller one
        self.open: dict[str, int] = {}  # how many elements of a name are on the stack
        self.stack: list[tuple[str, int, bool, int, int, int]] = []  # tag, id of the section it is or 0, whether it drops its content, the form, part and number of articles around it
        self.section = 0
        self.drops = self.pushed = 0
        self.form = self.forms = self.part = self.named = self.articles = 0
        self.link, self.linked = False, 0
        self.parts: list[str] = []
        self.tags = 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, max(self.tags, 1), self.section, self.drops > 0, self.form, 2 * self.linked > len(text), self.part))
            self.tags = 0
        self.parts = []
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.link = True
        if tag in VOID:
            return
        sort = _sort("div" if tag == "form" else tag, attrs, self.articles > 0)
        if tag == "form" and sort:
            sort = 2
        drops = sort == 2
        if not sort and tag not in BLOCKS and not self.open.get(tag):
            return  # inline elements, often left open, hold no state but within a part of their kind
        if sort and tag not in BLOCKS:
            self.cut()
        if tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th"):
            self._close_open(tag)
        section = 0
        if tag in SECTIONS:
            section = len(self.tag_of)
            self.tag_of.append(tag)
            self.around.append(self.section)
            self.section = section
        self.drops += drops
        self.pushed += 1
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append((tag, section, drops, self.form, self.part, self.articles))
        self.articles += tag in ("article", "main")
        if sort == 1 and not self.part:
            self.named += 1
            self.part = self.named
        if (tag == "form" or sort == 1 and _says_drop(attrs)) and not self.form:
            self.forms += 1
            self.form = self.forms

    def _close_open(self, tag: str) -> None:
        """An element whose end tag may be left out ends where its like begins, within the same section."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                return
            if self.stack[k][1] or self.stack[k][0] in ("ul", "ol", "dl", "select", "blockquote"):
                return

    def _pop(self, k: int) -> None:
        self.cut()
        self.form, self.part, self.articles = self.stack[k][3:]
        for tag, section, drops, *_ in reversed(self.stack[k:]):
            self.drops -= drops
            self.open[tag] -= 1
            if section:
                self.section = self.around[section]
        del self.stack[k:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        before = self.pushed
        self.handle_starttag(tag, attrs)
        if self.pushed > before:
            self._pop(len(self.stack) - 1)
        if tag == "a":
            self.link = False

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        if tag in BLOCKS or tag == "a":
            self.link = False
        if not self.open.get(tag):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.link:
            self.linked += len(data.strip())


def smooth(ratios: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """A Gaussian over the neighbouring lines, renormalised at the ends."""
    x = np.arange(-radius, radius + 1)
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel, "full")[radius : radius + len(ratios)] / weight


def _formless(lines: list[Line], hold: float) -> list[Line]:
    """The lines with those in forms dropped, but for a form that holds nearly all the text."""
    if not any(x.form for x in lines):
        return lines
    held: dict[int, int] = {}
    for x in lines:
        if not x.dropped:
            held[x.form] = held.get(x.form, 0) + len(x.text)
    around = {f for f, n in held.items() if n >= hold * sum(held.values())} | {0}
    return [x._replace(dropped=x.dropped or x.form not in around) for x in lines]


def clusters(lines: list[Line], share: float, named: float) -> np.ndarray:
    """Which lines belong to a cluster: their smoothed ratio reaches share of the smoothed ratios' deviation, and in a named
    part also the mean of the cluster lines outside of such parts."""
    ratios = np.asarray([0.0 if x.dropped else len(x.text) / x.tags * (named if x.part else 1.0) for x in lines])
    smoothed = smooth(ratios)
    part = np.asarray([x.part for x in lines])
    for p in np.unique(part[part > 0]):
        at = np.flatnonzero(part == p)
        smoothed[at] = smooth(ratios[at])
    found = (smoothed >= share * smoothed.std()) & ~np.asarray([x.dropped for x in lines], bool)
    plain = found & (part == 0)
    return found & ((part == 0) | (smoothed >= smoothed[plain].mean())) if plain.any() else found


def main_text(html: str | None, share: float = 0.5, hold: float = 0.95, named: float = 0.1) -> str:
    """The page's main text; share sets the threshold (of the smoothed ratios' deviation), hold the weight a region keeps,
    named the weight of ratios in parts whose name says they are no content."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    lines = _formless(parser.lines, hold)
    kept = np.asarray([not x.dropped for x in lines], bool)
    if not kept.any():
        return ""
    clustered = clusters(lines, share, named)
    if not clustered.any():
        clustered = kept
    lines = [x._replace(dropped=x.dropped or x.part > 0 and not c) for x, c in zip(lines, clustered.tolist(), strict=True)]
    weight = np.where(clustered, np.asarray([len(x.text) for x in lines], float), 0.0)
    sections = len(parser.tag_of)
    held = np.bincount([x.section for x in lines], weights=weight, minlength=sections).tolist()
    for k in range(sections - 1, 0, -1):  # a section's id is larger than that of the one around it
        held[parser.around[k]] += held[k]
    total = held[0]
    # sections that hold nearly all lie within each other
    chain = [k for k in range(1, sections) if held[k] >= hold * total]
    # lines hold a section's own table cells and wrappers; the text is the whole article or main element around them
    outer = [k for k in chain if parser.tag_of[k] in ("article", "main")]
    region, whole = chain[-1] if chain else 0, bool(outer)
    if outer:
        region = outer[0] if parser.tag_of[outer[0]] == "article" else outer[-1]
    elif alone := _outermost(parser, held):
        most = max(alone, key=lambda k: held[k])
        if held[most] >= (0.3 if len(alone) == 1 else 0.5) * total:  # text beside it, however dense, is no part of it
            region, whole = most, True
    inside = [region == 0] + [False] * (sections - 1)
    beside = [0] * sections  # the outermost section around each that the region is not in
    on_chain = set(chain)
    for k in range(1, sections):
        inside[k] = k == region or inside[parser.around[k]]
        beside[k] = k if k in on_chain else beside[parser.around[k]] if parser.around[k] not in on_chain and parser.around[k] else k
    if whole:
        return "\n".join(x.text for x in lines if not x.dropped and inside[x.section])
    # beside the region: each section next to it or around it, and each run of lines between them, is a block
    shown = [x for x in lines if not x.dropped]
    blocks: list[tuple[int | None, list[Line]]] = []
    for x in shown:
        at = None if inside[x.section] else beside[x.section]
        if not blocks or blocks[-1][0] != at:
            blocks.append((at, []))
        blocks[-1][1].append(x)
    links = lambda block: len(block) > 1 and 2 * sum(len(x.text) for x in block if x.linked) > sum(len(x.text) for x in block)
    return "\n".join(x.text for at, block in blocks if at is None or not links(block) for x in block)


def _outermost(parser: _Lines, held: list[float]) -> list[int]:
    """The article and main elements with weight that lie in no other such element."""
    within, found = [False] * len(held), []
    for k in range(1, len(held)):
        own = parser.tag_of[k] in ("article", "main")
        within[k] = own or within[parser.around[k]]
        if own and not within[parser.around[k]] and held[k]:
            found.append(k)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
