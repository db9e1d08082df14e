"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events. Text gathers in lines, one per block-level
element; a line knows how many characters and how many tags it holds, how much of it is links, and in which
container (article, section, division, list, ...) it stands. What its element names as boilerplate (menus, headers,
footers, asides, controls, scripts), and containers that a whole class, id or role marks so (adverts, notices, comments),
are barriers: lines of ratio 0 that are never content. The ratio characters / tags of all lines, smoothed by a Gaussian, is
split by two-means clustering of its logarithm; lines above the split are content.

Content decides about containers, and containers about the lines between content: a container is a
content region if most of the text that stands directly in it is content (of an article or main element, most of
all text in it). A region keeps all its lines, so a short last paragraph stays, and its lists, tables and quotes unless they are
mostly links; a heading stays with the region after it. Everything is kept in page order; a second
region, or one inside another, counts like the first.

A page is one row and one small computation in linear time, so pages go through Arrow batches where they
lie, without a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SKIPPED = frozenset(
    "script style noscript template nav header footer aside button select option textarea input label legend "
    "iframe object embed applet svg canvas math head title dialog menu datalist audio video map".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hr html li main "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div body blockquote details dl figure form fieldset center address table ul ol".split())
JOINED = frozenset({"article", "main"})
INNER = frozenset("blockquote details dl figure table ul ol address".split())
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
ROOT = 0
#: Parts of a class, id or role that mark a container as boilerplate whatever else its name says,
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal newsletter subscribe breadcrumb "
    "breadcrumbs sidebar comment comments disqus navbar navigation masthead pagination pager complementary contentinfo".split()
)
#: that do if the other parts of the name are marks or neutral too,
WEAK = frozenset("banner notice notices alert overlay signup login nav menu aside widget widgets related recommended share sharing social respond "
                 "replies footer header toolbar search form subscription".split())
#: and parts that say nothing.
NEUTRAL = frozenset("site page top bottom left right global primary secondary wrapper container area box bar list links block inner section".split())
#: First parts of names that only say whether such a part stands beside the content.
LAYOUT = frozenset("has with no without".split())
#: An element whose start closes an open paragraph or item of the same kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HIDDEN = re.compile(r"display\s*:\s*none")


def marked(name: str) -> bool:
    """Whether a class, id or role, as a whole, marks boilerplate."""
    parts = [p for p in re.split(r"[-_]+", name.lower()) if p]
    if not parts or parts[0] in LAYOUT:
        return False
    return any(p in MARKS for p in parts) or (any(p in WEAK for p in parts) and all(p in WEAK or p in NEUTRAL for p in parts))


@dataclass
class Line:
    text: str
    tags: int
    links: int  # characters inside of links
    container: int
    heading: bool
    barrier: bool = False


@dataclass
class Container:
    tag: str
    parent: int


class Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.containers = [Container("body", ROOT)]
        self.open: list[tuple[str, bool, int]] = []  # tag, whether it is skipped, the container around it
        self.places: dict[str, list[int]] = defaultdict(list)  # tag: its places among the open elements
        self.blocks: list[int] = []  # places of open blocks and skipped elements
        self.skipped = 0
        self.container = ROOT
        self.parts: list[str] = []
        self.tags = self.links = 0
        self.heading = False

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, min(self.links, len(text)), self.container, self.heading))
            self.tags = 0
        self.parts, self.links, self.heading = [], 0, False

    def _pop(self, at: int) -> None:
        while len(self.open) > at:
            tag, skipped, container = self.open.pop()
            self.places[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()
            self.skipped -= skipped
            self.container = container

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        breaks = tag in BLOCKS or tag in SKIPPED
        if breaks:
            self.end_line()
            self._imply_ends(tag)
            self.heading = tag in HEADINGS
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        skip = tag in SKIPPED or any(k == "hidden" or (k == "style" and v and _HIDDEN.search(v)) for k, v in attrs)
        if tag in CONTAINERS and tag not in JOINED and tag != "body":
            skip = skip or any(marked(name) for k, v in attrs if k in ("class", "id", "role") and v for name in v.split())
        if skip and not self.skipped:
            self.lines.append(Line("", 1, 0, self.container, False, True))
        self.places[tag].append(len(self.open))
        if breaks:
            self.blocks.append(len(self.open))
        self.open.append((tag, skip, self.container))
        self.skipped += skip
        if tag in CONTAINERS and not self.skipped and tag != "body":
            self.containers.append(Container(tag, self.container))
            self.container = len(self.containers) - 1

    def _imply_ends(self, tag: str) -> None:
        """A block ends an open paragraph; an item ends the one before it in the same list."""
        if self.blocks:
            name = self.open[self.blocks[-1]][0]
            if name == "p" or name in _CLOSES.get(tag, ()):
                self._pop(self.blocks[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        breaks = tag in BLOCKS or tag in SKIPPED
        if breaks:
            self.end_line()
        if self.places[tag]:
            at = self.places[tag][-1]
            if breaks or not self.blocks or self.blocks[-1] < at:  # a stray inline end does not close blocks
                self._pop(at)

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)
            if self.places["a"]:
                self.links += len("".join(data.split()))


def content_lines(lines: list[Line], sigma: float = 1.0) -> np.ndarray:
    """Which lines are content: those whose smoothed ratio is above the split between two clusters of its logarithm."""
    ratios = np.array([0.0 if x.barrier else len(x.text) / max(1, x.tags) for x in lines])
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    smooth = np.log1p(np.convolve(padded, kernel / kernel.sum(), "valid"))
    text = np.array([not x.barrier for x in lines])
    low, high = smooth.min(), smooth.max()
    if high - low < 0.5:  # one cluster
        return text
    for _ in range(50):
        upper = smooth > (low + high) / 2
        new = smooth[~upper].mean(), smooth[upper].mean()
        if new == (low, high):
            break
        low, high = new
    return text & (smooth > (low + high) / 2)


def kept_lines(lines: list[Line], containers: list[Container], content: np.ndarray) -> np.ndarray:
    """Which lines belong to the main text: all of content regions, see above; content lines of other containers by themselves."""
    n = len(containers)
    size = np.array([len(x.text) for x in lines])
    own = np.array([x.container for x in lines])
    every, good, links = (np.bincount(own, w, minlength=n) for w in (size, size * content, [x.links for x in lines]))
    whole, whole_good, whole_links = every.copy(), good.copy(), links.copy()
    for i in range(n - 1, ROOT, -1):  # a child comes after its parent
        if containers[i].tag not in INNER or 2 * whole_links[i] <= whole[i]:  # menus do not count for what is around them
            for sums in (whole, whole_good, whole_links):
                sums[containers[i].parent] += sums[i]
    linked = 2 * whole_links > whole
    region = np.zeros(n, bool)
    for i, c in enumerate(containers):
        some, of = (whole_good[i], whole[i]) if c.tag in JOINED else (good[i], every[i])
        region[i] = some > 0 and 2 * some >= of
        if i != ROOT and not region[i] and region[c.parent] and whole[i] and not linked[i]:
            region[i] = c.tag in INNER or (c.parent != ROOT and 2 * whole_good[i] >= whole[i])
        if c.tag in INNER and linked[i]:
            region[i] = False
    kept = np.array([not x.barrier for x in lines]) & (region[own] | content)
    kept &= ~np.array([containers[c].tag in INNER and bool(linked[c]) for c in own], bool)
    for i in range(len(lines) - 2, -1, -1):
        kept[i] |= lines[i].heading and bool(kept[i + 1]) and not lines[i].barrier
    return kept


def main_text(html: str) -> str:
    """The main text of a page: blocks joined by an empty line."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = _without_forms(parser.lines, parser.containers)
    if not any(x.text for x in lines):
        return ""
    kept = kept_lines(lines, parser.containers, content_lines(lines))
    return "\n\n".join(x.text for x, k in zip(lines, kept, strict=True) if k)


def _without_forms(lines: list[Line], containers: list[Container]) -> list[Line]:
    """Without the lines of forms, but for a form that wraps most of the page."""
    form = [ROOT] * len(containers)
    for i, c in enumerate(containers[1:], 1):
        form[i] = form[c.parent] or (i if c.tag == "form" else ROOT)
    if not any(form):
        return lines
    size: dict[int, int] = defaultdict(int)
    for x in lines:
        size[form[x.container]] += len(x.text)
    most = sum(size.values()) / 2
    return [x for x in lines if not form[x.container] or size[form[x.container]] > most]


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null page is empty; a page without main text has an empty one. Repeated rows get a row
    each, extra columns are left out, and broken markup is read as far as it goes.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
