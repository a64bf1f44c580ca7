"""Main text of web pages from the standard library's streaming parser.

Parser events become lines: a block element ends a line. Elements that never hold an article (scripts, forms,
navigation and the like), and elements whose class, id or role names such a part, are left out with all they
contain. Every other line has a text-to-tag ratio, its characters over its tags; the ratios of a page are
smoothed by a Gaussian over neighbouring lines, and two-means clustering of their logarithms gives the
threshold between content and the rest. A page whose two means are within a factor of ``APART`` has one kind of lines,
and all are content. A line is a seed when its smoothed ratio is above the threshold and its own above half of it.

Containers (an ``article`` or ``main``, or the page around them) are compared by the characters of their seeds,
which count ``PRIOR`` times in an ``article`` or ``main``; those with less than ``LEAST`` of the best are left out,
the page like any other. Short lines between two seeds stay by their distance, counted in tags, as lines of a menu
have several and lines of a verse one: at most ``JOIN``, or ``INSIDE`` in one ``article`` or ``main``. There, lines of
one or two tags stay at any distance between seeds, and next to the first and last one; the same holds next to the
first and last seed for lines of the ``div`` or ``section`` that holds the seed. A heading before the first seed stays
with all lines after it, such as a byline of several links, when they have at most ``INSIDE`` tags (``JOIN`` outside
``article`` and ``main``).

Inside ``article`` and ``main``, a paragraph, heading or cell whose class or id has the name of a page part only
inside a longer word (``share-price``) is not left out by that name: it stays when it is a seed by its ratio and that is
within a factor of ``APART`` of the page's median.

Pages are read whole, whatever their length; an empty table gives no rows. Character references are decoded, white space inside a line becomes one space, lines join by one space. Null
and empty pages give an empty text. Broken markup is closed implicitly: a block start ends an open paragraph,
and ``article`` or ``main`` ends an unclosed left-out element. Repeated rows are pages of their own; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
    "hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset(
    "applet aside audio button canvas dialog embed fieldset footer form frame frameset head header iframe input menu nav "
    "noscript object script select style svg template textarea title video".split()
)
PART_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|commentlist|complementary|contentinfo|cookies?|consent|"
    r"disqus|footer|gdpr|header|masthead|menu|nav|navbar|navigation|newsletter|notices?|notifications?|pagination|popup|promos?|related|"
    r"replies|respond|search|share|sharing|sidebar|signup|social|sponsor(?:ed)?|subscribe|toolbar|widgets?|alert|modal)(?:$|[\s_-])",
    re.IGNORECASE,
)
CLOSED_BY_BLOCK = frozenset("p li dt dd td th tr h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
SIGMA = 1.0
APART = 6.0
PRIOR, LEAST = 2.0, 0.2
JOIN, INSIDE = 8, 48


class Line(NamedTuple):
    text: str
    tags: int
    container: int  # number of the article or main around it, 0 for none
    section: int  # number of the nearest div or section, 0 for none
    heading: bool
    doubtful: bool  # named like a page part by a piece of a longer word only


class Lines(HTMLParser):
    """Collects the lines outside left-out elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, int, bool]] = []  # name, left out, container, section, doubtful
        self.text: list[str] = []
        self.tags = self.containers = self.sections = 0

    def _left_out(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, _, container, section, doubtful = self.open[-1] if self.open else ("", False, 0, 0, False)
            heading = any(name in HEADINGS for name, *_ in self.open)
            self.lines.append(Line(text, max(1, self.tags), container, section, heading, doubtful))
        self.text, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCKS or tag in LEFT_OUT
        if block:
            self._end_line()
            if tag not in ("br", "hr"):
                self._close_implied(tag)
        self.tags += 1
        if tag in VOID:
            return
        names = [v for k, v in attrs if v and k in ("class", "id", "role")]
        part = tag not in ("html", "body") and any(PART_NAMES.search(v) for v in names)
        _, left_out, container, section, doubtful = self.open[-1] if self.open else ("", False, 0, 0, False)
        if part and container and tag in PROSE and not any(PART_NAMES.fullmatch(word) for v in names for word in v.split()):
            part, doubtful = False, True
        if tag in ("article", "main") and not part:
            self.containers += 1
            container, left_out = self.containers, False
        if tag in ("div", "section"):
            self.sections += 1
            section = self.sections
        self.open.append((tag, left_out or part or tag in LEFT_OUT, container, section, doubtful))

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; a list item or cell ends the one before it."""
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == "p" or (name == tag and tag in CLOSED_BY_BLOCK):
                del self.open[k:]
                return
            if name in BLOCKS or name in LEFT_OUT:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in LEFT_OUT:
            self._end_line()
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if not self._left_out():
            self.text.append(data)


def content_threshold(ratios: np.ndarray) -> float:
    """Two-means split of the smoothed ratios' logarithms, started from their extremes; 0 when the means are near."""
    logs = np.log(ratios)
    low, high = logs.min(), logs.max()
    for _ in range(20):
        cut = (low + high) / 2
        below, above = logs[logs < cut], logs[logs >= cut]
        new = (below.mean() if len(below) else low, above.mean())
        if new == (low, high):
            break
        low, high = new
    return float(np.exp((low + high) / 2)) if high - low >= np.log(APART) else 0.0


def content_lines(lines: list[Line]) -> np.ndarray:
    """Which lines are content."""
    chars = np.array([len(line.text) for line in lines])
    tags, containers, sections = (np.array([line[k] for line in lines]) for k in (1, 2, 3))
    headings, doubtful = (np.array([line[k] for line in lines], dtype=bool) for k in (4, 5))
    own = chars / tags
    smoothed = smooth(own)
    cut = content_threshold(smoothed)
    seeds = (smoothed >= cut) & (own >= cut / 2)
    sure = ~doubtful | (seeds & (own >= np.median(own) / APART))
    seeds &= sure
    if not seeds.any():
        seeds = smoothed >= smoothed.max()
    value = np.bincount(containers, weights=np.where(seeds, chars, 0) * np.where(containers > 0, PRIOR, 1.0))
    allowed = (value >= LEAST * value.max())[containers]
    out = seeds & allowed
    at = np.flatnonzero(out)
    for a, b in zip(at, at[1:], strict=False):
        together = containers[a] == containers[b] != 0
        between = tags[a + 1 : b]
        if between.sum() <= (INSIDE if together else JOIN) or (together and between.max() <= 2):
            out[a:b] = allowed[a:b]
    for container in np.unique(containers[at]):
        inside = at[containers[at] == container]
        first, last = inside[0], inside[-1]
        for end, steps in ((first, range(first - 1, -1, -1)), (last, range(last + 1, len(out)))):
            for k in steps:
                near = container != 0 or sections[k] == sections[end] != 0
                if containers[k] != container or tags[k] > 2 or not near:
                    break
                out[k] = True
        spent = 0
        for k in range(first - 1, -1, -1):
            spent += tags[k]
            if containers[k] != container or spent > (INSIDE if container else JOIN):
                break
            if headings[k]:
                out[k:first] |= containers[k:first] == container
    return out & sure


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def main_text(html: str | None) -> str:
    """The article of one page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    lines = parser.lines
    if not lines:
        return ""
    return " ".join(line.text for line, stays in zip(lines, content_lines(lines), strict=True) if stays)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
