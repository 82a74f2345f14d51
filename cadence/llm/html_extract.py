"""Main-text extraction from HTML by text-to-tag ratio.

A streaming pass of the standard library's parser events turns a page into lines, one per block:
block tags, <br> and the ends of skipped elements start a new line. Each line has its text-to-tag
ratio (text length over the number of tags inside, links counted by their text). Ratios are
smoothed with a Gaussian kernel and clustered by a threshold (half of their mean, weighted by text)
into content and boilerplate; a line counts by its own or its smoothed ratio.

What the markup states itself weighs in: scripts, styles, forms, navigation, and containers or
paragraphs with boilerplate words (by role, class or id) never hold text. The bar is the same for all lines of a page;
an <article> or <main> element is taken as one cluster when it holds half of the page's text or the mean ratio of
its lines (weighted by text), times MARKED, reaches the bar. Then its short lines count too, but lines of links
alone only by their smoothed ratio. Other lines inside and all lines outside pass the bar by themselves.

Defined results: null, empty or markup-only html gives the empty text and 0 characters. Repeated
rows give repeated rows, other columns are ignored, an empty table gives an empty result. Nothing
else is dropped or cut: open elements end with the page, whatever its length.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.wordhash import slices

# fixed values: HTML element names by role, and class or id words of boilerplate
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre
search section summary table tbody td tfoot th thead title tr ul""".split())
SKIPPED = frozenset("""script style noscript template head title nav footer aside form button select textarea iframe
svg canvas object dialog menu noframes audio video""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset("p".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
BOILER_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment
comments cookie cookies consent copyright disqus footer gdpr header masthead menu modal nav navbar navigation
newsletter notice notices pagination pager popup promo promoted promotion related reply replies respond share sharing
sidebar sidenav signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets""".split())
MARKED = 2.0  # weight of the ratio of an <article> or <main> element
_WORD = re.compile(r"[A-Za-z]+")
_SPACES = re.compile(r"\s+")


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in SKIPPED:
        return True
    if tag == "header":
        return not in_article
    if tag in ("html", "body", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value and value.lower() in BOILER_ROLES:
            return True
        if name in ("class", "id") and value:
            words = _WORD.findall(value)
            if tag in ("article", "main"):  # what each name begins with: an article "has-sidebar" is none itself
                words = [w[0] for w in map(_WORD.findall, value.split()) if w]
            if any(w.lower() in BOILER_WORDS for w in words):
                return True
    return False


class _Lines(HTMLParser):
    """Collects (text, tags, link characters, number of the outermost article or 0) per block line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # tag, starts a skipped part, starts an article
        self.skip = self.article = self.link = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.regions = 0  # outermost articles so far
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self):
        if self.parts:
            text = _SPACES.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.tags, self.linked, self.regions if self.article else 0))
        self.parts = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if tag not in ("br", "hr"):
                self._close_paragraph()
        else:
            self.tags += 1
        if tag in VOID:
            return
        skips = _boilerplate(tag, attrs, self.article > 0)
        main = tag in ("article", "main") and not self.skip and not skips
        if skips:
            self.flush()
        self.stack.append((tag, skips, main))
        self.skip += skips
        if main:
            self.flush()
            self.regions += not self.article
        self.article += main
        self.link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _pop(self):
        tag, skips, main = self.stack.pop()
        if skips or main or tag in BLOCKS:
            self.flush()
        self.skip -= skips
        self.article -= main
        self.link -= tag == "a"

    def _close_paragraph(self):
        """A block start ends an open paragraph, and with it what is open inside."""
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k][0]
            if tag in CLOSED_BY_BLOCK:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in BLOCKS or self.stack[k][1]:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.flush()
            return
        block = tag in BLOCKS
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if not block and self.stack[k][0] in BLOCKS:
                return  # a stray end of an inline element
        if block:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            if self.link:
                self.linked += len(data)


def _smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    radius = int(3 * sigma)
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    kernel /= kernel.sum()
    return np.convolve(np.pad(x, radius, mode="edge"), kernel, mode="valid")


def content_lines(lines: list[tuple[str, int, int, int]]) -> list[str]:
    """Lines of the content cluster."""
    if not lines:
        return []
    size = np.array([max(0, len(t) - linked) for t, _, linked, _ in lines], float)
    ratio = size / np.array([max(1, tags) for _, tags, _, _ in lines])
    smooth = _smooth(ratio)
    bar = 0.5 * (smooth * size).sum() / max(size.sum(), 1.0)
    keep = (np.maximum(smooth, ratio) >= bar) & (size > 0)
    region = np.array([a for *_, a in lines])
    weight = np.bincount(region, size)
    mean = np.bincount(region, np.maximum(smooth, ratio) * size) / np.maximum(weight, 1.0)
    whole = (MARKED * mean >= bar) & (weight > 0) | (2 * weight >= max(size.sum(), 1.0))
    whole[0] = False
    keep |= whole[region] & ((size > 0) | (smooth >= bar))
    return [lines[i][0] for i in np.flatnonzero(keep)]


def extract(html: str | None) -> str:
    """Main text of one page, blocks joined by a newline."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n".join(content_lines(parser.lines))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return page_id, url, text, n_chars (code points) for every row."""
    def run(it):
        for batch in (part for whole in it for part in slices(whole, 2, 1 << 21)):
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
