"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser is fed the page and its events are folded, in one pass, into lines: a
line ends wherever a block element begins or ends. Each line knows its characters of text, how many
tags it took and how many of its characters are link text; lines inside elements that never hold an
article (menus, footers, forms, scripts, ...) are set aside as they stream by. The text-to-tag ratios
of the rest are smoothed by a Gaussian and split by a threshold into content and other regions, on
every page; a region of content is then completed by the lines that lie in the same article element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead"
    " title tr ul".split()
)
#: Elements whose content is never main text.
ASIDE = frozenset(
    "head title script style noscript template nav aside footer form button select option textarea label input fieldset menu"
    " dialog iframe object embed applet canvas svg math audio video map".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that name the same parts, as whole words of the attribute.
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|sidebar\w*|"
    r"complementary|contentinfo|related|recommend\w*|share|sharing|social|cookies?\w*|consent|notice\w*|popup|modal|newsletter|"
    r"subscri\w+|signup|paywall|alerts?|comment\w*|disqus|replies|respond|pagination|pager|toolbar|widget\w*|search)(?=$|[\s_-])",
    re.I,
)
#: Those that hold no article's text wherever they stand.
EXPLICIT = re.compile(r"(?:^|[\s_-])(?:ads?|advert(?:s|isements?)?|adsense|comments?|comment-?(?:list|area|section)|disqus\w*)(?=$|[\s_-])", re.I)
#: Whole words of an article's own class, id or role that say it is one of those.
NO_ARTICLE = re.compile(r"(?:ads?|advert(?:s|isements?)?|adsense|disqus[\w-]*|(?:user-|reader-)?(?:comments?|repl(?:y|ies))(?:-(?:body|content|item|list|area|section|thread))?)", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of their kind, as browsers have it.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACE = re.compile(r"\s+")
#: Characters a tag, without links, from which a line is prose by itself.
PROSE = 25


def _hidden(name: str, value: str) -> bool:
    return name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", ""))


def _named(tag: str, attrs: list[tuple[str, str | None]], within: bool) -> int:
    """2 for an element whose names are EXPLICIT, 1 for other ASIDE_WORDS, else 0.

    Within an article only explicit names count, and an id only as a whole: ids are anchors there. An
    article is set aside by NO_ARTICLE alone, a heading by nothing.
    """
    found = 0
    for name, value in attrs:
        if value and name in ("class", "id", "role") and tag not in HEADINGS:
            if tag == "article":
                found = max(found, 2 * any(NO_ARTICLE.fullmatch(word) is not None for word in value.split()))
            elif EXPLICIT.fullmatch(value) if within and name == "id" else EXPLICIT.search(value):
                return 2
            elif not within and ASIDE_WORDS.search(value):
                found = 1
    return found


class _Lines(HTMLParser):
    """Folds parser events into lines: [text parts, tags, link characters, number of the outermost article or 0]."""

    def __init__(self, ignored: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.ignored = ignored
        self.lines: list[tuple[str, int, int, int]] = []
        # elements with a hint by name, from 1 on: the one around each, its kind, characters without links in it and in articles
        self.hint = self.named = 0
        self.above, self.kind, self.prose, self.told = [0], [0], [0], [0]
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.open: list[tuple[str, bool, int]] = []  # element, set aside, hint around it
        self.names: dict[str, int] = {}
        self.aside = self.links = self.articles = self.article = 0

    def end_line(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.tags, self.linked, self.article if self.articles else 0))
            self.parts = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            if tag in CLOSES and self.open and self.open[-1][0] in CLOSES[tag]:
                self.shut(len(self.open) - 1)
        self.tags += 1
        if tag in VOID:
            return
        aside = tag in ASIDE or (tag == "header" and not self.articles)
        around = self.hint
        if attrs and not aside and tag not in ("html", "body", "main"):
            aside = any(_hidden(k, v or "") for k, v in attrs)
            kind = 0 if aside else _named(tag, attrs, self.articles > 0)
            if kind:
                self.hint = len(self.above)
                self.named += self.hint not in self.ignored
                for of, value in ((self.above, around), (self.kind, 3 if self.articles else kind), (self.prose, 0), (self.told, 0)):
                    of.append(value)
        self.open.append((tag, aside, around))
        self.names[tag] = self.names.get(tag, 0) + 1
        self.aside += aside
        self.links += tag == "a"
        self.article += tag == "article" and not self.articles
        self.articles += tag == "article"

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if self.names.get(tag):  # an end without a beginning costs no search
            k = len(self.open) - 1
            while self.open[k][0] != tag:
                k -= 1
            self.shut(k)

    def shut(self, k: int) -> None:
        """Ends the open element at depth k and all within it."""
        for tag, aside, around in reversed(self.open[k:]):
            self.names[tag] -= 1
            if self.hint != around:
                self.named -= self.hint not in self.ignored
                self.hint = around
            self.aside -= aside
            self.links -= tag == "a"
            self.articles -= tag == "article"
        del self.open[k:]

    def handle_data(self, data: str) -> None:
        if self.aside:
            return
        size = len(data.strip())
        if not self.links:
            self.prose[self.hint] += size
            if self.articles:
                self.told[self.hint] += size
        if not self.named:
            self.parts.append(data)
            if self.links:
                self.linked += size

    def wrong_hints(self) -> frozenset[int]:
        """Hints whose element holds half of the page's prose, or of what its articles tell.

        An explicit name is wrong only if its element holds half of the prose and all articles; inside
        an article it never is.
        """
        for k in range(len(self.above) - 1, 0, -1):
            self.prose[self.above[k]] += self.prose[k]
            self.told[self.above[k]] += self.told[k]
        total, told, wrong = self.prose[0], self.told[0], []
        for k, kind in enumerate(self.kind):
            most = 0 < total <= 2 * self.prose[k]
            if (kind == 1 and (most or 0 < told <= 2 * self.told[k])) or (kind == 2 and most and 0 < told == self.told[k]):
                wrong.append(k)
        return frozenset(wrong)


def page_lines(html: str) -> list[tuple[str, int, int, int]]:
    """(text, tags, link characters, number of the article or 0) of each line that may hold main text.

    A page with names that can't be meant so (a wrapper called "with-sidebar") is read again without
    those.
    """

    def read(ignored: frozenset[int] = frozenset()) -> _Lines:
        parser = _Lines(ignored)
        parser.feed(html)
        parser.close()
        parser.end_line()
        return parser

    parser = read()
    wrong = parser.wrong_hints()
    return read(wrong).lines if wrong else parser.lines


def content_lines(lines: list[tuple[str, int, int, int]], sigma: float = 1.0, share: float = 0.25) -> np.ndarray:
    """Which lines are main text.

    On every page the smoothed logarithms of the ratios choose among all lines that are not mostly link
    text: one stays if it reaches the border between the two clusters of these, or PROSE; where the
    clusters are not apart, all of them do. What stands between chosen lines without a link list, and prose beside
    them, is kept. An article element that holds a chosen line is completed by its other lines, but for
    link lists. Where articles hold at least half of what is chosen, a line outside them also needs a
    ratio of PROSE of its own.
    """
    if not lines:
        return np.zeros(0, bool)
    size = np.array([len(t) for t, *_ in lines], float)
    tags = np.array([k for _, k, *_ in lines], float)
    linked = np.array([k for _, _, k, _ in lines], float)
    article = np.array([k for *_, k in lines], np.int64)
    ratio = np.maximum(size - linked, 0) / np.maximum(tags, 1)
    scale = np.log1p(ratio)  # so that one very long paragraph sets no bar for others
    reach = int(np.ceil(3 * sigma))
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth, weight = (np.convolve(x, bell)[reach : reach + len(x)] for x in (scale, np.ones(len(scale))))
    smooth = smooth / weight  # the first and last lines have neighbours on one side only
    listed = linked >= 0.8 * size
    keep = (smooth >= min(border(smooth[~listed]), np.log1p(PROSE))) & ~listed
    keep = joined(keep, ~listed, (ratio >= PROSE) & ~listed)
    return with_articles(keep, article, size - linked, ratio, listed & (smooth < share * scale.mean()))


def border(values: np.ndarray) -> float:
    """Between the two clusters of least squares; -inf if their ratios are not fourfold apart."""
    x = np.sort(values)
    if len(x) < 2:
        return -np.inf
    n, total = np.arange(1, len(x)), np.cumsum(x)
    low, high = total[:-1] / n, (total[-1] - total[:-1]) / (len(x) - n)
    k = int(np.argmax(n * (len(x) - n) * (high - low) ** 2))
    return (low[k] + high[k]) / 2 if high[k] - low[k] >= np.log(4) else -np.inf


def joined(keep: np.ndarray, open_: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """Chosen lines, the runs of open lines between two of them, and prose in a row with one."""
    place = np.arange(len(keep))
    shut = np.cumsum(~open_)  # equal for two lines with only open ones after the first, up to the second
    before = np.maximum.accumulate(np.where(keep, place, -1))
    after = np.minimum.accumulate(np.where(keep, place, len(keep))[::-1])[::-1]
    both = (before >= 0) & (after < len(keep))
    keep = keep | (both & (shut[before] == shut[np.minimum(after, len(keep) - 1)]))
    run = np.cumsum(~(keep | prose))  # one number for each row of chosen lines and prose
    return keep | (prose & np.isin(run, run[keep]))


def with_articles(keep: np.ndarray, article: np.ndarray, size: np.ndarray, ratio: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Chosen lines, with the rest of the articles they are in and without short lines beside these.

    Where all lines of a page are link lists, its articles' are its text.
    """
    inside = article > 0
    if not keep.any():
        return inside
    keep = keep | (inside & np.isin(article, article[keep]) & ~links)
    if 2 * size[keep & inside].sum() >= size[keep].sum() and (keep & inside).any():
        keep &= inside | (ratio >= PROSE)
    return keep


def main_text(html: str | None) -> str:
    """The main text of one page; "" for null, empty or textless pages."""
    if not html:
        return ""
    lines = page_lines(html)
    keep = content_lines(lines)
    return "\n".join(t for (t, *_), k in zip(lines, keep, strict=True) if k)


def _extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, from the whole html (null: empty).

    Rows stay as they come, repeated ones too; extra columns are ignored. Parsing is streaming and
    per page, so a partition holds one page's lines at a time. A page cut off in a tag loses that
    tag; one cut off in a paragraph keeps what there is of it.
    """
    found = pages.select("page_id", "url", arrow_udf(_extract, "string")(F.col("html")).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
