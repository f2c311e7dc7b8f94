"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import ship_package, text_or_empty

# Element names of HTML, by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg annotation annotation-xml iframe object canvas select button textarea audio video".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
#: Elements that may stand in a head; any other one, or text, ends a head that is still open.
IN_HEAD = frozenset("html head base link meta title style script noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot"
    " th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a new block element ends (their end tag may be left out).
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist"
    " consent cookie cookies copyright discussion disqus footer header masthead menu modal nav navbar navigation newsletter"
    " notice notices notification overlay pagination popup promo promoted related reply replies responses share sharing"
    " sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Those among them that mark what readers wrote: never the page's own text, however long it is.
READERS = frozenset("comment comments commentlist discussion disqus replies reply responses".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
#: Smoothing radius in lines; its square is the variance of the Gaussian.
RADIUS = 2


def _own_header(value: str) -> bool:
    """A name that says header and nothing else unwanted: inside an article that is its title."""
    return MARKS.intersection(_NAME.findall(value.lower())) == {"header"}


def _unwanted(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> str:
    """"skip" for what is never text of the page, "doubt" for a form or a marked name (see ``_Lines.kept``), or ""."""
    if tag in BOILERPLATE or tag == "header" and not inside_article:
        return "skip"
    if tag in ("html", "body", "main", "article"):
        return ""
    doubt = tag == "form"
    for name, value in attrs:
        if name == "hidden":
            return "skip"
        if not value:
            continue
        if name in ("class", "id") and not MARKS.isdisjoint(_NAME.findall(value.lower())) and not (inside_article and _own_header(value)):
            doubt = True
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return "skip"
        if name == "style" and "display:none" in value.lower().replace(" ", ""):
            return "skip"
    return "doubt" if doubt else ""


class _Lines(HTMLParser):
    """Turns events into lines: (text, tags, article number or 0, heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []  # (tag, what it does: "", "skip", "doubt", "article", "link")
        self.found: list[tuple[list[tuple[str, tuple[int, ...], bool]], int, int, bool]] = []
        self.readers: set[int] = set()  # doubted elements that hold what readers wrote
        self.words: list[tuple[str, tuple[int, ...], bool]] = []  # with the doubted elements around them, and: inside a link?
        self.links = 0
        self.tags = 0
        self.skipping = 0
        self.doubts: tuple[int, ...] = ()
        self.n_doubts = 0
        self.holds: dict[int, tuple[int, ...]] = {}  # article number: doubted elements around it
        self.articles: list[int] = []
        self.n_articles = 0
        self.heading = False

    def end_line(self) -> None:
        if any(not data.isspace() for data, _, _ in self.words):
            self.found.append((self.words, self.tags, self.articles[0] if self.articles else 0, self.heading))
            self.tags = 0
        self.words = []
        self.heading = False

    def kept(self) -> list[tuple[str, int, int, bool, bool]]:
        """The lines without what stands in doubted elements; the last field: is half of it or more link text?

        A doubted element stays if it holds over half of the page's text (unless
        its name says that readers wrote it), or an article while no article with
        text stands outside of all doubted ones.
        """
        size: dict[int, int] = {}
        total, free = 0, False
        for words, _, article, _ in self.found:
            for data, doubts, _ in words:
                n = len(SPACE.sub("", data))
                total += n
                free = free or bool(n and article and not doubts)
                for d in doubts:
                    size[d] = size.get(d, 0) + n
        stays = {d for d, n in size.items() if 2 * n > total and d not in self.readers}
        if not free:
            stays.update(d for doubts in self.holds.values() for d in doubts)
        lines, passed = [], 0
        for words, tags, article, heading in self.found:
            own = [(data, link) for data, doubts, link in words if stays.issuperset(doubts)]
            text = SPACE.sub(" ", "".join(data for data, _ in own)).strip()
            passed += tags
            if text:
                linked = sum(len(SPACE.sub("", data)) for data, link in own if link)
                lines.append((text, passed, article, heading, 2 * linked >= len(text.replace(" ", ""))))
                passed = 0
        return lines

    def _pop(self) -> None:
        tag, role = self.open.pop()
        if role == "skip":
            self.skipping -= 1
        elif role == "doubt":
            self.doubts = self.doubts[:-1]
        elif role == "article":
            self.articles.pop()
        elif role == "link":
            self.links -= 1

    def _close(self, i: int) -> None:
        while len(self.open) > i:
            self._pop()

    def _leave_head(self, at_once: bool) -> None:
        """Ends an open head; if not ``at_once``, only when nothing inside it is open."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == "head":
                self._close(i)
                return
            if not at_once:
                return

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in IN_HEAD:
            self._leave_head(tag == "body")
        if tag in BLOCK:
            self.end_line()
            for i in range(len(self.open) - 1, -1, -1):
                name = self.open[i][0]
                if name in CLOSED_BY_BLOCK:
                    self._close(i)
                    break
                if name in SIBLINGS.get(tag, ()):
                    self._close(i)
                    break
                if name in BLOCK:
                    break
        elif tag == "br":
            self.words.append((" ", self.doubts, False))
        if tag in VOID:
            return
        role = "skip" if tag in HIDDEN else _unwanted(tag, attrs, bool(self.articles))
        if role == "skip":
            self.skipping += 1
        elif role == "doubt":
            self.n_doubts += 1
            self.doubts += (self.n_doubts,)
            if any(value and name in ("class", "id") and not READERS.isdisjoint(_NAME.findall(value.lower())) for name, value in attrs):
                self.readers.add(self.n_doubts)
        elif tag == "a":
            role = "link"
            self.links += 1
        elif tag in ("article", "main"):
            role = "article"
            if not self.articles:
                self.n_articles += 1
                if self.doubts and not self.skipping:
                    self.holds[self.n_articles] = self.doubts
            self.articles.append(self.n_articles)
        self.open.append((tag, role))
        if tag in HEADINGS:
            self.heading = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        own = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if own is not None and self.open[own][1] == "skip":  # its own end always ends it, whatever is open inside
            self._close(own)
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                self._close(i)
                return
            # An inline end tag does not reach out of its block, nor a block's out of the article around it.
            if tag not in BLOCK and name in BLOCK or name in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                return

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown section is markup to pass over
            return self.parse_bogus_comment(i)

    def handle_data(self, data):
        if not data.isspace():
            self._leave_head(False)
        if not self.skipping:
            self.words.append((data, self.doubts, self.links > 0))


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian of ``RADIUS`` lines to each side; weights outside the page are left out."""
    kernel = [math.exp(-(d * d) / (2 * RADIUS * RADIUS)) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(k, ratios[i + d]) for d, k in zip(range(-RADIUS, RADIUS + 1), kernel) if 0 <= i + d < len(ratios)]
        out.append(sum(k * r for k, r in near) / sum(k for k, _ in near))
    return out


def clusters(ratios: list[float]) -> list[bool]:
    """Content or not, by line: smoothed ratios split at the threshold halfway between the means of both sides."""
    curve = smoothed(ratios)
    low, high = min(curve), max(curve)
    threshold = (low + high) / 2
    for _ in range(50):
        above, below = [c for c in curve if c >= threshold], [c for c in curve if c < threshold]
        if not above or not below:
            break
        moved = (sum(above) / len(above) + sum(below) / len(below)) / 2
        if abs(moved - threshold) < 1e-9:
            break
        threshold = moved
    return [c >= threshold for c in curve]


def main_text(html: str) -> str:
    """The article of one page; see ``extract``."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.kept()
    if not lines:
        return ""
    content = clusters([len(text) / max(1, tags) for text, tags, *_ in lines])
    # The text lies in the regions that the content clusters lie in: marked articles, or what no article holds (0).
    weight: dict[int, int] = {}
    for (text, _, own, *_), c in zip(lines, content):
        weight[own] = weight.get(own, 0) + (len(text) if c else 0)
    largest = max(weight.values())
    regions = {a for a, w in weight.items() if w * 4 >= largest}
    # All lines of an article belong to it; elsewhere the content does, and what adjoins it without being links.
    chosen = [own in regions and (own > 0 or c) for (_, _, own, *_), c in zip(lines, content)]
    if 0 in regions:
        for order in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
            step = -1 if order.step > 0 else 1
            for i in order:
                _, _, own, _, linked = lines[i]
                if not own and not linked and chosen[i + step] and not lines[i + step][2]:
                    chosen[i] = True
    return "\n".join(line[0] for line, keep in zip(lines, chosen) if keep)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with a column of the main text; every other column passes through.

    Parser events cut a page into lines at block elements; scripts, styles,
    menus, headers, footers, sidebars, notices, adverts, forms and comments
    never make lines, unless a form or an element that is unwanted by its name
    holds the article or over half of the page's text.  Each line has the ratio of its characters to the tags
    since the line before; smoothed ratios are split in two clusters.  Each
    marked article is a region, and so is all that no article holds; those with
    at least a quarter of the fullest one's content text come out.  An article
    does so whole, the other region with its content lines and the lines that
    adjoin them and are not mostly links.  What readers wrote never comes out.

    NULL or empty html, and pages without text, give ""; broken markup is read
    as far as it goes; repeated rows come back each; an existing column named
    ``out`` is replaced; an empty table gives an empty one.
    """
    ship_package(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(pages_: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages_:
            yield pd.Series([main_text(h) for h in s], dtype="object")

    return pages.withColumn(out, text_of(text_or_empty(html)))
