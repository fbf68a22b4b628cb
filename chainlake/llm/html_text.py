"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams events; each block-level boundary ends a
line.  A line's ratio is its number of characters for each tag on it; lines in
menus, forms, adverts and the like count as zero.  The ratios are smoothed by
a Gaussian and split in two clusters by a threshold (one-dimensional two-means).
The lines of the upper cluster mark the content region: the articles that hold
them, or else the smallest element that holds all of them (never a part of a
list, quotation or table alone) and the headings right before it.  A line of the
lower cluster stays in the region if it is a heading, stands between lines of
the upper cluster, or shares its element with one; else it leaves (in an article
only if it is mostly links), as menus and footers without a telling name do.

Boilerplate is told by tags and roles, or by a class or id.  Names and forms are
a guess: a name counts only if all its words are known, and neither counts for
an element that holds ``main`` or most of the page's text (``content-sidebar``
or a form around the article); a name that may be a topic (``copyright``) counts
in an article only for lines of the lower cluster.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

SIGMA = 1.0
WRAPPER_SHARE = 0.5      # of the page's text: more of it in an element with a boilerplate name makes a wrapper
DISCUSSION_SHARE = 0.9   # the same for names of what readers write, which may be longer than the article
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol "
    "option p pre script section select style summary svg table tbody td template textarea tfoot th thead title tr "
    "ul".split())
SILENT = frozenset("head title script style noscript template svg iframe object select textarea button canvas".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
HOLDERS = ("article", "main")
PARTS = frozenset("ol ul dl li dt dd pre blockquote figure figcaption caption table thead tbody tfoot tr "
                  "h1 h2 h3 h4 h5 h6 hr summary".split())  # of a text, never all of it
HEADINGS = ("h1", "h2")
ALL_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINKED_SHARE = 0.5       # of a line's characters in links: a line of a menu
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies copyright disclaimer discussion disqus feedback footer gdpr login menu modal nav navbar navigation "
    "newsletter notice notification outbrain pagination pager popup promo promotion recommended related reply replies "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar topbar widget".split())
DISCUSSION = frozenset("comment comments discussion disqus feedback recommended related replies reply respond".split())
# words that say nothing of the content; a name counts if all others in it are boilerplate names
PLAIN = frozenset(
    "area article articles bar block body bottom box button buttons center col column container content desktop email "
    "entry fixed form global group header holder icon icons id inner item items left link links list main mobile module "
    "more outer page panel post posts primary region reader right row secondary section side site slot small sticky "
    "story stories text title top unit user view wide wrap wrapper zone".split())
TOPICS = frozenset("banner cookie cookies copyright disclaimer feedback login menu notice social".split())
TEXTUAL = frozenset("p section li dd td blockquote h1 h2 h3 h4 h5 h6".split())  # elements that a topic may name
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
CLOSED_BY = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")),
             "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")),
             "th": frozenset(("td", "th")), "option": frozenset(("option",))}
_PARTS = re.compile(r"[^a-z0-9]+")
_TAG = re.compile(r"<[A-Za-z/!?]")


class Lines(HTMLParser):
    """Collects (text, tags, element, boilerplate, mark) per line and the trees of block elements and of marks.

    A mark is an element with a boilerplate name; ``settle`` decides which of them are wrappers.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents = [-1]             # of each block element; 0 is the page
        self.holder = [""]              # its tag if that is article or main
        self.names = [""]               # its tag
        self.outer = [-1]               # of each mark; 0 is none
        self.talk = [False]             # whether its names are of what readers write
        self.soft = [False]             # whether it, or one around it, may name a topic
        self.has_main = [False]
        # tag, element, boilerplate, silent, mark, place of the innermost block element
        self.stack: list[tuple[str, int, bool, bool, int, int]] = [("", 0, False, False, 0, 0)]
        self.open: Counter = Counter()  # open elements by tag
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.owner: list[int] = []
        self.noise: list[bool] = []
        self.mark: list[int] = []
        self.linked: list[float] = []   # share of the line's characters in links
        self._links = 0
        self._text: list[str] = []
        self._tags = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            _, element, noise, _, mark, _ = self.stack[-1]
            self.linked.append(min(1.0, self._links / len(text)))
            self.texts.append(text)
            self.tags.append(self._tags)
            self.owner.append(element)
            self.noise.append(noise)
            self.mark.append(mark)
            self._tags = 0
        self._links = 0
        self._text.clear()

    def _is_noise(self, tag: str, attrs: list) -> bool:
        if tag in BOILERPLATE:
            return True
        if tag == "header":
            return not any(self.open[tag] for tag in HOLDERS)
        if not attrs or tag in HOLDERS or tag in ("html", "body"):
            return False
        for name, value in attrs:
            if value and name == "role" and value.lower() in ROLES or name == "hidden":
                return True
        return False

    def _named(self, tag: str, attrs: list) -> set[str]:
        """Boilerplate names in the class and id; a form is one by itself."""
        found = {"form"} if tag == "form" else set()
        if tag not in HOLDERS and tag not in ("html", "body"):
            for name, value in attrs:
                if value and name in ("class", "id"):
                    for word in value.lower().split():
                        parts = {w for w in _PARTS.split(word) if w and not w.isdigit()}
                        if parts <= NAMES | PLAIN:  # neither a modifier nor a word of the content
                            found |= NAMES.intersection(parts)
        return found

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCK
        if block:
            self._end_line()
            at = self.stack[-1][5]
            if self.stack[at][0] in CLOSED_BY.get(tag, ()):
                self._leave(at)
        self._tags += 1
        if tag in VOID:
            return
        _, element, noise, silent, mark, at = self.stack[-1]
        if block and tag != "p":
            self.parents.append(element)
            self.holder.append(tag if tag in HOLDERS else "")
            self.names.append(tag)
            element = len(self.parents) - 1
        if block or attrs:
            noise = noise or self._is_noise(tag, attrs)
        if (attrs or tag == "form") and not noise:
            found = self._named(tag, attrs)
            if found:
                self.outer.append(mark)
                self.talk.append(found <= DISCUSSION)
                self.soft.append(found <= TOPICS and tag in TEXTUAL and any(self.open[h] for h in HOLDERS))
                self.has_main.append(False)
                mark = len(self.outer) - 1
        if tag == "main" and not noise:
            self.has_main[mark] = True
        self.stack.append((tag, element, noise, silent or tag in SILENT, mark, len(self.stack) if block else at))
        self.open[tag] += 1

    def _leave(self, at: int) -> None:
        """Close the element at this place of the stack and all inside it."""
        for tag, *_ in self.stack[at:]:
            self.open[tag] -= 1
        del self.stack[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_line()
        self._tags += 1
        if self.open[tag] > 0:  # every step down the stack closes an element
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self._leave(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is boilerplate, and whether it is if it is of the lower cluster."""
        n, size = len(self.outer), np.array([len(t) for t in self.texts], float)
        held, lines, main = np.zeros(n), np.zeros(n, int), np.array(self.has_main)
        clean = 0.0                     # text of articles and mains that stands in no marked element
        inside = np.zeros(len(self.parents), bool)
        for e in range(1, len(self.parents)):
            inside[e] = inside[self.parents[e]] or bool(self.holder[e])
        for owner, noise, mark, chars in zip(self.owner, self.noise, self.mark, size):
            if not noise:
                held[mark] += chars
                lines[mark] += 1
                clean += chars if mark == 0 and inside[owner] else 0
        for m in range(n - 1, 0, -1):
            held[self.outer[m]] += held[m]
            lines[self.outer[m]] += lines[m]
            main[self.outer[m]] |= main[m]
        bad = np.zeros(n, bool)
        for m in range(1, n):
            share = DISCUSSION_SHARE if self.talk[m] else WRAPPER_SHARE
            wraps = main[m] or (lines[m] > 1 and held[m] > share * held[0] and clean < held[m] / 10)
            bad[m] = bad[self.outer[m]] or not (wraps or self.soft[m])
            self.soft[m] = self.soft[m] or self.soft[self.outer[m]]
        return (np.array([noise or bool(bad[mark]) for noise, mark in zip(self.noise, self.mark)]),
                np.array([self.soft[mark] for mark in self.mark]))

    def close(self) -> None:
        if self.rawdata.startswith("<!--"):  # a comment that never ends
            self.rawdata = ""
        super().close()

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][3]:
            self._text.append(data)
            if self.open["a"] > 0:
                self._links += len(" ".join(data.split()))


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at the ends and renormalised."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    pad = len(kernel) // 2
    return (np.convolve(x, kernel)[pad:pad + len(x)] / np.convolve(np.ones(len(x)), kernel)[pad:pad + len(x)])


def threshold(x: np.ndarray) -> float:
    """Border between the two clusters of x (two-means from the extremes)."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        border = (low + high) / 2
        upper = x >= border
        if upper.all() or not upper.any():
            return border
        now = float(x[~upper].mean()), float(x[upper].mean())
        if now == (low, high):
            return border
        low, high = now
    return border


def main_text(html: str) -> str:
    """Main text of one page; empty if there is none."""
    unfinished = _TAG.search(html, html.rfind(">") + 1)
    if unfinished:  # a tag that never ends is no text, and the parser would look for its end from each character
        html = html[:unfinished.start()]
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    if not parser.texts:
        return ""
    noise, soft = parser.settle()
    size = np.array([len(t) for t in parser.texts], float)
    if noise.all():
        return ""
    ratio = np.where(noise, 0.0, size / np.maximum(1, parser.tags))
    even = smooth(ratio)
    border = threshold(even)
    content = (even >= border) & (ratio >= border / 2) & ~noise  # a short line is not content for standing next to a long one
    if not content.any():
        content = ~noise & (ratio == ratio[~noise].max())
    region, marked, in_holder = _region(parser, content, size)
    inside = region[parser.owner] & ~noise
    core = np.flatnonzero(content & inside)
    kept = []
    for i in np.flatnonzero(inside).tolist():
        owner = parser.owner[i]
        if content[i]:
            kept.append(i)
        elif not soft[i] and len(core):
            if parser.names[owner] in ALL_HEADINGS and i < core[-1] or core[0] < i < core[-1]:
                kept.append(i)
            elif parser.linked[i] < LINKED_SHARE:
                while parser.names[owner] in PARTS:
                    owner = parser.parents[owner]
                if in_holder or marked[owner] > 0:  # shares its element with content
                    kept.append(i)
    return " ".join(parser.texts[i] for i in kept)


def _region(parser: Lines, content: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Whether each block element belongs to the content region, its characters of the upper cluster, and
    whether articles or a main make the region."""
    n = len(parser.parents)
    marked = np.zeros(n)            # characters of content lines in each element, children included
    for line in np.flatnonzero(content):
        marked[parser.owner[line]] += size[line]
    for e in range(n - 1, 0, -1):
        marked[parser.parents[e]] += marked[e]
    for holder in HOLDERS:
        top, inside = np.zeros(n, bool), np.zeros(n, bool)
        for e in range(1, n):
            above = inside[parser.parents[e]]
            inside[e] = above or parser.holder[e] == holder
            top[e] = parser.holder[e] == holder and not above and marked[e] > 0
        if marked[top].sum() >= marked[0] / 2:
            held = True
            break
    else:
        held = False
        top = np.zeros(n, bool)
        e = next(x for x in range(n - 1, -1, -1) if marked[x] == marked[0])  # children follow their parents: the innermost
        while parser.names[e] in PARTS:
            e = parser.parents[e]
        top[e] = True
        above, last = {}, e             # each element above e, and how far up
        while e > 0:
            e = parser.parents[e]
            above[e] = len(above)
        before = [c for c in range(1, last) if parser.names[c] in HEADINGS and parser.parents[c] in above and c not in above]
        if before:                      # the headings nearest to it
            near = min(above[parser.parents[c]] for c in before)
            top[[c for c in before if above[parser.parents[c]] == near]] = True
    region = top.copy()
    for e in range(1, n):
        region[e] |= region[parser.parents[e]]
    return region, marked, held


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``, in one pass without a shuffle.

    A null or empty html, or one of boilerplate alone, gives an empty text.
    Null ids and urls and repeated rows are kept; an empty table gives an
    empty result; other columns are not read.  Pages of any size are parsed
    whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
