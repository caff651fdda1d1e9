"""Main text of HTML pages by line-block distribution.

The page is read into lines: one for every block-level element's own text, with mark-up stripped, references decoded
and white space folded. Lines of elements that never hold an article (menus, headers outside it, footers, asides,
forms, scripts, notices, adverts, reader comments) are struck. Over the lines that remain, text lengths are summed in
sliding windows; the text begins where the sum surges above the threshold and is followed by more, and ends where it
dives. On a page where no sum passes the threshold, half of the largest sum is the threshold, and lines before the
surge that are shorter than a line's share of it are left to the mending of edges. What stands between the
surge and the dive is kept. Elements only mend the two edges, and only outwards, so that short first and last blocks
stay: while the line before the surge, or after the dive, stands in the same article (or main) as nine tenths of the
text found, or without one in the smallest container of all of it, the edge moves over it. A block quotation is no
container, nor is a table cell of one line.

An element is struck by its class, id or role if one of their names consists of marks (``MARKS``) and neutral words
(``NEUTRAL``) only: ``cookie-notice`` and ``comment-list`` are, ``ad-free`` and ``related-work`` are not.

Defined results: a null or empty page, or one without text, gives the empty string; unclosed elements end with their
parents, or with the page, which is a container too; of nested articles the outermost counts; nothing within the
article is dropped or cut; time and memory grow with the page's length, however deep it nests; extra columns are
ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import bounded_batches

#: Lines in a sliding window, and the text length at which a window's sum counts as a surge.
WINDOW, SURGE = 3, 86
# HTML element names by their role.
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div body td".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template iframe object svg canvas select textarea button form nav aside footer head menu dialog".split())
#: Marks of elements that are no article: whole words of class, id and role values.
MARKS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer form masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words that neither mark an element nor clear it, beside single letters and numbers.
NEUTRAL = frozenset("area article articles bar block body bottom box button buttons column container content footer head header icons inner item items left links list main menu middle outer page post posts right row section site slot text top unit wrap wrapper zone".split())
_NAME = re.compile(r"[^\s]+")
_WORD = re.compile(r"[a-z]{2,}")
CLOSED_BY = {"p": frozenset(BLOCKS - {"br"}), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


def marked(names: str) -> bool:
    for name in _NAME.findall(names.lower()):
        words = _WORD.findall(name)
        if not MARKS.isdisjoint(words) and all(w in MARKS or w in NEUTRAL for w in words):
            return True
    return False


class _Lines(HTMLParser):
    """Lines of (text, container), of elements that are not struck. Containers are numbers; 0 is the page."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        #: Of every container: the one around it, how deep it is, its tag, and its outermost article and main.
        self.parent, self.depth, self.tag, self.article, self.main = [-1], [0], ["page"], [-1], [-1]
        #: Open elements: tag, innermost container, struck.
        self.open: list[tuple[str, int, bool]] = []
        self.many: Counter = Counter()
        self.struck = 0
        self.parts: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text and not self.struck:
            self.lines.append((text, self.open[-1][1] if self.open else 0))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self._close(len(self.open) - 1)
        if tag in BLOCKS:
            self.flush()
        if tag in EMPTY:
            return
        struck = tag in NEVER or (tag == "header" and not self.many["article"] and not self.many["main"])
        if not struck and tag not in ("html", "body", "article", "main"):
            struck = marked(" ".join((v or "") for k, v in attrs if k in ("class", "id", "role")))
        if struck:
            self.flush()
            self.struck += 1
        inside = self.open[-1][1] if self.open else 0
        if tag in CONTAINERS:
            made = len(self.parent)
            self.parent.append(inside)
            self.depth.append(self.depth[inside] + 1)
            self.tag.append(tag)
            self.article.append(self.article[inside] if self.article[inside] >= 0 else made if tag == "article" else -1)
            self.main.append(self.main[inside] if self.main[inside] >= 0 else made if tag == "main" else -1)
            inside = made
        self.many[tag] += 1
        self.open.append((tag, inside, struck))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def _close(self, at: int) -> None:
        if any(t in BLOCKS or s for t, _, s in self.open[at:]):
            self.flush()
        for tag, _, struck in self.open[at:]:
            self.struck -= struck
            self.many[tag] -= 1
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if self.many[tag]:
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            self._close(at)

    def handle_data(self, data: str) -> None:
        if not self.struck:
            self.parts.append(data)

    def common(self, a: int, b: int) -> int:
        """The smallest container of two."""
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return a

    def article_of(self, node: int) -> int:
        """The outermost article around, or else main, or -1."""
        return self.article[node] if self.article[node] >= 0 else self.main[node]

    def inside(self, node: int, holder: int) -> bool:
        while self.depth[node] > self.depth[holder]:
            node = self.parent[node]
        return node == holder


def lines_of(html: str) -> _Lines:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def surges(lengths: list[int]) -> list[tuple[int, int]]:
    """Runs of lines (end exclusive) from a surge to its dive, as window sums show them."""
    n = len(lengths)
    sums = [sum(lengths[i : i + WINDOW]) for i in range(n)]
    least = SURGE if max(sums) > SURGE else max(sums) // 2
    runs, at = [], 0
    while at < n:
        if sums[at] <= least:
            at += 1
            continue
        dive = at
        while dive < n and sums[dive] > least:
            dive += 1
        first = at
        while least < SURGE and first < dive - 1 and WINDOW * lengths[first] < least:
            first += 1
        runs.append((first, dive))
        at = dive
    return runs


def main_text(html: str | None) -> str:
    page = lines_of(html or "")
    lines = page.lines
    if not lines:
        return ""
    lengths = [len(t) for t, _ in lines]
    first, end = max(surges(lengths), key=lambda run: sum(lengths[run[0] : run[1]]))
    weight: Counter = Counter()
    for text, node in lines[first:end]:
        weight[page.article_of(node)] += len(text)
    holder, most = weight.most_common(1)[0]
    if holder < 0 or 10 * most < 9 * weight.total():
        holder = lines[first][1]
        for _, node in lines[first + 1 : end]:
            holder = page.common(holder, node)
        while page.tag[holder] == "td" and sum(page.inside(node, holder) for _, node in lines) == 1:
            holder = page.parent[holder]
    while first > 0 and page.inside(lines[first - 1][1], holder):
        first -= 1
    while end < len(lines) and page.inside(lines[end][1], holder):
        end += 1
    return "\n\n".join(text for text, _ in lines[first:end])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page; narrow, no shuffle."""
    bounded_batches(pages)

    def run(frames):
        for pdf in frames:
            text = [main_text(h if isinstance(h, str) else None) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = dict(pages.dtypes)["page_id"]
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
