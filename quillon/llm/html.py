"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level elements.  What stands in an element
that is side matter by its tag, role or class (footer, form, advert, comments
...) is left out; a form, or what a class names, only if it holds no more than
half of the text.  Every other block is decided by its text:

* Pass 1: link density, length and stop-word density make a block good, bad,
  nearly good, or ambiguous.
* Pass 2: ambiguous blocks take the label of their nearest decided neighbours in
  the smallest element around them that has any; nearly good ones are bad only
  between bad ones.  Where the neighbours of a short block differ, a heading goes
  with the text below it, and any other block with the nearer one (bad if both
  are as near).

``<article>`` or ``<main>`` add one thing: if most of the good text is in them,
the rest isn't part of the article.  On a page with no good block, stop words
don't tell its language, and long blocks without links are good; if nothing at
all is decided, short blocks are good (those in the article, if there is one).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Share of a block's characters in links above which it is bad.
LINKS = 0.33
#: Shorter blocks are ambiguous; longer ones with enough stop words are good.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.3
#: A named element with more of the page's text than this is no side matter.
SIDE_SHARE = 0.5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he his in is it its not of on or she that the their they this to was were which with you
    als am auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im in ist mit nach nicht noch sich sie sind um und von war wie wird zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous
    al como con de del el ella en era es esta este ha la las lo los más no o para pero por que se sin sobre son su sus un una y ya
    """.split()
)

# Elements by their role.
_BLOCK = frozenset(
    """
    address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td
    tfoot th thead title tr ul
    """.split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SIDE = frozenset("aside button dialog fieldset footer head menu nav optgroup option search select template title".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_NAMED = frozenset(
    """
    ad ads advert advertisement advertising adverts banner bottombar breadcrumb breadcrumbs comment comments consent cookie cookies copyright
    disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup
    privacy promo promotion promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe
    subscription toolbar topbar widget widgets
    """.split()
)
#: An opening tag of these ends an open element of the second kind.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_SCOPES = frozenset("article aside body dialog div dl footer form header html li main menu nav ol section table td th ul".split())

# Attributes of a tag: quotes may hold anything, the rest no tag.  Without a way back, and at most so
# many quotes: a tag whose quotes don't pair is given up soon, and ends at its first ``>``.
_QUOTED = r"[^>\"'<]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"'<]*+){0,200}+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?:svg|math)(?=[\s/>]){_QUOTED}(?<=/)>"  # self-closed: empty
    r"|<(script|style|noscript|textarea|template|svg|iframe|object|canvas|math|video|audio|xmp)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_QUOTED})>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """Text of one block and where it stood: ``box`` is the number of the element around it."""

    text: str
    links: int
    side: bool
    article: bool
    heading: bool
    name: int
    box: int
    label: str = ""


@dataclass
class _Open:
    tag: str
    side: bool = False
    article: bool = False
    link: bool = False
    heading: bool = False
    credits: bool = False
    name: int = 0
    box: int = 0


@dataclass
class Page:
    """Blocks with text in page order, and the elements around them."""

    blocks: list[Block]
    #: For each element: the one around it, and the blocks in it as a range.
    around: list[int]
    first: list[int]
    end: list[int]
    #: For each element that is named like side matter: the named one around it.
    named: list[int]
    #: Whether a named element is in the article.
    within: list[bool]


def _attributes(raw: str) -> dict[str, str]:
    return {n.lower(): html.unescape(a or b or c or "") for n, a, b, c in _ATTRIBUTE.findall(raw)}


class _Stack:
    """Open elements; finds the last open one of a tag without a search."""

    def __init__(self) -> None:
        self.open = [_Open("")]
        self._at: dict[str, list[int]] = {}
        self._scopes = [0]

    def push(self, element: _Open) -> None:
        self._at.setdefault(element.tag, []).append(len(self.open))
        if element.tag in _SCOPES:
            self._scopes.append(len(self.open))
        self.open.append(element)

    def last(self, tags: set[str]) -> int:
        """Place of the last open element of these tags; 0 if there is none."""
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=0)

    def scope(self) -> int:
        return self._scopes[-1]

    def drop(self, place: int) -> list[_Open]:
        """Close all elements from ``place`` on."""
        gone = self.open[place:]
        del self.open[place:]
        for e in gone:
            self._at[e.tag].pop()
        while self._scopes[-1] >= place:
            self._scopes.pop()
        return gone


def read_page(page: str) -> Page:
    """Blocks of a page, in time proportional to its length."""
    out = Page([], [0], [0], [0], [0], [False])
    stack = _Stack()
    text: list[str] = []
    links = 0
    breaks = 0

    def end_block() -> None:
        nonlocal text, links, breaks
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            at = stack.open[-1]
            out.blocks.append(Block(joined, min(links, len(joined)), at.side or at.credits and not at.heading, at.article, at.heading, at.name, at.box))
        text, links, breaks = [], 0, 0

    def close(place: int) -> None:
        for e in stack.drop(place):
            if e.tag in _BLOCK:
                out.end[e.box] = len(out.blocks)

    def said(piece: str) -> None:
        nonlocal links, breaks
        if piece:
            text.append(piece)
            if not piece.isspace():
                breaks = 0
                if stack.open[-1].link:
                    links += len(" ".join(html.unescape(piece).split()))

    at = 0
    for m in _TOKEN.finditer(page):
        said(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            place = stack.last({tag})
            if place:
                if tag in _BLOCK:
                    end_block()
                close(place)
            continue
        if tag == "br":
            breaks += 1
            text.append(" ")
            if breaks > 1:
                end_block()
            continue
        if tag in _BLOCK:
            end_block()
            place = stack.last(_ENDS.get(tag, {"p"}))
            if place and place >= stack.scope():
                close(place)
        if tag in _VOID:
            continue
        up = stack.open[-1]
        new = _Open(tag, up.side, up.article, up.link or tag == "a", up.heading, up.credits, up.name, up.box)
        if tag in _BLOCK:
            new.box = len(out.around)
            out.around.append(up.box)
            out.first.append(len(out.blocks))
            out.end.append(-1)
        if tag in ("article", "main"):
            new.article = True
        if tag in _SIDE or tag == "header" and not up.article:
            new.side = True
        if tag == "header" and up.article:
            new.credits = True  # an article's own header: only its headings are text
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            new.heading = True
        named = tag == "form"  # side matter, but for one that holds most of the page
        if m[4].strip():
            attributes = _attributes(m[4])
            if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
                new.side = True
            if tag not in ("html", "body", "main", "a") and tag in _BLOCK | {"span", "ins"}:
                parts = _NAME_PARTS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")
                if _NAMED.intersection(p.lower() for p in parts) and not (tag == "article" and not up.article):
                    named = True
        if named:
            new.name = len(out.named)
            out.named.append(up.name)
            out.within.append(new.article)
        stack.push(new)
    said(page[at:])
    end_block()
    out.end = [len(out.blocks) if e < 0 else e for e in out.end]
    out.end[0] = len(out.blocks)
    return out


def first_label(b: Block) -> str:
    """Pass 1: good, bad, near (nearly good), long or short (ambiguous)."""
    if b.links > LINKS * len(b.text):
        return "bad"
    if len(b.text) < SHORT:
        return "short"
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if stops >= STOPS_HIGH:
        return "good" if len(b.text) > LONG else "near"
    return "near" if stops >= STOPS_LOW else "long"


def _inherit(page: Page, blocks: list[int], kinds: tuple[str, ...]) -> None:
    """Pass 2 for the blocks with these labels, from the neighbours that are decided."""
    n = len(page.blocks)
    label = [b.label for b in page.blocks]
    decided = np.zeros(n + 1, dtype=np.int64)
    before, after = np.full(n, -1), np.full(n, n)
    last = -1
    for i in blocks:
        before[i] = last
        if label[i] in ("good", "bad"):
            last = i
            decided[i + 1] = 1
    last = n
    for i in reversed(blocks):
        after[i] = last
        if label[i] in ("good", "bad"):
            last = i
    known = np.cumsum(decided)
    articles = any(page.blocks[i].article for i in blocks)
    # The smallest element around each one that has a decided block.
    around = list(range(len(page.around)))
    for e in range(1, len(around)):
        if known[page.end[e]] == known[page.first[e]]:
            around[e] = around[page.around[e]]
    for i in blocks:
        b = page.blocks[i]
        if label[i] not in kinds:
            continue
        e = around[b.box]
        left = label[before[i]] if before[i] >= page.first[e] else ""
        right = label[after[i]] if after[i] < page.end[e] else ""
        if label[i] == "near":
            b.label = "bad" if left == right == "bad" else "good"
        elif left == right or not (left and right):
            b.label = left or right or ("good" if b.article or not articles else "bad")
        elif b.heading:
            b.label = right
        else:
            nearer = left if i - before[i] < after[i] - i else right if i - before[i] > after[i] - i else "bad"
            b.label = nearer


def classify(page: Page) -> None:
    """Set every block's label to good or bad."""
    amount = [0] * len(page.named)
    for b in page.blocks:
        amount[b.name] += len(b.text)
    for k in range(len(amount) - 1, 0, -1):
        amount[page.named[k]] += amount[k]
    total = sum(len(b.text) for b in page.blocks if not b.side)
    side = [False] * len(amount)
    plain = any(b.article and not b.side and not b.name for b in page.blocks)
    for k in range(1, len(amount)):  # what holds most of a page's text is no side matter, whatever its name, unless the article is elsewhere
        side[k] = plain and not page.within[k] or side[page.named[k]] or amount[k] <= SIDE_SHARE * total
    inside = []  # side matter is no neighbour: what stands around it is text or not by itself
    for i, b in enumerate(page.blocks):
        if b.side or side[b.name]:
            b.label = "bad"
        else:
            b.label = first_label(b)
            inside.append(i)
    first = {i: page.blocks[i].label for i in inside}
    if not any(x in ("good", "near") for x in first.values()):
        for i in inside:
            if first[i] == "long":
                page.blocks[i].label = "good"
    _inherit(page, inside, ("near",))  # what nearly was decided counts as decided for the others
    _inherit(page, inside, ("short", "long"))
    good = [page.blocks[i] for i in inside if page.blocks[i].label == "good"]
    size = sum(len(b.text) for b in good)
    if 2 * sum(len(b.text) for b in good if b.article) > size:
        for b in good:
            if not b.article:
                b.label = "bad"


def main_text(page: str | None) -> str:
    """The good blocks of a page, joined by newlines; empty for a null page."""
    read = read_page(page or "")
    classify(read)
    return "\n".join(b.text for b in read.blocks if b.label == "good")


_TEXTS = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("html").cast(pa.binary()).to_pylist()
        texts = [main_text(p.decode("utf-8", "replace")) if p else "" for p in pages]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages`` (page_id, url, html).

    A null, empty or text-free html gives the empty text; null ids and urls
    stay.  Each page is handled by itself: repeated rows give equal rows, and
    an empty table an empty result.  Nothing is shuffled.
    """
    small_batches(pages.sparkSession, 128)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, _TEXTS)
